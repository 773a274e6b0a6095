"""Structure of Python sources from their syntax trees, in Arrow batches."""

import ast
import sys
from collections import deque

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# workers get this module's functions by value, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRUCTURE = T.StructType([
    T.StructField("functions", T.IntegerType()),
    T.StructField("classes", T.IntegerType()),
    T.StructField("complexity", T.IntegerType()),
    T.StructField("has_docstrings", T.BooleanType()),
    T.StructField("avg_function_length", T.DoubleType()),
    T.StructField("imports", T.ArrayType(T.StringType())),
])
_BRANCHES = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.comprehension)
# nothing that counts lies in them
_LEAVES = (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.alias, ast.Pass)


def _opens_with_text(node) -> bool:
    head = node.body[0] if node.body else None
    return isinstance(head, ast.Expr) and isinstance(head.value, ast.Constant) and isinstance(head.value.value, str)


def module_structure(source: str):
    """Structure counts of one module; None if it does not parse, be it for its syntax or for nesting beyond the parser.

    A worker that runs out of memory fails: that is no property of the text.
    A branch counts once for every function around it, hence the depth carried with each node.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    lengths, imports, classes, branches, documented = [], [], 0, 0, False
    pending = deque([(tree, 0)])
    while pending:
        node, depth = pending.popleft()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            depth += 1
            lengths.append(node.end_lineno - node.lineno + 1)
            documented = documented or _opens_with_text(node)
        elif isinstance(node, ast.ClassDef):
            classes += 1
            documented = documented or _opens_with_text(node)
        elif isinstance(node, ast.Import):
            imports += [alias.name.partition(".")[0] for alias in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            imports.append(node.module.partition(".")[0])
        elif isinstance(node, _BRANCHES):
            branches += depth
        for name in node._fields:
            value = getattr(node, name, None)
            for child in value if type(value) is list else (value,):
                if isinstance(child, ast.AST) and not isinstance(child, _LEAVES):
                    pending.append((child, depth))
    mean = sum(lengths) / len(lengths) if lengths else 0.0
    return len(lengths), classes, branches, documented, mean, imports


def _batch_structure(source: pd.Series) -> pd.DataFrame:
    empty = (0, 0, 0, False, 0.0, [])
    rows = [(module_structure(s) if s is not None else None) or empty for s in source]
    return pd.DataFrame(rows, columns=STRUCTURE.names)


python_structure = F.pandas_udf(_batch_structure, STRUCTURE)
