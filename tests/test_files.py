"""Per-file operators on small cases worked out by hand."""

import ast

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codelode import lexicons as lx
from codelode.functions.python_source import module_structure
from codelode.operators import files as fl


def one(df):
    return df.collect()[0].asDict()


@pytest.mark.parametrize(
    "path, content, expected",
    [
        ("a.py", "a\n\n# c\n", (4, 1, 1, 2)),
        ("a.kt", "// c", (1, 1, 0, 0)),
        ("a.js", "/* x\n y\n */\n  // z\n\tcode()\r\n", (6, 2, 3, 1)),
        ("a.rb", "", (1, 0, 0, 1)),
        ("a.py", ' """doc\n \nx', (3, 1, 1, 1)),
        ("a.go", "*p = 1", (1, 0, 1, 0)),
    ],
)
def test_line_metrics(files, path, content, expected):
    row = one(fl.line_metrics(files({path: content})))
    assert (row["lines_total"], row["lines_code"], row["lines_comment"], row["lines_blank"]) == expected


def plain_line_kinds(content, language):
    prefixes = next((ps for ls, ps in lx.COMMENT_PREFIXES.items() if language in ls), [])
    kinds = [0, 0, 0]
    for line in content.split("\n"):
        bare = line.strip()
        kinds[0 if not bare else 1 if bare.startswith(tuple(prefixes)) else 2] += 1
    return tuple(kinds)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="a#/*\"' \t\n\r\x0b\x1c\x85  b", max_size=40), min_size=20, max_size=20))
def test_line_metrics_agree_with_line_by_line_counting(spark, texts):
    rows = [(i, f"f{i}{'.py' if i % 2 else '.js'}", t) for i, t in enumerate(texts)]
    found = fl.line_metrics(spark.createDataFrame(rows, "repo_id int, path string, content string")).collect()
    for r in found:
        expected = plain_line_kinds(texts[r.repo_id], r.language)
        assert (r.lines_blank, r.lines_comment, r.lines_code) == expected, texts[r.repo_id]
        assert r.lines_total == sum(expected)


def test_source_files_skip_by_component_not_by_glob(files):
    table = files({
        "src/a.py": "", "node_modules/b.py": "", "x.egg-info/c.py": "", "*.egg-info/d.py": "", "build": "", "a/build/e.py": "",
        "builder/f.PY": "", "README": "",
    })
    kept = {r.path for r in fl.collect_source_files(table).collect()}
    assert kept == {"src/a.py", "x.egg-info/c.py", "builder/f.PY"}


def test_exclude_paths_hidden_and_case(files):
    table = files({"A/Vendor/x": "", ".cfg/y": "", ".env": "", "a/b": ""})
    kept = {r.path for r in fl.exclude_paths(table, lx.DISCOVERY_SKIP, hidden_dirs=True, ignore_case=True).collect()}
    assert kept == {".env", "a/b"}


def test_languages(files):
    table = files({"a.scala": "", "b.R": "", "c.tsx": "", "d.": "", ".py": "", "e.tar.sh": ""})
    assert {r.path: r.language for r in fl.file_language(table).collect()} == {"a.scala": "Unknown", "c.tsx": "TypeScript"}
    wide = {r.path: r.language for r in fl.file_language_wide(table).collect()}
    assert wide == {"a.scala": "Scala", "b.R": "R", "c.tsx": "TypeScript", "e.tar.sh": "Shell"}


def test_js_imports_and_metrics(files):
    source = "import x from \"@scope/pkg\"\nconst a = require('./rel')\nconst b = require('lodash/fp')\nimport y from 'react'\n"
    table = files({"a.js": source + "const f = async (q) => {\n if (q) {} else while (q) {}\n}\nclass Ä {}\nnotif (x)"})
    names = [r.name for r in fl.js_imports(table).orderBy("import_pos").collect()]
    assert names == ["scope", "react", "lodash"]
    row = one(fl.js_metrics(table))
    assert (row["functions"], row["classes"], row["complexity"]) == (2, 1, 2)


def test_go_imports_take_first_block_then_single_lines(files):
    source = 'import (\n\t"fmt"\n\tg "github.com/gin-gonic/gin"\n)\nimport "os/exec"\nimport (\n"late"\n)\nfunc (s *S) Run() {\nif x { for {} }\n}\ntype T struct {}\n'
    table = files({"a.go": source})
    assert [r.name for r in fl.go_imports(table).orderBy("import_pos").collect()] == ["fmt", "gin", "exec"]
    row = one(fl.go_metrics(table))
    assert (row["functions"], row["classes"], row["complexity"]) == (1, 1, 2)


NESTED = '''
"""module text does not count"""
import os.path, sys
from . import sibling
from .pkg.mod import name
def outer():
    if a:
        pass
    def inner():
        """doc"""
        for x in y:
            pass
    return [i for i in range(3)]
async def later():
    async for z in q:
        pass
'''


def test_python_structure_counts_branches_per_enclosing_function(files):
    row = one(fl.python_metrics(files({"a.py": NESTED})))
    # outer: if, for (of inner), comprehension; inner: for; async for does not count
    assert (row["functions"], row["classes"], row["complexity"]) == (3, 0, 4)
    assert row["has_docstrings"] is True
    assert row["imports"] == ["os", "sys", "pkg"]
    assert row["avg_function_length"] == pytest.approx((8 + 4 + 3) / 3)


def by_walking(source):
    """The same counts by walking below every function."""
    branch = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.comprehension)
    functions = [n for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return len(functions), sum(isinstance(c, branch) for f in functions for c in ast.walk(f))


@pytest.mark.parametrize("module", [ast, pytest, F])
def test_python_structure_of_real_modules(module):
    with open(module.__file__, encoding="utf-8") as f:
        source = f.read()
    found = module_structure(source)
    assert (found[0], found[2]) == by_walking(source)


def test_python_that_does_not_parse_keeps_line_counts(files):
    row = one(fl.file_metrics(files({"a.py": "def (:\n# x\n"})))
    assert (row["functions"], row["complexity"], row["lines_comment"], row["imports"]) == (0, 0, 1, [])


@pytest.mark.parametrize(
    "path, content, expected",
    [
        ("tests/a.py", "", False), ("x/tests/a.py", "", True), ("src/latest_x.py", "", True), ("a.py", "assert x", True),
        ("a.py", "reassert\tx", True), ("a.py", "assertx", False), ("a.js", 'describe("x")', True), ("a.js", "describe(x)", False),
    ],
)
def test_is_test_file(files, path, content, expected):
    assert one(fl.is_test_file(files({path: content})))["has_tests"] is expected


def test_file_metrics_agree_with_single_operators(files):
    table = files({"a.py": NESTED, "b.js": "const f = async (x) => {\n if (x) {}\n}\nimport r from 'react'", "c.go": "func a() {\nif x {}\n}", "d.rs": "// c"})
    whole = {r.path: r for r in fl.file_metrics(table).collect()}
    for part in (fl.js_metrics(table), fl.go_metrics(table), fl.python_metrics(table).select("path", "functions", "classes", "complexity")):
        for r in part.collect():
            got = whole[r.path]
            assert (got.functions, got.classes, got.complexity) == (r.functions, r.classes, r.complexity)
    assert whole["d.rs"].imports == [] and whole["d.rs"].has_docstrings is False
