"""Rules as rows: a join of texts with a table of patterns by the rarest run of each pattern.

The rows are (kind, rule_pos, rule, pattern_pos, pattern), as ``rules.rule_rows`` makes them of lexicons; any number of further rows
may come from anywhere. No rule travels in a function: texts meet patterns by equal grams, and are then checked.
"""

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from codelode.functions.grams import LONG, PLACES, SHARED, SHORT_CODES, SIZE, required, wanted_grams
from codelode.functions.lexicon_scan import FOLDED, FOUND
from codelode.functions.text import literal_text
from codelode.operators.ranking import spread_join
from codelode.operators.rules import in_scope
from codelode.sources.shared import write_shared

# workers get this module's functions by value, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVERY = -1  # the gram of patterns that hold no run of three ASCII characters
KEYED = "pattern string, gram int"
HELD = "id long, gram int"
SHARE = 1 << 12  # patterns that are checked beside one copy of a text


def needed_grams(pattern: str) -> list[int]:
    """Grams that every match holds, long ones if any is certain; ``EVERY`` alone if none is.

    Names that differ in a number share all their short grams with many others, whose texts would all meet them.
    """
    for size in (LONG, SIZE):
        formula = required(pattern, size)
        parts = [formula] if formula is None or isinstance(formula, int) or formula[0] == "or" else formula[1]
        if found := sorted({p for p in parts if isinstance(p, int)}):
            return found
    return [EVERY]


def _pattern_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(pattern, gram) for pattern in batch.column(0).to_pylist() for gram in needed_grams(pattern)]
        columns = zip(*rows) if rows else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32()))], names=["pattern", "gram"])


def _held(wanted: bytes):
    """Grams of texts among the wanted ones: a set of all codes in six megabytes, whatever the number of rules."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(np.frombuffer(wanted, np.uint8)).view(bool)
        for batch in batches:
            ids, grams = [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = wanted_grams(text.as_py() or "", mask)
                ids.append(np.full(len(codes), row, np.int64))
                grams.append(codes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(ids) if ids else [], pa.int64()), pa.array(np.concatenate(grams) if grams else [], pa.int32())], names=["id", "gram"]
            )

    return rows


@lru_cache(4096)
def _compiled(pattern: str):
    return re.compile(pattern)


@lru_cache(1 << 14)
def _literal(pattern: str):
    return literal_text(pattern)


def _count(pattern: str, body: str) -> int:
    word = _literal(pattern)
    return body.count(word) if word is not None else sum(1 for _ in _compiled(pattern).finditer(body))


def _check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def one(body, patterns):
        low = body.lower()
        folded = body.translate(FOLDED).lower() if any(chr(c) in body for c in FOLDED) else low
        found = []
        for pattern in sorted(patterns):
            n = _count(pattern, low)
            also = n if folded == low else _count(pattern, folded)
            if n or also:
                found.append({"pattern": pattern, "n": n, "any_case": also > 0})
        return found

    for bodies, patterns in batches:
        yield pd.Series([one(b, p) for b, p in zip(bodies, patterns)], dtype=object)


def rule_table_hits(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules.file_rule_hits`` for a table of rules: matches per (file, pattern), with the same columns and counts.

    Patterns are lowercase, as in lexicons. Of the grams that all matches of a pattern hold, the one that fewest texts hold
    stands for it, so a text meets only patterns whose rarest gram it holds, by an equal join; then the patterns themselves are run.
    Each distinct text is looked at once. A text that meets many patterns is checked in shares of 4,096. Patterns with
    no run of three ASCII characters meet every text, which nothing cheaper could rule out.

    A null or empty pattern, and one that is no valid expression, fails the query rather than matching nothing.
    """
    scope = write_shared(in_scope(files).filter("content IS NOT NULL").withColumn("digest", F.sha2("content", 256)), "rule-scope")
    texts = scope.groupBy("digest").agg(F.first("content").alias("content")).withColumn("id", F.monotonically_increasing_id())
    texts = write_shared(texts, "rule-texts")
    given = rules.select("pattern").distinct().withColumn("pattern", F.when(F.length("pattern") > 0, F.col("pattern")).otherwise(F.raise_error(F.lit("empty pattern"))))
    keyed = write_shared(given.mapInArrow(_pattern_grams, KEYED), "rule-grams")
    held = write_shared(texts.select("id", "content").mapInArrow(_held(_wanted(keyed)), HELD), "rule-held")
    spread = held.groupBy("gram").agg(F.count("*").alias("texts"))
    # a gram that no text holds is rarest of all; its pattern then meets nothing
    rarest = keyed.join(spread, "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("best"))
    chosen = write_shared(rarest.select("pattern", F.col("best.gram").alias("gram")), "rule-chosen")
    met = held.join(chosen, "gram").select("id", "pattern")
    always = chosen.filter(F.col("gram") == EVERY).select("pattern", F.lit(0).alias("__one"))
    met = met.unionByName(spread_join(texts.select("id", F.lit(0).alias("__one")), always, "__one", ["id"]).select("id", "pattern"))
    share = F.pmod(F.xxhash64("pattern"), F.lit(1 << 30))
    checked = F.pandas_udf(_check, FOUND)
    shared = met.groupBy("id", F.floor(share / (1 << 30) * _shares(chosen)).alias("share")).agg(F.collect_set("pattern").alias("patterns"))
    found = shared.join(texts, "id").select("digest", F.inline(checked("content", "patterns")))
    return scope.drop("content").join(found, "digest").select(
        "repo_id", "path", "pattern", "n", (F.col("corpus") & (F.col("n") > 0)).alias("in_corpus"), (F.col("evidence") & F.col("any_case")).alias("in_evidence")
    ).filter("in_corpus OR in_evidence")


def _wanted(keyed: DataFrame) -> bytes:
    """A bit for each place of a gram's code, the first one highest: gathered as words of 32 bits, of which there are 1.5 million at most."""
    place = F.when(F.col("gram") < SHORT_CODES, F.col("gram")).otherwise(SHORT_CODES + F.shiftright(F.col("gram") - SHORT_CODES, SHARED))
    places = keyed.filter(F.col("gram") != EVERY).select(place.alias("place"))
    words = places.groupBy(F.shiftright("place", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, 31 - place % 32)")).alias("bits")).toArrow()
    wanted = np.zeros(PLACES // 32, ">u4")
    wanted[words["word"].to_numpy()] = words["bits"].to_numpy()
    return wanted.tobytes()


def _shares(chosen: DataFrame) -> int:
    return max(1, -(-chosen.count() // SHARE))
