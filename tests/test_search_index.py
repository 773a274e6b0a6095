"""The search index and rules as rows, against scans of all texts."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codelode.functions import grams
from codelode.operators import rule_tables, rules, search, search_index
from tests.conftest import FILES

WORDS = "import export Stripe stripe charge async await range router post gem rails İstanbul ſhort Kelvin ıce straße naïve the on of".split()


def many_files(n=120):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        body = "\n".join(" ".join(rng.choices(WORDS, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 12)))
        rows.append((i % 3, f"src/m{i}.py", body))
    rows += [(0, "same/a.py", "gem rails once"), (1, "same/b.py", "gem rails once"), (2, "node_modules/x.js", "gem rails"), (0, "i.png", "gem"), (1, "e.txt", ""), (1, "n.txt", None)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(many_files(), FILES)


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    return search_index.build_index(table, str(tmp_path_factory.mktemp("index")), 8)


PATTERNS = [
    "stripe", "STRIPE", r"\bgem\s+rails", "async|range|the on", "a|b", "^$", r"^import.*export$", "istanbul", "short", "kelvin", "ice", "stra(ß|ss)e", "na.ve",
    "(router|post)s?", "(?:gem|post) rails", "(?P<w>gem) rails", "(?=gem)gem", "gem{1}", "ge?m", "(gem )?rails", "(gem )+rails", "nowhere at all", "x*", "[g]em", r"\x67em", "g", "", "(",
    "Gem Rails|", "(gem|) rails", "await{0,2}", r"the\x20on", "gem\nrails",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_the_index_finds_what_a_scan_finds(table, index, pattern):
    for k in (50, 3):
        found = search_index.search_index(index, pattern, k).collect()
        assert sorted(map(str, found)) == sorted(map(str, search.search_code(table, pattern, k).collect()))


def test_a_selective_pattern_reads_few_texts(spark, tmp_path):
    rows = [(1, f"f{i}.py", f"plain text number {i}") for i in range(300)] + [(1, "needle.py", "the haystack needle lies here")]
    index = search_index.build_index(spark.createDataFrame(rows, FILES), str(tmp_path / "index"), 64)
    query = search_index.search_index(index, "hay.*needle")
    assert [r.path for r in query.collect()] == ["needle.py"]
    plan = query._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[digest[^\n]*content[^\n]*", plan)
    assert scans and all(re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", s) for s in scans), plan
    assert search_index.candidates(index, "plain.*7").count() < 301
    assert search_index.candidates(index, "[ab].") is None


def test_versions_share_texts(spark, tmp_path):
    first = [(1, "a.py", "alpha beta"), (1, "b.py", "gamma")]
    index = search_index.build_index(spark.createDataFrame(first, FILES), str(tmp_path / "index"), 4)
    second = [(1, "b.py", "gamma"), (2, "c.py", "alpha beta"), (2, "d.py", "delta alpha")]
    index.add(spark.createDataFrame(second, FILES))
    assert index.texts().count() == 3  # what was there already is not kept twice
    assert sorted((r.repo_id, r.path) for r in search_index.search_index(index, "alpha").collect()) == [(2, "c.py"), (2, "d.py")]
    index.add(spark.createDataFrame([], FILES))
    assert search_index.search_index(index, "alpha").collect() == []


@given(st.text(alphabet="abAB İıſß\n", max_size=30), st.sampled_from(["aba", "BAB b", "a+b", "(ab|ba)a", "ab?a", "aab|bba"]))
@settings(max_examples=300, deadline=None)
def test_grams_never_rule_out_a_match(text, pattern):
    def holds(formula, have):
        if formula is None or isinstance(formula, int):
            return formula is None or formula in have
        return (all if formula[0] == "and" else any)(holds(p, have) for p in formula[1])

    if re.search(pattern, text, re.I):
        assert holds(grams.required(pattern), set(grams.text_grams(text).tolist()))


def test_long_texts_are_cut_in_pieces(monkeypatch):
    text = "abcdefghij" * 50 + "needle"
    whole = grams.text_grams(text).tolist()
    monkeypatch.setattr(grams, "PIECE", 7)
    assert grams.text_grams(text).tolist() == whole and grams.text_grams("").tolist() == [] == grams.text_grams("ab").tolist()


# --- rules as rows -----------------------------------------------------------------------------------------------------------------------


RULES = "kind string, rule_pos int, rule string, pattern_pos int, pattern string"


def test_a_table_of_rules_counts_like_the_lexicons(spark, table):
    texts = [r[2] for r in many_files()]
    rows = [(1, f"app/{i}.py", f"{t} Stripe checkout oauth login kubernetes rate-limit CI/CD shard") for i, t in enumerate(texts) if t is not None]
    rows += [(2, "README.md", "machine learning with s3 upload, real-time websocket; İstanbul"), (2, "x.py", "ſtripe and ſ3"), (3, "e.py", "")]
    files = spark.createDataFrame(rows, FILES)
    expected = sorted(map(tuple, rules.file_rule_hits(files).collect()))
    found = rule_tables.rule_table_hits(files, rules.rule_rows(spark))
    assert sorted(map(tuple, found.select("repo_id", "path", "pattern", "n", "in_corpus", "in_evidence").collect())) == expected
    assert expected


def test_all_detectors_honour_appended_rows(spark, files, repos):
    own = spark.createDataFrame([
        ("feature", 900, "zebra", 0, "zebra"), ("integration", 900, "Acme", 0, r"acme\s+corp"), ("scale", 900, "huge", 0, "ab"), ("domain", 900, "zoo", 0, "zebra|giraffe"),
    ], RULES)
    table, given = files({"a.py": "Zebra " * 9 + "ACME  corp ab", "b.txt": "zebra"}), rules.rule_rows(spark).union(own)
    hits = rule_tables.rule_table_hits(table, given)
    found = rules.detect_features(hits, lexicons=given)
    assert [(r.feature, r.title, r.hits) for r in found.collect()] == [("zebra", "zebra", 9)]
    assert [r.path for r in rules.feature_evidence(hits, found, lexicons=given).orderBy("position").collect()] == ["a.py", "b.txt"]
    assert [(r.integration, r.pattern) for r in rules.detect_integrations(hits, given).collect()] == [("Acme", r"acme\s+corp")]
    assert "huge" in {r.indicator for r in rules.scale_indicators(hits, given).collect()}
    assert rules.detect_domain(hits, repos(), lexicons=given).first().domain == "zoo"


def test_many_rules(spark, files):
    many = spark.range(100_000).select(
        F.lit("integration").alias("kind"), F.col("id").cast("int").alias("rule_pos"), F.concat(F.lit("r"), "id").alias("rule"), F.lit(0).alias("pattern_pos"),
        F.concat(F.lit("vendor"), F.col("id").cast("string"), F.lit("x")).alias("pattern"),
    )
    table = files({"a.py": "uses Vendor77x and vendor99999x", "b.py": "nothing of that kind", "c.py": "vendor5x " * 3})
    hits = rule_tables.rule_table_hits(table, many)
    assert sorted((r.path, r.pattern, r.n) for r in hits.collect()) == [("a.py", "vendor77x", 1), ("a.py", "vendor99999x", 1), ("c.py", "vendor5x", 3)]
    assert {r.integration for r in rules.detect_integrations(hits, many).collect()} == {"r5", "r77", "r99999"}


def test_names_that_differ_in_a_number_meet_their_own_texts(spark, files, monkeypatch):
    """A name's text holds the short grams of many other names; only long ones keep the others' patterns away from it."""
    names = [f"supplier {i:09d}" for i in range(300)]
    given = spark.createDataFrame([("integration", i, n, 0, n) for i, n in enumerate(names)], RULES)
    table = files({f"a{i}.py": f"# {n.title()}\n" + "ſupply " for i, n in enumerate(names)})
    looked, held = [], {}
    for i, name in enumerate(names):
        for code in rule_tables.needed_grams(name):
            held.setdefault(code, []).append(i)
    for i, name in enumerate(names):
        looked.append(min(len(held[code]) for code in rule_tables.needed_grams(name)))
    assert max(looked) <= 11  # its own and ten that go on with one more digit; three bytes of a number are in dozens
    hits = rule_tables.rule_table_hits(table, given)
    assert sorted((r.path, r.pattern, r.n) for r in hits.collect()) == sorted((f"a{i}.py", n, 1) for i, n in enumerate(names))


def test_codes_of_texts_hold_those_of_patterns():
    """Whatever stands before or after a run, in either case and across the pieces of a long text."""
    every = np.ones(grams.PLACES, bool)
    for run in ("abc", "payments", "İstanbul pay", "x" * 40, "Kelvin\u212aelvin"):
        for text in (run, f"é{run.upper()}é", "y" * (grams.PIECE - 3) + run):
            codes = set(grams.wanted_grams(text, every).tolist())
            for size in (grams.SIZE, grams.LONG):
                assert set(grams.run_grams(run, size)) <= codes or not run.isascii()
    assert not len(grams.wanted_grams("ab", every)) and not len(grams.wanted_grams("abcdefghij", ~every))


def test_empty_and_broken_rules_fail(spark, files):
    for pattern in ("", None, "("):
        with pytest.raises(Exception):
            rule_tables.rule_table_hits(files({"a.py": "x"}), spark.createDataFrame([("scale", 0, "r", 0, pattern)], RULES)).collect()
    assert rule_tables.rule_table_hits(files({"a.py": "x"}), spark.createDataFrame([], RULES)).count() == 0


def test_postings_name_many_texts_by_four_bytes_each(spark, table, index):
    postings = index.postings()
    assert "digest" not in postings.columns and dict(postings.dtypes)["ids"] == "array<int>"
    wanted = sum(len(grams.text_grams(r.content)) for r in index.texts().collect())
    assert postings.agg(F.sum(F.size("ids"))).collect()[0][0] == wanted > postings.count()
