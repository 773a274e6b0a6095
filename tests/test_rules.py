"""Lexicon scans, features, domains, frameworks, endpoints."""

import re

from hypothesis import given, settings, strategies as st

from codelode import lexicons as lx
from codelode.functions import lexicon_scan, text
from codelode.operators import repo as rp, rules

ALL_PATTERNS = sorted({p for lexicon in rules.HIGHLIGHT_LEXICONS.values() for ps in lexicon.values() for p in ps})


def finder(patterns):
    plain = {p: w for p in patterns if (w := text.literal_text(p)) is not None}
    return lexicon_scan.pattern_finder(plain, {p: text.required_texts(p) for p in patterns if p not in plain})


PIECES = ["auth", "oauth0", "seses", "rate limit", "rate-limit", "live \n update", "socket.io", "socketxio", "s3", "gpt-4", " ", "x", "transactional", "optimiz"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_one_pass_counts_equal_findall(body):
    expected = {p: n for p in ALL_PATTERNS if (n := len(re.findall(p, body)))}
    assert dict(finder(ALL_PATTERNS)(body)) == expected


def test_required_texts_hold_in_every_match():
    assert text.required_texts(r"rate.?limit") == ["rate", "limit"]
    assert text.required_texts(r"colou?rs") == ["colo", "rs"]
    assert text.required_texts(r"a|bc") == []
    assert text.required_texts(r"live\s*update") == ["live", "update"]
    assert text.literal_text(r"socket\.io") == "socket.io"
    assert text.literal_text(r"google.cloud") is None


def test_finder_without_the_automaton_library(monkeypatch):
    monkeypatch.setitem(__import__("sys").modules, "ahocorasick", None)
    assert dict(lexicon_scan.word_finder(["ses", "s"])("seses")) == {"ses": 1, "s": 3}


def features(files, n):
    hits = rules.file_rule_hits(files({"a.py": "kubernetes " * n}))
    return rules.detect_features(hits).collect()


def test_feature_threshold_and_confidence(files):
    assert features(files, 2) == []
    assert [(r.feature, r.confidence) for r in features(files, 3)] == [("ci_cd", 0.15)]
    assert [(r.feature, r.confidence) for r in features(files, 40)] == [("ci_cd", 1.0)]


def test_domain_needs_five_matches_and_prefers_the_first_listed(files, repos):
    def domain(body):
        return rules.detect_domain(rules.file_rule_hits(files({"a.rb": body})), repos()).collect()[0].domain

    assert domain("hotel " * 4) == ""
    assert domain("hotel " * 5) == "travel"
    assert domain("order " * 6) == "e-commerce"  # also a food word; e-commerce is listed first


def test_evidence_ignores_case_in_ways_lowercase_text_does_not(files):
    table = files({"a.py": "kubernetes " * 3, "docs/k.md": "KUBERNETEſ", "node_modules/z.js": "kubernetes", "docs/i.md": "nothing"})
    hits = rules.file_rule_hits(table)
    evidence = rules.feature_evidence(hits, rules.detect_features(hits)).orderBy("position").collect()
    assert [r.path for r in evidence] == ["a.py", "docs/k.md"]


def test_evidence_order_is_pattern_then_file_without_repeats(files):
    table = files({"b.py": "docker helm docker", "a.py": "helm", "c.py": "jenkins"})
    hits = rules.file_rule_hits(table)
    evidence = rules.feature_evidence(hits, rules.detect_features(hits)).orderBy("position").collect()
    assert [r.path for r in evidence] == ["c.py", "b.py", "a.py"]


def test_integration_takes_its_first_matching_pattern(files):
    hits = rules.file_rule_hits(files({"a.py": "pk_live sk_live", "b.py": "sk_live"}))
    found = {r.integration: r.pattern for r in rules.detect_integrations(hits).collect()}
    assert found == {"Stripe": "sk_live"}
    evidence = rules.integration_evidence(hits, rules.detect_integrations(hits)).collect()
    assert [(r.position, r.path) for r in sorted(evidence)] == [(1, "a.py"), (2, "b.py")]


def test_corpus_limits_and_order(files):
    table = files({"b/x.py": "12345", "a.py": "123", "README.md": "long text", "package.json": "{}", "c.md": "no", "dist/d.py": "no"})
    rows = sorted((r.part, r.position, r.path, r.content) for r in rules.build_corpus(table, 1, 2).collect())
    assert rows == [(0, 1, "package.json", "{}"), (0, 10, "README.md", "long text"), (1, 1, "a.py", "12")]
    assert rules.build_corpus(table).filter("part = 1").count() == 2


def test_framework_detection(files):
    table = files({
        "a.py": "FROM Django import x", "node_modules/b.js": "createapp(", "c.rb": "Rails.x", "d.ts": "q.svelte", "e.ts": "x\nz.svelte\n",
        "package.json": "@prisma/client",
    })
    found = sorted((r.rule_pos, r.framework) for r in rules.detect_frameworks(table).collect())
    assert [f for _, f in found] == ["Django", "Vue", "Svelte", "Prisma"]
    only_first = [r.framework for r in rules.detect_frameworks(table, n=1).collect()]
    assert sorted(only_first) == ["Django", "Prisma"]


def test_every_framework_pattern_agrees_with_ignore_case_search():
    patterns = [p for ps in lx.FRAMEWORKS.values() for p in ps]
    counts = finder([p.lower() for p in patterns])
    body = "Import REACT\nfrom 'react'\nFlask(__name__)\n<SCRIPT lang='x'>\nrequire(\"express\"\nit(\nlib.svelte\n"
    found = counts(body.lower())
    for p in patterns:
        assert (p.lower() in found) == bool(re.search(p, body, re.IGNORECASE)), p


def test_endpoints_are_gated_and_deduplicated(files, spark):
    table = files({
        "b.py": '@app.get("/a")\n@app.get("/a")\n@app.route("/r")', "a.js": "router.post('/p', f)\napp.get('/a')", "c.ts": "x.get('/no')",
    })
    endpoints = rp.endpoint_rows(table)
    no_frameworks = spark.createDataFrame([], "repo_id int, framework string, rule_pos int")
    rows = rp.api_endpoints(endpoints, no_frameworks).orderBy("position").collect()
    assert [(r.method, r.route, r.path) for r in rows] == [("GET", "/a", "b.py"), ("ROUTE", "/r", "b.py"), ("POST", "/p", "a.js")]
    flask = spark.createDataFrame([(1, "Flask", 1)], "repo_id int, framework string, rule_pos int")
    rows = rp.api_endpoints(endpoints, flask).orderBy("position").collect()
    assert [(r.method, r.route) for r in rows] == [("GET", "/a"), ("ROUTE", "/r")]


def test_results_do_not_depend_on_partitioning(files):
    table = files([(i % 2, f"d{i % 7}/f{i}.py", "docker login token " * (i % 4)) for i in range(60)])

    def told(df):
        hits = rules.file_rule_hits(df)
        return sorted(map(tuple, rules.feature_evidence(hits, rules.detect_features(hits)).collect()))

    assert told(table) == told(table.repartition(7)) == told(table.orderBy("content").coalesce(1))
