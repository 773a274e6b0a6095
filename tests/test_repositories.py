"""Manifests, documents, trees, rollups, search, whole-repository plans."""

import pytest
from pyspark.sql import functions as F

from codelode.operators import files as fl, manifests, repo as rp, repo_docs as docs, rules, search, trees
from codelode.plans import analysis, highlights as hl, repo_info as ri, reports


def names(df):
    return [r.name for r in df.orderBy("pos").collect()]


@pytest.mark.parametrize(
    "read, path, content, expected",
    [
        (manifests.requirements_dependencies, "requirements.txt", "-r x\n#\nFastAPI[all]==1\n  a_b>1\r\n.bad\n", ["fastapi", "a_b"]),
        (manifests.pyproject_dependencies, "pyproject.toml", 'dependencies = ["a"]\nx = "b"\n', ["b"]),
        (
            manifests.pyproject_dependencies, "pyproject.toml",
            '"no"\ndependencies = [\n "A>1", "skipped"\n] # "x"\n"out"\n[tool.dev-dependencies]\ndev-dependencies = 1\n\'q\'\n"c"\n', ["a", "c"],
        ),
        (manifests.package_json_dependencies, "package.json", '{"devDependencies":{"z":{"v":1}},"dependencies":{"b":1,"a":"2"}}', ["b", "a", "z"]),
        (manifests.package_json_dependencies, "package.json", '{"dependencies":{"b":1}', []),
        (manifests.package_json_dependencies, "package.json", '{"dependencies":{"b":1}} x', []),
        (manifests.package_json_dependencies, "package.json", '{"dependencies":null,"devDependencies":{"z":1}}', []),
        (manifests.package_json_dependencies, "package.json", '{"name":"x"}', []),
        (manifests.go_mod_dependencies, "go.mod", "require (\n// c\n\n a v1\n)\n)\nrequire b v2\nrequire\nother c\n", ["//", "a", "b"]),
        (
            manifests.cargo_dependencies, "Cargo.toml",
            "x = 1\n[dependencies]\ntokio = '1'\n# a = b\nplain\n[[bin]]\ny = 2\n[dev-dependencies]\n axum=0\n = z\n", ["tokio", "axum"],
        ),
        (manifests.gemfile_dependencies, "Gemfile", "gem 'a', '1'\n gem \"b\"\ngem c\ngems 'd'\n", ["a", "b"]),
    ],
)
def test_manifest(files, read, path, content, expected):
    assert names(read(files({path: content, f"sub/{path}": content}))) == expected


def test_dependencies_merge_python_lists_only_with_a_pyproject(files):
    table = files([(1, "requirements.txt", "a\na\n"), (2, "requirements.txt", "a\na\n"), (2, "pyproject.toml", 'dependencies = [\n"b"\n]\n')])
    found = sorted((r.repo_id, r.name, r.n) for r in manifests.dependencies(table).collect())
    assert found == [(1, "a", 2), (2, "a", 1), (2, "b", 1)]


def test_manifest_frameworks(files):
    table = files({"setup.py": "PyTorch", "package.json": '{"dependencies":{"reactor":"1","vue":"2"}}', "go.mod": "labstack/echo"})
    rows = manifests.manifest_frameworks(table).orderBy("position").collect()
    assert [r.framework for r in rows] == ["PyTorch", "Vue", "Echo"]


README = "# T\n![b](x)\n\n  First prose line.  \nmore"


@pytest.mark.parametrize(
    "content, expected",
    [
        (None, "none"), ("install usage api license [![b\n" + "x\n" * 17, "minimal"), ("INSTALL usage api license\n" + "x\n" * 100, "excellent"),
        ("setup, example\n" + "x\n" * 50, "good"), ("x\n" * 60, "basic"),
    ],
)
def test_readme_quality(files, repos, content, expected):
    table = files({"README.md": content, "README.txt": "x"} if content else {"docs/README.md": "x"})
    assert docs.readme_quality(table, repos()).collect()[0].readme_quality == expected


def test_description_falls_through_to_the_next_readme(files, repos):
    table = files([(1, "README.md", "# only\n!\n"), (1, "README.txt", "\n\n plain \n"), (2, "README.md", README), (3, "README", "y" * 300)])
    rows = docs.repo_description(table, repos([1, 2, 3, 4])).orderBy("repo_id").collect()
    assert [r.description for r in rows] == ["plain", "First prose line.", "y" * 200, None]


def test_presence(files, repos):
    table = files([(1, "specs/x", ""), (1, ".github/workflows/a.yml", ""), (2, "src/a.spec.ts", ""), (2, ".github/x", ""), (3, "latest_x.py", ""), (3, "docs/a", "")])
    ids = repos([1, 2, 3, 4])
    flag = lambda df, c: {r.repo_id for r in df.collect() if r[c]}
    assert flag(docs.repo_has_tests(table, ids), "has_tests") == {1, 2}
    assert flag(docs.repo_has_ci(table, ids), "has_ci") == {1}
    assert flag(docs.doc_presence(table, ids), "has_docs_folder") == {3}
    assert flag(docs.is_config_only(table, ids), "is_config_only") == {1, 4}


def test_config_only_by_name(spark, files):
    named = spark.createDataFrame([(1, "Dotfiles"), (2, "x")], "repo_id int, name string")
    table = files([(1, "a.py", ""), (2, ".config/a.py", ""), (2, "b.PY", "")])
    assert all(r.is_config_only for r in docs.is_config_only(table, named).collect())


def test_file_tree_flat_and_nested(files):
    table = files({"a/b/c/d/e.py": "", "a/.h/x": "", "z/.only/x": "", "node_modules/y": "", "r.txt": ""})
    flat = [r.entry for r in trees.file_tree(table).orderBy("order").collect()]
    assert flat == ["a/", "a/b/", "a/b/c/", "a/b/c/d/", "r.txt", "z/"]
    nested = sorted(map(tuple, trees.file_tree_nested(table).drop("repo_id").collect()))
    assert nested == [
        ("", "a", True, False), ("", "r.txt", False, False), ("a", "b", True, False), ("a/b", "c", True, False), ("a/b/c", "d", True, True),
    ]


def test_find_repo_roots(spark):
    listing = ["/r/x/.git/HEAD", "/r/x/y/.git/HEAD", "/r/.h/z/.git/a", "/r/VENV/q/.git/a", "/r/w/.git", "/r/" + "d/" * 10 + ".git/a", "/r/" + "e/" * 11 + ".git/a", "/other/.git/a"]
    table = spark.createDataFrame([(p,) for p in listing], "path string")
    assert sorted(r.path for r in trees.find_repo_roots(table, "/r").collect()) == ["/r/" + "/".join("d" * 10), "/r/x"]
    assert [r.path for r in trees.find_repo_roots(table, "/r/x").collect()] == ["/r/x"]


def test_read_file_statuses(spark, files):
    table = files({"a.txt": "1\n2\n3", "d/e": "x", "big": "b" * (1024 * 1024 + 1), "edge": "b" * (1024 * 1024)})
    wanted = spark.createDataFrame([(1, p) for p in ("a.txt", "d", "none", "big", "edge")], "repo_id int, path string")
    rows = {r.path: r for r in search.read_file(table, wanted, 2).collect()}
    assert (rows["a.txt"].content, rows["a.txt"].lines, rows["a.txt"].truncated, rows["a.txt"].size) == ("1\n2", 2, True, 5)
    assert [rows[p].error for p in ("d", "none", "big", "edge")] == ["Not a file", "File not found", "File too large", None]


def test_search_code(files):
    table = files({"b.py": "x\n  Foo(1)  \nfoo", "a.py": "FOO" * 100, "img.png": "foo", "venv/c.py": "foo", "img.PNG": "foo"})
    rows = search.search_code(table, r"foo\b|\bfoo", 3).collect()
    assert sorted((r.path, r.line, r.content) for r in rows) == [("a.py", 1, ("FOO" * 100)[:200]), ("b.py", 2, "Foo(1)"), ("b.py", 3, "foo")]
    assert search.search_code(table, "(").collect()[0].error == "Invalid regex pattern: ("
    assert {r.line for r in search.search_code(files({"a": "q\nw\n"}), "^$").collect()} == {3}


@pytest.mark.parametrize(
    "pattern, line, found",
    [
        (r"\Wé?1", "é1 x", False), (r"\Wé?1", "a é1", True), (r"^\d$", "٣", True), (r"^\D$", "٣", False), (r"a\Bb", "ab", True),
        (r"(?P<my_name>x)(?P=my_name)", "axxb", True), (r"[\W]", "é", False), (r"[\d.]+7", "1.7", True),
    ],
)
def test_search_speaks_pythons_dialect(files, pattern, line, found):
    rows = search.search_code(files({"a": line}), pattern).collect()
    assert [r.error for r in rows] == [None] * found


def test_search_answers_what_the_engine_cannot_run(files):
    assert "Invalid" in search.search_code(files({"a": "x"}), r"(?P<n>x)(?(n)y|z)").collect()[0].error


def test_undecodable_files_are_passed_over(spark, repos):
    table = spark.createDataFrame(
        [(1, "README.md", "bad", False), (1, "README.txt", "plain\n" * 30, True)], "repo_id int, path string, content string, is_text boolean"
    )
    assert [r.path for r in search.search_code(table, "a").collect()] == ["README.txt"] * 30
    assert docs.readme_quality(table, repos()).first().readme_quality == "basic"


def test_detectors_take_lexicons_of_the_user(files, repos):
    own = {**rules.HIGHLIGHT_LEXICONS, "feature": {"zebra": ["zebra"]}, "integration": {"Acme": ["acme"]}, "scale": {"huge": ["zebra"]}, "domain": {"zoo": ["zebra"]}}
    hits = rules.file_rule_hits(files({"a.py": "zebra " * 9 + "acme"}), own)
    found = rules.detect_features(hits, lexicons=own)
    assert [(r.feature, r.title, r.hits) for r in found.collect()] == [("zebra", "zebra", 9)]
    assert [r.path for r in rules.feature_evidence(hits, found, lexicons=own).collect()] == ["a.py"]
    assert [r.integration for r in rules.detect_integrations(hits, own).collect()] == ["Acme"]
    assert [r.indicator for r in rules.scale_indicators(hits, own).collect()] == ["huge"]
    assert rules.detect_domain(hits, repos(), lexicons=own).first().domain == "zoo"


def test_shares_and_primary_language(files):
    table = files({**{f"{i}.py": "" for i in range(3)}, **{f"{i}.js": "" for i in range(3)}, **{f"x{i}.go": "" for i in range(295)}})
    breakdown = rp.language_breakdown_files(fl.file_language_wide(table)).orderBy("position").collect()
    assert [(r.language, r.pct) for r in breakdown] == [("Go", 98.0)]
    tie = files({"b.js": "", "a.py": "", "c.py": "", "d.js": ""})
    shares = rp.language_breakdown_files(fl.file_language_wide(tie))
    assert rp.primary_language(shares).collect()[0].primary_language == "Python"


def test_rollup_quirks(files):
    table = files({"test_a.py": "def f():\n  if a: pass\n", "b_test.py": "", "c.spec.ts": ""})
    metrics = fl.file_metrics(table)
    row = rp.test_summary(metrics).collect()[0]
    assert (row.test_files, row.has_tests, row.test_ratio) == (3, True, 0.0)
    row = rp.repo_rollup(metrics).collect()[0]
    assert (row.total_files, row.avg_complexity) == (3, 1.0)


def test_imports_and_libraries(files):
    table = files({"b.py": "import redis\nimport aioredis", "a.py": "import zzz\nimport redis\nimport Requests_toolbelt"})
    imports = fl.file_imports(fl.file_metrics(table))
    assert [(r.name, r.n) for r in rp.import_counts(imports).orderBy("position").collect()] == [
        ("redis", 2), ("zzz", 1), ("Requests_toolbelt", 1), ("aioredis", 1)
    ]
    assert [r.library for r in rp.notable_libraries(imports).orderBy("position").collect()] == ["redis", "requests"]


def test_project_type_counts_directories_and_breaks_ties_by_list(files, repos):
    table = files([(1, "api/routes/a.py", ""), (2, "cli.py", ""), (2, "ios/a", ""), (3, "x", "")])
    found = {r.repo_id: r.project_type for r in rp.project_type(table, repos([1, 2, 3])).collect()}
    assert found == {1: "api", 2: "cli", 3: "unknown"}


def test_architecture_needs_half_of_the_indicators(files):
    table = files({"X/Models/a": "", "views/b": "", "my_services/c": "", "lambda": ""})
    found = [r.architecture for r in rp.architecture_patterns(table).orderBy("rule_pos").collect()]
    assert found == ["mvc"]


def test_key_files_entry_points_snippets(files):
    table = files({"cmd/main.go": "", "src/main.py": "l1\nl2\nl3", "lib/main.py": "", "app.py": "a", "go.mod": ""})
    assert [r.path for r in rp.key_files(table).orderBy("position").collect()] == ["lib/main.py", "src/main.py", "app.py", "cmd/main.go", "go.mod"]
    assert [r.path for r in rp.entry_points(table).orderBy("position").collect()] == ["src/main.py", "app.py", "cmd/main.go", "cmd/main.go"]
    snippets = rp.code_snippets(table, 2, 2).orderBy("position").collect()
    assert [(r.path, r.content, r.total_lines, r.truncated) for r in snippets] == [("lib/main.py", "", 1, False), ("src/main.py", "l1\nl2", 3, True)]


def test_whole_repository_plans(files, repos, commits, tmp_path):
    table = files({
        "README.md": "# Shop\nA shop. " + "order cart checkout " * 5, "src/main.py": "from fastapi import FastAPI\n@app.get('/x')\ndef f():\n    '''d'''\n    if a: pass\n",
        "package.json": '{"dependencies":{"stripe":"1"}}', "tests/test_a.py": "def test_x(): assert 1",
    })
    as_of = F.lit("2025-03-01 00:00:00").cast("timestamp_ntz")
    history = commits(["Add shopping cart for everyone", "Fix the checkout of orders", "x"])
    a = analysis.analyze(table, repos([1, 2]))
    row = a.filter("repo_id = 1").collect()[0]
    assert row.frameworks == ["FastAPI"] and row.languages == {"Python": 100.0} and row.entry_points == ["src/main.py"]
    assert (row.summary.total_files, row.testing.test_files, row.testing.test_ratio) == (2, 1, 1.0)
    assert [(e.method, e.path) for e in row.api_endpoints] == [("GET", "/x")]
    empty = a.filter("repo_id = 2").collect()[0]
    assert (empty.summary.project_type, empty.documentation.readme_quality, empty.key_files) == ("unknown", "none", [])
    h = hl.highlights(table, history, repos([1, 2]))
    row = h.filter("repo_id = 1").collect()[0]
    assert row.domain == "e-commerce" and [i.name for i in row.integrations] == ["Stripe"]
    assert row.achievements == ["Add shopping cart for everyone", "Fix the checkout of orders"]
    assert row.summary_context.startswith("README:\n# Shop") and "\n\nDomain: e-commerce\n\n" in row.summary_context
    assert hl.resume_bullets(h).filter("repo_id = 1").collect()[0].bullets == "• Integrated with Stripe"
    info = ri.repo_info(table, history, repos([1, 2]), as_of)
    profile = reports.offline_profile(info, a, h).orderBy("repo_id").collect()
    assert profile[0].profile.split("\n")[:5] == ["# repo1", "", "**Python** | 3 commits | 1+ yr", "", "*E Commerce Application*"]
    assert profile[1].profile.split("\n")[2] == "0 commits | < 1 mo"
    header = reports.metadata_header(info).orderBy("repo_id").collect()[0].header
    assert "- **Languages**: Python (100%)" in header and "(1 year, 1 months)" in header
    fields = {(r.field, r.value) for r in ri.portfolio_header(info).collect()}
    assert ("Total Commits", "3") in fields and ("Languages", "Python (100%)") in fields and ("Repositories", "repo2") in fields


def test_paths_are_written_once_for_all_sections(files, repos, monkeypatch):
    """Sections that need paths only read one written table, not the files behind it."""
    written, write = [], analysis.write_shared
    monkeypatch.setattr(analysis, "write_shared", lambda df, name: written.append((name, df.columns)) or write(df, name))
    analysis.analyze(files({"a.py": "x = 1\n"}), repos())
    assert ("file-paths", ["repo_id", "path"]) in written
