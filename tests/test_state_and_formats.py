"""Scalar formats, saved profiles, incremental state, file sources."""

import datetime as dt
import hashlib
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from codelode.functions import formats
from codelode.operators import repo, repo_docs as docs, state
from codelode.sources import commit_log, files as source, sinks


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def test_ages(spark):
    ntz = lambda s: F.lit(s).cast("timestamp_ntz")
    months = formats.age_months(ntz("2024-02-01 23:00:00"), ntz("2024-03-01 01:00:00"))
    assert value(spark, months) == 0
    # the future: whole days are floored, months are cut
    assert value(spark, formats.age_months(ntz("2024-03-01 01:00:00"), ntz("2024-01-31 02:00:00"))) == -1
    assert value(spark, formats.age_months(ntz("2024-03-01 01:00:00"), ntz("2024-02-01 02:00:00"))) == 0
    assert value(spark, formats.age_months(F.lit(None).cast("timestamp_ntz"), ntz("2024-03-01 01:00:00"))) == 0
    cases = {
        0: ("< 1 mo", "< 1 month", "< 1 mo"), 1: ("1 mo", "1 months", "1 mo"), 12: ("1+ yr", "1 year", "1 yr"),
        14: ("1+ yr", "1 year, 2 months", "1 yr 2 mo"), 25: ("2+ yr", "2 years, 1 months", "2 yr 1 mo"),
    }
    for m, expected in cases.items():
        c = F.lit(m)
        got = spark.range(1).select(formats.age_display(c), formats.age_long(c), formats.format_duration(c)).collect()[0]
        assert tuple(got) == expected


@pytest.mark.parametrize("size, shown", [(0, "0.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1024**4, "1.0 TB"), (1024**5 * 3, "3072.0 TB")])
def test_format_bytes(spark, size, shown):
    assert value(spark, formats.format_bytes(F.lit(size))) == shown


@pytest.mark.parametrize(
    "url, shown", [("git@github.com:o/r.git", "github.com/o/r"), ("https://x.gitlab.io/a.git", "xlab.io/a"), ("", None), (None, None)]
)
def test_clean_remote_url(spark, url, shown):
    assert value(spark, formats.clean_remote_url(F.lit(url).cast("string"))) == shown


@pytest.mark.parametrize(
    "written, shown",
    [("2024-01-02T03:04:05Z", "2024-01-02"), ("2024-01-02T23:30:00-05:00", "2024-01-02"), ("2024-01-02", "2024-01-02"), ("next week or so", "next week "), ("", "unknown"), (None, "unknown"), ("2024-13-99T00:00:00", "2024-13-99")],
)
def test_story_date(spark, written, shown):
    assert value(spark, formats.story_date(F.lit(written).cast("string"))) == shown


def test_small_formats(spark):
    assert value(spark, formats.subject(F.lit("\t\n first \n second"))) == "first "
    assert value(spark, formats.ellipsize(F.lit("x" * 101))) == "x" * 97 + "..."
    assert value(spark, formats.ellipsize(F.lit("x" * 100))) == "x" * 100
    assert value(spark, formats.repo_hash(F.lit("abc"), F.lit(7))) == hashlib.sha256(b"abc:7").hexdigest()[:16]
    assert value(spark, formats.repo_hash(F.lit(None).cast("string"), F.lit(0))) == ""
    assert value(spark, formats.content_hash(F.lit("é"))) == hashlib.sha256("é".encode()).hexdigest()
    assert value(spark, formats.domain_title(F.lit("real-estate"))) == "Real Estate"
    assert value(spark, formats.iso(F.lit("2024-01-02 03:04:05.5").cast("timestamp_ntz"))) == "2024-01-02T03:04:05.500000"
    assert value(spark, formats.truncate_diff(F.lit("a\nb\nc"), 3)) == "a\nb\nc"
    assert value(spark, formats.truncate_diff(F.lit("a\nb\nc\n"), 3)) == "a\nb\nc\n... (1 more lines)"


def sequential_names(profiles, existing, date):
    taken, out = set(existing), []
    for repo, ord in sorted(profiles, key=lambda p: p[1]):
        base = name = f"{repo}_{date}"
        n = 1
        while name in taken:
            name, n = f"{base}-{n}", n + 1
        taken.add(name)
        out.append((repo, ord, name))
    return sorted(out)


def test_saved_names_agree_with_one_by_one_numbering(spark):
    rng = random.Random(3)
    profiles = [(rng.choice(["hot", "hot", "hot", "b", "c"]), i) for i in range(200)]
    existing = [f"hot_2024-01-01-{n}" for n in (1, 2, 5, 40, 41, 300)] + ["hot_2024-01-01", "b_2024-01-01-2", "b_2024-01-01-007", "other"]
    found = state.saved_names(
        spark.createDataFrame(profiles, "repo_name string, ord bigint"), spark.createDataFrame([(n,) for n in existing], "name string"), "2024-01-01"
    )
    assert sorted(map(tuple, found.select("repo_name", "ord", "name").collect())) == sequential_names(profiles, existing, "2024-01-01")


@pytest.fixture
def profiles(spark):
    rows = [
        ("a", "## a\n### b\n", dt.datetime(2024, 1, 1), 1, True), ("b", "é", dt.datetime(2024, 1, 3), 0, False), ("c", "## ## ## ", dt.datetime(2024, 1, 2), 2, True),
    ]
    return spark.createDataFrame(rows, "name string, content string, modified timestamp_ntz, repo_count int, has_metadata boolean")


def test_profiles(profiles, spark, tmp_path):
    listed = state.list_profiles(profiles, "a.md")
    assert [(r.name, r.project_count, r.size, r.synced) for r in listed.collect()] == [("b", 0, 2, False), ("c", 2, 9, False), ("a", 1, 11, True)]
    assert state.latest_profile(profiles).collect()[0].name == "b"
    status = state.status_summary(listed).collect()[0]
    assert (status.profiles_count, status.last_analyze.day, status.pending_sync) == (3, 3, True)
    assert {r.name: r.status for r in state.profiles_to_push(listed).collect()} == {"b": "failed", "c": "pushed"}
    assert {r.name for r in state.profiles_to_push(listed, "a").collect()} == {"a"}
    assert state.get_profile(profiles, "c").count() == 1
    new = profiles.select(F.lit("r").alias("repo_name"), F.length("name").cast("bigint").alias("ord"), "content").limit(1)
    path = str(tmp_path / "saved")
    sinks.save_profiles(new, profiles.select("name"), path, "2024-01-01")
    saved = spark.read.parquet(path)
    sinks.save_profiles(new, saved.select("name"), path, "2024-01-01")
    assert sorted(r.name for r in spark.read.parquet(path).collect()) == ["r_2024-01-01", "r_2024-01-01-1"]
    sinks.write_report_json(sinks.report_json(listed, "name"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_stories(spark):
    rows = [(str(i), "r" if i % 2 else "s", f"story {i}", ["Go", "Rust"] if i % 3 else ["SQL"], 1, 2, 3, dt.datetime(2024, 1, 1 + i)) for i in range(10)]
    stories = spark.createDataFrame(
        rows, "story_id string, repo_name string, summary string, technologies array<string>, files_changed int, lines_added int, lines_removed int, last_commit_at timestamp_ntz"
    )
    page = state.stories_query(stories, repo_name="r", technologies=" go , x", limit=2, offset=1).collect()
    assert [(r.story_id, r.total) for r in page] == [("5", 3), ("1", 3)]
    assert state.stories_query(stories, limit=3).collect()[0].total == 10
    card = state.story_cards(stories.filter("story_id = '1'")).collect()[0]
    assert (card.technologies, card.details) == ("Go Rust", "r • 1 files • +2 -3 • 2024-01-02")


def test_incremental_state(spark):
    table = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    current, stored = table([("a", "1"), ("b", "2"), ("c", "3")]), table([("a", "1"), ("b", "old"), ("d", "4")])
    assert {r.path for r in state.changed_repos(current, stored).collect()} == {"b", "c"}
    assert sorted(map(tuple, state.next_state(current, stored).collect())) == [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")]


def test_sync_plan(spark, repos, commits):
    tracked = spark.createDataFrame(
        [("/code/repo1", dt.datetime(2024, 1, 1)), ("/code/repo2", dt.datetime(2024, 1, 1)), ("/code/repo3", None), ("/gone", None)], "path string, last_sync timestamp_ntz"
    )
    ids = repos([1, 2, 3])
    plan = {r.path: (r.status, r.reason) for r in state.sync_plan(tracked, ids, commits(["x"])).collect()}
    assert plan == {"/code/repo1": ("sync", None), "/code/repo2": ("skipped", "unchanged"), "/code/repo3": ("sync", None), "/gone": ("skipped", "not_found")}
    forced = {r.path: r.status for r in state.sync_plan(tracked, ids, commits(["x"]), force=True).collect()}
    assert forced == {"/code/repo1": "sync", "/code/repo2": "sync", "/code/repo3": "sync", "/gone": "skipped"}
    summary = {(r.status, r.reason): r.n for r in state.sync_summary(state.sync_plan(tracked, ids, commits(["x"]))).collect()}
    assert summary == {("sync", None): 2, ("skipped", "unchanged"): 1, ("skipped", "not_found"): 1}
    status = {r.path: r.exists for r in state.tracked_status(tracked, ids).collect()}
    assert status["/gone"] is False and status["/code/repo1"] is True


def test_read_files(spark, tmp_path):
    (tmp_path / "r1" / "src").mkdir(parents=True)
    (tmp_path / "r1" / "src" / "a b+c%20.py").write_bytes("é\n".encode())
    (tmp_path / "r1" / "bad.bin").write_bytes(b"a\xff\xfeb")
    (tmp_path / "r2").mkdir()
    (tmp_path / "r2" / "big.txt").write_text("x" * 100)
    rows = {(r.repo_id, r.path): r for r in source.read_files(spark, str(tmp_path)).collect()}
    assert rows[("r1", "src/a b+c%20.py")].content == "é\n"
    assert (rows[("r1", "bad.bin")].content, rows[("r1", "bad.bin")].is_text) == ("ab", False)
    small = source.read_files(spark, str(tmp_path), max_bytes=50)
    assert {r.repo_id for r in small.collect()} == {"r1"}


HIDDEN = [
    "__init__.py", "__main__.py", "_priv.py", ".env.example", ".gitlab-ci.yml", ".github/workflows/ci.yml", "__tests__/a.js", "src/a.py",
]


def test_read_files_sees_names_of_any_form(spark, tmp_path):
    for name in HIDDEN:
        (tmp_path / "r1" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r1" / name).write_text("x = 1\n")
    table = source.read_files(spark, f"file://{tmp_path}")
    assert sorted(r.path for r in table.collect()) == sorted(HIDDEN)
    assert sorted(r.path for r in source.list_files(spark, str(tmp_path)).collect()) == sorted(HIDDEN)
    ids = spark.createDataFrame([("r1",)], "repo_id string")
    assert docs.repo_has_ci(table, ids).first().has_ci is True
    assert docs.repo_has_tests(table, ids).first().has_tests is True
    assert "__main__.py" in {r.path for r in repo.entry_points(table).collect()}


def test_one_repository_is_listed_by_many_tasks(spark, tmp_path, monkeypatch):
    for i in range(400):
        (tmp_path / "tree" / "big" / f"d{i}").mkdir(parents=True)
        (tmp_path / "tree" / "big" / f"d{i}" / "f.py").write_text("x")
    (tmp_path / "tree" / "top.txt").write_text("beside the repositories")
    (tmp_path / "tree" / "big" / "d1" / "loop").symlink_to(tmp_path / "tree")
    written = []
    monkeypatch.setattr(source, "write_shared", lambda df, name: written.append(df) or df.sparkSession.createDataFrame(df.collect(), df.schema))
    found = source.list_files(spark, str(tmp_path / "tree"))
    assert found.count() == 400 and {r.repo_id for r in found.select("repo_id").distinct().collect()} == {"big"}
    assert len(written) == 3 and written[2].rdd.getNumPartitions() >= 8
    by_task = written[2].groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) >= 8 and max(r["count"] for r in by_task) <= 120


def test_a_tree_joins_its_commit_log(spark, tmp_path):
    for name in ("acme", "zeta", "left-out"):
        (tmp_path / "tree" / name / "node_modules" / "x").mkdir(parents=True)
        (tmp_path / "tree" / name / "a.py").write_text(name)
        (tmp_path / "tree" / name / "node_modules" / "x" / "b.js").write_text("b")
    by_name = [(n, f"s{n}", "e", "N", dt.datetime(2024, 1, 1), "m", 1) for n in ("acme", "zeta")]
    columns = "repo_id string, sha string, author_email string, author_name string, committed_date timestamp_ntz, message string, walk_pos int"
    spark.createDataFrame(by_name, columns).write.json(str(tmp_path / "log"))
    files = source.read_files(spark, str(tmp_path / "tree"), skip_folders=["node_modules"])
    joined = files.join(commit_log.read_commit_log(spark, str(tmp_path / "log"), key="string"), "repo_id")
    assert sorted((r.repo_id, r.path, r.sha) for r in joined.collect()) == [("acme", "a.py", "sacme"), ("zeta", "a.py", "szeta")]
    ids = source.repository_ids(spark.createDataFrame([("zeta",), ("acme",), ("acme",)], "name string"))
    assert sorted(map(tuple, ids.collect())) == [("acme", 1), ("zeta", 2)]
    spark.createDataFrame([(1 if n[0] == "acme" else 2, *n[1:]) for n in by_name], columns.replace("repo_id string", "repo_id int")).write.json(str(tmp_path / "numbered"))
    files = source.read_files(spark, str(tmp_path / "tree"), ids=ids)
    assert files.schema["repo_id"].dataType.simpleString() == "int" and files.count() == 4
    joined = files.join(commit_log.read_commit_log(spark, str(tmp_path / "numbered")), "repo_id")
    assert sorted((r.repo_id, r.content, r.sha) for r in joined.filter("path = 'a.py'").collect()) == [(1, "acme", "sacme"), (2, "zeta", "szeta")]
    assert source.list_files(spark, str(tmp_path / "tree" / "acme" / "node_modules")).count() == 1
    (tmp_path / "empty").mkdir()
    assert source.read_files(spark, str(tmp_path / "empty")).count() == 0


def test_saved_names_see_long_suffixes(spark):
    profiles = spark.createDataFrame([("a", 1), ("a", 2)], "repo_name string, ord long")
    taken = spark.createDataFrame([("a_d",), ("a_d-1",), ("a_d-12345678901",)], "name string")
    assert {r.name for r in state.saved_names(profiles, taken, "d").collect()} == {"a_d-2", "a_d-3"}


def some_profiles(spark, content, n=3):
    return spark.createDataFrame([("repo" if i else "other", i, f"{content}{i}", "{}") for i in range(n)], "repo_name string, ord long, content string, metadata string")


def test_two_writers_never_share_a_name(spark, tmp_path, monkeypatch):
    """The second writer commits while the first is about to: the first sees it, and gives out names anew."""
    first, second = (sinks.ProfileStore(spark, str(tmp_path / "store")) for _ in range(2))
    assert first.read().count() == 0
    claim, tried = first._claim, []

    def late(number, rows, names):
        if not tried:
            assert second.save(some_profiles(spark, "b"), "2024-01-01") == 0
        tried.append(number)
        return claim(number, rows, names)

    monkeypatch.setattr(first, "_claim", late)
    assert first.save(some_profiles(spark, "a"), "2024-01-01") == 1 and tried == [0, 1]
    rows = {r.name: r.content for r in second.read().collect()}
    assert rows == {
        "other_2024-01-01": "b0", "repo_2024-01-01": "b1", "repo_2024-01-01-1": "b2", "other_2024-01-01-1": "a0", "repo_2024-01-01-2": "a1", "repo_2024-01-01-3": "a2",
    }
    assert not [f for f in (tmp_path / "store" / "log").iterdir() if not f.name.startswith(".") and not f.name.endswith(".json")]


def test_writers_at_once(spark, tmp_path):
    store = sinks.ProfileStore(spark, str(tmp_path / "store"))
    with ThreadPoolExecutor(3) as pool:
        numbers = list(pool.map(lambda i: sinks.ProfileStore(spark, store.path).save(some_profiles(spark, f"w{i}-", 2), "2024-01-01"), range(3)))
    assert sorted(numbers) == [0, 1, 2]
    rows = store.read().collect()
    assert len({r.name for r in rows}) == 6 == len({r.content for r in rows})


def test_a_failed_writer_leaves_nothing_to_read(spark, tmp_path, monkeypatch):
    store = sinks.ProfileStore(spark, str(tmp_path / "store"))
    store.save(some_profiles(spark, "a"), "2024-01-01")
    broken = some_profiles(spark, "b").withColumn("content", F.when(F.col("ord") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        store.save(broken, "2024-01-01")
    monkeypatch.setattr(store, "_claim", lambda *a: False)
    with pytest.raises(RuntimeError, match="claimed"):
        store.save(some_profiles(spark, "c"), "2024-01-01", tries=2)
    fresh = sinks.ProfileStore(spark, store.path)
    assert sorted(r.content for r in fresh.read().collect()) == ["a0", "a1", "a2"]
    assert fresh.save(some_profiles(spark, "d"), "2024-01-01") == 1 and fresh.read().count() == 6
