"""Commit history, achievements, diffs, streaming feed."""

import datetime as dt
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from codelode import lexicons as lx
from codelode.operators import history, ranking
from codelode.plans import reports
from codelode.sources import commit_log
from codelode.streaming import commits as stream
from registry import oracles, queries

CHANGES = (
    "repo_id int, sha string, file_pos int, path string, change_type string, insertions int, deletions int, diff string"
)


def day(text):
    return F.lit(f"{text} 00:00:00").cast("timestamp_ntz")


def test_achievements_keep_only_the_real_one(commits):
    rows = history.achievements(commits(["Merge branch x into y", "wip on things", "Add new login page"])).collect()
    assert [r.subject for r in rows] == ["Add new login page"]


def test_achievement_retries_later_patterns_after_a_told_tail(commits):
    # the second subject's first capture was told before; its "fix" capture was not
    messages = ["add login page", "add login page fix broken header", "Add  login page"]
    rows = history.achievements(commits(messages)).orderBy("position").collect()
    assert [r.subject for r in rows] == ["add login page fix broken header", "add login page"]


def told_in_order(messages, n=200, k=15):
    import re

    seen, kept = set(), []
    for message in messages[:n]:
        subject = message.strip().split("\n")[0]
        low = subject.lower()
        if len(subject) <= 10 or any(w in low for w in lx.SUBJECT_STOP_WORDS):
            continue
        for pattern in lx.ACHIEVEMENT_PATTERNS:
            m = re.search(pattern, low)
            tail = re.sub(r"\s+", " ", m[1].strip())[:100] if m else ""
            if len(tail) > 5 and tail not in seen:
                seen.add(tail)
                kept.append(subject)
                break
    return sorted(kept, key=len, reverse=True)[:k]


def test_achievements_agree_with_a_sequential_reading(commits):
    rng = random.Random(5)
    words = ["add", "fix", "Fixed", "implement", "optimized", "login", "page", "cache layer", "merge", "refactor", "tail\ttab", "x"]
    messages = [" ".join(rng.choices(words, k=rng.randint(1, 6))) + "\n\nbody" for _ in range(300)]
    rows = history.achievements(commits(messages)).orderBy("position").collect()
    assert [r.subject for r in rows] == told_in_order(messages)


def test_achievements_of_all_commits_agree_with_a_sequential_reading(commits):
    rng = random.Random(6)
    words = ["add", "fix", "Fixed", "implement", "optimized", "login", "page", "cache layer", "merge", "refactor", "tail\ttab", "x", "Ärger"]
    told = {r: [" ".join(rng.choices(words, k=rng.randint(1, 6))) + "\n\nbody" for _ in range(n)] for r, n in ((1, 1300), (2, 3), (3, 700))}
    table = commits(told[1], 1).unionByName(commits(told[2], 2)).unionByName(commits(told[3], 3)).repartition(5)
    table = table.unionByName(commits(["Add what has no place in the walk"], 3).withColumn("walk_pos", F.lit(None).cast("int")))
    rows = history.achievements(table, None, 40).collect()
    assert {r.repo_id for r in rows} <= set(told) and len(rows) > 60
    for repo, messages in told.items():
        mine = sorted((r.position, r.subject) for r in rows if r.repo_id == repo)
        assert mine == list(enumerate(told_in_order(messages, len(messages), 40), 1))


def test_highlights_tell_of_all_commits(files, commits, repos):
    """An achievement older than the newest 200 commits counts, in the query and in its SQL."""
    messages = ["wip on this and that"] * 250 + ["Add a login page for everyone"]
    t = SimpleNamespace(files=files({"src/a.py": "x = 1"}), commits=commits(messages), repos=repos())
    assert [r.achievements for r in queries.highlight_rows(t).collect()] == ["Add a login page for everyone"]
    assert "walk_pos <= 200" not in oracles.oracle("highlights") and "walk_pos <= 200" in oracles.oracle("achievements")


def test_commits_since_stops_at_the_first_old_commit(spark):
    dates = ["2024-03-01", "2024-02-20", "2023-01-01", "2024-02-25"]
    rows = [(1, f"s{i}", "e", "n", dt.datetime.fromisoformat(d), "m", i + 1) for i, d in enumerate(dates)]
    table = spark.createDataFrame(rows, commit_log.COMMIT_SCHEMA)
    assert [r.sha for r in history.commits_since(table, day("2024-03-02")).orderBy("walk_pos").collect()] == ["s0", "s1"]
    assert [r.sha for r in history.commits_since(table, day("2024-03-02"), count=1).collect()] == ["s0"]
    assert [r.sha for r in history.commits_since(table, day("2024-03-02"), since_sha="s1").collect()] == ["s0"]


def test_commit_summary_uses_the_ends_of_the_walk(spark, repos):
    rows = [
        (1, "a", "u1@x.org", "User 1", dt.datetime(2024, 1, 5), "m", 1),
        (1, "b", "u2@x.org", "User 2", dt.datetime(2024, 1, 9), "m", 2),
        (1, "c", "u3@x.org", "User 3", dt.datetime(2024, 1, 7), "m", 3),
    ]
    r = history.commit_summary(spark.createDataFrame(rows, commit_log.COMMIT_SCHEMA), repos([1, 2])).orderBy("repo_id").collect()
    assert (r[0].commit_count, r[0].user_commit_count, r[0].contributors) == (3, 2, 3)
    assert (r[0].first_commit_date.day, r[0].last_commit_date.day) == (7, 5)
    assert (r[1].commit_count, r[1].first_commit_date, r[1].contributors) == (0, None, 0)


def test_contributors_take_the_most_recent_name(spark):
    rows = [
        (1, "a", "e", "New", dt.datetime(2024, 1, 5), "m", 1), (1, "b", "e", "Old", dt.datetime(2024, 1, 9), "m", 2),
        (1, "c", "f", "Other", dt.datetime(2024, 1, 1), "m", 3),
    ]
    found = history.contributor_report(spark.createDataFrame(rows, commit_log.COMMIT_SCHEMA)).collect()
    assert [(r.email, r.name, r.commits, r.first_commit.day, r.last_commit.day) for r in found] == [("e", "New", 2, 5, 9), ("f", "Other", 1, 1, 1)]


def test_commit_detail_and_ambiguous_prefix(spark):
    rows = [(1, s, "e", "n", dt.datetime(2024, 1, 5), " msg \n", i + 1) for i, s in enumerate(["abc1", "abc2", "d0"])]
    table = spark.createDataFrame(rows, commit_log.COMMIT_SCHEMA)
    changes = spark.createDataFrame([(1, "d0", 1, "p", "A", 2, 1, ""), (1, "d0", 2, "p", "M", 3, 0, ""), (1, "d0", 3, "q", "M", 1, 1, "")], CHANGES)
    rows = history.commit_detail(table, changes, "d").orderBy("path").collect()
    assert [(r.path, r.insertions, r.deletions, r.total_insertions, r.message) for r in rows] == [("p", 5, 1, 6, "msg"), ("q", 1, 1, 6, "msg")]
    assert [r.error for r in history.commit_detail(table, changes, "abc").collect()] == ["Ambiguous commit: abc"]
    stats = {r.full_sha: (r.files_changed, r.insertions) for r in history.commit_stats(table, changes).collect()}
    assert stats == {"d0": (2, 6), "abc1": (0, 0), "abc2": (0, 0)}


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_diffs_with_and_without_broadcast(spark, commits, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    table = commits([f"message {i}" for i in range(30)])
    long = "\n".join(f"+{i}" for i in range(60))
    changes = [(1, f"{c:040d}", p, f"f{p}", "MADRX"[p % 5], 1, 0, long if p == 1 else "") for c in (0, 29) for p in range(1, 14)]
    found = history.commits_with_diffs(table, spark.createDataFrame(changes, CHANGES), day("2024-01-29"), count=25)
    rows = found.filter("path is not null").orderBy("file_no").collect()
    assert [r.path for r in rows] == [f"f{p}" for p in range(1, 11)]
    assert rows[0].diff.split("\n")[-1] == "... (10 more lines)" and len(rows[0].diff.split("\n")) == 51
    assert found.count() == 10 + 24
    texts = reports.batch_texts(reports.commit_blocks(found), 10).orderBy("batch_num").collect()
    assert [(t.batch_num, t.total_batches) for t in texts] == [(1, 3), (2, 3), (3, 3)]
    assert texts[0].text.startswith(f"\nCommit: {'0' * 8}\nDate: 2024-01-28T00:00:00\nMessage: message 0\n\nFiles changed:\n  Added: f1\n```diff\n+0")
    assert "\n  Changed: f4\n" in texts[0].text and texts[0].text.count("\n\n---\n") == 9


def test_running_total_splits_one_key_over_many_partitions(spark):
    values = list(range(1000))
    random.Random(1).shuffle(values)
    table = spark.createDataFrame([("hot" if v % 10 else "cold", v) for v in values], "k string, v int")
    rows = ranking.running_total(table, ["k"], [F.desc("v")], F.col("v"), "total").collect()
    for key in ("hot", "cold"):
        run = 0
        for r in sorted((r for r in rows if r.k == key), key=lambda r: -r.v):
            run += r.v
            assert r.total == run
    assert len(rows) == 1000


def test_number_commits(commits):
    table = commits([f"m{i}" for i in range(50)])
    numbered = commit_log.number_commits(table.drop("walk_pos")).select("sha", "walk_pos")
    assert sorted(map(tuple, numbered.collect())) == sorted(map(tuple, table.select("sha", "walk_pos").collect()))


def test_read_commit_log(spark, commits, tmp_path):
    table = commits(["a", "b", "c"])
    table.write.json(str(tmp_path / "log"))
    for ordered in (True, False):
        back = commit_log.read_commit_log(spark, str(tmp_path / "log"), ordered)
        assert sorted(map(tuple, back.select(*table.columns).collect())) == sorted(map(tuple, table.collect()))


def test_a_broken_log_line_fails_instead_of_becoming_nulls(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"repo_id": 1, "sha": "a", "committed_date": "2024-01-01T00:00:00"}\n{broken\n')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        commit_log.read_commit_log(spark, str(tmp_path)).collect()
    rows = commit_log.read_commit_log(spark, str(tmp_path), mode="DROPMALFORMED").collect()
    assert [(r.sha, r.walk_pos) for r in rows] == [("a", 1)]


def test_stream_loses_nothing(spark, commits, tmp_path):
    table = commits([f"m{i}" for i in range(40)])
    out, position = str(tmp_path / "out"), F.col("walk_pos")
    parts = [  # most; duplicates with stale positions; late firsts far behind; the same again by another stream
        ("a", table.filter(position % 4 != 0), "2024-02-20"), ("a", table.filter(position % 3 == 0).withColumn("walk_pos", position + 5), "2024-03-21"),
        ("a", table.filter(position % 8 == 0), "2024-01-01"), ("b", table.filter(position % 2 == 0), "2024-01-01"),
    ]
    for name, part, when in parts:
        feed = str(tmp_path / f"feed-{name}")
        part.withColumn("ingest_ts", F.lit(when).cast("timestamp")).write.mode("append").json(feed)
        stream.stream_commits(spark, feed, out, str(tmp_path / f"checkpoint-{name}")).awaitTermination()
    stored = stream.stored_commits(spark, out)
    assert stored.count() == 40 and stored.select("repo_id", "sha").distinct().count() == 40
    expected = stream.contributor_counts(stream.contributor_deltas(table))
    assert sorted(map(tuple, stream.contributor_table(spark, out).collect())) == sorted(map(tuple, expected.collect()))


def test_a_batch_costs_what_it_brings(spark, commits, tmp_path):
    """The second batch never opens what is stored: those files are not even readable."""
    table, out, feed = commits([f"m{i}" for i in range(40)]), tmp_path / "out", str(tmp_path / "feed")
    position = F.col("walk_pos")

    def arrive(part, when):
        part.withColumn("ingest_ts", F.lit(when).cast("timestamp")).write.mode("append").json(feed)
        query = stream.stream_commits(spark, feed, str(out), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return query

    arrive(table.filter(position <= 30), "2024-02-20")
    stored = list((out / "commits").rglob("*.parquet"))
    held = {f: f.read_bytes() for f in stored}
    for f in stored:
        f.write_bytes(b"no parquet")
    query = arrive(table.filter(position > 28), "2024-02-21")  # two of the commits are stored already
    progress = query.recentProgress
    assert sum(p["numInputRows"] for p in progress) == 12
    assert any("RocksDB" in str(p["stateOperators"]) or "rocksdb" in str(p["stateOperators"]) for p in progress)
    for f, content in held.items():
        f.write_bytes(content)
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert stream.stored_commits(spark, str(out)).count() == 40
    expected = stream.contributor_counts(stream.contributor_deltas(table))
    assert sorted(map(tuple, stream.contributor_table(spark, str(out)).collect())) == sorted(map(tuple, expected.collect()))


def test_a_batch_that_runs_again_changes_nothing(spark, commits, tmp_path):
    """Landed twice, as after a failure between landing and its checkpoint; the first version by time of arrival stays whole."""
    table, out = commits(["a", "b", "c"]), str(tmp_path / "out")
    for when, part in (("2024-02-20", table), ("2024-02-19", table.withColumn("message", F.upper("message")))):
        part.withColumn("ingest_ts", F.lit(when).cast("timestamp")).write.mode("append").json(str(tmp_path / "feed"))
    for name in ("one", "two"):
        stream.land_commits(spark, str(tmp_path / "feed"), out, str(tmp_path / name)).awaitTermination()
    for _ in range(2):
        stream.admit_commits(spark, out).awaitTermination()
    assert sorted(r.message for r in stream.stored_commits(spark, out).collect()) == ["A", "B", "C"]


def test_feeds_of_repositories_known_by_name(spark, commits, tmp_path):
    table = commits(["a", "b"]).withColumn("repo_id", F.lit("acme")).withColumn("ingest_ts", F.lit("2024-02-20").cast("timestamp"))
    table.write.json(str(tmp_path / "feed"))
    stream.stream_commits(spark, str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), key="string").awaitTermination()
    assert {r.repo_id for r in stream.stored_commits(spark, str(tmp_path / "out"), "string").collect()} == {"acme"}
    assert [r.repo_id for r in stream.contributor_table(spark, str(tmp_path / "out"), "string").collect()] == ["acme"] * 2


def test_diffs_of_old_commits_stay_in_the_scan(spark, tmp_path):
    """No shuffle carries the diffs of all commits: they pass a filter of the recent keys first, and none is shuffled twice."""
    spark.range(2000).select(
        (F.col("id") % 3).cast("int").alias("repo_id"), F.col("id").cast("string").alias("sha"), F.lit("u").alias("author_email"), F.lit("U").alias("author_name"),
        F.expr("timestamp_ntz'2024-01-01' - make_dt_interval(CAST(id AS INT))").alias("committed_date"), F.lit("m").alias("message"),
        (F.floor(F.col("id") / 3) + 1).cast("int").alias("walk_pos"),
    ).write.parquet(str(tmp_path / "commits"))
    spark.range(40_000).select(
        (F.col("id") % 2000 % 3).cast("int").alias("repo_id"), (F.col("id") % 2000).cast("string").alias("sha"), F.floor(F.col("id") / 2000).cast("int").alias("file_pos"),
        F.concat(F.lit("f"), "id").alias("path"), F.lit("M").alias("change_type"), F.lit(1).alias("insertions"), F.lit(1).alias("deletions"), F.lit("+x").alias("diff"),
    ).write.parquet(str(tmp_path / "changes"))
    table, changes = spark.read.parquet(str(tmp_path / "commits")), spark.read.parquet(str(tmp_path / "changes"))
    likely = ranking.likely_rows(changes, table.filter("walk_pos <= 10"), ["repo_id", "sha"])
    assert 30 * 20 <= likely.count() < 30 * 20 * 1.2
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = history.commits_with_diffs(table, changes, day("2024-01-01"), days=30, max_files=10)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [__word" in plan and "WindowGroupLimit" in plan
        shuffled = [line for line in plan.splitlines() if " Exchange hashpartitioning" in line]
        after = plan[plan.index("Exchange hashpartitioning") :]
        assert shuffled and after
        assert found.filter("path is not null").count() == 31 * 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_a_hot_repository_is_dealt_over_tasks(spark, commits):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 10 < 7, 1).otherwise((F.col("id") % 50 + 2).cast("int")).alias("repo_id"), F.col("id").cast("string").alias("sha"),
        F.expr("timestamp_ntz'2024-01-01' - make_dt_interval(CAST(id AS INT))").alias("committed_date"), (F.col("id") + 1).cast("int").alias("walk_pos"),
    )
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan in (history.commit_batches(rows), history.commits_since(rows, day("2024-02-01"))):
            text = plan._jdf.queryExecution().executedPlan().toString()
            joined = [line for line in text.splitlines() if "Join" in line]
            assert joined and all("__slot" in line for line in joined), text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


WALK = "repo_id int, sha string, committed_date timestamp_ntz, message string, walk_pos int, parents array<string>"


def graph(spark, rows):
    return spark.createDataFrame([(1, s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) if h is not None else None, "m", 9, p) for s, h, p in rows], WALK)


def test_the_walk_follows_the_graph_not_the_clock(spark):
    rows = [  # a slow clock at d, a fast one at b, a merge, a second root, a parent that is not there, nulls
        ("a", 0, None), ("b", 500, ["a"]), ("c", 2, ["b"]), ("d", -100, ["b"]), ("e", 3, ["c", "d"]), ("f", 4, ["e", "gone"]), ("r", 600, []), ("s", None, ["r"]),
    ]
    found = [r.sha for r in commit_log.walk_commits(graph(spark, rows)).orderBy("walk_pos").collect()]
    place = {s: i for i, s in enumerate(found)}
    assert len(found) == 8 and all(place[s] < place[p] for s, _, ps in rows for p in ps or () if p in place)
    assert found.index("s") == 0 and found[-1] == "a"


def test_random_graphs_agree_with_a_sequential_reading(spark):
    rng = random.Random(5)
    rows, corrected = [], {}
    for i in range(300):
        parents = sorted({f"c{rng.randrange(max(0, i - 6), i):03d}" for _ in range(rng.choice([1, 1, 1, 1, 2]))}) if i else []
        date = rng.randrange(-40, 40) + i
        rows.append((f"c{i:03d}", date, parents))
        corrected[f"c{i:03d}"] = max([date * 3_600_000_000, *[corrected[p] + 1 for p in parents]])
    shuffled = rows[:]
    rng.shuffle(shuffled)
    found = [r.sha for r in commit_log.walk_commits(graph(spark, shuffled)).orderBy("walk_pos").collect()]
    assert found == sorted(corrected, key=lambda s: (-corrected[s], s))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    real = commit_log.write_shared
    monkeypatch.setattr(commit_log, "write_shared", lambda df, name: written.append(name) or real(df, name))
    n = 20_000
    chain = spark.range(n).select(
        F.lit(1).alias("repo_id"), F.col("id").cast("string").alias("sha"), F.lit("2024-01-01").cast("timestamp_ntz").alias("committed_date"),
        F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).alias("parents"), F.lit("m").alias("message"),
    )
    first = commit_log.walk_commits(chain).filter("walk_pos IN (1, 2, 20000)").orderBy("walk_pos").collect()
    assert [r.sha for r in first] == [str(n - 1), str(n - 2), "0"]
    assert len(written) < 26


def test_a_stretch_of_wrong_dates_takes_few_rounds(spark, monkeypatch):
    written = []
    real = commit_log.write_shared
    monkeypatch.setattr(commit_log, "write_shared", lambda df, name: written.append(name) or real(df, name))
    n, rows = 120, [("c000", 900, [])]
    rows += [(f"c{i:03d}", i, [f"c{i - 1:03d}"] + [f"c{i - 3:03d}"] * (i % 2 and i > 2)) for i in range(1, n)]
    walked = commit_log.walk_commits(graph(spark, rows))
    assert [r.sha for r in walked.orderBy("walk_pos").collect()] == [f"c{i:03d}" for i in reversed(range(n))]
    assert len(written) < 26


@pytest.mark.parametrize("block", [1, 7])
def test_dates_pass_between_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(commit_log, "BLOCK", block)
    rows = [("a", 50, []), ("b", 1, ["a"]), ("c", 2, ["a"]), ("d", 3, ["b", "c"]), ("e", 90, ["c"]), ("f", 4, ["d", "e"]), ("g", 60, ["d"])]
    found = [r.sha for r in commit_log.walk_commits(graph(spark, rows)).orderBy("walk_pos").collect()]
    assert found == ["f", "e", "g", "d", "b", "c", "a"]
    if block == 1:
        with pytest.raises(ValueError, match="lead back"):
            commit_log.walk_commits(graph(spark, [("a", 0, ["b", "r"]), ("b", 1, ["a", "r"]), ("r", 5, [])])).count()


def test_a_cycle_is_refused(spark):
    with pytest.raises(ValueError, match="lead back"):
        commit_log.walk_commits(graph(spark, [("a", 0, ["b"]), ("b", 1, ["a"]), ("c", 2, ["b"])])).count()


@pytest.mark.parametrize("fast", [8, 3])
def test_fast_clocks_do_not_send_dates_to_and_fro(spark, monkeypatch, fast):
    """Every few commits of a day a clock is weeks fast; with blocks of a few chains, dates passed between them once for each."""
    written = []
    real = commit_log.write_shared
    monkeypatch.setattr(commit_log, "BLOCK", 4)
    monkeypatch.setattr(commit_log, "write_shared", lambda df, name: written.append(name) or real(df, name))
    n = 160
    rows = [(f"c{i:03d}", i // 80 * 24 + (700 if i % fast == 1 else 0), [f"c{j:03d}" for j in (i - 1, i - 2) if j >= 0]) for i in range(n)]
    walked = commit_log.walk_commits(graph(spark, rows))
    assert [r.sha for r in walked.orderBy("walk_pos").collect()] == [f"c{i:03d}" for i in reversed(range(n))]
    assert len(written) < 26


@pytest.mark.parametrize("sizes", [{}, {"SHARE": 40}, {"REPOSITORY": 1, "SHARE": 1}, {"REPOSITORY": 60, "SHARE": 20, "BLOCK": 8}])
def test_repositories_of_any_size_are_walked_alike(spark, monkeypatch, sizes):
    """Alone in a task, several to a task, or in rounds of joins; with commits that come twice, with other dates and parents, and nulls."""
    for name, value in sizes.items():
        monkeypatch.setattr(commit_log, name, value)
    rng, rows = random.Random(3), []
    for repo, n in enumerate((90, 30, 1, 75)):
        for i in range(n):
            for _ in range(rng.choice([1, 1, 1, 2])):
                date = rng.randrange(-5, 5) + i // 4 + 300 * (rng.random() < 0.05) if rng.random() < 0.95 else None
                parents = [rng.choice([f"s{rng.randrange(max(0, i - 5), i) * 37 % 101:03d}", f"s{(i - 1) * 37 % 101:03d}"]) for _ in range(rng.choice([1, 1, 2]))] if i else None
                rows.append((repo, f"s{i * 37 % 101:03d}", date, f"m{len(rows)}", parents and [*parents, *rng.choice([[], [None], ["gone"], parents])]))
    known = {(r, s) for r, s, *_ in rows}
    dates, before = {}, {}
    for r, s, date, _, parents in rows:
        dates[r, s] = max(dates.get((r, s), commit_log.EARLIEST), date * 3_600_000_000 if date is not None else commit_log.EARLIEST)
        before.setdefault((r, s), set()).update((r, p) for p in parents or () if (r, p) in known)
    corrected = {}
    for key in dict.fromkeys((r, s) for r, s, *_ in rows):  # parents come first
        corrected[key] = max([dates[key], *[corrected[p] + 1 for p in before[key]]])
    rng.shuffle(rows)
    odd = [(None, "a", 1, "m", None), (1, None, 2, "m", ["s000"]), (0, None, None, "m", None)]
    log = spark.createDataFrame(
        [(r, s, dt.datetime(1970, 1, 1) + dt.timedelta(hours=h) if h is not None else None, m, 9, p) for r, s, h, m, p in rows + odd], WALK
    )
    walked = commit_log.walk_commits(log)
    assert walked.columns == ["repo_id", "sha", "committed_date", "message", "walk_pos"]
    found = sorted((r.repo_id, r.walk_pos, r.sha, r.message) for r in walked.collect())
    wanted = sorted(((r, s) for r, s, *_ in rows), key=lambda k: (k[0], -corrected[k], k[1]))
    assert [(r, s) for r, _, s, _ in found] == wanted
    assert [p for _, p, *_ in found] == [i for r in range(4) for i in range(1, 1 + sum(x[0] == r for x in rows))]
    assert sorted(m for *_, m in found) == sorted(x[3] for x in rows)


def test_cycles_are_refused_whatever_walks_them(spark, monkeypatch):
    for rows in ([("a", 0, ["a"])], [("a", 0, ["b"]), ("b", 0, ["a"])], [("a", 0, ["c"]), ("b", 1, ["a"]), ("c", 2, ["b"])], [("a", 0, ["b", "r"]), ("b", 1, ["a", "r"]), ("r", 5, [])]):
        for held in (commit_log.REPOSITORY, 0):
            monkeypatch.setattr(commit_log, "REPOSITORY", held)
            monkeypatch.setattr(commit_log, "SHARE", min(commit_log.SHARE, held or 1))
            with pytest.raises(ValueError, match="lead back"):
                commit_log.walk_commits(graph(spark, rows)).count()
        monkeypatch.undo()


def test_a_log_with_parents_is_read(spark, tmp_path):
    spark.createDataFrame([(1, "b", "2024-01-01T00:00:00", ["a"]), (1, "a", "2024-01-02T00:00:00", [])], "repo_id int, sha string, committed_date string, parents array<string>").write.json(str(tmp_path / "log"))
    found = commit_log.read_commit_log(spark, str(tmp_path / "log"), parents=True).orderBy("walk_pos").collect()
    assert [r.sha for r in found] == ["b", "a"]


def test_pages_skip_what_lies_before_them(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 5000).alias("v"), F.lit("x" * 10).alias("wide"))
    rows = rows.withColumn("v", F.when(F.col("v") % 10 == 3, None).otherwise(F.floor(F.col("v") / 4)))
    order = [F.desc_nulls_last("v"), F.col("k")]
    everything = [tuple(r) for r in rows.orderBy(*order).collect()]
    for offset, limit in ((0, 5), (1234, 50), (4990, 50), (6000, 5), (0, 5000), (700, 0)):
        found = [tuple(r) for r in ranking.page_rows(rows, ["v", "k"], order, offset, limit).collect()]
        assert found == everything[offset : offset + limit]
    assert ranking.page_rows(rows.filter("false"), ["v", "k"], order, 0, 5).collect() == []


def test_streamed_commits_are_made_once(spark, tmp_path):
    """All parts of the feed are read from one written table, so commits are numbered once, not for each part."""
    made, n = spark.sparkContext.accumulator(0), 60

    def count(sha):
        made.add(1)
        return sha

    rows = [(1, f"s{i}", f"u{i % 4}@x", "n", dt.datetime(2001, 1, 1 + i % 28), "m", i + 1) for i in range(n)]
    log = spark.createDataFrame(rows, "repo_id int, sha string, author_email string, author_name string, committed_date timestamp_ntz, message string, walk_pos int")
    found = queries.streamed_contributors(SimpleNamespace(spark=spark, commits=log.withColumn("sha", F.udf(count, "string")("sha"))))
    assert {r.email: r.commits for r in found.collect()} == {f"u{i}@x": n // 4 for i in range(4)}
    assert made.value == n
