"""Analysis of changed files only, against the analysis of everything."""

import os

from pyspark.sql import functions as F

from codelode.plans import analysis, incremental
from codelode.sources import files as source


def write(root, path, content, when=None):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(content.encode() if isinstance(content, str) else content)
    if when:
        os.utime(at, (when, when))


def everything(spark, root, ids, repos):
    return analysis.analyze(source.read_files(spark, str(root), ids=ids), repos)


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_change_of_few_files_reads_few_files(spark, tmp_path):
    root = tmp_path / "tree"
    for repo in ("one", "two", "three"):
        write(root, f"{repo}/README.md", f"# {repo}\n" + "Install and usage\n" * 30)
        write(root, f"{repo}/package.json", '{"dependencies":{"express":"1"}}')
        write(root, f"{repo}/logo.png", b"\x89PNG\xff")
        for i in range(60):
            write(root, f"{repo}/src/p{i % 5}/m{i}.py", f"import redis\nfrom fastapi import FastAPI\n@app.get('/{repo}/{i}')\ndef f{i}():\n    if a: pass\n")
    names = spark.createDataFrame([(n,) for n in ("one", "two", "three")], "name string")
    ids = source.repository_ids(names)
    repos = ids.select("repo_id", "name", F.concat(F.lit("/"), "name").alias("path"))
    store = incremental.FactStore(spark, str(tmp_path / "store"))
    first = store.update(str(root), ids)
    assert first == 3 * 62  # pictures are never opened
    assert rows(store.analyze(repos)) == rows(everything(spark, root, ids, repos))
    assert store.update(str(root), ids) == 0
    # one changed in place with its size kept, one new, one gone, one moved, a read-me no longer text
    write(root, "one/src/p1/m1.py", "import celery\nclass C: pass\n", 2_000_000_000)
    write(root, "two/src/p9/new.py", "import numpy\n" * 3)
    (root / "two" / "src" / "p2" / "m2.py").unlink()
    (root / "one" / "src" / "p3" / "m3.py").rename(root / "one" / "src" / "p3" / "moved.py")
    write(root, "three/README.md", b"# bad \xff\xfe\n" * 40, 2_000_000_000)
    again = incremental.FactStore(spark, str(tmp_path / "store"))
    assert again.version == 1 and again.update(str(root), ids) == 4
    assert rows(again.analyze(repos)) == rows(everything(spark, root, ids, repos))
    # a version that was cut short is written over
    (tmp_path / "store" / "facts" / "3").mkdir(parents=True)
    assert incremental.FactStore(spark, again.path).update(str(root), ids) == 0


def test_only_differing_folders_are_compared(spark):
    def listing(rows):
        return spark.createDataFrame([(1, p, s) for p, s in rows], "repo_id int, path string, stamp string")

    old = [(f"d{i}/f{j}", "s") for i in range(20) for j in range(5)] + [("top", "s")]
    new = [(p, "t" if p == "d3/f1" else s) for p, s in old if p not in ("d4/f0", "top")] + [("d5/new", "s")]
    changed, gone = incremental.changed_files(listing(new), listing(old))
    assert sorted(r.path for r in changed.collect()) == ["d3/f1", "d5/new"]
    assert sorted(r.path for r in gone.collect()) == ["d4/f0", "top"]
    same = incremental.branches(listing(old)).join(incremental.branches(listing(new)), ["repo_id", "branch", "n", "one", "two"], "left_semi")
    assert same.count() == 17
