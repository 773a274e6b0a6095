"""Tables derived from the given Parquet tables by SQL that Spark and DuckDB both run.

Repositories are the nations, which own all commits and code (few, large groups), and the suppliers,
which bring manifests and read-me files, so every table grows with the data.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.operators.ranking import row_numbers

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

CODE_PATH = """concat(CASE CAST(floor(p_partkey / 25) % 9 AS INT) WHEN 0 THEN 'src/' WHEN 1 THEN 'src/components/' WHEN 2 THEN 'tests/' WHEN 3 THEN 'api/routes/' WHEN 4 THEN 'models/'
   WHEN 5 THEN 'node_modules/x/' WHEN 6 THEN 'controllers/' WHEN 7 THEN 'services/core/' ELSE '' END,
  CASE WHEN p_size % 9 = 0 THEN concat(CASE WHEN p_partkey < 225 THEN '' ELSE concat('d', CAST(CAST(floor(p_partkey / 225) AS INT) AS STRING), '/') END, 'main') WHEN p_size % 9 = 1 THEN concat('test_', CAST(p_partkey AS STRING)) ELSE concat('m', CAST(p_partkey AS STRING)) END,
  CASE CAST(p_size % 11 AS INT) WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.go' WHEN 4 THEN '.rs' WHEN 5 THEN '.rb' WHEN 6 THEN '.java'
   WHEN 7 THEN '.tsx' WHEN 8 THEN '.py' WHEN 9 THEN '.kt' ELSE '.md' END)"""

CODE_CONTENT = """CASE CAST(p_size % 11 AS INT)
  WHEN 3 THEN concat('package main', chr(10), 'import (', chr(10), chr(9), '"fmt"', chr(10), chr(9), '"github.com/gin-gonic/gin"', chr(10), ')', chr(10),
     repeat(concat('func run() {', chr(10), 'if x { for i := range y {} }', chr(10), '}', chr(10), '// note', chr(10)), CAST(p_size % 5 AS INT)))
  WHEN 0 THEN concat('import redis', chr(10), 'from fastapi import FastAPI', chr(10), '# ', p_name, chr(10), chr(10),
     repeat(concat('@app.get("/', lower(p_type), '")', chr(10), 'def f():', chr(10), concat('    ', repeat(chr(34),3), 'doc', repeat(chr(34),3)), chr(10), '    if a: return 1', chr(10)), CAST(p_size % 4 AS INT)))
  WHEN 8 THEN concat('from .local import x', chr(10), 'import numpy.linalg', chr(10),
     repeat(concat('class C:', chr(10), '  def m(self):', chr(10), '    for i in [j for j in x]:', chr(10), '      assert i', chr(10)), CAST(p_size % 3 AS INT)))
  WHEN 10 THEN concat('# ', p_name, chr(10), 'Usage and install', chr(10))
  WHEN 5 THEN concat('# rb', chr(10), 'gem "rails"', chr(10), repeat(concat('puts 1', chr(10)), CAST(p_size % 7 AS INT)))
  ELSE concat('import React from "react"', chr(10), 'import x from "@scope/pkg"', chr(10), 'const a = require("./rel")', chr(10), '/* c', chr(10), ' * d', chr(10), ' */', chr(10),
     repeat(concat('const f = async (x) => {', chr(10), '  if (x) { stripe.charge(x) }', chr(10), '}', chr(10), chr(10), 'router.post("/', lower(p_type), '", f)', chr(10)), CAST(p_size % 6 AS INT)))
 END"""

# pieces of Python files; a file holds those whose bit its part's key has
PYTHON_PIECES = [
    """def grade(n):
    if n > 2:
        return 1
    elif n > 1:
        return 2
    else:
        return 3
""", """async def load(path):
    'Read it.'
    try:
        with open(path) as f, open(path) as g:
            return f
    except (OSError, ValueError):
        pass
    except KeyError:
        raise
""", """class Box:
    'Holds.'
    def outer(self):
        def inner(x):
            while x:
                x -= 1
            return [y for y in range(x) if y for z in y]
        return inner
""", """import os.path, sys as system
from ..pkg.mod import thing
from . import sibling
if os:
    for i in []:
        pass
""", """def choose(x): return (lambda y: y if y else 0)(x)
""", """def broken(:
""",
]


def sql_text(text: str) -> str:
    lines = ["'" + line.replace("'", "''") + "'" for line in text.split("\n")]
    return "concat(" + ", chr(10), ".join(lines) + ")"


PYTHON_CONTENT = "concat('', " + ", ".join(
    f"CASE WHEN floor(p_partkey / {2**i}) % 2 = 1 THEN {sql_text(piece)} ELSE '' END" for i, piece in enumerate(PYTHON_PIECES)
) + ")"

# what lies below a repository, by repo_id % 8
LISTING_TAILS = {
    "/.git/HEAD": range(7), "/sub/inner/.git/HEAD": range(8), "/.cache/r/.git/HEAD": range(8),
    "/Vendor/lib/.git/config": range(8), "/a/b/c/d/e/f/g/h/i/.git/HEAD": [7], "/a/b/c/d/e/f/g/h/i/j/k/.git/HEAD": range(8),
    "/work/.git": range(8), "/src/main.py": range(8),
}
LISTING_ROWS = ", ".join(f"({k}, '{tail}')" for tail, ks in LISTING_TAILS.items() for k in ks)

# name -> (tables it reads, SQL)
FIXTURES = {
    "fx_seed": (["nation", "supplier"], """
SELECT n_nationkey AS repo_id, n_nationkey AS nation, n_name AS label FROM nation
UNION ALL SELECT CAST(25 + s_suppkey AS INT) AS repo_id, s_nationkey AS nation, replace(s_name, '#', ' ') AS label FROM supplier"""),
    "fx_repos": (["fx_seed", "customer"], """
SELECT repo_id, lower(replace(label,' ','-')) AS name, concat('/code/', lower(replace(label,' ','-'))) AS path,
  CASE WHEN repo_id % 6 = 5 THEN NULL
       WHEN repo_id % 6 = 4 THEN concat('https://github.com/forks/', lower(replace(label,' ','-')), '.git')
       ELSE concat('git@github.com:org/', lower(replace(label,' ','-')), '.git') END AS remote_url,
  CASE WHEN repo_id % 4 = 3 THEN NULL ELSE concat('u', CAST(k AS STRING), '@example.com') END AS user_email,
  CASE WHEN repo_id % 5 = 0 THEN NULL ELSE nm END AS user_name
FROM fx_seed LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS k, max(c_name) AS nm FROM customer GROUP BY c_nationkey) u
  ON u.c_nationkey = nation"""),
    "fx_commit_rows": (["orders", "customer"], """
SELECT c.c_nationkey AS repo_id, lpad(CAST(o.o_orderkey AS STRING), 40, '0') AS sha,
  concat('u', CAST(o.o_custkey AS STRING), '@example.com') AS author_email, c.c_name AS author_name,
  o.o_orderdate AS committed_date,
  concat(CASE CAST(o.o_orderkey % 10 AS INT) WHEN 0 THEN 'Add ' WHEN 1 THEN 'Implemented ' WHEN 2 THEN 'Merge branch ' WHEN 3 THEN 'fix typo in '
     WHEN 4 THEN 'Refactor ' WHEN 5 THEN 'wip ' WHEN 6 THEN 'Optimize ' WHEN 7 THEN 'Fixes ' WHEN 8 THEN 'migrate ' ELSE 'misc ' END,
   lower(o.o_orderpriority), ' module ', CAST(o.o_orderkey % 37 AS STRING), chr(10), chr(10), 'body of ', CAST(o.o_orderkey AS STRING)) AS message
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""),
    # for DuckDB; Spark numbers the rows without a window over a whole repository, see Tables.commits
    "fx_commits": (["fx_commit_rows"], """
SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY committed_date DESC, sha DESC) AS walk_pos FROM fx_commit_rows"""),
    # a graph along the dates, with a merge every eleven commits and clocks that are weeks fast every forty
    "fx_walk": (["fx_commit_rows"], """
SELECT repo_id, sha, CASE WHEN r % 40 = 7 THEN committed_date + INTERVAL '30' DAY ELSE committed_date END AS committed_date,
  CASE WHEN r = 1 THEN NULL WHEN r % 11 = 0 THEN split(concat(p1, ',', p5), ',') ELSE split(p1, ',') END AS parents
FROM (SELECT *, row_number() OVER w AS r, lag(sha, 1) OVER w AS p1, lag(sha, 5) OVER w AS p5 FROM fx_commit_rows WINDOW w AS (PARTITION BY repo_id ORDER BY committed_date, sha)) x"""),
    "fx_files_code": (["part"], f"""
SELECT CAST(p_partkey % 25 AS INT) AS repo_id, {CODE_PATH} AS path, {CODE_CONTENT} AS content FROM part"""),
    "fx_python": (["part"], f"""
SELECT CAST(p_partkey % 25 AS INT) AS repo_id, concat('py/m', CAST(p_partkey AS STRING), '.py') AS path, {PYTHON_CONTENT} AS content FROM part"""),
    "fx_files_docs": (["documents"], """
SELECT CAST(doc_id % 25 AS INT) AS repo_id, concat('docs/', lang, '/', CAST(doc_id AS STRING), '.md') AS path, text AS content FROM documents"""),
    "fx_files_root": (["fx_seed"], """
SELECT repo_id, 'requirements.txt' AS path, concat('# deps', chr(10), '-r base.txt', chr(10), 'FastAPI==0.1', chr(10), 'scikit-learn>=1', chr(10), CASE WHEN repo_id % 2 = 0 THEN 'celery' ELSE 'torch' END, chr(10)) AS content FROM fx_seed WHERE repo_id % 3 <> 2
UNION ALL SELECT repo_id, 'pyproject.toml' AS path, concat('[project]', chr(10), 'dependencies = [', chr(10), '  "Pydantic>=2",', chr(10), '  "numpy",', chr(10), ']', chr(10), 'x = "y"', chr(10)) AS content FROM fx_seed WHERE repo_id % 4 = 0
UNION ALL SELECT repo_id, 'package.json' AS path, concat('{"dependencies":{"react":"18","n', CAST(repo_id AS STRING), '":"1"},"devDependencies":{"typescript":"5"}', CASE WHEN repo_id % 10 = 3 THEN '' ELSE '}' END) AS content FROM fx_seed WHERE repo_id % 5 IN (1,3)
UNION ALL SELECT repo_id, 'go.mod' AS path, concat('module m', chr(10), 'require github.com/a/b v1', chr(10), 'require (', chr(10), chr(9), 'github.com/gin-gonic/gin v1', chr(10), chr(9), '// c', chr(10), ')', chr(10)) AS content FROM fx_seed WHERE repo_id % 7 = 1
UNION ALL SELECT repo_id, 'Cargo.toml' AS path, concat('[package]', chr(10), 'name = "p"', chr(10), '[dependencies]', chr(10), 'tokio = "1"', chr(10), '# k = v', chr(10), '[dev-dependencies]', chr(10), 'axum = "0"', chr(10)) AS content FROM fx_seed WHERE repo_id % 7 = 2
UNION ALL SELECT repo_id, 'Gemfile' AS path, concat('source :x', chr(10), 'gem "rails", "7"', chr(10), 'gem ', chr(39), 'puma', chr(39), chr(10)) AS content FROM fx_seed WHERE repo_id % 7 = 3
UNION ALL SELECT repo_id, 'README.md' AS path, concat('# ', label, chr(10), chr(10), '![b](x)', chr(10), '  A service for ', lower(label), '. Install, usage, api, license.', chr(10), repeat(concat('line', chr(10)), CAST(repo_id % 40 * 6 AS INT)), '[![ci](y)](z)') AS content FROM fx_seed WHERE repo_id % 6 <> 5
UNION ALL SELECT repo_id, 'README.txt' AS path, concat('plain ', label) AS content FROM fx_seed WHERE repo_id % 12 IN (3, 5)
UNION ALL SELECT repo_id, 'CHANGELOG.md' AS path, 'v1' AS content FROM fx_seed WHERE repo_id % 2 = 0
UNION ALL SELECT repo_id, '.github/workflows/ci.yml' AS path, 'on: push' AS content FROM fx_seed WHERE repo_id % 3 = 0
UNION ALL SELECT repo_id, 'Dockerfile' AS path, 'FROM x' AS content FROM fx_seed WHERE repo_id % 4 = 1
UNION ALL SELECT repo_id, 'app/service.rb' AS path, concat('# ', label, chr(10), repeat(CASE CAST(repo_id % 6 AS INT)
  WHEN 0 THEN 'rate limit, rate-limiter and shard by partition; pipeline of streams' WHEN 1 THEN 'latency and throughput, optimised; full-text search index'
  WHEN 2 THEN 'failover, backup, SLA; live   update of the booking hotel flight' WHEN 3 THEN 'Patient health record, Doctor appointment; OAuth login token, S3 upload'
  WHEN 4 THEN 'shopping cart checkout with Stripe, PayPal and an order' ELSE 'CI/CD with GitHub actions, docker, kubernetes; unit-test coverage' END, CAST(repo_id % 4 + 1 AS INT)), chr(10)) AS content FROM fx_seed WHERE repo_id % 11 <> 0
UNION ALL SELECT repo_id, CASE CAST(repo_id % 3 AS INT) WHEN 0 THEN 'src/app.py' WHEN 1 THEN 'lib/models.py' ELSE 'server.py' END AS path, concat('import requests', chr(10), 'import pytest', chr(10),
  repeat(concat('def f():', chr(10), '    ', repeat(chr(34),3), 'doc', repeat(chr(34),3), chr(10), '    if a: return 1', chr(10)), CAST(repo_id % 5 AS INT)), '# ', label, chr(10)) AS content FROM fx_seed WHERE repo_id % 7 <> 6
UNION ALL SELECT repo_id, 'web/app.test.ts' AS path, concat('import { test } from "vitest"', chr(10), 'import fp from "lodash/fp"', chr(10), 'describe("', label, '", () => { it("works") })', chr(10)) AS content FROM fx_seed WHERE repo_id % 6 = 2
UNION ALL SELECT repo_id, 'domain/core/.keep/setup.cfg' AS path, label AS content FROM fx_seed WHERE repo_id % 9 = 4"""),
    "fx_files": (["fx_files_code", "fx_files_docs", "fx_files_root"], """
SELECT repo_id, path, content FROM fx_files_code UNION ALL SELECT repo_id, path, content FROM fx_files_docs UNION ALL SELECT repo_id, path, content FROM fx_files_root"""),
    "fx_commit_files": (["lineitem", "part", "fx_commit_rows"], """
SELECT c.repo_id, c.sha, l.l_linenumber AS file_pos, concat('src/m', CAST(l.l_partkey AS STRING), CASE CAST(p.p_size % 4 AS INT) WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.ts' ELSE '.txt' END) AS path,
 CASE l.l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'R' ELSE 'M' END AS change_type,
 CAST(floor(l.l_quantity) AS INT) AS insertions, CAST(floor(l.l_discount * 100 + 0.5) AS INT) AS deletions,
 repeat(concat('+', p.p_name, chr(10)), CAST(floor(l.l_quantity * 2) AS INT)) AS diff
FROM lineitem l JOIN fx_commit_rows c ON c.sha = lpad(CAST(l.l_orderkey AS STRING), 40, '0') JOIN part p ON p.p_partkey = l.l_partkey"""),
    "fx_profiles": (["documents", "orders"], """
SELECT concat(lang, '_', CAST(doc_id AS STRING)) AS name,
  concat('# ', source, chr(10), '## Summary', chr(10), CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('### Skills', chr(10)) END, text) AS content,
  o_orderdate AS modified, CAST(doc_id % 4 AS INT) AS repo_count, doc_id % 5 <> 0 AS has_metadata
FROM documents JOIN orders ON o_orderkey = doc_id"""),
    "fx_stories": (["fx_commit_rows", "fx_commit_files", "fx_repos"], """
SELECT c.sha AS story_id, max(r.name) AS repo_name, max(c.message) AS summary,
  CASE CAST(CAST(c.sha AS BIGINT) % 3 AS INT) WHEN 0 THEN split('Python,Go', ',') WHEN 1 THEN split('TypeScript', ',') ELSE split('Rust,python,SQL', ',') END AS technologies,
  count(*) AS files_changed, CAST(sum(f.insertions) AS BIGINT) AS lines_added, CAST(sum(f.deletions) AS BIGINT) AS lines_removed,
  max(c.committed_date) AS last_commit_at
FROM fx_commit_rows c JOIN fx_commit_files f ON f.sha = c.sha JOIN fx_repos r ON r.repo_id = c.repo_id GROUP BY c.sha"""),
    "fx_listing": (["fx_repos"], f"""
SELECT concat(path, tail) AS path FROM fx_repos JOIN (VALUES {LISTING_ROWS}) AS v(k, tail) ON repo_id % 8 = k"""),
    "fx_tracked": (["fx_repos", "orders"], """
SELECT CASE WHEN repo_id % 3 = 1 THEN concat(path, '-gone') ELSE path END AS path, last_sync
FROM fx_repos LEFT JOIN (SELECT o_orderkey, o_orderdate AS last_sync FROM orders WHERE o_orderkey % 4 <> 0) o ON o_orderkey = repo_id"""),
}


# The same rows for Spark, joined by order number rather than by the padded text of it: numbers sort and shuffle far cheaper, and no
# table of commits or lines is broadcast, small as its file may be. File changes meet their commits as sums.
KEYED = FIXTURES | {
    "fx_commit_rows": (["orders", "customer"], FIXTURES["fx_commit_rows"][1].replace("SELECT ", "SELECT o.o_orderkey AS order_no, ", 1)),
    "fx_commit_files": (["lineitem", "part", "fx_commit_rows"], FIXTURES["fx_commit_files"][1].partition("FROM lineitem")[0].replace(
        "SELECT ", "SELECT /*+ MERGE(l, p, c) */ c.order_no, ", 1) + """FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN fx_commit_rows c ON c.order_no = l.l_orderkey"""),
    "fx_stories": (["fx_commit_rows", "fx_commit_files", "fx_repos"], FIXTURES["fx_stories"][1].partition("  count(*)")[0].replace(
        "SELECT ", "SELECT /*+ MERGE(c, f) */ ", 1) + """  sum(f.n) AS files_changed, sum(f.insertions) AS lines_added, sum(f.deletions) AS lines_removed, max(c.committed_date) AS last_commit_at
FROM fx_commit_rows c JOIN (SELECT order_no, count(*) AS n, sum(insertions) AS insertions, sum(deletions) AS deletions FROM fx_commit_files GROUP BY order_no) f
  ON f.order_no = c.order_no JOIN fx_repos r ON r.repo_id = c.repo_id GROUP BY c.order_no, c.sha"""),
}


def with_clause(names, base=None, views=FIXTURES) -> str:
    """``WITH`` list of the views and all they read; ``base`` says how to read a given table."""
    done: dict[str, str] = {}

    def add(name):
        if name in done or (base is None and name in BASE):
            return
        if name in BASE:
            done[name] = base(name)
            return
        needs, sql = views[name]
        for need in needs:
            add(need)
        done[name] = sql

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in done.items())


class StoredTables:
    """Derived tables that were written before, one Parquet folder each."""

    def __init__(self, spark: SparkSession, folder: str, stored: str):
        self.spark, self.folder = spark, folder
        for name in ("files", "repos", "commits", "commit_files", "profiles", "stories", "listing", "tracked"):
            setattr(self, name, spark.read.parquet(f"{stored}/{name}"))


class Tables:
    """The tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def fixture(self, name: str, views=FIXTURES) -> DataFrame:
        # a few bytes of a part make a file's text, so its rows are dealt out before they grow: the table may be one small file
        tasks = 4 * self.spark.sparkContext.defaultParallelism
        dealt = {"part": f"/*+ REPARTITION({tasks}) */ "} if name in ("fx_files", "fx_files_code", "fx_python") else {}
        sql = with_clause([name], lambda t: f"SELECT {dealt.get(t, '')}* FROM parquet.`{self.folder}/{t}.parquet`", views)
        return self.spark.sql(f"{sql}\nSELECT * FROM {name}")

    files = cached_property(lambda self: self.fixture("fx_files"))
    repos = cached_property(lambda self: self.fixture("fx_repos"))

    @cached_property
    def commits(self) -> DataFrame:
        order = [F.desc("committed_date"), F.desc("sha")]
        numbered = row_numbers(self.fixture("fx_commit_rows"), ["repo_id"], order, "walk_pos")
        return numbered.withColumn("walk_pos", F.col("walk_pos").cast("int"))

    commit_files = cached_property(lambda self: self.fixture("fx_commit_files", KEYED).drop("order_no"))
    profiles = cached_property(lambda self: self.fixture("fx_profiles"))
    stories = cached_property(lambda self: self.fixture("fx_stories", KEYED))
    listing = cached_property(lambda self: self.fixture("fx_listing"))
    tracked = cached_property(lambda self: self.fixture("fx_tracked"))
