"""Headline timings on one machine; prints one JSON line.

The derived tables are written once, outside the timing, as a lake of repositories would hold them;
every query then runs to a full result in the ``noop`` sink.
"""

import json
import os
import sys
import tempfile
import time

from codelode.session import local_session
from registry.fixtures import StoredTables, Tables
from registry.queries import QUERIES

HEADLINES = [
    "repo_code_overview", "file_metrics", "repo_analysis", "features", "feature_evidence", "highlights", "frameworks",
    "api_endpoints", "search_code", "file_tree", "project_type", "dependencies", "repo_info", "contributor_stats",
    "commit_stats", "commits_with_diffs", "commit_prompt_blocks", "achievements", "numbered_commits", "changed_repos",
]


def store(tables: Tables, folder: str) -> None:
    for name in ("files", "repos", "commits", "commit_files", "profiles", "stories", "listing", "tracked"):
        getattr(tables, name).write.parquet(f"{folder}/{name}")


def main():
    source = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINES
    spark = local_session(cpus)
    stored = tempfile.mkdtemp(prefix="run-bench-")
    store(Tables(spark, source), stored)
    tables = StoredTables(spark, source, stored)
    sizes = {n: getattr(tables, n).count() for n in ("files", "commits", "commit_files")}
    QUERIES["python_metrics"](tables).write.format("noop").mode("overwrite").save()  # starts the Python workers
    seconds = {}
    for name in wanted:
        start = time.time()
        QUERIES[name](tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(source.rstrip("/")).removeprefix("sf"), "rows": sizes, "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
