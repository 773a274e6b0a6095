import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codelode.session import local_session  # noqa: E402

FILES = "repo_id int, path string, content string"
COMMITS = (
    "repo_id int, sha string, author_email string, author_name string, committed_date timestamp_ntz, message string, "
    "walk_pos int"
)


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "4g")


@pytest.fixture
def files(spark):
    """Build a files table from {path: content} of one repository, or from (repo, path, content) rows."""

    def build(rows):
        if isinstance(rows, dict):
            rows = [(1, path, content) for path, content in rows.items()]
        return spark.createDataFrame(rows, FILES)

    return build


@pytest.fixture
def commits(spark):
    """Build a commits table of one repository from messages, newest first."""

    def build(messages, repo_id=1, start_day=28):
        import datetime as dt

        rows = [
            (repo_id, f"{i:040d}", f"u{i % 3}@x.org", f"User {i % 3}", dt.datetime(2024, 1, start_day) - dt.timedelta(days=i), m, i + 1)
            for i, m in enumerate(messages)
        ]
        return spark.createDataFrame(rows, COMMITS)

    return build


@pytest.fixture
def repos(spark):
    def build(ids=(1,)):
        return spark.createDataFrame(
            [(i, f"repo{i}", f"/code/repo{i}", None, "u1@x.org", "User 2") for i in ids],
            "repo_id int, name string, path string, remote_url string, user_email string, user_name string",
        )

    return build
