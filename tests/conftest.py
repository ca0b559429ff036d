import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuslens.session import local_session  # noqa: E402
from corpuslens.sources.corpus import COMMITS_SCHEMA, FILES_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_files(spark):
    """files({path: content}) for repository r, or files([(repo, path, content)])."""
    def build(rows):
        if isinstance(rows, dict):
            rows = [("r", p, c) for p, c in rows.items()]
        return spark.createDataFrame(rows, FILES_SCHEMA)
    return build


@pytest.fixture
def make_commits(spark):
    return lambda rows: spark.createDataFrame(rows, COMMITS_SCHEMA)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
