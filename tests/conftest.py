import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablegauge.session import ensure_checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    ensure_checkpoint_dir(session, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    yield session


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture
def frame(spark):
    """Build a DataFrame from (ddl, rows)."""
    return lambda ddl, rows: spark.createDataFrame(rows, ddl)


def one(df):
    return df.first().asDict()


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
