from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shelfmark.session import build_session

    session = build_session("local[*]", 8, app_name="shelfmark-tests", extra={
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="shelfmark-test-ckpt-"),
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="shelfmark-test-warehouse-"),
        "spark.sql.autoBroadcastJoinThreshold": "10485760",
    })
    yield session
    session.stop()


@pytest.fixture(scope="session")
def seed(spark):
    from seeds import make_tables

    return make_tables(spark)


def rows(df, *cols):
    """Collected rows as plain tuples of the given columns (all when none given)."""
    cols = cols or tuple(df.columns)
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
