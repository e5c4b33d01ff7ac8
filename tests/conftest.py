import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelwright.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8")
    yield session
    session.stop()


@pytest.fixture
def many_pieces(spark):
    """Small partitions stay apart, so that steps across partitions really cross them."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


@pytest.fixture(scope="session")
def tables(spark):
    from panelwright.plans.catalog import Tables

    return Tables(spark, SMALL)


def rows(df):
    """Rows as sorted tuples of text, for order-free comparison."""
    return sorted(tuple(map(str, r)) for r in df.collect())
