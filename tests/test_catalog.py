"""Every registered query against its SQL oracle on the smallest tables."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as driver
from contactweave.catalog.oracle import ORACLE
from contactweave.catalog.queries import QUERIES
from contactweave.plans import ordering
from contactweave.sources import sample_tables

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLE) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).count() == 3_762


@pytest.fixture
def large(spark, monkeypatch):
    """Limits so low that every table takes the path of large data."""
    monkeypatch.setattr(ordering, "SMALL", -1)
    monkeypatch.setattr(ordering, "BLOCK", 64)
    monkeypatch.setattr(sample_tables, "_CACHE", {})
    spark.conf.set("spark.contactweave.broadcastBytes", "1")
    yield
    spark.conf.unset("spark.contactweave.broadcastBytes")


LARGE = [
    "contig_offsets", "pixels_10k", "bin_offsets", "zoom_chain", "mask_mad", "rect_balanced", "trans_max",
    "best_neighbors_start", "pairs_all", "adjacent_reads", "pairs_sorted_rank", "dedup_greedy", "gfa_bfs",
]


@pytest.mark.parametrize("name", LARGE)
def test_query_on_the_large_data_path(spark, con, large, name):
    assert compare(driver.queries()[name](spark, SF_DIR), con, driver.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(driver.queries()[name](spark, SF_DIR), con, driver.oracle_sql()[name]) is None
