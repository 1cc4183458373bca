import os

import pytest
from compare import compare, connect

import __spark_entry__ as driver
from contactweave.llm import catalog

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def test_operators_are_registered():
    names = [n for n in driver.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_query_against_sql(spark, name):
    assert compare(driver.queries()[name](spark, SMALL), connect(SMALL), driver.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE])
def test_query_covers_its_table(spark, name):
    got = driver.queries()[name](spark, SMALL)
    ids = {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in got.select("doc_id").collect()} == ids
