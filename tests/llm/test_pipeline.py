import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import odd_rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from contactweave.plans.storage import materialize  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.oracle_sql()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    before = docs.count()
    names = []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SMALL), name)
        names.append(name)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            after = {r.doc_id for r in out.select("doc_id").collect()}
            lost = {r.doc_id for r in docs.select("doc_id").collect()} - after
            if name in ("quality_classifier", "quality_rules"):
                assert sum(quality.get(k) == 1 for k in lost) <= 1
            docs = out
    assert names == ["quality_classifier", "quality_rules", "near_dedup", "pii", "packing"]
    assert docs.count() < before and not any(quality.get(r.doc_id) == 0 for r in docs.select("doc_id").collect())
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, empty):
    docs = odd_rows.nothing(spark) if empty else odd_rows.documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SMALL), name)
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    assert out.isEmpty() == docs.isEmpty()
