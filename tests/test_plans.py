"""Plan helpers, with size limits forced low so the large-data paths run."""

import random
import statistics

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from contactweave.errors import ResolutionError
from contactweave.plans import lookups, ordering, storage
from contactweave.plans.zoom_order import checked_zoom_plan, zoom_order


def test_zoom_order_examples():
    assert zoom_order({1000}, [2000, 5000, 10000]) == [(1000, -1), (2000, 0), (5000, 0), (10000, 2)]
    assert zoom_order({1000}, [1500]) == [(1000, -1), (1500, -1)]
    assert zoom_order({1000}, [1000]) == []
    assert zoom_order({1000}, [500]) == []


@given(st.lists(st.integers(1, 40), unique=True, min_size=1), st.lists(st.integers(1, 40), unique=True, min_size=1))
@settings(max_examples=200, deadline=None)
def test_zoom_plan_steps_divide_and_are_ready(have, want):
    try:
        steps = checked_zoom_plan(have, want)
    except ResolutionError:
        return
    ready = set(have)
    for source, target in steps:
        assert source in ready and target % source == 0
        assert source == max(r for r in set(have) | set(want) if r < target and target % r == 0)
        ready.add(target)
    assert ready == set(have) | set(want)


def test_zoom_plan_rejects_bad_requests():
    for want in ([1000], [500], [1500], [2000, 2000]):
        with pytest.raises(ResolutionError):
            checked_zoom_plan([1000], want)
    assert checked_zoom_plan([1000], []) == []


@pytest.mark.parametrize("n_keys", [None, 500])
def test_prefix_sum_by_blocks(spark, n_keys, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 16)
    values = [random.Random(3).randint(0, 9) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "k bigint, v bigint").repartition(7)
    got = ordering.prefix_sum(df, "k", "v", "s", n_keys).orderBy("k").collect()
    assert [r.s for r in got] == [sum(values[:i]) for i in range(500)]


def test_global_rank_large_path(spark):
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.4 else rng.randint(0, 50), i) for i in range(2000)]  # b is unique
    df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(5)
    got = ordering.global_rank(df, ["a", "b"], "r").collect()
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.r)] == sorted(rows)
    assert sorted(x.r for x in got) == list(range(2000))


def test_copies_are_spread_over_partitions(spark):
    copies = storage.materialize(spark.range(3000).select(F.lit(7).alias("a")), "copies")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")  # tiny partitions would be joined again
    try:
        ranked = ordering.global_rank(copies, ["a"], "r", copies=True)
    finally:
        spark.conf.unset(merging)
    assert sorted(r.r for r in ranked.collect()) == list(range(3000))
    assert len(ranked.inputFiles()) > 4


def test_median_of_small_groups_needs_no_global_order(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SMALL", 10)
    monkeypatch.setattr(ordering, "global_rank", None)
    rows = [(g, float(g * k)) for g in range(20) for k in range(1 + g % 6)]
    df = spark.createDataFrame(rows, "g bigint, x double")
    got = {r.g: r.m for r in ordering.exact_median(df, "x", "g", "m", len(rows), 20, n_in_group=6).collect()}
    assert got == {g: statistics.median(x for h, x in rows if h == g) for g in range(20)}


@pytest.mark.parametrize("n_rows", [None, 10])
def test_exact_median(spark, n_rows):
    assert ordering.exact_median(
        spark.createDataFrame([(v,) for v in (1.0, 2.0, 5.0, 9.0)], "x double"), "x", None, "m", n_rows
    ).first()["m"] == 3.5
    rng = random.Random(9)
    rows = [(g, float(rng.randint(0, 6))) for g in range(7) for _ in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "g bigint, x double").repartition(4)
    got = {r.g: r.m for r in ordering.exact_median(df, "x", "g", "m", n_rows, 7).collect()}
    assert got == {g: statistics.median(x for h, x in rows if h == g) for g in range(7)}


def test_median_of_nothing_has_no_value(spark):
    empty = spark.createDataFrame([], "x double")
    for n_rows in (None, 0):
        row = ordering.exact_median(empty, "x", None, "m", n_rows).first()
        assert row is None or row["m"] is None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_salts_past_the_budget(spark, how):
    facts = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(300)], "k bigint, v bigint")
    dim = spark.createDataFrame([(0, "a"), (2, "b")], "k bigint, name string")
    plain = facts.join(dim, "k", how).collect()
    small = lookups.lookup(facts, dim, {"k": "k"}, 2, how)
    large = lookups.lookup(facts, dim, {"k": "k"}, 1 << 40, how)
    assert "_salt" not in large.columns
    assert sorted(map(tuple, large.collect()), key=str) == sorted(map(tuple, plain), key=str)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, plain), key=str)
    explained = large._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in explained


@pytest.mark.parametrize("heavy", [20, 1 << 40])
def test_a_table_past_the_budget_is_not_broadcast_for_looking_small(spark, monkeypatch, heavy):
    monkeypatch.setattr(lookups, "HEAVY_ROWS", heavy)
    facts = spark.range(300).selectExpr("id % 3 as k", "id as v")
    dim = spark.range(1).selectExpr("explode(sequence(0, 5000)) as k", "'x' as name")
    large = lookups.lookup(facts, dim, {"k": "k"}, 1 << 40)
    assert large.count() == 300
    assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()


def test_scratch_folder_comes_from_the_session(spark):
    stored = storage.materialize(spark.range(3).toDF("x"), "t")
    assert stored.count() == 3
    assert all(spark.conf.get("spark.checkpoint.dir") in f for f in stored.inputFiles())


def test_alternating_table_reads_while_it_writes(spark):
    table = storage.AlternatingTable(spark, "loop")
    df = table.replace(spark.range(5).toDF("x"))
    for _ in range(4):
        df = table.replace(df.select((F.col("x") + 1).alias("x")))
    assert sorted(r.x for r in df.collect()) == [4, 5, 6, 7, 8]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_heavy_keys_are_split_by_their_count(spark, monkeypatch, how):
    monkeypatch.setattr(lookups, "HEAVY_ROWS", 20)
    facts = spark.createDataFrame([(0 if i % 3 else i % 7, i % 50) for i in range(600)], "k bigint, v bigint")
    dim = spark.createDataFrame([(0, "a"), (2, "b"), (5, "c")], "k bigint, name string")
    plain = facts.join(dim, "k", how).collect()
    large = lookups.lookup(facts, dim, {"k": "k"}, 1 << 40, how)
    assert not {"_salt", "_parts", "_dim_salt"} & set(large.columns)
    assert sorted(map(tuple, large.collect()), key=str) == sorted(map(tuple, plain), key=str)


def test_small_and_large_ranks_agree_and_stay(spark):
    df = spark.createDataFrame([(i % 4, i) for i in range(200)], "a bigint, b bigint").repartition(5)
    small = ordering.global_rank(df, ["a"], "r", n_rows=200, copies=True)
    assert sorted(small.collect()) == sorted(small.collect())
    want = ordering.global_rank(df, ["a", "b"], "r")
    assert sorted(map(tuple, ordering.global_rank(df, ["a", "b"], "r", 200).collect())) == sorted(map(tuple, want.collect()))
    for n_rows in (None, 0):
        assert ordering.exact_median(spark.createDataFrame([], "x double"), "x", None, "m", n_rows).collect() == [(None,)]


def test_a_rank_stores_only_the_columns_asked_for(spark, monkeypatch):
    from contactweave.plans import ordering

    df = spark.createDataFrame([(3, "x", 1), (1, "y", 2), (1, "z", 1)], "a long, b string, c long")
    for small in (ordering.SMALL, -1):
        monkeypatch.setattr(ordering, "SMALL", small)
        ranked = ordering.global_rank(df, ["a", "c"], "at", 3, keep=["b"])
        assert ranked.columns == ["b", "at"]
        assert sorted(map(tuple, ranked.collect())) == [("x", 2), ("y", 1), ("z", 0)]
