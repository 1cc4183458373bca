"""Sorting and duplicate removal against a plain sequential scan."""

import random

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from contactweave.operators import dedup as dd

SCHEMA = "read_name string, tig1 string, pos1 bigint, tig2 string, pos2 bigint, strand1 string, strand2 string, ord bigint"


def df_of(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)


def scan(rows, n, greedy):
    """Names a sorted scan keeps."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], rows[i][3], rows[i][2], rows[i][4], i))
    seen, kept = [], []
    for i in order:
        r = rows[i]
        clash = any(
            (r[1], r[3], r[5], r[6]) == (e[1], e[3], e[5], e[6]) and abs(r[2] - e[2]) <= n and abs(r[4] - e[4]) <= n
            for e in seen
        )
        if not clash:
            kept.append(r[0])
        if not clash or not greedy:
            seen.append(r)
    return sorted(kept)


def names(df):
    return sorted(r.read_name for r in df.collect())


FIRST = [
    ("a", "c1", 100, "c2", 200, "+", "+"), ("b", "c1", 101, "c2", 202, "+", "+"), ("c", "c1", 102, "c2", 203, "-", "+"),
    ("d", "c1", 104, "c2", 204, "+", "+"), ("e", "c1", 500, "c2", 900, "+", "+"),
]
SECOND = [
    ("a", "c1", 100, "c2", 200, "+", "+"), ("b", "c1", 101, "c2", 201, "-", "+"), ("c", "c1", 200, "c2", 300, "+", "+"),
    ("d", "c1", 201, "c2", 9000, "+", "+"), ("e", "c1", 900, "c2", 950, "+", "+"), ("f", "c1", 990, "c2", 995, "+", "+"),
]


def test_examples(spark):
    assert names(dd.dedup_pairs(df_of(spark, FIRST))) == ["a", "c", "d", "e"]
    assert names(dd.dedup_pairs(df_of(spark, FIRST), mode="any_earlier")) == ["a", "c", "e"]
    assert names(dd.dedup_pairs(df_of(spark, SECOND))) == list("abcdef")
    with pytest.raises(ValueError):
        dd.dedup_pairs(df_of(spark, FIRST), mode="other")
    with pytest.raises(ValueError):
        dd.dedup_pairs(df_of(spark, FIRST), -1)


def crowded(seed, n, span):
    rng = random.Random(seed)
    return [
        (f"r{i}", rng.choice("AAAB"), rng.randint(0, span), rng.choice("AB"), rng.randint(0, span), rng.choice("+-"), "+")
        for i in range(n)
    ]


@pytest.mark.parametrize("mode", dd.MODES)
@pytest.mark.parametrize("n", [0, 1, 3, 40])
def test_crowded_pairs_match_the_scan(spark, mode, n):
    rows = crowded(n, 600, 90)
    got = dd.dedup_pairs(df_of(spark, rows), n, mode)
    assert names(got) == scan(rows, n, mode == "greedy")
    assert got.columns == SCHEMA.replace(" string", "").replace(" bigint", "").split(", ")


def test_greedy_twice_changes_nothing(spark):
    rows = crowded(8, 400, 60)
    once = dd.dedup_pairs(df_of(spark, rows))
    assert names(dd.dedup_pairs(once)) == names(once)


def test_copies_of_one_place_keep_the_first(spark):
    rows = [("r%d" % i, "A", 5, "B", 6, "+", "-") for i in range(500)]
    assert names(dd.dedup_pairs(df_of(spark, rows))) == ["r0"]
    cells = dd.near_earlier(dd.distinct_places(df_of(spark, rows)), 3)
    assert cells.count() == 0


@pytest.mark.parametrize("n", [1, 3, 40])
def test_conflicts_meet_over_the_edges_of_cells(spark, n):
    """Places around the corners of cells, below zero as well, with copies; those with a null conflict with nothing."""
    rng, cell = random.Random(n), max(dd._CELL, 4 * n)
    near = lambda: rng.choice([-cell, 0, cell, 2 * cell]) + rng.randint(-n - 1, n + 1)
    rows = [(f"r{i}", rng.choice("AB"), near(), "B", near(), rng.choice("+-"), "+") for i in range(400)]
    odd = [("n1", "A", None, "B", 0, "+", "+"), ("n2", "A", None, "B", 1, "+", "+"), ("n3", None, 0, "B", 0, "+", "+"), ("n4", None, 1, "B", 1, "+", "+")]
    odd += [("n5", "A", None, "B", 0, "+", "+"), ("n6", "A", 0, "B", None, "+", "+"), ("n7", "A", 1, "B", None, "+", "+"), ("n8", "A", 0, "B", 0, None, "+")]
    got = dd.dedup_pairs(df_of(spark, rows + odd), n, "any_earlier")
    assert names(got) == sorted(scan(rows, n, False) + ["n1", "n2", "n3", "n4", "n6", "n7", "n8"])
    places = dd.distinct_places(df_of(spark, rows + odd)).collect()
    want = {
        (a.ord, b.ord)
        for a in places for b in places
        if None not in (*a[:6], *b[:6]) and a[:4] == b[:4] and 0 <= a.pos1 - b.pos1 <= n and abs(a.pos2 - b.pos2) <= n and (b.pos1, b.pos2) < (a.pos1, a.pos2)
    }
    found = dd.near_earlier(dd.distinct_places(df_of(spark, rows + odd)), n).collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_any_earlier_shuffles_pairs_by_place_and_by_cell_alone(spark):
    kept = dd.dedup_pairs(df_of(spark, crowded(2, 300, 60)), 3, "any_earlier")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_positions_below_zero(spark):
    rows = [("a", "A", -1, "A", -1, "+", "+"), ("b", "A", 1, "A", -4, "+", "+"), ("c", "A", 3, "A", 2, "+", "+")]
    assert names(dd.dedup_pairs(df_of(spark, rows))) == scan(rows, 3, True)


def test_sort(spark):
    rows = crowded(1, 300, 20)
    want = [i for i in sorted(range(300), key=lambda i: (rows[i][1], rows[i][3], rows[i][2], rows[i][4], i))]
    df = df_of(spark, rows).repartition(5)
    assert [r.ord for r in dd.sort_pairs(df).collect()] == want
    for n_rows in (None, 300):
        assert [r.ord for r in dd.rank_pairs(df, n_rows).orderBy("sort_rank").collect()] == want


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.sampled_from("+-")), min_size=1, max_size=25))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_any_small_input(spark, places):
    rows = [(f"r{i}", "A", a, "A", b, s, "+") for i, (a, b, s) in enumerate(places)]
    assert names(dd.dedup_pairs(df_of(spark, rows), 2)) == scan(rows, 2, True)


def test_a_long_chain_takes_a_few_rounds(spark, monkeypatch):
    rounds = []
    real = dd.new_scratch_path
    monkeypatch.setattr(dd, "new_scratch_path", lambda s, label: rounds.append(label) or real(s, label))
    rows = [(f"r{i}", "a", i, "b", i, "+", "+") for i in range(400)]
    assert names(dd.dedup_pairs(df_of(spark, rows), 3)) == scan(rows, 3, True)
    assert rounds.count("ranges") <= 12


def test_pairs_out_of_reach_take_one_round(spark, monkeypatch):
    rounds = []
    real = dd.new_scratch_path
    monkeypatch.setattr(dd, "new_scratch_path", lambda s, label: rounds.append(label) or real(s, label))
    rows = [(f"r{i}", "a", 10 * i, "b", i % 7, "+", "+") for i in range(400)]
    assert len(names(dd.dedup_pairs(df_of(spark, rows), 3))) == 400
    assert rounds.count("ranges") == 1


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_scan_holds_the_window_alone(size):
    rng = random.Random(size)
    keys = [("a", "b", "+", "+"), ("a", "c", "+", "-")]
    places = sorted({(p, rng.choice(keys), rng.randint(0, 400), rng.randint(0, 30)) for p in (0, 1, 4) for _ in range(700)})
    rows = [(p, True, *k, a, b, i, False) for i, (p, k, a, b) in enumerate(places)]
    held = []
    real = dd._Window.keep

    def keep(self, a, b):
        real(self, a, b)
        held.append(len(self.cells))

    dd._Window.keep, least = keep, dd._WINDOW_LEAST
    dd._WINDOW_LEAST = 4
    try:
        table = pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), dd._RANGE)], [n for n, _ in dd._RANGE])
        out = pa.Table.from_batches(dd.scan_ranges(iter(table.to_batches(max_chunksize=size)), 2)).to_pylist()
    finally:
        dd._Window.keep, dd._WINDOW_LEAST = real, least
    kept, want = [], set()
    for p, k, a, b in places:
        if any(q == (p, k) and a - c <= 2 and abs(b - d) <= 2 for q, c, d in kept):
            want.add((p, k, a, b))
        else:
            kept.append(((p, k), a, b))
    place = lambda r: (r["part"], tuple(r[k] for k in dd._KEYS), r["pos1"], r["pos2"])
    assert {place(r) for r in out if r["dropped"]} == want
    assert sum(r["own"] for r in out) == len(rows)
    ends = {p: max(x for x in places if x[0] == p) for p in (0, 1, 4)}
    carried = sorted(place(r) for r in out if not r["own"])
    assert carried == sorted((p, k, a, b) for (p, k), a, b in kept if ends[p][1] == k and ends[p][2] - a <= 2)
    assert max(held) <= 30


def test_chains_cross_ranges(spark):
    rng = random.Random(3)
    rows = [(f"r{i}", rng.choice("ab"), rng.randint(0, 300), "c", rng.randint(0, 12), rng.choice("+-"), "+") for i in range(900)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 3, 7):
            assert names(dd.dedup_pairs(df_of(spark, rows), n)) == scan(rows, n, True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
