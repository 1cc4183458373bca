"""Sorting contact pairs and removing duplicates within a base-pair tolerance."""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.ordering import global_rank
from ..plans.storage import materialize, new_scratch_path

MAX_MISMATCH = 3
MODES = ("greedy", "any_earlier")
ORDER = ["tig1", "tig2", "pos1", "pos2", "ord"]

_PLACE = ["tig1", "tig2", "strand1", "strand2", "pos1", "pos2"]
_KEYS = ["tig1", "tig2", "strand1", "strand2"]
_CELL = 128  # least cell width; with the usual tolerance a place in 14 goes to a second cell


def sort_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs by contig names (byte order), positions, then input order ``ord``."""
    return pairs.orderBy(*ORDER)


def rank_pairs(pairs: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Pairs with ``sort_rank``, their 0-based place in the sorted order."""
    return global_rank(pairs, ORDER, "sort_rank", n_rows)


def distinct_places(pairs: DataFrame) -> DataFrame:
    """First pair (smallest ``ord``) at each exact place.

    Copies at one place share their fate: whatever removes the first also
    removes the rest, and otherwise the first itself does.
    """
    names = [c for c in pairs.columns if c not in (*_PLACE, "ord")]
    return pairs.groupBy(*_PLACE).agg(
        F.min("ord").alias("ord"), *[F.min_by(c, "ord").alias(c) for c in names]
    )


def with_earlier(places: DataFrame, max_mismatch: int) -> DataFrame:
    """Places with ``earlier``: what the places sorted before each that it conflicts with are called by ``ord``.

    Both lie on the same contigs and strands and within ``max_mismatch`` at
    each position; a place with a null conflicts with nothing.  Places are dealt
    by the cells of a grid, those near an edge to the next cells as well, so one
    shuffle brings together all that can conflict, and a place leaves it whole.
    After copies are gone a cell holds at most its number of grid points,
    whatever the data.
    """
    n, cell = max_mismatch, max(_CELL, 4 * max_mismatch)
    at = lambda x: f"floor(({x}) / {cell})"
    cells1 = F.expr(f"array_distinct(array({at('pos1')}, {at(f'pos1 + {n}')}))")
    cells2 = F.expr(f"array_distinct(array({at('pos2')}, {at(f'pos2 - {n}')}, {at(f'pos2 + {n}')}))")
    dealt = places.withColumn("_c1", F.explode(cells1)).withColumn("_c2", F.explode(cells2))
    reach = Window.partitionBy(*_KEYS, "_c1", "_c2").orderBy("pos1").rangeBetween(-n, 0)
    held = dealt.withColumn("_held", F.collect_list(F.struct("pos1", "pos2", "ord")).over(reach))
    held = held.where(f"{at('pos1')} <=> _c1 and {at('pos2')} <=> _c2")  # each place once, in its own cell
    whole = functools.reduce(operator.and_, [F.col(k).isNotNull() for k in _PLACE])
    conflicts = F.expr(f"filter(_held, x -> abs(pos2 - x.pos2) <= {n} and (x.pos1 < pos1 or x.pos2 < pos2))")
    earlier = F.when(whole, F.transform(conflicts, lambda x: x["ord"])).otherwise(F.array().cast("array<bigint>"))
    return held.select(*places.columns, earlier.alias("earlier"))


def near_earlier(places: DataFrame, max_mismatch: int) -> DataFrame:
    """Conflicts between places: ``ord`` of a pair, ``earlier`` of one sorted before it."""
    return with_earlier(places, max_mismatch).select("ord", F.explode("earlier").alias("earlier"))


def dedup_pairs(
    pairs: DataFrame, max_mismatch: int = MAX_MISMATCH, mode: str = "greedy"
) -> DataFrame:
    """Pairs without duplicates; ``ord`` must be unique.

    ``greedy`` scans in sorted order and drops a pair if an earlier *kept* pair
    on the same contigs and strands lies within the tolerance at both ends.
    ``any_earlier`` drops it if any earlier pair does.

    The greedy scan streams through ranges of the sorted pairs, one range a
    task.  Where a range starts within the tolerance of the one before, it is
    scanned again with what that one kept; only ranges for which that changed
    take part in a further round.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if max_mismatch < 0:
        raise ValueError("max_mismatch must not be negative")
    places = distinct_places(pairs)
    if max_mismatch == 0:
        return places.select(*pairs.columns)
    if mode == "any_earlier":
        return with_earlier(places, max_mismatch).where(F.size("earlier") == 0).select(*pairs.columns)
    places = materialize(places, "places")
    dropped = _greedy_drops(places, max_mismatch)
    return places.join(dropped, "ord", "left_anti").select(*pairs.columns)


_RANGE = [("part", pa.int32()), ("own", pa.bool_())] + [(k, pa.string()) for k in _KEYS]
_RANGE += [("pos1", pa.int64()), ("pos2", pa.int64()), ("ord", pa.int64()), ("dropped", pa.bool_())]
_RANGE_DDL = "part int, own boolean, tig1 string, tig2 string, strand1 string, strand2 string, pos1 bigint, pos2 bigint, ord bigint, dropped boolean"
_WINDOW_LEAST = 1_024


class _Window:
    """Kept pairs of one group that a pair at the current place can still conflict with.

    Cells are one tolerance wide in pos2.  Of two kept pairs in a cell the
    earlier one is out of reach, so a cell holds one.
    """

    def __init__(self, n: int):
        self.n, self.most = n, _WINDOW_LEAST
        self.cells: dict[int, tuple[int, int]] = {}

    def hit(self, pos1: int, pos2: int) -> bool:
        cell, n = pos2 // (self.n + 1), self.n
        for c in (cell - 1, cell, cell + 1):
            k = self.cells.get(c)
            if k and pos1 - k[0] <= n and -n <= pos2 - k[1] <= n:
                return True
        return False

    def keep(self, pos1: int, pos2: int) -> None:
        self.cells[pos2 // (self.n + 1)] = pos1, pos2
        if len(self.cells) > self.most:
            self.cells = {c: k for c, k in self.cells.items() if pos1 - k[0] <= self.n}
            self.most = max(_WINDOW_LEAST, 2 * len(self.cells))


def scan_ranges(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows with ``dropped``, and behind each range what it kept within ``n`` of its last place.

    Rows that are not ``own`` are what the range before kept; they come first.
    Pairs with no other in reach are kept without being looked at one by one,
    and only the window of the others is held.
    """
    window, last = _Window(n), None

    def carry() -> pa.RecordBatch:
        part, keys, end = last
        rows = [(part, False, *keys, *k, None, False) for k in sorted(window.cells.values()) if end - k[0] <= n]
        columns = zip(*rows) if rows else [[] for _ in _RANGE]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _RANGE)], [c for c, _ in _RANGE])

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column("part").to_numpy()
        for at, end in itertools.pairwise([0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]):
            rows = batch.slice(at, end - at)
            part, keys = int(parts[at]), tuple(rows.column(k)[0].as_py() for k in _KEYS)
            if last and last[0] != part:
                yield carry()
                window, last = _Window(n), None
            pos1, pos2, own = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("pos1", "pos2", "own"))
            fresh = np.ones(len(pos1), bool)
            fresh[0] = last is None or last[1] != keys or pos1[0] - last[2] > n
            near = pos1[1:] - pos1[:-1] <= n
            for k in _KEYS:
                column = rows.column(k)
                near &= pc.equal(column.slice(1), column.slice(0, len(near))).to_numpy(zero_copy_only=False)
            fresh[1:] = ~near
            alone = fresh.copy()
            alone[:-1] &= fresh[1:]
            alone[-1] = False  # what follows is not known
            dropped = np.zeros(len(pos1), bool)
            for i in np.flatnonzero(~alone).tolist():
                a, b = int(pos1[i]), int(pos2[i])
                if fresh[i]:
                    window = _Window(n)
                if own[i] and window.hit(a, b):
                    dropped[i] = True
                else:
                    window.keep(a, b)
            yield pa.RecordBatch.from_arrays([*rows.columns[:9], pa.array(dropped)], [c for c, _ in _RANGE]).filter(pa.array(own))
            last = part, tuple(rows.column(k)[len(pos1) - 1].as_py() for k in _KEYS), int(pos1[-1])
    if last:
        yield carry()


def _greedy_drops(places: DataFrame, n: int) -> DataFrame:
    """``ord`` of the pairs a sorted scan drops; pairs with a null place conflict with nothing."""
    spark = places.sparkSession
    names = [c for c, _ in _RANGE]
    order = [*_KEYS, "pos1", "pos2", "ord"]

    def scanned(rows: DataFrame) -> DataFrame:
        """Stored by range, so that a range can be read alone."""
        path = new_scratch_path(spark, "ranges")
        rows.mapInArrow(lambda batches: scan_ranges(batches, n), _RANGE_DDL).write.partitionBy("part").parquet(path)
        return spark.read.schema(_RANGE_DDL).parquet(path).select(*names)

    dealt = places.dropna(subset=_PLACE).select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    first = scanned(dealt.select(F.spark_partition_id().alias("part"), F.lit(True).alias("own"), *order, F.lit(False).alias("dropped")))
    # a short row for each range
    starts = sorted(
        first.where("own").groupBy("part").agg(F.min(F.struct(*_KEYS, "pos1")).alias("s")).select("part", "s.*").collect()
    )
    if not starts:
        return first.where("dropped").select("ord")
    follows = spark.createDataFrame(
        [(b.part, *a[1:], a.part) for b, a in itertools.pairwise(starts)],
        "before int, first1 string, first2 string, first3 string, first4 string, start bigint, next int",
    )
    same = [F.col(k) == F.col(f"first{i + 1}") for i, k in enumerate(_KEYS)]
    tables, latest, used = [first], {r.part: 0 for r in starts}, {}

    def newest(k: int) -> list[int]:
        return [p for p, v in latest.items() if v == k]

    while True:
        state = None
        for k, table in enumerate(tables):
            if newest(k):
                held = table.where(F.col("part").isin(newest(k)))
                state = held if state is None else state.unionByName(held)
        moved = state.where("not own").join(F.broadcast(follows), (F.col("part") == F.col("before")) & (F.col("start") - F.col("pos1") <= n) & functools.reduce(operator.and_, same))
        moved = materialize(moved.select(F.col("next").alias("part"), "own", *order, "dropped"), "carried")
        digest = F.sum(F.xxhash64(*_KEYS, "pos1", "pos2").cast("decimal(38,0)"))
        asked = {r.part: (r.n, r.d) for r in moved.groupBy("part").agg(F.count(F.lit(1)).alias("n"), digest.alias("d")).collect()}
        changed = [p for p in latest if asked.get(p) != used.get(p)]
        if not changed:
            return state.where("dropped").select("ord")
        used = asked
        again = state.where("own").where(F.col("part").isin(changed)).unionByName(moved.where(F.col("part").isin(changed)))
        tables.append(scanned(again.repartition("part").sortWithinPartitions("part", "own", *order)))
        latest |= {p: len(tables) - 1 for p in changed}
