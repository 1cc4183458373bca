"""Ranks, prefix sums and exact medians without a single-task window over data.

A window with no partition key runs in one task.  Below, such windows only see
tables whose size is proven small: one row per block of a dense key or one row
per sorted partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lookups import lookup
from .storage import materialize

BLOCK = 65_536
SMALL = 262_144
_ROW_BITS = 33


def prefix_sum(
    df: DataFrame, key: str, value: str, out: str, n_keys: int | None = None
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows with a smaller ``key``.

    ``key`` must hold the numbers 0..n-1, each once.  Blocks of consecutive
    keys are summed on their own and shifted by the total of earlier blocks.
    """
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    block = BLOCK
    if n_keys is not None and n_keys <= block:
        return df.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))

    blocked = df.withColumn("_block", F.expr(f"`{key}` div {block}"))
    totals = blocked.groupBy("_block").agg(F.sum(value).alias("_total"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        F.col("_block").alias("_shift_block"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_shift"),
    )
    if n_keys is not None and n_keys <= block * block:
        shifts = F.broadcast(shifts)
    inside = (
        Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        blocked.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(shifts, F.col("_block") == F.col("_shift_block"))
        .withColumn(out, F.col("_shift") + F.col("_inside"))
        .drop("_block", "_shift_block", "_shift", "_inside")
    )


def global_rank(
    df: DataFrame,
    order: list[Column | str],
    out: str,
    n_rows: int | None = None,
    copies: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``out``: the 0-based position of each row in the order of ``order``.

    Rows are range-partitioned and sorted once and stored in that order.  The
    position is then the row's place in its partition plus the size of the
    partitions before it.

    The ordering columns must tell all rows apart, so that a task that runs
    again puts every row where it was.  ``copies=True`` lifts that for a table
    read straight from files: an extra last key, the row's place in the scan,
    spreads equal rows over partitions and stays the same on a rerun.

    ``keep`` names the columns that are stored and returned, all by default.
    """
    keys, held = list(order), keep or df.columns
    if copies:
        df = df.withColumn("_spread", F.monotonically_increasing_id())
        keys.append("_spread")
    if n_rows is not None and n_rows <= SMALL:
        ranked = df.withColumn(
            out, F.row_number().over(Window.orderBy(*keys)).cast("bigint") - 1
        ).select(*held, out)
        return materialize(ranked, "ranked") if copies else ranked
    stored = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(*held, F.monotonically_increasing_id().alias("_at")),
        "ranked",
    )
    part = F.shiftright(F.col("_at"), _ROW_BITS)
    place = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift")
    )
    # One row per sort partition, so the broadcast is bounded by the partition count.
    return (
        stored.join(F.broadcast(shifts), part == F.col("_part"))
        .withColumn(out, F.col("_shift") + place)
        .drop("_part", "_shift", "_at")
    )


def exact_median(
    df: DataFrame,
    value: str,
    group: str | None,
    out: str,
    n_rows: int | None = None,
    n_groups: int = 1,
    n_in_group: int | None = None,
) -> DataFrame:
    """Exact median of ``value`` per group (mean of the two middle values).

    Without ``group`` there is one row, null if there are no values.  Small
    inputs use the built-in aggregate, which holds a group's distinct values
    in memory, and so do larger ones whose groups hold at most ``n_in_group``
    values, if that is small.  All others count copies of each value first, then find
    the middle positions in one distributed order.
    """
    if any(n is not None and n <= SMALL for n in (n_rows, n_in_group)):
        grouped = df.groupBy(group) if group else df.groupBy()
        return grouped.agg(F.median(value).alias(out))
    key = group or "_all"
    source = df if group else df.withColumn(key, F.lit(0))
    counted = source.groupBy(key, value).agg(F.count(F.lit(1)).alias("_copies"))
    placed = prefix_sum(global_rank(counted, [key, value], "_rank"), "_rank", "_copies", "_before")
    spans = placed.groupBy(key).agg(
        F.min("_before").alias("_first"), F.sum("_copies").alias("_n")
    )
    held = lookup(placed, spans, {key: key}, n_groups)
    low = F.expr("_first + (_n - 1) div 2")
    high = F.expr("_first + _n div 2")
    after = F.col("_before") + F.col("_copies")
    # A value covering both middle positions leaves one row, two values leave two.
    middle = held.where(
        ((F.col("_before") <= low) & (low < after)) | ((F.col("_before") <= high) & (high < after))
    )
    middle_value = F.avg(F.col(value).cast("double")).alias(out)
    return middle.groupBy(key).agg(middle_value) if group else middle.agg(middle_value)
