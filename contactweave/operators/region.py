"""Rectangular and row queries over the stored upper triangle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..errors import MatrixIndexError
from ..plans.lookups import lookup, lookup_value
from ..plans.tiles import tiles_over

_STRIP = 4_096  # columns that one marker of a dense rectangle stands for
_BLOCK_ROWS = 4_096  # most rows that it stands for
_RUN = 256  # columns that are made at a time; a strip is a multiple
_TASK_CELLS = 1 << 26  # cells of a dense rectangle that a task makes


def check_range(n_bins: int, i0: int, i1: int, j0: int, j1: int) -> None:
    if not (0 <= i0 < i1 <= n_bins and 0 <= j0 < j1 <= n_bins):
        raise MatrixIndexError(
            f"rows [{i0}, {i1}) and columns [{j0}, {j1}) do not fit {n_bins} bins"
        )


def check_row(n_bins: int, row: int) -> None:
    if not 0 <= row < n_bins:
        raise MatrixIndexError(f"row {row} does not fit {n_bins} bins")


def _within(column: str, low: int, high: int):
    return (F.col(column) >= low) & (F.col(column) < high)


def symmetric(pixels: DataFrame) -> DataFrame:
    """Both halves of the matrix as i, j, count; diagonal pixels once."""
    upper = pixels.select(F.col("bin1_id").alias("i"), F.col("bin2_id").alias("j"), "count")
    lower = pixels.where("bin1_id != bin2_id").select(
        F.col("bin2_id").alias("i"), F.col("bin1_id").alias("j"), "count"
    )
    return upper.unionByName(lower)


def upper_rectangle(
    pixels: DataFrame, i0: int, i1: int, j0: int, j1: int, tile_bins: int | None = None
) -> DataFrame:
    """Stored pixels with bin1 in [i0, i1) and bin2 in [j0, j1).

    ``tile_bins`` says that the pixels are laid out in tiles of that side;
    then only the tiles the rectangle touches are read.
    """
    if tile_bins:
        pixels = pixels.where(F.col("tile").isin(tiles_over(tile_bins, i0, i1, j0, j1)))
    return pixels.where(_within("bin1_id", i0, i1) & _within("bin2_id", j0, j1))


def rectangle(
    pixels: DataFrame, n_bins: int, i0: int, i1: int, j0: int, j1: int, tile_bins: int | None = None
) -> DataFrame:
    """Cells of the full symmetric matrix with i in [i0, i1) and j in [j0, j1).

    Both halves get the ranges on their stored columns.  Only bin1 <= bin2 is
    stored, which narrows the ranges further.  In a tiled store a row reads
    the tiles of its own row and, for what is stored in other rows, those of
    its column.
    """
    check_range(n_bins, i0, i1, j0, j1)
    direct = upper_rectangle(pixels, i0, min(i1, j1), max(i0, j0), j1, tile_bins).select(
        F.col("bin1_id").alias("i"), F.col("bin2_id").alias("j"), "count"
    )
    flipped = (
        upper_rectangle(pixels, j0, min(i1, j1), max(i0, j0), i1, tile_bins)
        .where("bin1_id != bin2_id")
        .select(F.col("bin2_id").alias("i"), F.col("bin1_id").alias("j"), "count")
    )
    return direct.unionByName(flipped)


def touching(pixels: DataFrame, bins: list[int], n_bins: int, tile_bins: int | None = None) -> DataFrame:
    """Stored pixels with one of a few bins at either end; of a tiled store only their rows and columns of tiles."""
    if tile_bins:
        tiles = {t for b in bins for t in tiles_over(tile_bins, b, b + 1, b, n_bins) + tiles_over(tile_bins, 0, b + 1, b, b + 1)}
        pixels = pixels.where(F.col("tile").isin(sorted(tiles)))
    return pixels.where(F.col("bin1_id").isin(bins) | F.col("bin2_id").isin(bins))


def balanced_rectangle(
    pixels: DataFrame, weights: DataFrame, n_bins: int, i0: int, i1: int, j0: int, j1: int, tile_bins: int | None = None
) -> DataFrame:
    """Rectangle cells as i, j, value; only weights of the asked bins are joined."""
    cells = rectangle(pixels, n_bins, i0, i1, j0, j1, tile_bins)
    out = lookup_value(cells, weights.where(_within("bin_id", i0, i1)), "i", "weight", "_wi", i0, i1 - i0)
    out = lookup_value(out, weights.where(_within("bin_id", j0, j1)), "j", "weight", "_wj", j0, j1 - j0)
    return out.select("i", "j", (F.col("count") * F.col("_wi") * F.col("_wj")).alias("value"))


def finite(column: str):
    return ~F.isnan(column) & (F.abs(F.col(column)) != float("inf")) & F.col(column).isNotNull()


def balanced_row(
    pixels: DataFrame, weights: DataFrame, n_bins: int, row: int, tile_bins: int | None = None
) -> DataFrame:
    """Finite cells of one row as bin_id, value, in column order."""
    check_row(n_bins, row)
    cells = balanced_rectangle(pixels, weights, n_bins, row, row + 1, 0, n_bins, tile_bins)
    return cells.where(finite("value")).select(F.col("j").alias("bin_id"), "value").orderBy("bin_id")


def dense_row(
    pixels: DataFrame, weights: DataFrame, bins: DataFrame, n_bins: int, row: int, tile_bins: int | None = None
) -> DataFrame:
    """One row with every column: bin_id, value, zero where nothing finite is stored."""
    held = balanced_row(pixels, weights, n_bins, row, tile_bins).select(
        F.col("bin_id").alias("_held"), F.col("value").alias("_value")
    )
    return bins.select("bin_id").join(held, F.col("bin_id") == F.col("_held"), "left").select(
        "bin_id", F.coalesce("_value", F.lit(0.0)).alias("value")
    )


def dense_rectangle(
    cells: DataFrame, i0: int, i1: int, j0: int, j1: int, value: str = "value"
) -> DataFrame:
    """Every cell of a rectangle as i, j, value; zero where nothing finite is stored.

    Only the stored cells and one marker for each block of rows in a strip of
    columns are shuffled.  Behind that a marker becomes one for each run of
    columns in each of its rows, and each of these and of the cells spreads into
    itself and the zeros up to the next one of its run, so the zeros are made
    where they are used and neither a row nor the rectangle has to fit in one
    place.  A task makes few strips, and all rows of a run one after the other:
    columns that soon come again are written small.
    """
    spark = cells.sparkSession
    strips = -(-(j1 - j0) // _STRIP)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = max(1, min(_BLOCK_ROWS, (i1 - i0) * strips // (16 * n_parts)))
    blocks = -(-(i1 - i0) // rows)
    markers = spark.range(blocks * strips).select(
        (F.col("id") % blocks).alias("_block"),
        F.expr(f"id div {blocks}").alias("_strip"),
        F.expr(f"id % {blocks} * {rows} + {i0}").alias("i"),
        F.lit(None).cast("bigint").alias("_j"),
        F.lit(None).cast("double").alias("_v"),
    )
    held = (
        cells.select(F.col("i").cast("bigint"), F.col("j").cast("bigint").alias("_j"), F.col(value).cast("double").alias("_v"))
        .where(_within("i", i0, i1) & _within("_j", j0, j1) & finite("_v"))
        .select(F.expr(f"(i - {i0}) div {rows}").alias("_block"), F.expr(f"(_j - {j0}) div {_STRIP}").alias("_strip"), "i", "_j", "_v")
    )
    n_parts = max(n_parts, -(-(i1 - i0) * (j1 - j0) // _TASK_CELLS))
    marker = F.col("_v").isNull()
    last_row = F.when(marker, F.least(F.col("i") + rows, F.lit(i1)) - 1).otherwise(F.col("i"))
    own = F.expr(f"array({j0} + (_j - {j0}) div {_RUN} * {_RUN})")
    runs = F.expr(f"sequence({j0} + _strip * {_STRIP}, least({j0} + (_strip + 1) * {_STRIP}, {j1}) - 1, {_RUN}L)")
    in_run = Window.partitionBy("_strip", "_block", "_run", "i").orderBy("_j")
    end = F.least(F.col("_run") + _RUN, F.lit(j1))
    zeros = F.coalesce(F.lead("_j").over(in_run), end) - F.col("_j") - 1  # less than none between copies of a cell
    first = F.when(marker, 1).otherwise(0).cast("bigint")
    spread = (
        markers.unionByName(held)
        .repartition(n_parts, "_strip", "_block")  # few rows here, many cells behind
        .select("_strip", "_block", F.explode(F.sequence("i", last_row)).alias("i"), "_j", "_v")
        .select("_strip", "_block", "i", "_j", "_v", F.explode(F.when(marker, runs).otherwise(own)).alias("_run"))
        .withColumn("_j", F.coalesce("_j", F.col("_run") - 1))
        .withColumn("_zeros", F.greatest(zeros, F.lit(0).cast("bigint")))
        .where((first == 0) | (F.col("_zeros") > 0))
        .select("i", "_j", "_v", F.explode(F.sequence(first, F.col("_zeros"))).alias("_k"))
    )
    return spread.select(
        "i", (F.col("_j") + F.col("_k")).alias("j"), F.when(F.col("_k") == 0, F.col("_v")).otherwise(F.lit(0.0)).alias("value")
    )


def to_dense(cells: DataFrame, i0: int, i1: int, j0: int, j1: int, value: str = "value") -> np.ndarray:
    """A rectangle as an array in the driver's memory; ``dense_rectangle`` is the distributed form."""
    out = np.zeros((i1 - i0, j1 - j0))
    table = cells.select("i", "j", F.col(value).cast("double").alias("v")).where(finite("v")).toPandas()
    out[table["i"].to_numpy() - i0, table["j"].to_numpy() - j0] = table["v"].to_numpy()
    return out


def pixel_slice(
    pixels: DataFrame, index: DataFrame, start: int, end: int, n_bins: int | None = None, tile_bins: int | None = None
) -> DataFrame:
    """Pixels at positions [start, end) of the (bin1_id, bin2_id) order, with ``pos``.

    The row pointers name the bins whose pixels overlap the slice, and only
    those are read.  A pixel's position is its row's pointer and its place in
    the row, so nothing is sorted across rows or stored.
    """
    if not 0 <= start < end:
        raise MatrixIndexError(f"slice [{start}, {end}) is empty")
    first = index.where(F.col("bin1_offset") <= start).agg(F.max("bin_id")).first()[0]
    last = index.where(F.col("bin1_offset") < end).agg(F.max("bin_id")).first()[0]
    if tile_bins:
        pixels = upper_rectangle(pixels, first, last + 1, first, n_bins + 1, tile_bins)
    part = pixels.where(F.col("bin1_id").between(first, last)).select("bin1_id", "bin2_id", "count")
    starts = index.where(F.col("bin_id").between(first, last)).select(
        F.col("bin_id").alias("_row"), F.col("bin1_offset").alias("_first")
    )
    in_row = Window.partitionBy("bin1_id").orderBy("bin2_id")
    placed = lookup(part.withColumn("_place", F.row_number().over(in_row) - 1), starts, {"bin1_id": "_row"}, last - first + 1)
    return placed.withColumn("pos", F.col("_first") + F.col("_place")).where(
        F.col("pos").between(start, end - 1)
    ).drop("_first", "_place")
