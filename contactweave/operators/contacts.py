"""Contact pairs to sparse matrix pixels, and coarser matrices from finer ones."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..errors import ResolutionError
from ..plans.lookups import fits_broadcast, lookup, lookup_value
from .genome import Genome

BOUNDARIES = ("clamp", "strict")
_CELL_BINS = 1_024  # most bins a side of a cell that all coarser resolutions share
_TASK_PIXELS = 1 << 19  # pixels whose coarser levels a task sums


def _place(local_bin: str, suffix: str, res: int, boundary: str):
    """Matrix bin of a contig-local bin.

    ``floor(min(pos, top) / res)`` equals ``min(floor(pos / res), floor(top / res))``,
    so positions can be binned before the contig length is known.
    """
    top = f"(length{suffix} - 1)" if boundary == "clamp" else f"length{suffix}"
    bin_id = F.expr(f"offset{suffix} + least({local_bin}, {top} div {res})")
    negative = F.raise_error(F.lit("a position must not be negative")).cast("bigint")
    return F.when(F.col(local_bin) >= 0, bin_id).otherwise(negative)


def contact_pixels(
    pairs: DataFrame, genome: Genome, res: int, boundary: str = "clamp"
) -> DataFrame:
    """Count contacts per bin pair: bin1_id <= bin2_id, count.

    Pairs naming an unknown contig are left out.  ``boundary="clamp"`` puts a
    position at or past a contig's end into its last bin; ``"strict"`` keeps
    the plain division, which can fall one bin past it.  A negative position on
    a known contig is an error.
    """
    placed = _placed_pairs(pairs, genome, res, boundary)
    return placed.groupBy("bin1_id", "bin2_id").agg(F.sum("_n").alias("count"))


def located_pixels(
    pairs: DataFrame, genome: Genome, res: int, boundary: str = "clamp"
) -> DataFrame:
    """``contact_pixels`` with the contigs of both bins, tig1_id and tig2_id."""
    if boundary != "clamp":  # a bin past the end belongs to the contig after
        return locate(contact_pixels(pairs, genome, res, boundary), genome, res)
    placed = _placed_pairs(pairs, genome, res, boundary)
    return placed.groupBy("bin1_id", "bin2_id", "tig1_id", "tig2_id").agg(F.sum("_n").alias("count"))


def _placed_pairs(pairs: DataFrame, genome: Genome, res: int, boundary: str) -> DataFrame:
    if boundary not in BOUNDARIES:
        raise ValueError(f"boundary must be one of {BOUNDARIES}")
    local = pairs.select(
        "tig1",
        F.expr(f"if(pos1 < 0, -1, pos1 div {res})").alias("_k1"),
        "tig2",
        F.expr(f"if(pos2 < 0, -1, pos2 div {res})").alias("_k2"),
    )
    if genome.names_fit(res):
        weighted = local.withColumn("_n", F.lit(1).cast("bigint"))
    else:
        # The contig table must be shuffled, so send it one row per local bin pair.
        weighted = local.groupBy("tig1", "_k1", "tig2", "_k2").agg(F.count(F.lit(1)).alias("_n"))
    names = genome.names(res)
    if boundary == "clamp":
        names = names.where("length > 0")  # an empty contig has no bin to hold a contact
    for end in "12":
        side = names.select(
            F.col("tig_name").alias("_name"),
            F.col("tig_id").alias(f"_tig{end}"),
            F.col("length").alias(f"length{end}"),
            F.col("chrom_offset").alias(f"offset{end}"),
        )
        weighted = lookup(
            weighted, side, {f"tig{end}": "_name"}, genome.n_tigs, string_bytes=genome.longest_name
        )
    a, b = _place("_k1", "1", res, boundary), _place("_k2", "2", res, boundary)
    placed = weighted.select(a.alias("_a"), b.alias("_b"), "_tig1", "_tig2", "_n")
    in_order = F.col("_a") <= F.col("_b")
    return placed.select(
        F.least("_a", "_b").alias("bin1_id"),
        F.greatest("_a", "_b").alias("bin2_id"),
        F.when(in_order, F.col("_tig1")).otherwise(F.col("_tig2")).alias("tig1_id"),
        F.when(in_order, F.col("_tig2")).otherwise(F.col("_tig1")).alias("tig2_id"),
        "_n",
    )


def unplaced_pairs(pairs: DataFrame, genome: Genome) -> DataFrame:
    """Pairs left out of every clamped matrix: a contig is unknown or has no length.

    ``reason`` is ``unknown`` or ``empty``; unknown comes first if both apply.
    """
    known = genome.contigs.groupBy("tig_name").agg((F.max("length") > 0).alias("_holds"))
    flagged = pairs
    for end in "12":
        side = known.select(F.col("tig_name").alias("_name"), F.col("_holds").alias(f"_known{end}"))
        flagged = lookup(
            flagged, side, {f"tig{end}": "_name"}, genome.n_tigs, "left", genome.longest_name
        )
    reason = F.when(F.col("_known1").isNull() | F.col("_known2").isNull(), "unknown").when(
        ~F.col("_known1") | ~F.col("_known2"), "empty"
    )
    return flagged.withColumn("reason", reason).where("reason is not null").drop("_known1", "_known2")


def locate(pixels: DataFrame, genome: Genome, res: int) -> DataFrame:
    """Pixels with the contigs of both bins, null where a bin lies outside the matrix.

    For pixels from elsewhere; stored ones carry their contigs.
    """
    out = pixels.select("bin1_id", "bin2_id", "count")
    for end in "12":
        side = genome.bins(res).select(F.col("bin_id").alias("_bin"), F.col("tig_id").alias(f"tig{end}_id"))
        out = lookup(out, side, {f"bin{end}_id": "_bin"}, genome.n_bins(res), "left")
    return out


def pyramid(
    pixels: DataFrame, genome: Genome, from_res: int, to_res: list[int], n_pixels: int | None = None
) -> DataFrame:
    """All coarser resolutions from one scan: res, bin1_id, bin2_id, tig1_id, tig2_id, count.

    ``pixels`` carry the contigs of their bins, so a bin's place on its contig
    is a difference, its coarser place a quotient, and only contigs are looked
    up.  All levels share one shuffle.

    With their count ``n_pixels`` known, pixels are dealt by the cells of the
    least common multiple of all resolutions, and a task sums its cells to the
    end.  So its memory follows ``_TASK_PIXELS`` and no level is shuffled.
    Where such cells would be large, partial sums are shuffled instead.
    """
    for res in to_res:
        if res % from_res or res <= from_res:
            raise ResolutionError(f"{res} is not a larger multiple of {from_res}")
    levels = [from_res, *to_res]
    starts = genome.contigs.select("tig_id")
    for res in levels:
        side = genome.offsets(res).select(F.col("tig_id").alias("_tig"), F.col("chrom_offset").alias(f"_at{res}"))
        starts = lookup(starts, side, {"tig_id": "_tig"}, genome.n_tigs)
    out, cells = pixels, []
    across = math.lcm(*to_res) // from_res
    if n_pixels is not None and across <= _CELL_BINS and fits_broadcast(starts, genome.n_tigs):
        out, cells = _dealt(pixels, starts, genome, from_res, across, n_pixels), ["_cell1", "_cell2"]
    for end in "12":
        side = starts.select(F.col("tig_id").alias("_tig"), *[F.col(f"_at{r}").alias(f"_at{r}_{end}") for r in levels])
        out = lookup(out, side, {f"tig{end}_id": "_tig"}, genome.n_tigs, "left")
    outside = F.raise_error(F.lit("pixel lies outside the matrix")).cast("bigint")

    def coarse(end: str, res: int):
        place = F.expr(f"_at{res}_{end} + (bin{end}_id - _at{from_res}_{end}) div {res // from_res}")
        return F.coalesce(place, outside).alias(f"bin{end}_id")

    each = F.array(*[F.struct(F.lit(r).cast("bigint").alias("res"), coarse("1", r), coarse("2", r)) for r in to_res])
    keys = ["res", "bin1_id", "bin2_id", "tig1_id", "tig2_id"]
    seen = out.select(F.explode(each).alias("_level"), "tig1_id", "tig2_id", *cells, "count")
    sums = seen.select("_level.*", "tig1_id", "tig2_id", *cells, "count").groupBy(*keys, *cells)
    return sums.agg(F.sum("count").alias("count")).drop(*cells)


def _dealt(pixels: DataFrame, starts: DataFrame, genome: Genome, from_res: int, across: int, n_pixels: int) -> DataFrame:
    """Pixels with the cell of ``across`` bins a side that each end lies in, dealt by contigs and cells."""
    out = pixels.select("bin1_id", "bin2_id", "tig1_id", "tig2_id", "count")
    for end in "12":
        side = starts.select(F.col("tig_id").alias("_tig"), F.col(f"_at{from_res}").alias("_at"))
        out = lookup(out, side, {f"tig{end}_id": "_tig"}, genome.n_tigs, "left")
        out = out.withColumn(f"_cell{end}", F.expr(f"(bin{end}_id - _at) div {across}")).drop("_at")
    n_parts = max(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_pixels // _TASK_PIXELS))
    return out.repartition(n_parts, "tig1_id", "tig2_id", "_cell1", "_cell2")


def zoom_pixels(
    pixels: DataFrame, genome: Genome, from_res: int, to_res: int, n_pixels: int | None = None
) -> DataFrame:
    """Sum pixels of ``from_res`` into the coarser ``to_res``.

    Pixels that carry their contigs keep them; others are located first.
    """
    if to_res % from_res or to_res <= from_res:
        raise ResolutionError(f"{to_res} is not a larger multiple of {from_res}")
    if "tig1_id" in pixels.columns:
        return pyramid(pixels, genome, from_res, [to_res], n_pixels).drop("res")
    return pyramid(locate(pixels, genome, from_res), genome, from_res, [to_res]).select("bin1_id", "bin2_id", "count")


def balanced_pixels(pixels: DataFrame, weights: DataFrame, n_bins: int) -> DataFrame:
    """Pixels with ``value = count * weight of bin1 * weight of bin2`` (NaN if masked).

    ``weights`` holds bin_id and weight for every bin.
    """
    out = pixels
    for end in "12":
        out = lookup_value(out, weights, f"bin{end}_id", "weight", f"weight{end}", 0, n_bins)
    return out.select(
        "bin1_id",
        "bin2_id",
        (F.col("count") * F.col("weight1") * F.col("weight2")).alias("value"),
    )
