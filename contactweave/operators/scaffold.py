"""Neighbouring contigs for scaffolding, from the strongest trans contacts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.lookups import FEW_KEYS, block_keys, broadcast_budget, column_blocks, lookup, lookup_ends, lookup_ends_in_blocks
from ..plans.storage import materialize
from .genome import Genome
from .region import finite, touching

# Fixed values of the method.
LENGTH_CUTOFF = 100_000
PRECISION = 1e-7

NAN = float("nan")
_FEW = 1_000  # bins that a filter on pixels lists


def bin_facts(
    bins: DataFrame, genome: Genome, weights: DataFrame, cutoff: int = LENGTH_CUTOFF
) -> DataFrame:
    """Per bin: contig, weight, whether the contig is long, first and last bin flags."""
    lengths = genome.contigs.select("tig_id", "length")
    known = lookup(bins.select("bin_id", "tig_id", "start", "end"), lengths, {"tig_id": "tig_id"}, genome.n_tigs)
    scored = weights.select(F.col("bin_id").alias("_bin"), "weight")
    return known.join(scored, F.col("bin_id") == F.col("_bin")).select(
        "bin_id",
        "tig_id",
        "weight",
        (F.col("length") >= cutoff).alias("long"),
        (F.col("start") == 0).alias("is_first"),
        (F.col("end") == F.col("length")).alias("is_last"),
    )


def _with_facts(pixels: DataFrame, facts: DataFrame, columns: list[str], bytes_a_bin: int, n_bins: int) -> DataFrame:
    """Pixels between two contigs with ``columns`` of the facts of both bins, suffixed 1 and 2, and tig1_id, tig2_id.

    Facts of more than a few bins are a stored table.  Where it has every bin
    and ``bytes_a_bin`` fit the budget, they come as arrays by block and no
    pixel is shuffled.
    Stored pixels carry their contigs, so those within one drop out first.
    """
    located = "tig1_id" in pixels.columns
    kept = ["bin1_id", "bin2_id", "count"]
    if located:
        kept += ["tig1_id", "tig2_id"]
        pixels = pixels.where("tig1_id != tig2_id")
    else:
        columns, bytes_a_bin = ["tig_id", *columns], bytes_a_bin + 8
    pixels = pixels.select(*kept)
    fits = n_bins * bytes_a_bin <= broadcast_budget(pixels.sparkSession)
    if n_bins > FEW_KEYS and fits and facts.count() == n_bins:
        size = block_keys(n_bins)
        both = lookup_ends_in_blocks(pixels, column_blocks(facts, columns, size), columns, size)
    else:
        both = lookup_ends(pixels, facts, columns, n_bins)
    return both if located else both.withColumnsRenamed({"tig_id1": "tig1_id", "tig_id2": "tig2_id"}).where("tig1_id != tig2_id")


def trans_max(pixels: DataFrame, facts: DataFrame, n_bins: int) -> DataFrame:
    """Per bin the largest balanced contact with another contig (NaN if none).

    Only contacts between two long contigs count.  Bins of short contigs have
    no weight here, so their pixels drop out.
    """
    facts = facts.select("bin_id", "tig_id", F.when(F.col("long"), F.col("weight")).alias("weight"))
    if n_bins > FEW_KEYS:
        facts = materialize(facts, "facts")
    value = F.col("count") * F.col("weight1") * F.col("weight2")
    trans = (
        _with_facts(pixels, facts, ["weight"], 8, n_bins)
        .select(F.explode(F.array("bin1_id", "bin2_id")).alias("_bin"), value.alias("_v"))
        .where(finite("_v"))
    )
    best = trans.groupBy("_bin").agg(F.max("_v").alias("_best")).where("_best > 0")
    return facts.join(best, F.col("bin_id") == F.col("_bin"), "left").select(
        "bin_id", F.coalesce("_best", F.lit(NAN)).alias("max_val")
    )


# Bits of what is known of a bin, and of a pixel: those of its first bin, of its second one, and whether it is near the top.
_LONG, _FIRST, _LAST, _SECOND, _NEAR = 1, 2, 4, 3, 64
_ENDS = "bin1_id long, bin2_id long, tig1_id long, tig2_id long, w double, flags int"


def _trans_pixels(pixels: DataFrame, known: DataFrame, n_bins: int) -> DataFrame:
    """Finite balanced pixels between two contigs, one of them long: ``_ENDS``.

    A pixel is near the top if it is the strongest trans contact of both of its bins.
    """
    both = _with_facts(pixels, known, ["weight", "best", "flags"], 20, n_bins)
    value = F.col("count") * F.col("weight1") * F.col("weight2")
    top = F.greatest("best1", "best2")
    near = F.when((top != 0) & (top - F.col("w") < PRECISION), _NEAR).otherwise(0)
    flags = F.col("flags1") + F.shiftleft("flags2", _SECOND) + near
    cells = both.withColumn("w", value).where(finite("w"))
    return cells.select("bin1_id", "bin2_id", "tig1_id", "tig2_id", "w", flags.alias("flags")).where(
        F.col("flags").bitwiseAND(_LONG | _LONG << _SECOND) != 0
    )


def _trans_cells(ends: DataFrame) -> DataFrame:
    """Cells from both sides of ``_trans_pixels`` whose column is long: ``_CELLS``."""
    bit = lambda end, b: F.col("flags").bitwiseAND(b << (_SECOND if end == "2" else 0)) != 0
    side = lambda row, col: F.struct(
        F.col(f"bin{row}_id").alias("i"),
        F.col(f"bin{col}_id").alias("j"),
        F.col(f"tig{row}_id").alias("tig_i"),
        F.col(f"tig{col}_id").alias("tig_j"),
        "w",
        bit(row, _FIRST).alias("is_first"),
        bit(row, _LAST).alias("is_last"),
        (bit(row, _FIRST | _LAST) & bit("1", _NEAR)).alias("mutual"),
        bit(col, _LONG).alias("long_j"),
    )
    cells = ends.select(F.explode(F.array(side("1", "2"), side("2", "1"))).alias("c"))
    return cells.select("c.*").where("long_j").drop("long_j")


def _mirrored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_trans_cells`` on batches of ``_trans_pixels``."""
    names = ["i", "j", "tig_i", "tig_j", "w", "is_first", "is_last", "mutual"]
    for batch in batches:
        bin1, bin2, tig1, tig2, w, flags = (c.to_numpy() for c in batch.columns)
        near, second = flags & _NEAR != 0, flags >> _SECOND
        for i, j, tig_i, tig_j, row, col in ((bin1, bin2, tig1, tig2, flags, second), (bin2, bin1, tig2, tig1, second, flags)):
            mutual = near & (row & (_FIRST | _LAST) != 0)
            cells = [i, j, tig_i, tig_j, w, row & _FIRST != 0, row & _LAST != 0, mutual]
            long = col & _LONG != 0
            yield pa.RecordBatch.from_arrays([pa.array(x[long]) for x in cells], names)


def two_best(at: np.ndarray, tig: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each bin's strongest cell, in the order of bins, and of its strongest one with another contig.

    Ties go to the lower contig.  The result of joined parts is that of the
    joined results, so it can be taken in any order and as often as wanted.
    """
    order = np.lexsort((tig, -w, at))
    at, tig = at[order], tig[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])[: len(at)]
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
    other = np.flatnonzero(tig != tig[starts][group])
    second = other[np.unique(group[other], return_index=True)[1]]
    return order[starts], order[second]


def outdone(table: pa.Table, first: np.ndarray, second: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of the ``asked`` cells have, in one of their two bins, a cell as strong that avoids both contigs.

    More cells only make that cell stronger, so these never score above one.
    """
    i, j, tig_i, tig_j, w = (table.column(c).to_numpy() for c in ("i", "j", "tig_i", "tig_j", "w"))
    bins, tig, w1, w2 = i[first], tig_j[first], w[first], np.full(len(first), NAN)
    w2[np.searchsorted(bins, i[second])] = w[second]
    out = np.zeros(len(asked), bool)
    for row, without in ((i[asked], tig_j[asked]), (j[asked], tig_i[asked])):
        at = np.minimum(np.searchsorted(bins, row), len(bins) - 1)
        rest = np.where(bins[at] == row, np.where(tig[at] == without, w2[at], w1[at]), NAN)
        out |= (rest >= w[asked]) & (rest > 0)
    return out


_CELLS = "i long, j long, tig_i long, tig_j long, w double, is_first boolean, is_last boolean, mutual boolean"
_HELD = 1 << 17  # cells a task takes in before it thins out what it holds


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mutual cells that are not outdone, as they are, and each bin's two best partners by part: i, tig_j and w of them."""
    parts, held, kept = [], 0, 0

    def thinned() -> tuple[pa.Table, pa.Table]:
        table = pa.Table.from_batches(parts).combine_chunks()
        first, second = two_best(*(table.column(c).to_numpy() for c in ("i", "tig_j", "w")))
        asked = np.flatnonzero(table.column("mutual").to_numpy())
        mutual = table.take(asked[~outdone(table, first, second, asked)])
        best = table.take(np.concatenate((first, second)))
        none, no = pa.array(np.zeros(len(best), np.int64)), pa.array(np.zeros(len(best), bool))
        columns = [best.column("i"), none, none, best.column("tig_j"), best.column("w"), no, no, no]
        return mutual, pa.Table.from_arrays(columns, names=table.column_names)

    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append(batch)
        held += batch.num_rows
        if held > kept + _HELD:
            mutual, best = thinned()
            yield from mutual.to_batches()
            if len(best) > _HELD:  # many bins: pass them on and start anew
                yield from best.to_batches()
                best = best.slice(0, 0)
            parts, held, kept = best.to_batches(), len(best), len(best)
    if parts:
        for table in thinned():
            yield from table.to_batches()


def _mutual_and_best(cells: DataFrame) -> DataFrame:
    """From one pass over ``cells``: the mutual ones that can score, and each bin's two best partners by part."""
    return cells.mapInArrow(_thinned, _CELLS)


def best_neighbors(
    pixels: DataFrame,
    facts: DataFrame,
    max_vals: DataFrame,
    n_bins: int,
    rows: list[int] | None = None,
    tile_bins: int | None = None,
) -> DataFrame:
    """Best scaffold neighbour of every contig end: tig_id, end, neighbor_id, score.

    A cell of the row at a contig's first or last bin is a candidate if it is
    the strongest trans contact of both of its bins.  Its score compares it
    with the next strongest contact of the two bins that avoids both contigs;
    scores above one are kept and the best one wins, the first column on ties.

    One pass over the pixels finds the candidates and, by a partial aggregate,
    every bin's two best partners with different contigs.  What a task holds
    rules out most candidates; only the bins of the others go on from there.

    ``rows`` names the bins at the ends of the contigs asked for.  Then a first
    pass reads the pixels of those bins alone and a second one those of the
    bins in candidates; with ``tile_bins`` both read only their tiles.
    """
    best = max_vals.select(F.col("bin_id").alias("_bin"), F.nanvl("max_val", F.lit(0.0)).alias("best"))
    bits = [F.when(F.col(c), b).otherwise(0) for c, b in (("long", _LONG), ("is_first", _FIRST), ("is_last", _LAST))]
    known = facts.join(best, F.col("bin_id") == F.col("_bin")).select(
        "bin_id", "tig_id", "weight", "best", (bits[0] + bits[1] + bits[2]).alias("flags")
    )
    many = n_bins > FEW_KEYS
    if many:
        known = materialize(known, "facts")
    n_touched = n_bins
    if rows is None:
        ends = _trans_pixels(pixels, known, n_bins)
        found = materialize(ends.mapInArrow(lambda batches: _thinned(_mirrored(batches)), _CELLS), "neighbors")
        mutual, partial = found.where("mutual"), found.where("not mutual")
    else:
        ends = _trans_cells(_trans_pixels(touching(pixels, rows, n_bins, tile_bins), known, n_bins))
        mutual = materialize(ends.where(F.col("i").isin(rows) & F.col("mutual")), "mutual")
    if many or rows is not None:
        touched = materialize(mutual.select(F.explode(F.array("i", "j")).alias("_row")).distinct(), "touched")
        n_touched = touched.count()
    if rows is not None:
        few = [r["_row"] for r in touched.limit(_FEW + 1).collect()]
        near = touching(pixels, few, n_bins, tile_bins) if len(few) <= _FEW else pixels
        held = lookup(_trans_cells(_trans_pixels(near, known, n_bins)), touched, {"i": "_row"}, n_touched, "left_semi")
        partial = _mutual_and_best(held.withColumn("mutual", F.lit(False))).where("not mutual")
    elif many:
        partial = lookup(partial, touched, {"i": "_row"}, n_touched, "left_semi")
    # a part gives a bin two rows at most
    ranked = partial.groupBy("i").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("less"), F.col("tig_j").alias("tig")))).alias("_best"))
    first = F.element_at("_best", 1)
    other = F.filter("_best", lambda x: x["tig"] != F.col("t1"))
    top_two = ranked.select("i", "_best", first["tig"].alias("t1"), (-first["less"]).alias("w1")).select(
        "i", "t1", "w1", (-F.try_element_at(other, F.lit(1))["less"]).alias("w2")
    )

    scored = mutual
    for side in ("i", "j"):
        renamed = top_two.select(
            F.col("i").alias("_at"), *[F.col(c).alias(f"{c}_{side}") for c in ("t1", "w1", "w2")]
        )
        scored = lookup(scored, renamed, {side: "_at"}, n_touched)
    avoid_i = F.when(F.col("t1_i") == F.col("tig_j"), F.col("w2_i")).otherwise(F.col("w1_i"))
    avoid_j = F.when(F.col("t1_j") == F.col("tig_i"), F.col("w2_j")).otherwise(F.col("w1_j"))
    scored = (
        scored.withColumn("_a", avoid_i)
        .withColumn("_b", avoid_j)
        .where("_a is not null and _b is not null")
        .withColumn("score", F.col("w") / F.greatest("_a", "_b"))
        .where(F.col("score") - 1.0 >= PRECISION)
    )
    ends = F.filter(
        F.array(F.when(F.col("is_first"), F.lit("start")), F.when(F.col("is_last"), F.lit("end"))),
        lambda e: e.isNotNull(),
    )
    pick = F.struct("score", (-F.col("j")).alias("_first"), F.col("tig_j").alias("_tig"))
    return (
        scored.withColumn("end", F.explode(ends))
        .groupBy(F.col("tig_i").alias("tig_id"), "end")
        .agg(F.max(pick).alias("_pick"))
        .select("tig_id", "end", F.col("_pick._tig").alias("neighbor_id"), F.col("_pick.score").alias("score"))
    )


def named_neighbors(neighbors: DataFrame, genome: Genome) -> DataFrame:
    """Neighbour rows with contig names: tig_name, end, neighbor, score."""
    out = neighbors
    for key, name in (("tig_id", "tig_name"), ("neighbor_id", "neighbor")):
        side = genome.contigs.select(F.col("tig_id").alias("_id"), F.col("tig_name").alias(name))
        out = lookup(out, side, {key: "_id"}, genome.n_tigs, string_bytes=genome.longest_name)
    return out.select("tig_name", "end", "neighbor", "score")


def neighbor_names(per_resolution: list[DataFrame], genome: Genome) -> DataFrame:
    """Distinct neighbour names of each contig end over several resolutions."""
    every = named_neighbors(per_resolution[0], genome)
    for more in per_resolution[1:]:
        every = every.unionByName(named_neighbors(more, genome))
    return every.select("tig_name", "end", "neighbor").distinct()


def contigs_by_length(genome: Genome) -> DataFrame:
    """Contigs, longest first; equal lengths by name."""
    return genome.contigs.orderBy(F.desc("length"), "tig_name")


def longest_contig(genome: Genome) -> DataFrame:
    return contigs_by_length(genome).select("tig_name", "length").limit(1)
