"""Read alignments to contact pairs, with rescue of chimeric reads.

Only a bounded part of a read's alignments matters: how many there are per
mate, the last primary one of each mate and the first two of each mate.  All
of it comes from partial aggregates and from a per-group limit that Spark
applies before the shuffle, so a read name with very many alignments is never
gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from ..plans.lookups import lookup
from ..plans.ordering import global_rank, prefix_sum

# Fixed values of the method.
MIN_MAPQ = 10
MAX_MOLECULE_SIZE = 2000

STRATEGIES = ("unique", "simple", "complex")
_PARTS = ("ref_id", "mid", "rev", "mapq")
COUNTERS = [
    "reads", "alignments", "pairs",
    "unmapped_both", "unmapped_one", "mapped_both",
    "primary", "supplementary", "secondary",
    "mapq0_both", "mapq0_one", "mapq0_none",
    "intra", "inter",
    "pairs_unique", "pairs_simple", "pairs_complex",
]


def midpoint(start: str = "start", end: str = "end") -> Column:
    return F.expr(f"`{start}` + (`{end}` - `{start}`) div 2")


def near(a: str, b: str, limit: int) -> Column:
    """True if two alignments share a contig and their midpoints are closer than ``limit``."""
    same = F.col(f"{a}_ref_id") == F.col(f"{b}_ref_id")
    close = F.abs(F.col(f"{a}_mid") - F.col(f"{b}_mid")) < limit
    return F.coalesce(same & close, F.lit(False))


def opposed(a: str, b: str) -> Column:
    """True if the strands differ and the reverse-strand read lies strictly downstream."""
    ahead = F.col(f"{b}_mid") - F.col(f"{a}_mid")
    return (F.col(f"{a}_rev") != F.col(f"{b}_rev")) & F.when(
        F.col(f"{b}_rev"), ahead > 0
    ).otherwise(ahead < 0)


def number_islands(alignments: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Add ``island``: runs of adjacent rows (by ``ord``) that share a read name."""
    ranked = global_rank(alignments, ["ord"], "_rank", n_rows)
    previous = ranked.select((F.col("_rank") + 1).alias("_next"), F.col("qname").alias("_prev"))
    starts = ranked.join(previous, F.col("_rank") == F.col("_next"), "left").withColumn(
        "_start", F.when(F.col("_prev") == F.col("qname"), 0).otherwise(1).cast("bigint")
    )
    summed = prefix_sum(starts, "_rank", "_start", "_before", n_rows)
    return summed.withColumn("island", F.col("_before") + F.col("_start")).drop(
        "_rank", "_next", "_prev", "_start", "_before"
    )


def mate_of_flag(flag: str = "flag") -> Column:
    """1 or 2 from SAM flag bits; an unpaired alignment is an error."""
    bits = F.col(flag)
    return (
        F.when(bits.bitwiseAND(0x40) != 0, F.lit(1))
        .when(bits.bitwiseAND(0x80) != 0, F.lit(2))
        .otherwise(F.raise_error(F.lit("alignment is neither first nor last in its pair")).cast("int"))
    )


def _slim(alignments: DataFrame, keys: list[str]) -> DataFrame:
    primary = ~F.col("is_secondary") & ~F.col("is_supplementary")
    return alignments.select(
        *keys,
        "mate",
        "ord",
        F.col("ref_id").cast("bigint").alias("ref_id"),
        midpoint().cast("bigint").alias("mid"),
        F.col("is_reverse").alias("rev"),
        F.col("mapq").cast("int").alias("mapq"),
        F.col("is_mapped").alias("mapped"),
        F.col("is_secondary").alias("sec"),
        (F.col("is_supplementary") & ~F.col("is_secondary")).alias("supp"),
        primary.alias("prime"),
    )


def summarize_reads(alignments: DataFrame, keys: list[str]) -> DataFrame:
    """One row per read: counts by mate and kind, and each mate's last primary alignment."""
    slim = _slim(alignments, keys)
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    aggs = [count(F.col("mate") == m).alias(f"n{m}") for m in (1, 2)]
    aggs += [count(F.col(k)).alias(f"n_{k}") for k in ("prime", "supp", "sec")]
    for m in (1, 2):
        at = F.when((F.col("mate") == m) & F.col("prime"), F.col("ord"))
        aggs.append(F.max(at).alias(f"p{m}_ord"))
        for c in ("mapq", "mapped"):
            aggs.append(F.max_by(c, at).alias(f"p{m}_{c}"))
    return slim.groupBy(*keys).agg(*aggs)


def leading_alignments(alignments: DataFrame, keys: list[str]) -> DataFrame:
    """One row per read: the first two alignments of each mate in file order."""
    slim = _slim(alignments, keys).select(*keys, "mate", "ord", *_PARTS)
    order = Window.partitionBy(*keys, "mate").orderBy("ord")
    two = slim.withColumn("_rn", F.row_number().over(order)).where("_rn <= 2")
    aggs = []
    for m in (1, 2):
        for k in (1, 2):
            here = (F.col("mate") == m) & (F.col("_rn") == k)
            for c in _PARTS:
                aggs.append(F.max(F.when(here, F.col(c))).alias(f"a{m}{k}_{c}"))
    return two.groupBy(*keys).agg(*aggs)


def route_reads(
    alignments: DataFrame,
    strategy: str = "complex",
    min_mapq: int = MIN_MAPQ,
    max_molecule_size: int = MAX_MOLECULE_SIZE,
    adjacent: bool = False,
    n_rows: int | None = None,
    mapq_zero_rescue: bool = False,
    matched_rate: float = 0.8,
) -> DataFrame:
    """One row per read with its counts, its route and the chosen alignments.

    ``shape`` is UU (one alignment per mate), UD (one against several), DD (two
    against two) or null.  ``emitted`` tells whether the read gives a pair,
    whose two alignments are ref_id1, mid1, rev1 and ref_id2, mid2, rev2 in
    stored order.  ``adjacent=True`` splits a read name that comes back later
    in the file into separate reads.  ``mapq_zero_rescue`` and ``matched_rate``
    are settings of the method that no rule uses; any value gives the same rows.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    keys = ["qname"]
    if adjacent:
        alignments, keys = number_islands(alignments, n_rows), ["qname", "island"]
    level = STRATEGIES.index(strategy)
    reads = summarize_reads(alignments, keys).join(leading_alignments(alignments, keys), keys)

    paired = (F.col("n1") > 0) & (F.col("n2") > 0)
    primaries = paired & F.col("p1_ord").isNotNull() & F.col("p2_ord").isNotNull()
    mapped = primaries & F.col("p1_mapped") & F.col("p2_mapped")
    reads = reads.withColumn("paired", paired).withColumn("primaries", primaries)
    reads = reads.withColumn("mapped", mapped)
    one1, one2 = F.col("n1") == 1, F.col("n2") == 1
    shape = (
        F.when(~F.col("mapped"), None)
        .when(one1 & one2, "UU")
        .when(one1 | one2, "UD" if level >= 1 else None)
        .when((F.col("n1") == 2) & (F.col("n2") == 2), "DD" if level >= 2 else None)
    )
    met = {
        f"{kind}{i}{j}": test
        for i in (1, 2)
        for j in (1, 2)
        for kind, test in (
            ("near", near(f"a1{i}", f"a2{j}", max_molecule_size)),
            ("opp", opposed(f"a1{i}", f"a2{j}")),
        )
    }
    reads = reads.withColumns({"shape": shape, **met}).withColumn("_pick", _choice())
    return _chosen_pair(reads, min_mapq).drop(
        *met, "_pick", *[f"a{m}{k}_{c}" for m in (1, 2) for k in (1, 2) for c in _PARTS]
    )


def _choice() -> Column:
    """Which alignments stand for the read: 10 * (of mate 1) + (of mate 2), or null.

    Every route ends in one of mate 1's and one of mate 2's first two
    alignments.  Columns near_ij and opp_ij compare the i-th with the j-th.
    """
    c = F.col
    both = lambda i, j, code: F.when(c(f"opp{i}{j}"), code)
    # One alignment of mate 1: the other end is the one of mate 2 that does not lie by it.
    single1 = F.when(c("near12"), both(1, 2, 11)).when(c("near11"), both(1, 1, 12))
    single2 = F.when(c("near21"), both(2, 1, 11)).when(c("near11"), both(1, 1, 21))
    double = F.when(c("near11") & c("near22"), F.when(c("opp11") & c("opp22"), 12)).when(
        c("near12") & c("near21"), F.when(c("opp12") & c("opp21"), 11)
    )
    return (
        F.when(c("shape") == "UU", 11)
        .when((c("shape") == "UD") & (c("n1") == 1), single1)
        .when(c("shape") == "UD", single2)
        .when(c("shape") == "DD", double)
    )


def _chosen_pair(reads: DataFrame, min_mapq: int) -> DataFrame:
    """Order the chosen alignments by contig, then midpoint; drop weakly mapped ones.

    At equal places the later of the two named ones comes first: mate 2, but
    mate 1 where mate 1 is the single alignment of a rescued read.
    """
    of1 = lambda part: F.when(F.col("_pick") > 20, F.col(f"a12_{part}")).otherwise(F.col(f"a11_{part}"))
    of2 = lambda part: F.when(F.col("_pick") % 10 == 2, F.col(f"a22_{part}")).otherwise(F.col(f"a21_{part}"))
    reads = reads.withColumns(
        {f"_x_{p}": of1(p) for p in _PARTS} | {f"_y_{p}": of2(p) for p in _PARTS}
    )
    x_ref, y_ref, x_mid, y_mid = (F.col(n) for n in ("_x_ref_id", "_y_ref_id", "_x_mid", "_y_mid"))
    tie = (x_ref == y_ref) & (x_mid == y_mid)
    lone1 = (F.col("shape") == "UD") & (F.col("n1") == 1)
    x_first = (x_ref < y_ref) | ((x_ref == y_ref) & (x_mid < y_mid)) | (tie & lone1)
    good = (F.col("_x_mapq") >= min_mapq) & (F.col("_y_mapq") >= min_mapq)
    reads = reads.withColumn("_x_first", x_first).withColumn(
        "emitted", F.coalesce(F.col("_pick").isNotNull() & good, F.lit(False))
    )
    put = {}
    for p in ("ref_id", "mid", "rev"):
        x, y = F.col(f"_x_{p}"), F.col(f"_y_{p}")
        put[f"{p}1"] = F.when(F.col("_x_first"), x).otherwise(y)
        put[f"{p}2"] = F.when(F.col("_x_first"), y).otherwise(x)
    return reads.withColumns(put).drop(
        "_x_first", *[f"_{e}_{p}" for e in "xy" for p in _PARTS]
    )


def emitted_pairs(
    routed: DataFrame,
    references: DataFrame,
    n_references: int,
    longest_name: int = 64,
    shapes: tuple[str, ...] = ("UU", "UD", "DD"),
) -> DataFrame:
    """Contact pairs in pairs-file columns plus ``shape``.

    ``references`` maps ref_id to ref_name.  A chosen alignment without a
    contig turns the row into the placeholder of the format: empty names,
    position -1, forward strands.
    """
    kept = routed.where(F.col("emitted") & F.col("shape").isin(*shapes))
    flat = kept.select(
        F.col("qname").alias("read_name"),
        "shape",
        *[f"{c}{i}" for i in (1, 2) for c in ("ref_id", "mid", "rev")],
    )
    for i in "12":
        side = references.select(
            F.col("ref_id").cast("bigint").alias("_ref"), F.col("ref_name").alias(f"name{i}")
        )
        flat = lookup(flat, side, {f"ref_id{i}": "_ref"}, n_references, "left", longest_name)
    placed = (F.col("ref_id1") != -1) & (F.col("ref_id2") != -1)
    unknown = F.raise_error(F.lit("reference id is not in the header"))
    name = lambda i: F.when(placed, F.coalesce(F.col(f"name{i}"), unknown)).otherwise("")
    strand = lambda i: F.when(placed & F.col(f"rev{i}"), "-").otherwise("+")
    pos = lambda i: F.when(placed, F.col(f"mid{i}")).otherwise(F.lit(-1).cast("bigint"))
    return flat.select(
        F.when(placed, F.col("read_name")).otherwise("").alias("read_name"),
        name(1).alias("tig1"),
        pos(1).alias("pos1"),
        name(2).alias("tig2"),
        pos(2).alias("pos2"),
        strand(1).alias("strand1"),
        strand(2).alias("strand2"),
        "shape",
    )


def _counters() -> list[Column]:
    """Counters over all reads.

    Two placed contigs are the same exactly if their ids are; a placeholder
    row has two empty names and counts as a contact within one contig.
    """
    total = lambda value, name: F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(name)
    flag = lambda cond, name: total(F.when(cond, 1).otherwise(0), name)
    emitted = F.col("emitted")
    r1, r2 = F.col("ref_id1"), F.col("ref_id2")
    intra = (r1 == r2) | (r1 == -1) | (r2 == -1)
    m1, m2 = F.col("p1_mapped"), F.col("p2_mapped")
    z1, z2 = F.col("p1_mapq") == 0, F.col("p2_mapq") == 0
    inside = lambda name: F.when(F.col("paired"), F.col(name)).otherwise(0)
    return [
        flag(F.col("paired"), "reads"),
        total(F.col("n1") + F.col("n2"), "alignments"),
        flag(emitted, "pairs"),
        flag(F.col("primaries") & ~m1 & ~m2, "unmapped_both"),
        flag(F.col("primaries") & (m1 != m2), "unmapped_one"),
        flag(F.col("primaries") & m1 & m2, "mapped_both"),
        total(inside("n_prime"), "primary"),
        total(inside("n_supp"), "supplementary"),
        total(inside("n_sec"), "secondary"),
        flag(F.col("mapped") & z1 & z2, "mapq0_both"),
        flag(F.col("mapped") & (z1 != z2), "mapq0_one"),
        flag(F.col("mapped") & ~z1 & ~z2, "mapq0_none"),
        flag(emitted & intra, "intra"),
        flag(emitted & ~intra, "inter"),
        *[
            flag(emitted & (F.col("shape") == s), f"pairs_{n}")
            for s, n in (("UU", "unique"), ("UD", "simple"), ("DD", "complex"))
        ],
    ]


def conversion_stats(routed: DataFrame) -> DataFrame:
    """One row of counters over all reads."""
    return routed.agg(*_counters())


def counted(routed: DataFrame) -> tuple[DataFrame, Observation]:
    """``routed`` as it is, and its counters once an action has gone over it: pairs and counters take one pass."""
    seen = Observation()
    return routed.observe(seen, *_counters()), seen


def observed_stats(spark: SparkSession, seen: Observation) -> DataFrame:
    """The row ``conversion_stats`` gives, from an observation whose action has ended."""
    names = ", ".join(f"{name} bigint" for name in seen.get)
    return spark.createDataFrame([tuple(seen.get.values())], names)
