"""Matrix balancing: by bin length, or by genome-wide iterative correction."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Observation, functions as F

from ..plans.lookups import block_keys, broadcast_budget, lookup, lookup_in_blocks, value_blocks
from ..plans.ordering import exact_median
from ..plans.storage import AlternatingTable, materialize, new_scratch_path
from .genome import Genome

# Fixed values of the method.
IGNORE_DIAGS = 3
MIN_NNZ = 5
MAX_ITERS = 400
MAD_MAX = 5.0
VAR_BOUND = 1e-5

BLOCK_BINS = 8_192
BUCKET_BINS = 1 << 17  # bins whose contacts a task sums

NAN = float("nan")


def length_weights(bins: DataFrame, res: int) -> DataFrame:
    """The same weight 1/res for every bin."""
    return bins.select("bin_id", (F.lit(1.0) / F.lit(float(res))).alias("weight"))


def off_diagonal(pixels: DataFrame, ignore_diags: int = IGNORE_DIAGS) -> DataFrame:
    """Pixels that count for balancing; the ones near the diagonal weigh zero."""
    far = F.abs(F.col("bin1_id") - F.col("bin2_id")) >= ignore_diags
    return pixels.where(far & (F.col("count") != 0))


def mirrored(pixels: DataFrame) -> DataFrame:
    """Every pixel seen from both of its bins: bin_id, other_id, count."""
    seen = F.array(
        F.struct(F.col("bin1_id").alias("bin_id"), F.col("bin2_id").alias("other_id")),
        F.struct(F.col("bin2_id").alias("bin_id"), F.col("bin1_id").alias("other_id")),
    )
    return pixels.select(F.explode(seen).alias("_seen"), "count").select("_seen.*", "count")


def marginals(pixels: DataFrame, bins: DataFrame, ignore_diags: int = IGNORE_DIAGS) -> DataFrame:
    """Per bin: number of non-zero pixels and their sum, zero where there are none.

    Bins and contacts are summed together.  A join would take bins, which are
    made from a few rows of contigs, for a small table and broadcast them.
    """
    seen = mirrored(off_diagonal(pixels, ignore_diags)).select(
        "bin_id", F.lit(None).cast("bigint").alias("tig_id"), F.lit(1).alias("_n"), "count"
    )
    every = bins.select("bin_id", F.col("tig_id").cast("bigint"), F.lit(0).alias("_n"), F.lit(0).cast(seen.schema["count"].dataType).alias("count"))
    sums = every.unionByName(seen).groupBy("bin_id")
    return (
        sums.agg(F.max("tig_id").alias("tig_id"), F.sum("_n").alias("nnz"), F.sum("count").alias("total"))
        .where("tig_id is not null")  # a pixel outside the matrix
        .select("bin_id", "tig_id", "nnz", "total")
    )


def scaled_marginals(margs: DataFrame, n_tigs: int, n_bins: int, longest: int | None = None) -> DataFrame:
    """Add ``scaled``: a bin's total over the median positive total of its contig (of at most ``longest`` bins)."""
    positive = margs.where("total > 0").withColumn("_x", F.col("total").cast("double"))
    medians = exact_median(positive, "_x", "tig_id", "_median", n_bins, n_tigs, longest)
    joined = lookup(margs, medians, {"tig_id": "tig_id"}, n_tigs, "left")
    scaled = F.coalesce(F.col("total") / F.col("_median"), F.lit(0.0))
    return joined.withColumn("scaled", scaled).drop("_median")


def mad_cutoff(scaled: DataFrame, n_bins: int, mad_max: float = MAD_MAX) -> float | None:
    """Lower bound on scaled marginals, or None if no bin has any contact."""
    logs = scaled.where("scaled != 0").select(F.ln("scaled").alias("_x"))
    middle = exact_median(logs, "_x", None, "m", n_bins).first()
    if middle is None or middle["m"] is None:
        return None
    away = logs.select(F.abs(F.col("_x") - F.lit(middle["m"])).alias("_x"))
    spread = exact_median(away, "_x", None, "m", n_bins).first()["m"]
    return math.exp(middle["m"] - mad_max * spread)


def bin_masks(
    pixels: DataFrame,
    genome: Genome,
    res: int,
    ignore_diags: int = IGNORE_DIAGS,
    min_nnz: int = MIN_NNZ,
    mad_max: float = MAD_MAX,
) -> DataFrame:
    """Per bin: marginals and whether either mask removes it from balancing."""
    n_bins = genome.n_bins(res)
    margs = marginals(pixels, genome.bins(res), ignore_diags)
    scaled = materialize(scaled_marginals(margs, genome.n_tigs, n_bins, genome.longest_bins(res)), "marginals")
    cutoff = mad_cutoff(scaled, n_bins, mad_max)
    low = F.lit(False) if cutoff is None else F.col("scaled") < F.lit(cutoff)
    return scaled.withColumn("few_nnz", F.col("nnz") < min_nnz).withColumn("low_mad", low)


def _block(column: str, size: int):
    return F.expr(f"{column} div {size}")


class BlockedContacts:
    """Contacts laid out once; a round moves biases, and sums only where these don't fit the broadcast budget.

    If the biases fit, every contact is kept for both of its bins in a table
    bucketed by bin: a bin's sum is made where its contacts are and no contact
    is shuffled again.  Past the budget contacts are bucketed by (row block,
    column block), and a round shuffles one pair of bias blocks for each block
    of the matrix that holds contacts, and partial sums by bin.
    """

    def __init__(self, contacts: DataFrame, n_bins: int):
        self.spark, self.size, self.n_bins = contacts.sparkSession, block_keys(n_bins, BLOCK_BINS), n_bins
        self.small = n_bins * 8 <= broadcast_budget(self.spark)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"contacts_{uuid.uuid4().hex}"
        path = new_scratch_path(self.spark, "contacts")
        if self.small:
            n = max(n, -(-n_bins // BUCKET_BINS))
            writer = mirrored(contacts).repartition(n, "bin_id").write.bucketBy(n, "bin_id").sortBy("bin_id")
        else:
            blocks = [_block(f"bin{end}_id", self.size).alias(f"block{end}") for end in "12"]
            order = ["block1", "block2", "bin1_id", "bin2_id"]
            writer = contacts.select(*blocks, "bin1_id", "bin2_id", "count").write.bucketBy(n, "block1", "block2").sortBy(*order)
        writer.option("path", path).saveAsTable(name)
        self.name, self.table = name, self.spark.table(name)
        if not self.small:
            self.pairs = materialize(self.table.select("block1", "block2").distinct(), "blocks")

    def sums(self, state: DataFrame) -> DataFrame:
        """bin_id and marginal of every bin that holds contacts, for biases ``state`` (bin_id, bias) of all bins."""
        bias = value_blocks(state, "bias", self.size)
        if self.small:
            seen = lookup_in_blocks(self.table, bias, "other_id", "bias", self.size)
            sums = seen.groupBy("bin_id").agg(F.sum(F.col("count") * F.col("bias")).alias("_others"))
            own = lookup_in_blocks(sums, bias, "bin_id", "bias", self.size)
            return own.select(F.col("bin_id").alias("_bin"), (F.col("_others") * F.col("bias")).alias("_sum"))
        one = bias.select(F.col("block").alias("block1"), F.col("held").alias("bias1"))
        two = bias.select(F.col("block").alias("block2"), F.col("held").alias("bias2"))
        moved = self.pairs.join(one, "block1").join(two, "block2")
        joined = self.table.join(moved.hint("shuffle_hash"), ["block1", "block2"])
        at = lambda end: F.expr(f"bias{end}[cast(bin{end}_id % {self.size} as int)]")
        value = (F.col("count") * at("1") * at("2")).alias("_v")
        seen = joined.select(F.explode(F.array("bin1_id", "bin2_id")).alias("_bin"), value)
        return seen.groupBy("_bin").agg(F.sum("_v").alias("_sum"))

    def drop(self) -> None:
        """Forget the bucketed table; its files stay with the scratch folder."""
        self.spark.sql(f"drop table if exists {self.name}")


def iterative_weights(
    pixels: DataFrame,
    genome: Genome,
    res: int,
    n_iters: int = MAX_ITERS,
    var_bound: float = VAR_BOUND,
    ignore_diags: int = IGNORE_DIAGS,
    min_nnz: int = MIN_NNZ,
    mad_max: float = MAD_MAX,
) -> DataFrame | None:
    """Genome-wide iterative correction: bin_id, weight (NaN for masked bins).

    Each round divides every bias by its bin's share of the mean marginal and
    stops once the variance of the marginals found in that round is small.
    None means nothing was left to balance.

    A round is one action: it multiplies the blocks of contacts with their
    biases, sums the products by bin, writes the biases with their marginals
    and observes mean and variance while it writes.  Masked bins have bias
    zero throughout, so their contacts add nothing to any sum.
    """
    masks = bin_masks(pixels, genome, res, ignore_diags, min_nnz, mad_max)
    n_bins = genome.n_bins(res)
    masks = materialize(masks.select("bin_id", (F.col("few_nnz") | F.col("low_mad")).alias("masked")), "masks")
    contacts = off_diagonal(pixels, ignore_diags)
    blocks = BlockedContacts(contacts, n_bins)
    table = AlternatingTable(genome.spark, "bias")

    def one_pass(bias: DataFrame) -> tuple[DataFrame, float | None, float | None]:
        sums = blocks.sums(bias)
        state = bias.join(sums, F.col("bin_id") == F.col("_bin"), "left").select(
            "bin_id", "bias", F.coalesce("_sum", F.lit(0.0)).alias("marg")
        )
        seen = Observation()
        taking_part = F.when(F.col("marg") != 0, F.col("marg"))
        stored = table.replace(state.observe(seen, F.avg(taking_part).alias("mean"), F.var_pop(taking_part).alias("variance")))
        return stored, seen.get["mean"], seen.get["variance"]

    bias = masks.select("bin_id", F.when(F.col("masked"), 0.0).otherwise(1.0).alias("bias"))
    try:
        for _ in range(n_iters):
            state, mean, variance = one_pass(bias)
            if mean is None:
                return None
            share = F.when(F.col("marg") == 0, F.lit(1.0)).otherwise(F.col("marg") / F.lit(mean))
            bias = state.select("bin_id", (F.col("bias") / share).alias("bias"))
            if variance < var_bound:
                break
        state, scale, _ = one_pass(bias)
    finally:
        blocks.drop()
    if scale is None:
        return None
    weight = F.when(F.col("bias") == 0, F.lit(NAN)).otherwise(F.col("bias") / F.lit(math.sqrt(scale)))
    return state.select("bin_id", weight.alias("weight"))


def balance_weights(
    pixels: DataFrame, genome: Genome, res: int, strategy: str | None
) -> DataFrame | None:
    """Weights by strategy name: ``ICGW``, ``LEN``; any other name balances nothing."""
    if strategy == "ICGW":
        return iterative_weights(pixels, genome, res)
    if strategy == "LEN":
        return length_weights(genome.bins(res), res)
    return None
