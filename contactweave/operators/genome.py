"""Contig dictionary and bin geometry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..errors import ContactWeaveError
from ..plans.lookups import fits_broadcast
from ..plans.ordering import global_rank, prefix_sum
from ..plans.storage import materialize

_BIN_CHUNK = 65_536


def order_contigs(lengths: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Number contigs by ascending length; equal lengths keep the order of ``ord``."""
    return global_rank(
        lengths.select("tig_name", F.col("length").cast("bigint").alias("length"), "ord"),
        ["length", "ord"],
        "tig_id",
        n_rows,
    ).select("tig_id", "tig_name", "length")


def last_name_wins(contigs: DataFrame) -> DataFrame:
    """One row per contig name: a repeated name points at its last id."""
    return contigs.groupBy("tig_name").agg(
        F.max_by("length", "tig_id").alias("length"), F.max("tig_id").alias("tig_id")
    )


@dataclass
class Genome:
    """Contigs with dense ids and the sizes every broadcast decision needs."""

    contigs: DataFrame
    n_tigs: int
    longest_name: int
    unique_names: bool
    _bin_counts: dict[int, int] = field(default_factory=dict)

    @classmethod
    def from_lengths(cls, lengths: DataFrame) -> "Genome":
        """``lengths`` holds tig_name, length and the file order ``ord``."""
        n_rows = lengths.count()
        return cls.from_contigs(materialize(order_contigs(lengths, n_rows), "contigs"))

    @classmethod
    def from_contigs(cls, contigs: DataFrame) -> "Genome":
        facts = contigs.agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.octet_length("tig_name")).alias("longest"),
            F.min("length").alias("shortest"),
        ).first()
        if facts["n"] and facts["shortest"] < 0:
            raise ContactWeaveError("contig lengths must not be negative")
        repeated = contigs.groupBy("tig_name").count().where("count > 1").limit(1).count()
        return cls(contigs, facts["n"], facts["longest"] or 0, repeated == 0)

    @property
    def spark(self):
        return self.contigs.sparkSession

    def n_bins(self, res: int) -> int:
        if res not in self._bin_counts:
            total = self.contigs.agg(F.sum(_bins_of(res)).alias("n")).first()["n"]
            self._bin_counts[res] = int(total or 0)
        return self._bin_counts[res]

    def longest_bins(self, res: int) -> int:
        """Bins of the longest contig."""
        return self.contigs.agg(F.max(_bins_of(res))).first()[0] or 0

    def offsets(self, res: int) -> DataFrame:
        """Per contig: its bin count and the id of its first bin."""
        sized = self.contigs.withColumn("n_bins", _bins_of(res))
        return prefix_sum(sized, "tig_id", "n_bins", "chrom_offset", self.n_tigs).select(
            "tig_id", "tig_name", "length", "n_bins", "chrom_offset"
        )

    def names(self, res: int) -> DataFrame:
        """Name lookup used to place a position: tig_id, tig_name, length, chrom_offset."""
        table = self.offsets(res)
        if not self.unique_names:
            kept = last_name_wins(self.contigs).select(F.col("tig_id").alias("_kept"))
            table = table.join(kept, F.col("tig_id") == F.col("_kept"), "left_semi")
        return table.select("tig_id", "tig_name", "length", "chrom_offset")

    def names_fit(self, res: int) -> bool:
        return fits_broadcast(self.names(res), self.n_tigs, self.longest_name)

    def tig_index(self, res: int) -> DataFrame:
        """Contig offsets plus the closing row that holds the number of bins."""
        rows = self.offsets(res).select("tig_id", "chrom_offset", "n_bins")
        close = rows.agg(
            F.count(F.lit(1)).alias("tig_id"),
            F.coalesce(F.sum("n_bins"), F.lit(0)).alias("chrom_offset"),
            F.lit(0).cast("bigint").alias("n_bins"),
        )
        return rows.unionByName(close)

    def bins(self, res: int) -> DataFrame:
        """One row per bin: bin_id, tig_id, start, end.

        Long contigs are cut into chunks first, so no row expands to more than
        a fixed number of bins at once.
        """
        chunks = self.offsets(res).where("n_bins > 0").withColumn(
            "_chunk", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1, F.lit(_BIN_CHUNK)))
        )
        if self.n_tigs > _BIN_CHUNK or self.n_bins(res) > 16 * _BIN_CHUNK:
            chunks = chunks.repartition("tig_id", "_chunk")
        k = F.col("_k")
        return chunks.withColumn(
            "_k",
            F.explode(
                F.sequence(
                    F.col("_chunk"),
                    F.least(F.col("_chunk") + _BIN_CHUNK, F.col("n_bins")) - 1,
                )
            ),
        ).select(
            (F.col("chrom_offset") + k).alias("bin_id"),
            "tig_id",
            (k * res).alias("start"),
            F.least((k + 1) * res, F.col("length")).alias("end"),
        )


def _bins_of(res: int):
    return F.expr(f"(length + {res} - 1) div {res}")


def bin_index(pixels: DataFrame, bins: DataFrame, n_bins: int) -> DataFrame:
    """Row pointers into pixels sorted by (bin1_id, bin2_id), with a closing row.

    ``bin1_offset`` of a bin is the number of pixels whose first bin is smaller.
    """
    held = pixels.groupBy("bin1_id").agg(F.count(F.lit(1)).alias("_held"))
    every = bins.select("bin_id").join(held, F.col("bin_id") == F.col("bin1_id"), "left")
    sized = every.select("bin_id", F.coalesce("_held", F.lit(0)).alias("_held"))
    rows = prefix_sum(sized, "bin_id", "_held", "bin1_offset", n_bins)
    close = pixels.agg(
        F.lit(n_bins).cast("bigint").alias("bin_id"), F.count(F.lit(1)).alias("bin1_offset")
    )
    return rows.select("bin_id", "bin1_offset").unionByName(close)


def contig_bin_range(bins: DataFrame) -> DataFrame:
    """First and last bin of every contig that has one."""
    return bins.groupBy("tig_id").agg(
        F.min("bin_id").alias("first_bin"), F.max("bin_id").alias("last_bin")
    )
