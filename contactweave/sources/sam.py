"""SAM text: alignment rows and the reference dictionary of the header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.cigar import parse_cigar, ref_length
from ..operators.convert import mate_of_flag
from ..plans.lookups import lookup
from ..plans.ordering import global_rank
from ..plans.storage import materialize
from .text_order import with_file_order


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """ref_id and ref_name in the order of the ``@SQ`` header lines."""
    lines = spark.read.text(path).where(F.col("value").startswith("@SQ\t"))
    ordered = materialize(with_file_order(lines), "header")  # the text is read once for the header
    name = F.regexp_extract("value", "\tSN:([^\t]+)", 1)
    listed = ordered.select(name.alias("ref_name"), "ord")
    return materialize(global_rank(listed, ["ord"], "ref_id", listed.count()).select("ref_id", "ref_name"), "references")


def longest_name(references: DataFrame) -> int:
    """Bytes of the longest contig name."""
    return references.agg(F.max(F.octet_length("ref_name"))).first()[0] or 0


def flag_columns(flag: str = "flag") -> list[Column]:
    """Mate and the boolean parts of a SAM flag."""
    bit = lambda mask: F.col(flag).bitwiseAND(mask) != 0
    return [
        mate_of_flag(flag).alias("mate"),
        (~bit(0x4)).alias("is_mapped"),
        bit(0x10).alias("is_reverse"),
        bit(0x100).alias("is_secondary"),
        bit(0x800).alias("is_supplementary"),
    ]


def read_sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Alignments and references of name-collated SAM text.

    Positions become 0-based; ``end`` is start plus the reference length of
    the CIGAR.
    """
    references = read_references(spark, path)
    lines = with_file_order(spark.read.text(path).where(~F.col("value").startswith("@")))
    field = F.split("value", "\t")
    rows = lines.select(
        field[0].alias("qname"),
        field[1].cast("int").alias("flag"),
        field[2].alias("ref_name"),
        (field[3].cast("bigint") - 1).alias("start"),
        field[4].cast("int").alias("mapq"),
        parse_cigar(field[5]).alias("cigar"),
        "ord",
    )
    shaped = rows.select(
        "qname",
        "ref_name",
        "start",
        (F.col("start") + ref_length(F.col("cigar"))).alias("end"),
        "mapq",
        *flag_columns(),
        "ord",
    )
    numbered = lookup(
        shaped,
        references.select(F.col("ref_name").alias("_name"), "ref_id"),
        {"ref_name": "_name"},
        references.count(),
        "left",
        longest_name(references),
    )
    unknown = F.raise_error(F.lit("alignment names a contig missing from the header")).cast("bigint")
    ref_id = F.when(F.col("ref_name") == "*", F.lit(-1)).otherwise(F.coalesce("ref_id", unknown))
    return numbered.withColumn("ref_id", ref_id), references
