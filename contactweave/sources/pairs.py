"""Pairs files and contig-length files: tab-separated text without a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import LENGTHS, PAIR_COLUMNS, PAIR_TEXT_COLUMNS, PAIRS
from .text_order import with_file_order


# Pruned columns would hide rows with too few or too many fields.
STRICT_TEXT = {"sep": "\t", "header": False, "mode": "FAILFAST", "quote": "", "columnPruning": False}


def read_pairs(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Contact pairs; ``#`` lines are comments and a row without 7 fields is an error.

    An empty name stays an empty string, as placeholder rows have it.
    ``ordered=True`` adds the file order as ``ord``.
    """
    rows = spark.read.schema(PAIRS).options(**STRICT_TEXT, comment="#").csv(path)
    rows = with_file_order(rows) if ordered else rows
    return rows.fillna("", PAIR_TEXT_COLUMNS)


def write_pairs(pairs: DataFrame, path: str, names_only: bool = False) -> None:
    """Pairs as text in the column order of the format, or only their read names.

    Row order inside and across part files follows the input's order.
    """
    columns = ["read_name"] if names_only else PAIR_COLUMNS
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    pairs.select(line.alias("value")).write.text(path)


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Contig names and lengths with their file order ``ord``; no comment lines."""
    rows = spark.read.schema(LENGTHS).options(**STRICT_TEXT).csv(path)
    return with_file_order(rows)
