"""File order of text rows as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..plans.lookups import lookup

_ROW_BITS = 33
_LARGEST_FILE = 44  # bits of the offset of a split in one file


def _split_bits(spark: SparkSession) -> int:
    """Splits of one file start at least ``1 << bits`` bytes apart in this session."""
    text = [spark.conf.get(f"spark.sql.files.{k}") for k in ("maxPartitionBytes", "openCostInBytes")]
    return max(0, min(_size(t) for t in text).bit_length() - 1)


def _size(text: str) -> int:
    """Bytes of a size setting such as 134217728b, 64k or 16m."""
    text = text.strip().lower().removesuffix("b") or "0"
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1])
    return int(text[:-1]) << unit if unit else int(text)


def _plain_path(path: Column) -> Column:
    """A path the way the session lists it: one slash after the scheme."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*:)/+", "$1/")


def with_file_order(df: DataFrame) -> DataFrame:
    """Add a unique ``ord`` that follows the rows of a file-backed DataFrame.

    The number is the file's place in the list of files by name, then the
    offset of the split, then the row in its task, so no row is moved.
    """
    spark, columns = df.sparkSession, df.columns
    files = sorted({_one_slash(f) for f in df.inputFiles()})
    unit = _split_bits(spark)
    offset_bits = max(1, _LARGEST_FILE - unit)
    file_bits = max(1, (max(1, len(files)) - 1).bit_length())
    row_bits = min(_ROW_BITS, 63 - offset_bits - file_bits)
    if row_bits < 24:
        raise ValueError("too many files or too small splits to number rows; raise spark.sql.files.openCostInBytes")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    split = F.shiftright(F.col("_metadata.file_block_start"), unit)
    too_many = F.raise_error(F.lit("a split has too many rows to number")).cast("bigint")
    inside = F.shiftleft(split, row_bits) + F.when(row < (1 << row_bits), row).otherwise(too_many)
    if len(files) <= 1:
        return df.select(*columns, inside.alias("ord"))
    placed = df.select(*columns, _plain_path(F.col("_metadata.file_path")).alias("_file"), inside.alias("_inside"))
    table = spark.createDataFrame(
        list(enumerate(files)), T.StructType([T.StructField("_at", T.LongType()), T.StructField("_path", T.StringType())])
    )
    widest = max(len(f.encode()) for f in files)
    numbered = lookup(placed, table, {"_file": "_path"}, len(files), "left", string_bytes=widest)
    unlisted = F.raise_error(F.concat(F.lit("a file came up that was not listed: "), F.col("_file"))).cast("bigint")
    ord_ = F.shiftleft(F.coalesce("_at", unlisted), row_bits + offset_bits) + F.col("_inside")
    return numbered.select(*columns, ord_.alias("ord"))


def _one_slash(path: str) -> str:
    scheme, colon, rest = path.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if colon else path
