"""GFA1 text: header, segment and link records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.tags import TAG_VALUE, parse_tags
from .text_order import with_file_order

# Record letters; C and P are known but not read.
READ_RECORDS = ("H", "S", "L")
KNOWN_RECORDS = ("#", "H", "S", "L", "C", "P")


def record_type(field: Column) -> Column:
    """The record letter, null for anything that is not exactly one known letter."""
    return F.when(field.isin(*KNOWN_RECORDS), field)


def gfa_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-comment lines: record letter, tab-separated fields, file order.

    Quotes have no meaning in a field.
    """
    lines = with_file_order(spark.read.text(path))
    fields = F.split("value", "\t", -1)
    return lines.where((F.col("value") != "") & ~F.col("value").startswith("#")).select(
        record_type(fields[0]).alias("record"), fields.alias("fields"), "ord"
    )


def _tags_from(at: int) -> Column:
    fields = F.col("fields")
    count = F.greatest(F.size(fields) - at, F.lit(0))
    return parse_tags(F.slice(fields, F.lit(at + 1), count))


def _need(cond: Column, message: str, value: Column) -> Column:
    return F.when(cond, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def header_tags(lines: DataFrame) -> DataFrame:
    """One row with the tags of the last header line, no row without one."""
    heads = lines.where("record = 'H'").select("ord", _tags_from(1).alias("tags"))
    return heads.groupBy().agg(F.max_by("tags", "ord").alias("tags")).where("tags is not null")


def segments(lines: DataFrame) -> DataFrame:
    """name, seq (null for ``*``), tags."""
    f = F.col("fields")
    whole = F.size(f) >= 3
    seq = _need(
        whole & (F.try_element_at(f, F.lit(3)) != ""),
        "a segment line needs a name and a sequence",
        F.when(~F.try_element_at(f, F.lit(3)).startswith("*"), F.try_element_at(f, F.lit(3))),
    )
    return lines.where("record = 'S'").select(
        _need(whole, "a segment line needs a name and a sequence", F.try_element_at(f, F.lit(2))).alias("name"),
        seq.alias("seq"),
        _tags_from(3).alias("tags"),
    )


def links(lines: DataFrame) -> DataFrame:
    """from_name, from_strand, to_name, to_strand, cigar, tags."""
    f = F.col("fields")
    at = lambda i: F.try_element_at(f, F.lit(i + 1))
    whole = F.size(f) >= 6
    message = "a link line needs two oriented names and an overlap"
    strand = lambda i: _need(whole & at(i).isin("+", "-"), message, at(i))
    return lines.where("record = 'L'").select(
        _need(whole, message, at(1)).alias("from_name"),
        strand(2).alias("from_strand"),
        at(3).alias("to_name"),
        strand(4).alias("to_strand"),
        at(5).alias("cigar"),
        _tags_from(6).alias("tags"),
    )


@dataclass
class Gfa:
    """The three record tables of one graph."""

    header: DataFrame
    segments: DataFrame
    links: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Gfa":
        lines = gfa_lines(spark, path)
        return cls(header_tags(lines), segments(lines), links(lines))

    @classmethod
    def empty(cls, spark: SparkSession) -> "Gfa":
        tags = f"tags map<string,{TAG_VALUE}>"
        return cls(
            spark.createDataFrame([], tags),
            spark.createDataFrame([], f"name string, seq string, {tags}"),
            spark.createDataFrame(
                [], f"from_name string, from_strand string, to_name string, to_strand string, cigar string, {tags}"
            ),
        )

    def with_header(self, tags: DataFrame) -> "Gfa":
        return Gfa(tags, self.segments, self.links)

    def with_segments(self, more: DataFrame) -> "Gfa":
        return Gfa(self.header, self.segments.unionByName(more), self.links)

    def with_links(self, more: DataFrame) -> "Gfa":
        return Gfa(self.header, self.segments, self.links.unionByName(more))
