"""Hi-C inputs derived from the star-schema test tables.

Suppliers act as contigs and segments, line items as contact pairs and
alignments.  Everything is a column expression over whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.tags import parse_tags
from ..operators.contacts import located_pixels
from ..operators.genome import Genome
from ..operators.matrix import Matrix
from ..plans.lookups import lookup
from ..plans.ordering import global_rank
from ..plans.storage import materialize, new_scratch_path

_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
]
_RANKED = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]
_LENGTH = "cast(50000 + ((s_suppkey * 7919) % 40) * 5000 as bigint)"
_CACHE: dict[tuple[str, str], "SampleTables"] = {}


def sample_tables(spark: SparkSession, sf_dir: str) -> "SampleTables":
    """Shared per session and folder, so contigs are numbered and rows ranked once."""
    key = (spark.conf.get("spark.app.id", ""), sf_dir)
    if key not in _CACHE:
        _CACHE[key] = SampleTables(spark, sf_dir)
    return _CACHE[key]


class SampleTables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def n_suppliers(self) -> int:
        return self.table("supplier").count()

    def lengths(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "concat('s', s_suppkey) as tig_name", f"{_LENGTH} as length", "cast(s_suppkey as bigint) as ord"
        )

    @cached_property
    def genome(self) -> Genome:
        return Genome.from_lengths(self.lengths())

    def references(self) -> DataFrame:
        return self.lengths().select(F.col("ord").alias("ref_id"), F.col("tig_name").alias("ref_name"))

    @cached_property
    def n_lines(self) -> int:
        return self.table("lineitem").count()

    @cached_property
    def _ranked(self) -> DataFrame:
        used = self.table("lineitem").select(*_ORDER, "l_quantity", "l_returnflag", "l_linestatus")
        return global_rank(used, _ORDER, "ord", self.n_lines, copies=True, keep=_RANKED)

    def pairs(self, named: bool = False) -> DataFrame:
        """Contact pairs; read names and ``ord`` only if ``named``, as they need a global rank."""
        lines = self._ranked if named else self.table("lineitem")
        lines = lines.withColumn("_b", F.expr(
            "case when l_linenumber % 2 = 0 then l_suppkey"
            f" else (l_orderkey * 31 + l_partkey) % {self.n_suppliers} end"
        ))
        for end, key in (("1", "l_suppkey"), ("2", "_b")):
            side = self.lengths().select(
                F.col("ord").alias("_sup"),
                F.col("tig_name").alias(f"tig{end}"),
                F.col("length").alias(f"_len{end}"),
            )
            lines = lookup(lines, side, {key: "_sup"}, self.n_suppliers)
        ln = "cast(l_linenumber as bigint)"
        pos1 = f"(l_partkey * 9973 + {ln} * 131) % _len1"
        step = f"l_orderkey * 7907 + {ln} * 17"
        columns = [
            "tig1",
            f"{pos1} as pos1",
            "tig2",
            f"case when l_linenumber % 2 = 0 then least({pos1} + ({step}) % 30000, _len1)"
            f" else ({step}) % _len2 end as pos2",
            "case when l_returnflag = 'R' then '-' else '+' end as strand1",
            "case when l_linestatus = 'O' then '-' else '+' end as strand2",
        ]
        if named:
            columns = ["concat('r', ord) as read_name", *columns, "ord"]
        return lines.selectExpr(*columns)

    def alignments(self) -> DataFrame:
        """Alignments, stored once like the input file they stand for."""
        return self._alignments

    @cached_property
    def _alignments(self) -> DataFrame:
        """Named by order key; the rank within an order sets mate and kind.

        The global rank is sorted by order key first, so the rank within an
        order is the distance to its first row and needs no window per key.
        """
        lines = self._ranked.selectExpr("l_orderkey", "cast(l_quantity as bigint) as qty", "ord")
        firsts = lines.groupBy(F.col("l_orderkey").alias("_key")).agg(F.min("ord").alias("_first"))
        ranked = lookup(lines, firsts, {"l_orderkey": "_key"}, self.n_lines).withColumn(
            "rk", F.col("ord") - F.col("_first")
        )
        start = "(l_orderkey * 97) % 40000 + (rk * 911) % 2600"
        shaped = ranked.selectExpr(
            "concat('q', l_orderkey) as qname",
            "case when rk % 2 = 0 then 1 else 2 end as mate",
            "case when qty = 13 then -1 else (l_orderkey + case when qty % 5 = 0 then 1 else 0 end)"
            f" % {self.n_suppliers} end as ref_id",
            f"{start} as start",
            f"{start} + 50 + qty as `end`",
            "case when qty % 9 = 0 then 0 else qty end as mapq",
            "qty <> 13 as is_mapped",
            "(rk % 4) in (1, 2) as is_reverse",
            "rk >= 2 and qty % 11 = 0 as is_secondary",
            "rk >= 2 and qty % 11 <> 0 as is_supplementary",
            "ord",
        )
        return materialize(shaped, "alignments")

    def matrix(self, *resolutions: int) -> Matrix:
        """A stored matrix of all pairs with length weights at the asked resolutions."""
        for res in resolutions:
            if res not in self._matrix.resolutions():
                self._matrix.add_level(res, located_pixels(self.pairs(), self.genome, res))
                self._matrix.balance([res], "LEN")
        return self._matrix

    @cached_property
    def _matrix(self) -> Matrix:
        return Matrix.create(self.spark, new_scratch_path(self.spark, "matrix"), self.genome)

    def reopened(self) -> Matrix:
        """A matrix built from the pairs at two resolutions, with trans maxima, opened from its folder."""
        return Matrix.open(self.spark, self._built)

    @cached_property
    def _built(self) -> str:
        path = new_scratch_path(self.spark, "built")
        Matrix.build(self.spark, path, self.pairs(), self.lengths(), [10_000, 20_000], "LEN").update_trans_max()
        return path

    def segments(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "concat('s', s_suppkey) as name",
            "case when s_suppkey % 7 = 3 then null"
            " else substr('ACGTNACGGTTACA', 1 + cast(s_suppkey % 5 as int), 8) end as seq",
            f"{_LENGTH} as ln",
        )

    def tagged_segments(self) -> DataFrame:
        """Segments with their length as an LN tag, where they have a sequence."""
        fields = F.expr("array(concat('LN:i:', ln), concat('RC:i:', ln * 2))")
        tags = F.when(F.col("seq").isNotNull(), parse_tags(fields))
        return self.segments().select("name", "seq", tags.alias("tags"))

    def links(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "concat('s', s_suppkey) as from_name",
            "case when s_suppkey % 2 = 0 then '+' else '-' end as from_strand",
            f"concat('s', (s_suppkey * 3 + 1) % {self.n_suppliers + 2}) as to_name",
            "case when s_suppkey % 3 = 0 then '-' else '+' end as to_strand",
            "concat(10 + s_suppkey % 20, 'M') as cigar",
        )
