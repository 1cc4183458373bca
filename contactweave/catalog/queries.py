"""One query per operator over the sample tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import cigar as cg, sequence as sq, tags as tg
from ..operators import (
    balance as bal,
    contacts as ct,
    convert as cv,
    dedup as dd,
    genome as gn,
    graph as gr,
    region as rg,
    scaffold as sc,
)
from ..operators.matrix import Matrix
from ..plans.storage import materialize, new_scratch_path
from ..plans.zoom_order import checked_zoom_plan
from ..sources.gfa import Gfa
from ..sources.matrix_store import dump_weights
from ..sources.pairs import read_lengths, read_pairs, write_pairs
from ..sources.sam import flag_columns
from ..sources.sample_tables import SampleTables, sample_tables
from ..sources.stats_report import write_stats

RES = 10_000
MASK_RES = 2_000
ZOOM_RES = [20_000, 30_000, 60_000]
SOURCE_NODE = "s0+"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[SampleTables], DataFrame]) -> Callable[[SampleTables], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(sample_tables(spark, sf_dir))
    return fn


def _null_nan(column: str):
    return F.when(~F.isnan(column), F.col(column))


def _pixels(d: SampleTables, res: int = RES, boundary: str = "clamp") -> DataFrame:
    return ct.contact_pixels(d.pairs(), d.genome, res, boundary)


# Contigs and bins


@query
def contig_order(d):
    return d.genome.contigs


@query
def contig_offsets(d):
    return d.genome.tig_index(RES)


@query
def bin_table(d):
    return d.genome.bins(RES)


@query
def contig_bin_range(d):
    return gn.contig_bin_range(d.genome.bins(RES))


@query
def longest_contig(d):
    return sc.longest_contig(d.genome)


# Pixels


@query
def pixels_10k(d):
    return _pixels(d)


@query
def pixels_10k_strict(d):
    return _pixels(d, boundary="strict")


@query
def bin_offsets(d):
    m = d.matrix(RES)
    return gn.bin_index(m.pixels(RES), m.bins(RES), m.n_bins(RES))


@query
def pixel_slice(d):
    m = d.matrix(RES)
    return m.pixel_slice(RES, m.n_pixels(RES) // 4, m.n_pixels(RES) // 2)


@query
def zoom_20k_from_10k(d):
    zoomed = ct.zoom_pixels(d.matrix(RES).tiled_pixels(RES), d.genome, RES, 20_000)
    return zoomed.select("bin1_id", "bin2_id", "count")


@query
def zoom_chain(d):
    levels = {RES: d.matrix(RES).tiled_pixels(RES)}
    for source, target in checked_zoom_plan([RES], ZOOM_RES):
        levels[target] = ct.zoom_pixels(levels[source], d.genome, source, target)
    columns = ["bin1_id", "bin2_id", "count"]
    parts = [levels[r].select(*columns, F.lit(r).cast("bigint").alias("res")) for r in ZOOM_RES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def pyramid_one_pass(d):
    """The same levels from one scan of the stored pixels."""
    m = d.matrix(RES)
    levels = ct.pyramid(m.tiled_pixels(RES), d.genome, RES, ZOOM_RES, m.n_pixels(RES))
    return levels.select("res", "bin1_id", "bin2_id", "count")


# Balancing


def _marginals(d):
    m = d.matrix(RES)
    return bal.marginals(m.pixels(RES), m.bins(RES))


@query
def nnz_marginal(d):
    return _marginals(d).select("bin_id", "nnz")


@query
def count_marginal(d):
    return _marginals(d).select("bin_id", "total")


def _masks(d):
    return bal.bin_masks(d.matrix(MASK_RES).pixels(MASK_RES), d.genome, MASK_RES)


@query
def mask_min_nnz(d):
    return _masks(d).select("bin_id", "nnz", "few_nnz")


@query
def mask_mad(d):
    return _masks(d).select("bin_id", F.round("scaled", 9).alias("scaled"), "low_mad")


@query
def weights_len(d):
    return d.matrix(RES).weights(RES)


@query
def balanced_pixels_len(d):
    return d.matrix(RES).balanced_pixels(RES).withColumn("value", F.round("value", 14))


@query
def icgw_5_iters(d):
    pixels = d.matrix(MASK_RES).pixels(MASK_RES)
    weights = bal.iterative_weights(pixels, d.genome, MASK_RES, n_iters=5)
    return weights.select("bin_id", F.round(_null_nan("weight"), 6).alias("weight"))


@query
def icgw_converged_marginals(d):
    """Marginals of the balanced matrix: one for every bin that takes part."""
    pixels = d.matrix(RES).pixels(RES)
    weights = bal.iterative_weights(pixels, d.genome, RES)
    value = ct.balanced_pixels(bal.off_diagonal(pixels), weights, d.genome.n_bins(RES))
    seen = value.where(rg.finite("value")).select(
        F.explode(F.array("bin1_id", "bin2_id")).alias("bin_id"), "value"
    )
    return seen.groupBy("bin_id").agg(F.round(F.sum("value"), 3).alias("marginal"))


# Rectangles and rows


def _rect(d, i0, i1, j0, j1):
    """Bounds are eighths of the matrix."""
    m = d.matrix(RES)
    at = lambda eighths: m.n_bins(RES) * eighths // 8
    return m.rectangle(RES, at(i0), at(i1), at(j0), at(j1))


@query
def rect_symmetric(d):
    return _rect(d, 2, 4, 2, 4)


@query
def rect_disjoint(d):
    return _rect(d, 1, 2, 4, 6)


@query
def rect_nested(d):
    return _rect(d, 0, 8, 2, 4)


@query
def rect_overlap(d):
    return _rect(d, 1, 4, 2, 6)


@query
def rect_transposed(d):
    return _rect(d, 4, 6, 1, 2)


@query
def rect_balanced(d):
    m = d.matrix(RES)
    n = m.n_bins(RES)
    cells = m.balanced_rectangle(RES, n // 8, n // 2, n // 4, n * 6 // 8)
    return cells.withColumn("value", F.round("value", 14))


@query
def rect_upper(d):
    m = d.matrix(RES)
    n = m.n_bins(RES)
    cells = rg.upper_rectangle(m.tiled_pixels(RES), n // 8, n // 2, n // 4, n * 6 // 8, m.tile_bins(RES))
    return cells.select("bin1_id", "bin2_id", "count")


@query
def matrix_symmetric(d):
    return rg.symmetric(d.matrix(RES).pixels(RES))


@query
def row_nnz(d):
    m = d.matrix(RES)
    return m.balanced_row(RES, m.n_bins(RES) // 2).withColumn("value", F.round("value", 14))


@query
def row_dense(d):
    m = d.matrix(RES)
    return m.dense_row(RES, m.n_bins(RES) // 2).withColumn("value", F.round("value", 14))


# Scaffolding


def _trans_max(d, res=RES):
    m = d.matrix(res)
    facts = sc.bin_facts(m.bins(res), m.genome, m.weights(res))
    return facts, sc.trans_max(m.pixels(res), facts, m.n_bins(res))


def _neighbors(d, res=RES):
    facts, best = _trans_max(d, res)
    m = d.matrix(res)
    return sc.best_neighbors(m.pixels(res), facts, materialize(best, "trans-max"), m.n_bins(res))


@query
def trans_max(d):
    _, best = _trans_max(d)
    return best.select("bin_id", F.round(_null_nan("max_val"), 14).alias("max_val"))


def _end_neighbors(d, end):
    named = sc.named_neighbors(_neighbors(d), d.genome).where(F.col("end") == end)
    return named.select("tig_name", "neighbor", F.round("score", 9).alias("score"))


@query
def best_neighbors_start(d):
    return _end_neighbors(d, "start")


@query
def best_neighbors_end(d):
    return _end_neighbors(d, "end")


@query
def neighbor_names_multires(d):
    return sc.neighbor_names([_neighbors(d, RES), _neighbors(d, 20_000)], d.genome)


# Alignments to pairs


@query
def group_shapes(d):
    reads = cv.summarize_reads(d.alignments(), ["qname"])
    return reads.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("reads"))


@query
def primary_pick(d):
    return cv.summarize_reads(d.alignments(), ["qname"]).select("qname", "p1_ord", "p2_ord")


def _emitted(d, *shapes):
    routed = cv.route_reads(d.alignments())
    return cv.emitted_pairs(routed, d.references(), d.n_suppliers, shapes=shapes)


@query
def pairs_uu(d):
    return _emitted(d, "UU")


@query
def pairs_simple_rescue(d):
    return _emitted(d, "UD")


@query
def pairs_complex_rescue(d):
    return _emitted(d, "DD")


@query
def pairs_all(d):
    return _emitted(d, "UU", "UD", "DD")


@query
def conversion_stats(d):
    return cv.conversion_stats(cv.route_reads(d.alignments()))


def _converted(d) -> tuple[str, DataFrame]:
    """Folder of the written pairs, and the counters seen while they were written."""
    routed, seen = cv.counted(cv.route_reads(d.alignments()))
    path = new_scratch_path(d.spark, "pairs-file")
    write_pairs(cv.emitted_pairs(routed, d.references(), d.n_suppliers), path)
    return path, cv.observed_stats(d.spark, seen)


@query
def conversion_stats_observed(d):
    return _converted(d)[1]


@query
def conversion_report(d):
    """The text report on a conversion, line by line."""
    path = new_scratch_path(d.spark, "report")
    write_stats(_converted(d)[1], path)
    return d.spark.read.text(path)


@query
def adjacent_reads(d):
    """Reads by runs of one name in file order, with their size."""
    islands = cv.number_islands(d.alignments(), d.n_lines)
    return islands.groupBy("qname", "island").agg(F.count(F.lit(1)).alias("alignments"))


# Sorting and duplicates


@query
def pairs_sorted_rank(d):
    return dd.rank_pairs(d.pairs(named=True), d.n_lines).select("read_name", "sort_rank")


@query
def pairs_sorted(d):
    return dd.sort_pairs(d.pairs(named=True)).drop("ord")


@query
def dedup_exact(d):
    return dd.dedup_pairs(d.pairs(named=True), 0)


@query
def dedup_any_earlier(d):
    return dd.dedup_pairs(d.pairs(named=True), 3, "any_earlier")


@query
def dedup_greedy(d):
    return dd.dedup_pairs(d.pairs(named=True), 3)


# Assembly graph


@query
def gfa_nodes(d):
    return gr.vertices(d.segments())


@query
def gfa_named_segments(d):
    return gr.named_segments(d.segments())


@query
def gfa_segment_lengths(d):
    return gr.segment_lengths(d.tagged_segments())


@query
def gfa_edges(d):
    return gr.edges(d.links(), d.segments())


@query
def gfa_inverted_links(d):
    return gr.invert_link(d.links())


@query
def gfa_out_degree(d):
    return gr.out_degrees(gr.edges(d.links(), d.segments()), gr.vertices(d.segments()))


@query
def gfa_reachable(d):
    return gr.reachable(gr.edges(d.links(), d.segments()), gr.vertices(d.segments()), SOURCE_NODE)


@query
def gfa_bfs(d):
    return gr.bfs_distances(gr.edges(d.links(), d.segments()), SOURCE_NODE)


# Column functions


@query
def tag_parse(d):
    lines = d.table("supplier").selectExpr(
        "concat('s', s_suppkey) as name",
        "array(concat('LN:i:', s_suppkey), concat('XF:f:', cast(s_suppkey as double) / 4),"
        " concat('XA:A:', substr(s_name, 1, 1)), concat('UR:Z:', s_name),"
        " concat('XH:H:', hex(s_suppkey)), concat('XI:i:v', s_nationkey, 'b'),"
        " case when s_nationkey % 2 = 0 then concat('LN:i:', s_suppkey + 100) else '1N:i:5' end,"
        " 'XX:q:1', 'XY:i:none', concat('XG:f:', s_suppkey, '5e6'), concat('XS:f:', s_suppkey + 1, 'e-7')) as fields",
    )
    parsed = lines.select("name", tg.parse_tags(F.col("fields")).alias("tags"))
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    return parsed.select(
        "name",
        tg.int_tag(F.col("tags"), "LN").alias("ln"),
        tag("XF")["f"].alias("xf"),
        tag("XA")["a"].alias("xa"),
        tg.text_tag(F.col("tags"), "UR").alias("ur"),
        F.array_join(tag("XH")["h"].cast("array<string>"), ",").alias("xh"),
        tg.int_tag(F.col("tags"), "XI").alias("xi"),
        F.size("tags").cast("bigint").alias("n_tags"),
        tg.show_tag(tag("XH")).alias("shown_h"),
        tg.show_tag(tag("LN")).alias("shown_i"),
        tg.show_tag(tag("XF")).alias("shown_f"),
        tg.show_tag(tag("XG")).alias("shown_large"),
        tg.show_tag(tag("XS")).alias("shown_small"),
    )


def _cigars(d) -> DataFrame:
    k = lambda n: f"cast(1 + s_suppkey % {n} as bigint)"
    text = f"concat({k(4)}, 'H', {k(5)}, 'S', 9 + {k(20)}, 'M', {k(3)}, 'I', {k(6)}, 'D', {k(7)}, 'S')"
    rows = d.table("supplier").selectExpr("concat('s', s_suppkey) as name", f"{text} as text")
    return rows.select("name", "text", cg.parse_cigar("text").alias("ops"))


@query
def cigar_lengths(d):
    ops = F.col("ops")
    return _cigars(d).select(
        "name",
        cg.ref_length(ops).alias("ref_len"),
        cg.query_length(ops).alias("query_len"),
        cg.cigar_text(cg.from_raw(cg.to_raw(ops))).alias("text"),
    )


@query
def cigar_clips(d):
    ops = F.col("ops")
    return _cigars(d).select(
        "name",
        cg.hard_clipping(ops).alias("hard_left"),
        cg.hard_clipping(ops, left=False).alias("hard_right"),
        cg.soft_clipping(ops).alias("soft_left"),
        cg.soft_clipping(ops, left=False).alias("soft_right"),
    )


@query
def cigar_classes(d):
    """Operations of all overlaps by letter, with code, class and summed length."""
    ops = _cigars(d).select(F.explode("ops").alias("o")).select("o.op", "o.len")
    return (
        ops.withColumn("code", cg.op_code(F.col("op")).cast("bigint"))
        .withColumn("class", cg.op_class(F.col("op")))
        .groupBy("op", "code", "class")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total"))
    )


@query
def cigar_aligned_pairs(d):
    return cg.aligned_pairs(_cigars(d).select("name", "ops"), "ops").drop("ops")


@query
def cigar_matching_pairs(d):
    return cg.matching_pairs(_cigars(d).select("name", "ops"), "ops").drop("ops")


@query
def seq_revcomp(d):
    return d.segments().select("name", sq.reverse_complement(F.col("seq")).alias("revcomp"))


@query
def seq_acgtn(d):
    mixed = F.concat(F.lower("seq"), F.lit("RYK="))
    return d.segments().select("name", sq.acgtn_only(mixed).alias("plain"))


@query
def seq_subseq(d):
    seq = F.col("seq")
    return d.segments().select(
        "name",
        sq.subseq(seq, 2, 6).alias("part"),
        sq.reverse_complement(sq.subseq(seq, 2, 6)).alias("part_revcomp"),
    )


@query
def seq_codes(d):
    codes = sq.to_codes(F.col("seq")).cast("array<string>")
    return d.segments().select("name", F.array_join(codes, ",").alias("codes"))


@query
def seq_base_at(d):
    return d.segments().select("name", sq.base_at(F.col("seq"), 2).alias("base"))


@query
def seq_text(d):
    seq = F.when(F.col("seq").isNull(), "").otherwise(F.col("seq"))
    return d.segments().select("name", sq.sequence_text(seq).alias("text"))


@query
def cigar_long_pairs(d):
    """Aligned bases of overlaps with hundreds of operations and a long skip, summed up by overlap."""
    text = "concat(repeat(concat(3 + s_suppkey % 4, 'M1I2D'), 200), '100000N5M')"
    rows = d.table("supplier").selectExpr("concat('s', s_suppkey) as name", f"{text} as text")
    pairs = cg.aligned_pairs(rows.select("name", cg.parse_cigar("text").alias("ops")), "ops")
    both = F.col("query_pos").isNotNull() & F.col("ref_pos").isNotNull()
    return pairs.groupBy("name").agg(
        F.count(F.lit(1)).alias("bases"),
        F.count(F.when(both, 1)).alias("matches"),
        F.sum("query_pos").alias("query_sum"),
        F.sum(F.when(both, F.col("ref_pos"))).alias("ref_sum"),
        F.max("ref_pos").alias("last_ref"),
    )


# Files


def _written(d, pairs: DataFrame) -> str:
    path = new_scratch_path(d.spark, "pairs-file")
    write_pairs(pairs, path)
    return path


@query
def pairs_file_roundtrip(d):
    """Converted pairs, placeholder rows included, written and read again."""
    return read_pairs(d.spark, _written(d, _emitted(d, "UU", "UD", "DD")))


@query
def pairs_file_sorted(d):
    """Places of the pairs of a file of several parts in sorted order, ties by file order."""
    read = read_pairs(d.spark, _written(d, d.pairs(named=True).orderBy("ord")), ordered=True)
    return dd.rank_pairs(read, d.n_lines).select("read_name", "sort_rank")


@query
def pairs_file_dedup(d):
    """Write, sort, write, read and remove duplicates."""
    first = read_pairs(d.spark, _written(d, d.pairs(named=True).orderBy("ord")), ordered=True)
    second = read_pairs(d.spark, _written(d, dd.sort_pairs(first)), ordered=True)
    return dd.dedup_pairs(second, 3).drop("ord")


@query
def dedup_names_file(d):
    """The names-only output of duplicate removal, read back."""
    path = new_scratch_path(d.spark, "names")
    write_pairs(dd.dedup_pairs(d.pairs(named=True), 3), path, names_only=True)
    return d.spark.read.text(path).withColumnRenamed("value", "read_name")


@query
def dumped_weights(d):
    """Weights as written for a look at a balancing run, as numbers again."""
    path = new_scratch_path(d.spark, "weights-text")
    dump_weights(d.matrix(RES).weights(RES), path)
    return d.spark.read.text(path).select(F.col("value").cast("double").alias("weight"))


@query
def lengths_file(d):
    path = new_scratch_path(d.spark, "lengths-file")
    d.lengths().orderBy("ord").select(F.concat_ws("\t", "tig_name", "length").alias("value")).write.text(path)
    return gn.Genome.from_lengths(read_lengths(d.spark, path)).contigs


@query
def alignments_from_flags(d):
    bits = (
        "case when mate = 1 then 64 else 128 end + case when is_mapped then 0 else 4 end + case when is_reverse then 16 else 0 end"
        " + case when is_secondary then 256 else 0 end + case when is_supplementary then 2048 else 0 end"
    )
    flagged = d.alignments().selectExpr("ord", f"cast({bits} as int) as flag")
    return flagged.select("ord", "flag", *flag_columns())


@query
def dedup_greedy_dense(d):
    """Long chains: places one base apart, so every decision hangs on the one before."""
    lines = d._ranked.selectExpr(
        "concat('r', ord) as read_name", "concat('d', l_linenumber) as tig1", "l_partkey as pos1",
        "concat('d', l_linenumber) as tig2", "l_partkey + 5 as pos2", "'+' as strand1", "'+' as strand2", "ord",
    )
    return dd.dedup_pairs(lines, 3).select("tig1", "pos1", "pos2")


@query
def pairs_unplaced(d):
    """Pairs on contigs that are unknown, or known with no length."""
    lengths = d.lengths().where("ord % 10 != 3").withColumn("length", F.expr("if(ord % 10 = 7, 0, length)"))
    return ct.unplaced_pairs(d.pairs(named=True), gn.Genome.from_lengths(lengths)).select("read_name", "reason")


@query
def rect_dense(d):
    m = d.matrix(RES)
    n = m.n_bins(RES)
    return m.dense_rectangle(RES, n // 8, n // 4, n // 6, n // 3).withColumn("value", F.round("value", 14))


def _gfa(d) -> Gfa:
    """Segments, links and two headers as text, read back."""
    heads = d.table("supplier").selectExpr("count(*) as n").selectExpr(
        "explode(array(concat('H\tVN:Z:1.', n), concat('H\tVN:Z:2.', n))) as value", "0 as k"
    )
    heads = heads.withColumn("k", F.expr("if(value like '%:1.%', 0, 4)"))
    body = d.segments().selectExpr("concat_ws('\t', 'S', name, coalesce(seq, '*'), concat('LN:i:', ln)) as value", "1 as k")
    links = d.links().selectExpr("concat_ws('\t', 'L', from_name, from_strand, to_name, to_strand, cigar) as value", "2 as k")
    note = d.table("supplier").selectExpr("concat('# ', s_suppkey) as value", "3 as k")
    path = new_scratch_path(d.spark, "gfa-file")
    lines = heads.unionByName(body).unionByName(links).unionByName(note)
    lines.orderBy("k", "value").select("value").write.text(path)
    return Gfa.read(d.spark, path)


@query
def gfa_text_segments(d):
    return _gfa(d).segments.select("name", "seq", tg.int_tag(F.col("tags"), "LN").alias("ln"))


@query
def gfa_text_links(d):
    return _gfa(d).links.select("from_name", "from_strand", "to_name", "to_strand", "cigar")


@query
def gfa_header(d):
    return _gfa(d).header.select(tg.text_tag(F.col("tags"), "VN").alias("version"))


@query
def gfa_bfs_jump(d):
    return gr.bfs_distances(gr.edges(d.links(), d.segments()), SOURCE_NODE, jump_complement_at_sink=True)


# Stored matrices and settings


@query
def built_matrix_levels(d):
    """Size and total of every level of a matrix built from pairs and opened again."""
    m = d.reopened()
    parts = [
        m.pixels(r).agg(F.sum("count").alias("total")).select(
            F.lit(r).cast("bigint").alias("res"), F.lit(m.n_bins(r)).cast("bigint").alias("n_bins"),
            F.lit(m.n_pixels(r)).cast("bigint").alias("n_pixels"), "total",
        )
        for r in m.resolutions()
    ]
    return parts[0].unionByName(parts[1])


@query
def matrix_after_failed_build(d):
    """A second build over a stored matrix fails; the folder still opens as the first one."""
    path = new_scratch_path(d.spark, "rebuilt")
    Matrix.build(d.spark, path, d.pairs(), d.lengths(), [20_000])
    broken = d.pairs().withColumn("pos1", F.expr("if(pos1 % 97 = 5, -1, pos1)"))
    try:
        Matrix.build(d.spark, path, broken, d.lengths(), [20_000, 40_000])
    except Exception as e:
        if "must not be negative" not in str(e):
            raise
    m = Matrix.open(d.spark, path)
    return m.pixels(20_000).withColumn("n_levels", F.lit(len(m.resolutions())).cast("bigint"))


@query
def reopened_weights(d):
    return d.reopened().bins(RES, with_values=True).select("bin_id", "start", "end", "weight")


@query
def stored_trans_max(d):
    return d.reopened().best_trans_weights(RES).withColumn("max_val", F.round("max_val", 14))


@query
def neighbors_of_one_contig(d):
    """The first contig by name that has a neighbour, asked for alone."""
    m = d.reopened()
    name = m.neighbor_names().agg(F.min("tig_name")).first()[0]
    return m.neighbor_names(name)


def _with_settings(d, **settings):
    routed = cv.route_reads(d.alignments(), **settings)
    return cv.emitted_pairs(routed, d.references(), d.n_suppliers)


@query
def pairs_unique_only(d):
    return _with_settings(d, strategy="unique")


@query
def pairs_simple_only(d):
    return _with_settings(d, strategy="simple")


@query
def pairs_adjacent(d):
    return _with_settings(d, adjacent=True, n_rows=d.n_lines)


@query
def pairs_mapq_30(d):
    return _with_settings(d, min_mapq=30)


# Real weights


def _icgw(d):
    m = d.matrix(MASK_RES)
    weights = bal.iterative_weights(m.pixels(MASK_RES), d.genome, MASK_RES, n_iters=5)
    return m, materialize(weights, "icgw")


@query
def balanced_pixels_icgw(d):
    m, weights = _icgw(d)
    value = ct.balanced_pixels(m.pixels(MASK_RES), weights, m.n_bins(MASK_RES))
    return value.withColumn("value", F.round(_null_nan("value"), 5))


@query
def rect_icgw(d):
    m, weights = _icgw(d)
    n = m.n_bins(MASK_RES)
    cells = rg.balanced_rectangle(m.pixels(MASK_RES), weights, n, n // 8, n // 2, n // 4, n * 6 // 8)
    return cells.withColumn("value", F.round(_null_nan("value"), 5))


@query
def best_neighbors_icgw(d):
    m, weights = _icgw(d)
    facts = sc.bin_facts(m.bins(MASK_RES), m.genome, weights)
    n = m.n_bins(MASK_RES)
    best = materialize(sc.trans_max(m.pixels(MASK_RES), facts, n), "trans-max")
    named = sc.named_neighbors(sc.best_neighbors(m.pixels(MASK_RES), facts, best, n), d.genome)
    return named.select("tig_name", "end", "neighbor", F.round("score", 5).alias("score"))


@query
def trans_max_icgw(d):
    m, weights = _icgw(d)
    facts = sc.bin_facts(m.bins(MASK_RES), m.genome, weights)
    best = sc.trans_max(m.pixels(MASK_RES), facts, m.n_bins(MASK_RES))
    return best.select("bin_id", F.round(_null_nan("max_val"), 5).alias("max_val"))
