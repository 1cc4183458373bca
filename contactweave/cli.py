"""Command line: ``python -m contactweave <command>``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession

from .operators import convert as cv, dedup as dd
from .operators.contacts import unplaced_pairs
from .operators.matrix import Matrix
from .sources.bam import read_bam
from .sources.pairs import read_lengths, read_pairs, write_pairs
from .sources.sam import longest_name, read_sam
from .sources.stats_report import write_stats

log = logging.getLogger("contactweave")


def read_alignments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_sam(spark, path) if path.endswith(".sam") else read_bam(spark, path)


def convert(spark, args) -> None:
    alignments, references = read_alignments(spark, args.bam)
    n_references = references.count()
    routed = cv.route_reads(
        alignments,
        args.strategy,
        args.min_mapq,
        args.max_molecule_size,
        adjacent=args.adjacent,
    )
    routed, seen = cv.counted(routed)
    pairs = cv.emitted_pairs(routed, references, n_references, longest_name=longest_name(references))
    write_pairs(pairs, args.pairs)
    write_stats(cv.observed_stats(spark, seen), args.stats)


def sort(spark, args) -> None:
    write_pairs(dd.sort_pairs(read_pairs(spark, args.pairs, ordered=True)), args.out)


def dedup(spark, args) -> None:
    kept = dd.dedup_pairs(read_pairs(spark, args.pairs, ordered=True), args.max_mismatch, args.mode)
    write_pairs(dd.sort_pairs(kept), args.out, args.names_only)


def build(spark, args) -> None:
    pairs = read_pairs(spark, args.pairs)
    matrix = Matrix.build(
        spark,
        args.matrix,
        pairs,
        read_lengths(spark, args.lengths),
        args.resolutions,
        args.strategy,
        args.boundary,
    )
    for row in unplaced_pairs(pairs, matrix.genome).groupBy("reason").count().collect():
        log.warning("pairs left out, a contig is %s: %d", row["reason"], row["count"])


def balance(spark, args) -> None:
    done = Matrix.open(spark, args.matrix).balance(args.resolutions, args.strategy)
    log.info("balanced resolutions: %s", done)


def zoom(spark, args) -> None:
    Matrix.open(spark, args.matrix).zoom(args.resolutions)


def neighbors(spark, args) -> None:
    matrix = Matrix.open(spark, args.matrix)
    matrix.update_trans_max(args.cutoff)
    names = matrix.neighbor_names(cutoff=args.cutoff)
    names.write.mode("overwrite").csv(args.out, sep="\t")


def _resolutions(text: str) -> list[int]:
    return [int(part) for part in text.split(",") if part]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="contactweave")
    commands = top.add_subparsers(dest="command", required=True)

    def command(run, help_text):
        sub = commands.add_parser(run.__name__, help=help_text)
        sub.set_defaults(run=run)
        return sub

    def resolutions(sub):
        sub.add_argument("-r", "--resolutions", type=_resolutions, required=True, help="comma-separated")

    def strategy(sub):
        sub.add_argument("-s", "--strategy", choices=["ICGW", "LEN"], help="balancing method; none by default")

    c = command(convert, "alignments to contact pairs")
    c.add_argument("-b", "--bam", required=True, help="name-collated BAM, or SAM text ending in .sam")
    c.add_argument("-p", "--pairs", required=True)
    c.add_argument("-s", "--stats", required=True)
    c.add_argument("-g", "--graph", help="accepted and not used")
    c.add_argument("--strategy", choices=cv.STRATEGIES, default="complex")
    c.add_argument("--min-mapq", type=int, default=cv.MIN_MAPQ)
    c.add_argument("--max-molecule-size", type=int, default=cv.MAX_MOLECULE_SIZE)
    c.add_argument("--adjacent", action="store_true", help="a name that comes back later is another read")

    c = command(sort, "sort pairs by contigs and positions")
    c.add_argument("-p", "--pairs", required=True)
    c.add_argument("-o", "--out", required=True)
    for flag, name in (("-m", "--memory"), ("-t", "--nproc"), ("-d", "--tmpdir")):
        c.add_argument(flag, name, help="accepted and not used: Spark settings decide")

    c = command(dedup, "remove duplicated pairs")
    c.add_argument("-p", "--pairs", required=True)
    c.add_argument("-o", "--out", required=True)
    c.add_argument("--max-mismatch", type=int, default=dd.MAX_MISMATCH)
    c.add_argument("--mode", choices=dd.MODES, default="greedy")
    c.add_argument("--names-only", action="store_true", help="write read names instead of pairs")

    c = command(build, "pairs to a multi-resolution matrix")
    c.add_argument("-p", "--pairs", required=True)
    c.add_argument("-l", "--lengths", "--lengts", required=True)
    c.add_argument("-m", "--matrix", required=True)
    c.add_argument("--boundary", choices=["clamp", "strict"], default="clamp")
    resolutions(c)
    strategy(c)

    c = command(balance, "weights for stored resolutions")
    c.add_argument("-m", "--matrix", required=True)
    resolutions(c)
    strategy(c)

    c = command(zoom, "add coarser resolutions")
    c.add_argument("-m", "--matrix", required=True)
    resolutions(c)

    c = command(neighbors, "best scaffold neighbours of every contig end")
    c.add_argument("-m", "--matrix", required=True)
    c.add_argument("-o", "--out", required=True)
    c.add_argument("--cutoff", type=int, default=100_000)

    for sub in commands.choices.values():
        sub.add_argument("-L", "--log-level", default="INFO")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level, format="[%(asctime)s %(levelname)s] %(message)s")
    session = spark or SparkSession.builder.appName(f"contactweave-{args.command}").getOrCreate()
    try:
        args.run(session, args)
    finally:
        if spark is None:
            session.stop()
