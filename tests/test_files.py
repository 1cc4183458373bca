"""Text sources, the command line and streaming ingest."""

import glob
import random

import pytest
from test_bam import record, write_bam

from contactweave import cli
from contactweave.operators.contacts import contact_pixels, unplaced_pairs
from contactweave.operators.genome import Genome
from contactweave.operators.matrix import Matrix
from contactweave.sources.pairs import read_lengths, read_pairs
from contactweave.sources.sam import read_sam
from contactweave.streaming.pixel_stream import append_pixels, stream_pairs, total_pixels

TIGS = [("A", 300_000), ("B", 120_000), ("C", 240_000)]


def lines(path):
    return [l for part in sorted(glob.glob(f"{path}/part-*")) for l in open(part).read().splitlines()]


def pair_lines(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        (a, la), (b, lb) = rng.choice(TIGS), rng.choice(TIGS)
        out.append(f"r{seed}_{i}\t{a}\t{rng.randint(0, la)}\t{b}\t{rng.randint(0, lb)}\t{rng.choice('+-')}\t{rng.choice('+-')}")
    return out


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    (root / "x.pairs").write_text("\n".join(["# head", *pair_lines(1, 4000)]) + "\n")
    (root / "len.tsv").write_text("".join(f"{n}\t{l}\n" for n, l in TIGS))
    return root


def test_pairs_reader(spark, inputs, tmp_path):
    rows = read_pairs(spark, str(inputs / "x.pairs"), ordered=True)
    got = rows.orderBy("ord").collect()
    assert ["\t".join(map(str, tuple(r)[:7])) for r in got] == pair_lines(1, 4000)
    assert len({r.ord for r in got}) == 4000
    for bad in ("r\tA\t1\tB\t2\t+", "r\tA\t1\tB\t2\t+\t-\tmore", "r\tA\tx\tB\t2\t+\t-"):
        (tmp_path / "bad").write_text(bad + "\n")
        with pytest.raises(Exception):
            read_pairs(spark, str(tmp_path / "bad")).select("pos1").collect()


def test_file_order_over_splits_and_files(spark, tmp_path):
    for part in (1, 2, 3):
        (tmp_path / f"p{part}").write_text("\n".join(pair_lines(part, 800)) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    rows = read_pairs(spark, str(tmp_path), ordered=True)
    assert [r.read_name for r in rows.orderBy("ord").collect()] == [f"r{p}_{i}" for p in (1, 2, 3) for i in range(800)]
    (tmp_path / "one").mkdir()
    big = [f"r{i}\tA\t{i}\tB\t{i}\t+\t{'-' * 50}" for i in range(60_000)]
    (tmp_path / "one" / "x").write_text("\n".join(big) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 20))
    try:
        rows = read_pairs(spark, str(tmp_path / "one"), ordered=True)
        assert rows.rdd.getNumPartitions() > 1
        got = rows.orderBy("ord").collect()
        assert [r.pos1 for r in got] == list(range(60_000))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_lengths_reader_has_no_comments(spark, inputs, tmp_path):
    assert [r.tig_name for r in read_lengths(spark, str(inputs / "len.tsv")).orderBy("ord").collect()] == ["A", "B", "C"]
    (tmp_path / "l").write_text("#A\t5\n")
    assert read_lengths(spark, str(tmp_path / "l")).first()["tig_name"] == "#A"


def test_sort_dedup_build_balance_zoom(spark, inputs, tmp_path):
    run = lambda *args: cli.main([str(a) for a in args], spark)
    run("sort", "-p", inputs / "x.pairs", "-o", tmp_path / "sorted", "-m", "2G", "-t", 4)
    done = [l.split("\t") for l in lines(tmp_path / "sorted")]
    assert done == sorted(done, key=lambda r: (r[1], r[3], int(r[2]), int(r[4])))
    run("dedup", "-p", tmp_path / "sorted", "-o", tmp_path / "unique")
    kept = lines(tmp_path / "unique")
    run("dedup", "-p", tmp_path / "sorted", "-o", tmp_path / "names", "--names-only")
    assert [l.split("\t")[0] for l in kept] == lines(tmp_path / "names")
    root = str(tmp_path / "matrix")
    run("build", "-p", tmp_path / "unique", "-l", inputs / "len.tsv", "-r", "10000,20000", "-m", root, "-s", "ICGW")
    run("zoom", "-m", root, "-r", "60000")
    run("balance", "-m", root, "-r", "60000", "-s", "LEN")
    matrix = Matrix.open(spark, root)
    assert matrix.resolutions() == [10_000, 20_000, 60_000]
    for res in matrix.resolutions():
        assert matrix.pixels(res).groupBy().sum("count").first()[0] == len(kept)
        assert matrix.balanced_row(res, 1).count() > 0
    run("neighbors", "-m", root, "-o", tmp_path / "next")
    names = [l.split("\t") for l in lines(tmp_path / "next")]
    assert all(a in "ABC" and e in ("start", "end") and b in "ABC" and a != b for a, e, b in names)


def reads():
    rng, rows = random.Random(6), []
    for i in range(400):
        for mate in (0x40, 0x80):
            for extra in range(rng.randint(1, 2)):
                flag = 1 | mate | rng.choice([0, 0x10]) | (0x800 if extra else 0)
                rows.append((f"q{i}", flag, rng.randint(0, 2), rng.randint(100, 3000), rng.choice([0, 20, 60])))
    return rows


def test_convert_agrees_for_sam_and_bam(spark, tmp_path):
    rows = reads()
    cigar = [(5, "S"), (90, "M"), (5, "D")]
    write_bam(str(tmp_path / "x.bam"), TIGS, [record(n, f, r, p, q, cigar, 95) for n, f, r, p, q in rows])
    sam = [f"@SQ\tSN:{n}\tLN:{l}" for n, l in TIGS]
    sam += [f"{n}\t{f}\t{TIGS[r][0]}\t{p + 1}\t{q}\t5S90M5D\t*\t0\t0\t*\t*" for n, f, r, p, q in rows]
    (tmp_path / "x.sam").write_text("\n".join(sam) + "\n")
    for kind in ("bam", "sam"):
        cli.main(["convert", "-b", str(tmp_path / f"x.{kind}"), "-p", str(tmp_path / f"{kind}.pairs"), "-s", str(tmp_path / f"{kind}.stats")], spark)
    got = sorted(lines(tmp_path / "bam.pairs"))
    assert got and got == sorted(lines(tmp_path / "sam.pairs"))
    assert lines(tmp_path / "bam.stats") == lines(tmp_path / "sam.stats")
    report = lines(tmp_path / "bam.stats")
    assert report[0] == "Total number of good aligned reads 400"
    assert report[1] == f"Total number of good alignment records {len(rows)}"
    assert f"Total number of saved HiC pairs {len(got)}" in report
    assert report[3:5] == ["", "Mapping Statistics"]
    alignments, _ = read_sam(spark, str(tmp_path / "x.sam"))
    first = alignments.orderBy("ord").first()
    assert (first.qname, first.end - first.start) == ("q0", 95)


def test_stream_equals_batch(spark, inputs, tmp_path):
    folder = tmp_path / "arriving"
    folder.mkdir()
    genome = Genome.from_lengths(read_lengths(spark, str(inputs / "len.tsv")))
    out = str(tmp_path / "out")
    for part in (1, 2, 3):
        (folder / f"{part}.pairs").write_text("\n".join(pair_lines(part, 500)) + "\n")
        query = append_pixels(stream_pairs(spark, str(folder), 1), genome, 10_000, out, str(tmp_path / "state"))
        query.awaitTermination()
    got = sorted(map(tuple, total_pixels(spark, out).collect()))
    want = contact_pixels(read_pairs(spark, str(folder)), genome, 10_000)
    assert got == sorted(map(tuple, want.collect()))


def test_rows_are_numbered_once_over_small_splits(spark, tmp_path):
    for part in (1, 2):
        (tmp_path / f"p{part}").write_text("".join(f"r{part}_{i}\tA\t{i}\tB\t{i}\t+\t-\n" for i in range(40_000)))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "256k")
    try:
        rows = read_pairs(spark, str(tmp_path), ordered=True)
        assert rows.rdd.getNumPartitions() > 3
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
        got = rows.orderBy("ord").select("read_name", "ord").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r.read_name for r in got] == [f"r{p}_{i}" for p in (1, 2) for i in range(40_000)]
    assert len({r.ord for r in got}) == 80_000


def test_convert_sort_dedup_build_is_one_path(spark, tmp_path):
    """Placeholder rows of unmapped ends come through every step, and build reports what it leaves out."""
    rows = reads() + [(f"u{i}", 0x41, 0, 500 + i, 30) for i in range(5)] + [(f"u{i}", 0x81, -1, -1, 30) for i in range(5)]
    rows.sort(key=lambda r: r[0])
    cigar = [(90, "M")]
    write_bam(str(tmp_path / "x.bam"), TIGS, [record(n, f, r, p, q, cigar, 90) for n, f, r, p, q in rows])
    (tmp_path / "len.tsv").write_text("A\t300000\nB\t0\n")
    run = lambda *args: cli.main([str(a) for a in args], spark)
    run("convert", "-b", tmp_path / "x.bam", "-p", tmp_path / "pairs", "-s", tmp_path / "stats")
    made = lines(tmp_path / "pairs")
    assert any(l.startswith("\t\t-1\t") for l in made)
    run("sort", "-p", tmp_path / "pairs", "-o", tmp_path / "sorted")
    assert sorted(lines(tmp_path / "sorted")) == sorted(made)
    run("dedup", "-p", tmp_path / "sorted", "-o", tmp_path / "unique")
    kept = read_pairs(spark, str(tmp_path / "unique"))
    assert kept.where("read_name = ''").count() == 1
    run("build", "-p", tmp_path / "unique", "-l", tmp_path / "len.tsv", "-r", "10000", "-m", tmp_path / "m")
    matrix = Matrix.open(spark, str(tmp_path / "m"))
    left_out = {r.reason: r["count"] for r in unplaced_pairs(kept, matrix.genome).groupBy("reason").count().collect()}
    assert set(left_out) == {"unknown", "empty"}
    assert matrix.pixels(10_000).groupBy().sum("count").first()[0] + sum(left_out.values()) == kept.count()
