"""BAM reading against records written here by hand."""

import os
import random
import struct
import zlib

import pytest

from contactweave.operators.convert import emitted_pairs, route_reads
from contactweave.sources.bam import read_bam

EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
OPS = "MIDNSHP=X"


def bgzf(data, block):
    out = b""
    for i in range(0, len(data), block):
        part = data[i : i + block]
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
        out += head + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out + EOF_BLOCK


def record(name, flag, ref, pos, mapq, cigar, seq_len):
    ops = b"".join(struct.pack("<I", n << 4 | OPS.index(op)) for n, op in cigar)
    raw = name.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(raw), mapq, 0, len(cigar), flag, seq_len, -1, -1, 0)
    body += raw + ops + b"\x11" * ((seq_len + 1) // 2) + b"\x20" * seq_len
    return struct.pack("<i", len(body)) + body


def write_bam(path, refs, records, block=3000):
    text = b"@HD\tVN:1.6\n"
    head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    for name, length in refs:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    with open(path, "wb") as f:
        f.write(bgzf(head + b"".join(records), block))


@pytest.fixture(scope="module")
def sample(tmp_path_factory):
    rng = random.Random(7)
    refs = [(f"tig{i}", 10_000 + i) for i in range(40)]
    rows, records = [], []
    for i in range(3000):
        n = rng.randint(0, 3)
        cigar = [(rng.randint(1, 90), rng.choice(OPS)) for _ in range(n)]
        flag = rng.choice([0x40, 0x80]) | rng.choice([0, 4, 0x10, 0x100, 0x800])
        ref, pos, mapq = rng.randint(-1, 39), rng.randint(0, 9_000), rng.randint(0, 60)
        rows.append(
            (
                f"read{i // 4}", 1 if flag & 0x40 else 2, ref, pos,
                pos + sum(k for k, op in cigar if op in "MDN=X"), mapq,
                not flag & 4, bool(flag & 0x10), bool(flag & 0x100), bool(flag & 0x800),
            )
        )
        records.append(record(f"read{i // 4}", flag, ref, pos, mapq, cigar, rng.randint(0, 200)))
    path = str(tmp_path_factory.mktemp("bam") / "x.bam")
    write_bam(path, refs, records)
    return path, refs, rows


@pytest.mark.parametrize("split", [1 << 26, 20_000, 4_001, 1_500])
def test_every_record_once_and_in_order(spark, sample, split):
    path, _, rows = sample
    alignments, _ = read_bam(spark, path, split)
    expected = -(-os.path.getsize(path) // split)
    assert alignments.rdd.getNumPartitions() == expected
    got = sorted(alignments.collect(), key=lambda r: r["ord"])
    assert len({r["ord"] for r in got}) == len(rows)
    assert [tuple(r)[:-1] for r in got] == rows


def test_references(spark, sample):
    path, refs, _ = sample
    _, references = read_bam(spark, path)
    assert [tuple(r) for r in references.orderBy("ref_id").collect()] == [(i, n, l) for i, (n, l) in enumerate(refs)]


def test_unpaired_alignment_is_an_error(spark, tmp_path):
    path = str(tmp_path / "bad.bam")
    write_bam(path, [("a", 10)], [record("r", 0, 0, 1, 9, [(3, "M")], 3)])
    with pytest.raises(Exception, match="neither first nor last"):
        read_bam(spark, path)[0].collect()


def test_no_records(spark, tmp_path):
    path = str(tmp_path / "none.bam")
    write_bam(path, [("a", 10)], [])
    assert read_bam(spark, path)[0].count() == 0


def test_record_longer_than_many_splits(spark, tmp_path):
    rng = random.Random(1)
    long = record("long", 0x40, 0, 5, 30, [(7, "M")], 0)
    body = long[4:] + bytes(rng.randbytes(900_000))
    records = [
        record("a", 0x40, 0, 1, 30, [(7, "M")], 10),
        struct.pack("<i", len(body)) + body,
        record("b", 0x80, 0, 2, 30, [(7, "M")], 10),
    ]
    path = str(tmp_path / "long.bam")
    write_bam(path, [("a", 10)], records, block=60_000)
    got = read_bam(spark, path, 50_000)[0].orderBy("ord").collect()
    assert [r["qname"] for r in got] == ["a", "long", "b"]


def folder(tmp_path, first, second, n=100):
    """Two files of n read pairs each, on the contigs of their own header."""
    for k, refs in enumerate((first, second)):
        records = []
        for i in range(n):
            for flag in (0x40, 0x80):
                records.append(record(f"q{k}_{i}", flag, i % len(refs), 100 + i, 30, [(50, "M")], 50))
        write_bam(str(tmp_path / f"part{k}.bam"), refs, records)
    return str(tmp_path)


TWO = [("a", 1000), ("b", 2000)]


@pytest.mark.parametrize("second", [TWO, TWO[::-1], TWO[1:]])
@pytest.mark.parametrize("adjacent", [False, True])
def test_a_folder_of_files(spark, tmp_path, second, adjacent):
    alignments, references = read_bam(spark, folder(tmp_path, TWO, second), 2_000)
    names = {r.ref_id: r.ref_name for r in references.collect()}
    assert names == {0: "a", 1: "b"}
    got = alignments.orderBy("ord").collect()
    assert len({r.ord for r in got}) == len(got) == 400
    want = [f"q{k}_{i}" for k in (0, 1) for i in range(100) for _ in (0, 1)]
    assert [r.qname for r in got] == want
    for r in got:
        k, i = map(int, r.qname[1:].split("_"))
        own = (TWO, second)[k]
        assert names[r.ref_id] == own[i % len(own)][0]
    routed = route_reads(alignments, adjacent=adjacent, n_rows=400)
    pairs = emitted_pairs(routed, references.select("ref_id", "ref_name"), 2).collect()
    assert len(pairs) == 200 and all(p.tig1 == p.tig2 for p in pairs)


@pytest.mark.parametrize("second", [[("a", 1000), ("c", 5)], [("a", 1000), ("b", 2001)]])
def test_headers_that_disagree_are_an_error(spark, tmp_path, second):
    with pytest.raises(Exception, match="does not have|long in"):
        read_bam(spark, folder(tmp_path, TWO, second))[0].collect()
