"""CIGAR and nucleotide column functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from contactweave.functions import cigar as cg, sequence as sq


def texts(spark, *values):
    df = spark.createDataFrame([(v,) for v in values], "text string")
    return df.withColumn("ops", cg.parse_cigar("text"))


def test_example(spark):
    ops = F.col("ops")
    row = texts(spark, "5H3S10M2I4D1N6M2S").select(
        cg.ref_length(ops), cg.query_length(ops), cg.hard_clipping(ops), cg.hard_clipping(ops, False),
        cg.soft_clipping(ops), cg.soft_clipping(ops, False),
    ).first()
    assert tuple(row) == (21, 23, 5, 0, 3, 2)


def test_text_raw_and_empty(spark):
    ops = F.col("ops")
    row = texts(spark, "*", "3M2P1=1X").select(
        cg.cigar_text(ops).alias("t"), cg.to_raw(ops).alias("raw"), cg.cigar_text(cg.from_raw(cg.to_raw(ops))).alias("again"),
        cg.cigar_text(cg.push(cg.push(ops, F.lit(4), F.lit("S")), F.lit(0), F.lit("M"))).alias("more"),
    ).collect()
    assert [tuple(r) for r in row] == [
        ("*", [], "*", "4S"), ("3M2P1=1X", [48, 38, 23, 24], "3M2P1=1X", "3M2P1=1X4S"),
    ]
    second = texts(spark, "3M2P").select(cg.at(ops, 1)["op"], F.size(ops)).first()
    assert tuple(second) == ("P", 2)


@pytest.mark.parametrize("bad", ["3Q", "0M", "M", "3M4", "3M 2S"])
def test_malformed_cigar_is_an_error(spark, bad):
    with pytest.raises(Exception, match="malformed CIGAR"):
        texts(spark, bad).collect()


def test_classes(spark):
    df = spark.createDataFrame([(c,) for c in cg.OPS], "op string")
    got = df.select(cg.op_class(F.col("op")), cg.op_letter(cg.op_code(F.col("op")))).collect()
    assert [r[0] for r in got] == ["match", "insertion", "deletion", "deletion", "insertion", "hard", "hard", "match", "match"]
    assert "".join(r[1] for r in got) == cg.OPS
    with pytest.raises(Exception, match="unexpected CIGAR"):
        spark.createDataFrame([("Q",)], "op string").select(cg.op_code(F.col("op"))).collect()


def walk(text, r):
    q, out = 0, []
    for n, op in re.findall(r"(\d+)(.)", text):
        if op in "HP":
            continue
        for _ in range(int(n)):
            out.append((q if op in "MIS=X" else None, r if op in "MDN=X" else None))
            q += op in "MIS=X"
            r += op in "MDN=X"
    return out


def test_aligned_pairs(spark):
    rng = random.Random(4)
    made = ["".join(f"{rng.randint(1, 9)}{rng.choice(cg.OPS)}" for _ in range(rng.randint(1, 8))) for _ in range(60)]
    df = texts(spark, *made).withColumn("from", F.length("text"))
    key = lambda p: tuple((x is None, x or 0) for x in p)
    got = {}
    for r in cg.aligned_pairs(df, "ops", "from").collect():
        got.setdefault(r.text, []).append((r.query_pos, r.ref_pos))
    matched = {}
    for r in cg.matching_pairs(df, "ops", "from").collect():
        matched.setdefault(r.text, []).append((r.query_pos, r.ref_pos))
    for text in set(made):
        times = made.count(text)
        want = walk(text, len(text))
        assert sorted(got.get(text, []), key=key) == sorted(want * times, key=key)
        assert sorted(matched.get(text, [])) == sorted([p for p in want if None not in p] * times)


def test_sequences(spark):
    df = spark.createDataFrame([("ACGTN",), ("ACRTN",), ("acgt",), ("",), (None,)], "s string")
    s = F.col("s")
    got = df.select(
        sq.reverse_complement(s), sq.acgtn_only(s), sq.sequence_text(s), sq.reverse_complement(sq.reverse_complement(s)),
        sq.available(s),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("NACGT", "ACGTN", "ACGTN", "ACGTN", True), ("NAYGT", "ACNTN", "ACRTN", "ACRTN", True),
        ("ACGT", "ACGT", "acgt", "ACGT", True), ("", "", "*", "", False), (None, None, None, None, None),
    ]
    one = df.where(s == 'ACGTN').select(sq.to_codes(s), sq.subseq(s, 1, 3), sq.subseq(s, 2, 2), sq.base_at(s, 4), sq.complement(s)).first()
    assert tuple(one) == ([1, 2, 4, 8, 15], "CG", "", "N", "TGCAN")


def test_bad_sequences(spark):
    df = spark.createDataFrame([("ACZ",)], "s string")
    for bad in (sq.normalize(F.col("s")), sq.subseq(F.lit("ACG"), 1, 4), sq.subseq(F.lit("ACG"), 2, 1), sq.base_at(F.lit("A"), 1)):
        with pytest.raises(Exception, match="not expected|out of range"):
            df.select(bad).collect()


def test_base_at(spark):
    df = spark.createDataFrame([("ACg",), (None,)], "s string")
    assert [r[0] for r in df.select(sq.base_at(F.col("s"), 2)).collect()] == ["G", None]
    for index in (3, -1):
        with pytest.raises(Exception, match="out of range"):
            df.select(sq.base_at(F.col("s"), index)).collect()
    odd = spark.createDataFrame([("A!",)], "s string")
    assert odd.select(sq.base_at(F.col("s"), 0)).first()[0] == "A"


def test_a_long_skip_is_spread_out(spark):
    df = spark.createDataFrame([("r", "2M200000N3M1D")], "name string, text string")
    df = df.select("name", cg.parse_cigar("text").alias("ops"))
    pairs = cg.aligned_pairs(df, "ops")
    assert pairs.count() == 200_006
    both = pairs.where("query_pos is not null and ref_pos is not null").select("query_pos", "ref_pos").collect()
    assert sorted(map(tuple, both)) == [(0, 0), (1, 1), (2, 200_002), (3, 200_003), (4, 200_004)]


def test_aligned_bases_are_placed_without_a_look_at_their_operation(spark):
    """What an operation consumes is settled before its bases are spread out, also with a null start."""
    df = spark.createDataFrame([("a", "2S3M1D", 5), ("b", "2M", None), ("c", "*", 1)], "name string, text string, start long")
    pairs = cg.aligned_pairs(df.select("name", "start", cg.parse_cigar("text").alias("ops")), "ops", "start").drop("ops")
    assert pairs.columns == ["name", "start", "query_pos", "ref_pos"]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert " IN" not in plan[: plan.index("Generate")]
    got = sorted((r.name, r.query_pos, r.ref_pos) for r in pairs.where("name = 'a'").collect() if r.query_pos is not None)
    assert got == [("a", 0, None), ("a", 1, None), ("a", 2, 5), ("a", 3, 6), ("a", 4, 7)]
    assert [(r.query_pos, r.ref_pos) for r in pairs.where("name = 'a' and query_pos is null").collect()] == [(None, 8)]
    assert sorted((r.query_pos, r.ref_pos) for r in pairs.where("name = 'b'").collect()) == [(0, None), (1, None)]
