"""Read routing and rescue against hand-made cases and a plain per-read model."""

import random

import pytest
from pyspark.sql import functions as F

from contactweave.operators import convert as cv

SCHEMA = (
    "qname string, mate int, ref_id bigint, start bigint, `end` bigint, mapq int, is_mapped boolean, "
    "is_reverse boolean, is_secondary boolean, is_supplementary boolean, ord bigint"
)


def aln(name, mate, ref, mid, strand="+", mapq=30, mapped=True, sec=False, supp=False, ord=0):
    return (name, mate, ref, mid - 10, mid + 10, mapq, mapped, strand == "-", sec, supp, ord)


def run(spark, rows, **kw):
    rows = [(*r[:-1], i) for i, r in enumerate(rows)]
    refs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "ref_id bigint, ref_name string")
    routed = cv.route_reads(spark.createDataFrame(rows, SCHEMA), **kw)
    pairs = cv.emitted_pairs(routed, refs, 50).collect()
    return sorted(tuple(p) for p in pairs), cv.conversion_stats(routed).first().asDict()


def test_simple_rescue(spark):
    def case(name, second):
        return [aln(name, 1, 0, 10000, "-"), aln(name, 2, 1, 500, "+"), aln(name, 2, 0, second[0], second[1], supp=True)]

    pairs, _ = run(spark, case("a", (9000, "+")) + case("b", (9000, "-")) + case("c", (8000, "+")))
    assert pairs == [("a", "t0", 10000, "t1", 500, "-", "+", "UD")]


def test_complex_rescue(spark):
    rows = [
        aln("a", 1, 0, 1000, "+"), aln("a", 1, 1, 7000, "-", supp=True),
        aln("a", 2, 0, 1500, "-"), aln("a", 2, 1, 6500, "+", supp=True),
    ]
    pairs, _ = run(spark, rows)
    assert pairs == [("a", "t0", 1000, "t1", 6500, "+", "+", "DD")]


def test_equal_midpoints_store_mate_two_first(spark):
    rows = [aln("a", 1, 0, 100, "+"), aln("a", 2, 0, 100, "-")]
    assert run(spark, rows)[0] == [("a", "t0", 100, "t0", 100, "-", "+", "UU")]


def test_read_name_that_comes_back(spark):
    rows = [aln("a", 1, 0, 1), aln("a", 2, 1, 2), aln("b", 1, 0, 1), aln("b", 2, 1, 2), aln("a", 1, 2, 1), aln("a", 2, 3, 2)]
    together, _ = run(spark, rows)
    apart, _ = run(spark, rows, adjacent=True)
    assert [p[0] for p in together] == ["b"]  # a is one read of shape 2&2 and is not rescued
    assert [p[0] for p in apart] == ["a", "a", "b"]


def model(groups, names, min_mapq=10, limit=2000, strategy="complex"):
    """The routing rules, one read at a time."""
    out, st = [], dict.fromkeys(cv.COUNTERS, 0)
    mid = lambda r: r[3] + (r[4] - r[3]) // 2
    far = float("inf")
    dist = lambda a, b: abs(mid(a) - mid(b)) if a[2] == b[2] else far

    def opp(a, b):
        return a[7] != b[7] and (mid(b) > mid(a) if b[7] else mid(b) < mid(a))

    for g in groups:
        st["alignments"] += len(g)
        r1, r2 = [r for r in g if r[1] == 1], [r for r in g if r[1] == 2]
        if not r1 or not r2:
            continue
        st["reads"] += 1
        for r in g:
            st["secondary" if r[8] else "supplementary" if r[9] else "primary"] += 1
        p1 = [r for r in r1 if not r[8] and not r[9]]
        p2 = [r for r in r2 if not r[8] and not r[9]]
        if not p1 or not p2:
            continue
        p1, p2 = p1[-1], p2[-1]
        st[("unmapped_both", "unmapped_one", "mapped_both")[p1[6] + p2[6]]] += 1
        if not (p1[6] and p2[6]):
            continue
        st[("mapq0_none", "mapq0_one", "mapq0_both")[(p1[5] == 0) + (p2[5] == 0)]] += 1
        pick = shape = None
        if len(r1) == 1 and len(r2) == 1:
            shape, pick = "UU", (p1, p2)
        elif len(r1) == 1 or len(r2) == 1:
            if strategy == "unique":
                continue
            shape = "UD"
            lin, (f, s) = (r1[0], r2[:2]) if len(r1) == 1 else (r2[0], r1[:2])
            if dist(s, lin) < limit:
                pick = (f, lin) if opp(s, lin) else None
            elif dist(f, lin) < limit:
                pick = (s, lin) if opp(f, lin) else None
        elif len(r1) == 2 and len(r2) == 2 and strategy == "complex":
            shape = "DD"
            if dist(r1[0], r2[0]) < limit and dist(r1[1], r2[1]) < limit:
                pick = (r1[0], r2[1]) if opp(r1[0], r2[0]) and opp(r1[1], r2[1]) else None
            elif dist(r1[0], r2[1]) < limit and dist(r1[1], r2[0]) < limit:
                pick = (r1[0], r2[0]) if opp(r1[0], r2[1]) and opp(r1[1], r2[0]) else None
        if not pick or pick[0][5] < min_mapq or pick[1][5] < min_mapq:
            continue
        st["pairs"] += 1
        st[{"UU": "pairs_unique", "UD": "pairs_simple", "DD": "pairs_complex"}[shape]] += 1
        a, b = pick
        if a[2] == -1 or b[2] == -1:
            out.append(("", "", -1, "", -1, "+", "+", shape))
            st["intra"] += 1
            continue
        if (b[2], mid(b)) < (a[2], mid(a)) or (a[2], mid(a)) == (b[2], mid(b)):
            a, b = b, a
        st["intra" if a[2] == b[2] else "inter"] += 1
        strand = lambda r: "-" if r[7] else "+"
        out.append((a[0], names[a[2]], mid(a), names[b[2]], mid(b), strand(a), strand(b), shape))
    return sorted(out), st


def random_groups(seed, n):
    rng, groups = random.Random(seed), []
    for i in range(n):
        n1, n2 = rng.choice([(1, 1), (1, 2), (2, 1), (2, 2), (1, 4), (3, 1), (3, 2), (0, 2), (2, 3)])
        group = []
        for mate, k in ((1, n1), (2, n2)):
            for at in range(k):
                prime = at == 0 or rng.random() < 0.2
                sec = not prime and rng.random() < 0.4
                mapped = rng.random() < 0.95
                ref = rng.randint(0, 1) if mapped else -1
                mapq = rng.choice([0, 9, 10, 40, 60])
                group.append(
                    aln(f"q{i}", mate, ref, rng.choice([1000, 1500, 1500, 3000, 3500, 9000]), rng.choice("+-"), mapq, mapped, sec, not prime and not sec)
                )
        rng.shuffle(group)
        groups.append(group)
    return groups


@pytest.mark.parametrize("strategy", cv.STRATEGIES)
def test_random_reads_match_the_rules(spark, strategy):
    groups = random_groups(3, 1500)
    want, counters = model(groups, {i: f"t{i}" for i in range(50)}, strategy=strategy)
    got, stats = run(spark, [r for g in groups for r in g], strategy=strategy)
    assert got == want
    assert stats == counters
    assert min(counters[k] for k in ("pairs_unique", "intra", "mapq0_one", "unmapped_one")) > 0


def test_hot_read_name_is_limited_before_the_shuffle(spark):
    big = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("q"), F.col("id"))).alias("qname"),
        (F.when(F.col("id") == 0, 1).otherwise(2)).cast("int").alias("mate"),
        F.lit(0).cast("bigint").alias("ref_id"),
        (F.col("id") * 0 + 500).alias("start"),
        (F.col("id") * 0 + 520).alias("end"),
        F.lit(30).alias("mapq"),
        F.lit(True).alias("is_mapped"),
        (F.col("id") % 2 == 1).alias("is_reverse"),
        F.lit(False).alias("is_secondary"),
        (F.col("id") > 3).alias("is_supplementary"),
        F.col("id").alias("ord"),
    )
    lead = cv.leading_alignments(big, ["qname"])
    plan = lead._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    hot = cv.route_reads(big).where("qname = 'hot'").first()
    assert (hot.n1, hot.n2, hot["shape"]) == (1, 19_999, "UD")
