"""GFA reading, typed tags and graph traversal."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from contactweave.functions import tags as tg
from contactweave.operators import graph as gr
from contactweave.sources.gfa import Gfa, gfa_lines, record_type

TEXT = (
    "# a comment\nH\tVN:Z:0.9\nH\tVN:Z:1.0\nS\ta\tACGT\tLN:i:4\tRC:i:7\nS\tb\t*\tLN:i:10\n"
    "L\ta\t+\tb\t-\t4M\tXX:i:1\nL\ta\t+\tnone\t-\t4M\nC\ta\t+\tb\t-\t1\t4M\nP\tp\ta+,b-\t*\nZZ\tq\n"
)


@pytest.fixture(scope="module")
def gfa(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("gfa") / "g.gfa"
    path.write_text(TEXT)
    return Gfa.read(spark, str(path))


def test_records(gfa):
    assert [r.tags["VN"].z for r in gfa.header.collect()] == ["1.0"]
    got = {r.name: (r.seq, r.tags["LN"].i) for r in gfa.segments.collect()}
    assert got == {"a": ("ACGT", 4), "b": (None, 10)}
    link = gfa.links.where("to_name = 'b'").first()
    assert (link.from_name, link.from_strand, link.to_strand, link.cigar, link.tags["XX"].i) == ("a", "+", "-", "4M", 1)
    assert gfa.links.count() == 2


def test_record_letters(spark):
    df = spark.createDataFrame([(x,) for x in ("H", "S", "L", "C", "P", "#", "HH", "Z", "")], "f string")
    assert [r[0] for r in df.select(record_type(F.col("f"))).collect()] == ["H", "S", "L", "C", "P", "#", None, None, None]


@pytest.mark.parametrize("line", ["S\ta", "S\ta\t", "L\ta\t+\tb\t-", "L\ta\t*\tb\t-\t4M"])
def test_broken_lines_are_errors(spark, tmp_path, line):
    path = tmp_path / "bad.gfa"
    path.write_text(line + "\n")
    g = Gfa.read(spark, str(path))
    with pytest.raises(Exception, match="line needs"):
        (g.segments if line[0] == "S" else g.links).collect()


def test_containers(spark, gfa):
    empty = Gfa.empty(spark)
    full = empty.with_header(gfa.header).with_segments(gfa.segments).with_links(gfa.links)
    assert (full.header.count(), full.segments.count(), full.links.count()) == (1, 2, 2)


def test_graph_of_the_example(gfa):
    edges, vertices = gr.edges(gfa.links, gfa.segments), gr.vertices(gfa.segments)
    assert sorted(map(tuple, edges.collect())) == [("a+", "b-"), ("b+", "a-")]
    assert [r.name for r in gr.named_segments(gfa.segments).collect()] == ["a"]
    assert {r.name: r.length for r in gr.segment_lengths(gfa.segments).collect()} == {"a": 4, "b": 10}
    assert gr.has_path(edges, vertices, "a+", "b-")
    assert not gr.has_path(edges, vertices, "b-", "a+")
    assert not gr.has_path(edges, vertices, "a+", "a+")
    assert not gr.has_path(edges, vertices, "nope+", "a+")
    assert dict(map(tuple, gr.bfs_distances(edges, "a+").collect())) == {"a+": 0, "b-": 1}


def test_strand_pairs(spark):
    segs = spark.createDataFrame([("a", "A"), ("b", "A")], "name string, seq string")
    want = {"++": {("a+", "b+"), ("b-", "a-")}, "+-": {("a+", "b-"), ("b+", "a-")},
            "-+": {("a-", "b+"), ("b-", "a+")}, "--": {("a-", "b-"), ("b+", "a+")}}
    schema = "from_name string, from_strand string, to_name string, to_strand string, cigar string"
    for strands, pair in want.items():
        links = spark.createDataFrame([("a", strands[0], "b", strands[1], "1M")] * 2, schema)
        got = [tuple(r) for r in gr.edges(links, segs).collect()]
        assert len(got) == 4 and set(got) == pair
        inverse = gr.invert_link(links).first()
        assert (inverse.from_name, inverse.to_name) == ("a", "b")
        assert inverse.from_strand + inverse.to_strand == strands.translate(str.maketrans("+-", "-+"))


def plain_bfs(steps, source, jump=False):
    out = {source: 0}
    queue = deque([source])
    nodes = {a for a, _ in steps}
    while queue:
        at = queue.popleft()
        nexts = [b for a, b in steps if a == at]
        if jump and at not in nodes:
            nexts = [at[:-1] + {"+": "-", "-": "+"}[at[-1]]]
        for b in nexts:
            if b not in out:
                out[b] = out[at] + 1
                queue.append(b)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_distances_match_a_queue(spark, seed):
    rng = random.Random(seed)
    node = lambda: f"n{rng.randint(0, 24)}{rng.choice('+-')}"
    steps = [(node(), node()) for _ in range(45)] + [("hub+", node()) for _ in range(30)]
    steps.append((node(), "hub+"))
    edges = spark.createDataFrame(steps, "src string, dst string")
    for source in ("hub+", steps[0][0]):
        assert dict(map(tuple, gr.bfs_distances(edges, source).collect())) == plain_bfs(steps, source)
    jumped = gr.bfs_distances(edges, "hub+", jump_complement_at_sink=True)
    assert dict(map(tuple, jumped.collect())) == plain_bfs(steps, "hub+", jump=True)


def test_cycle_back_to_the_source(spark):
    edges = spark.createDataFrame([("a+", "b+"), ("b+", "a+")], "src string, dst string")
    nodes = spark.createDataFrame([("a+",), ("b+",), ("c+",)], "node string")
    assert not gr.has_path(edges, nodes, "a+", "a+")
    assert gr.has_path(edges, nodes, "a+", "a+", count_cycles=True)
    assert gr.bfs_distances(edges, "a+").count() == 2


def parse(spark, *fields):
    df = spark.createDataFrame([(list(fields),)], "f array<string>")
    return df.select(tg.parse_tags(F.col("f")).alias("t"))


def test_tags(spark):
    row = parse(
        spark, "XX:i:abc12", "XH:H:1F", "XA:A:q", "XF:f:-1.5e3", "XZ:Z:a b", "XJ:J:{1}", "XB:B:i,1", "QQ:q:1", "1X:i:5",
        "XE:i:x", "XI:i:1", "XI:i:2", "BG:i:99999999999999999999", "X", "XI", "YY:i",
    ).first()["t"]
    assert set(row) == {"XX", "XH", "XA", "XF", "XZ", "XJ", "XB", "XI"}
    assert (row["XX"].i, row["XH"].h, row["XA"].a, row["XF"].f, row["XZ"].z) == (12, [1, 15], "q", -1500.0, "a b")
    assert (row["XJ"].type, row["XJ"].z, row["XB"].z, row["XI"].i) == ("J", "{1}", "i,1", 2)
    shown = parse(spark, "XX:i:7", "XH:H:1F", "XF:f:2").select(
        *[tg.show_tag(F.col("t")[k]).alias(k) for k in ("XX", "XH", "XF")]
    ).first()
    assert tuple(shown) == ("i:7", "H:1f", "f:2")
    assert parse(spark).first()["t"] == {}


def test_a_long_chain_takes_a_few_rounds(spark):
    """Ten thousand nodes in a row, a branching, a cycle on the way and one that nothing leads to."""
    rows = [(f"n{i}+", f"n{i + 1}+") for i in range(10_000)]
    rows += [("n5000+", "x0+"), ("x0+", "x1+"), ("x1+", "n4990+"), ("n20+", "n9000+"), ("y0+", "y1+"), ("y1+", "y0+")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    got = {r.node: r.distance for r in gr.bfs_distances(edges, "n0+").collect()}
    steps, want, queue = {}, {"n0+": 0}, deque(["n0+"])
    for a, b in rows:
        steps.setdefault(a, []).append(b)
    while queue:
        at = queue.popleft()
        for b in steps.get(at, ()):
            if b not in want:
                want[b] = want[at] + 1
                queue.append(b)
    assert got == want
    again = {r.node: r.distance for r in gr.bfs_distances(edges, "x0+", include_source=False).collect()}
    assert again["x0+"] == 13 and "y0+" not in again


def test_floats_are_shown_as_plain_decimals(spark):
    values = ["1e7", "0.0001", "12345678.5", "-2.5e-3", "3", "-1.5e12", "1.25e-10", "0", "123456789012", "1e22"]
    df = spark.createDataFrame([(f"XF:f:{v}",) for v in values], "f string")
    shown = [r[0] for r in df.select(tg.show_tag(tg.tag_value(F.col("f")))).collect()]
    assert shown == [
        "f:10000000", "f:0.0001", "f:12345678.5", "f:-0.0025", "f:3", "f:-1500000000000", "f:0.000000000125", "f:0",
        "f:123456789012", "f:10000000000000000000000",
    ]


def test_a_deep_branching_graph_takes_a_few_rounds(spark, monkeypatch):
    """Every node of a chain has a way round with a dead end, so no path is without a branching; a far shortcut too."""
    rows, n = [], 200
    for i in range(n):
        rows += [(f"n{i}+", f"n{i + 1}+"), (f"n{i}+", f"m{i}+"), (f"m{i}+", f"n{i + 1}+"), (f"m{i}+", f"e{i}+")]
    rows += [("n20+", "n90+"), ("n150+", "n3+"), ("z+", "n0+"), ("n5+", "n5+")]
    calls = []
    plain = gr.lookup
    monkeypatch.setattr(gr, "lookup", lambda *a, **k: calls.append(1) or plain(*a, **k))
    edges = spark.createDataFrame(rows, "src string, dst string")
    got = gr.bfs_distances(edges, "n0+").collect()
    steps = {}
    for a, b in rows:
        steps.setdefault(a, []).append(b)
    want, queue = {"n0+": 0}, deque(["n0+"])
    while queue:
        at = queue.popleft()
        for b in steps.get(at, ()):
            if b not in want:
                want[b] = want[at] + 1
                queue.append(b)
    assert len(got) == len(want) and dict(map(tuple, got)) == want
    assert len(calls) < 50
