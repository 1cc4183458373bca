"""Near-duplicate removal by min-max hashing.

Each permutation of the shingle space gives two signature values, the least
and the greatest hash of a document, so ``VALUES`` values take half as many
hash evaluations.  Values are banded; documents that share a band are
candidates, and every link is confirmed on the full shingle sets.

No group is compared all against all.  Documents with one shingle sequence
are folded first.  In every bucket each document is compared with one centre,
the document with the fewest shingles of its own; what is linked then forms
components.  After that only documents of different components in a bucket
meet, and of those only pairs whose shared shingles could reach the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contactweave.llm.common import factorize, mix, slices
from contactweave.plans.lookups import fits_broadcast
from contactweave.plans.storage import materialize

VALUES = 120
MISS = 2e-6
SLICE_BYTES = 2 << 20  # of text whose words a task holds at once
_BLOCK_SETS = 64


def bands_for(threshold: float, values: int = VALUES, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands): the most rows a band for which a pair at ``threshold`` is missed with at most ``miss``."""
    for rows in range(values, 0, -1):
        bands = values // rows
        if bands and (1 - threshold**rows) ** bands <= miss:
            return rows, bands
    return 1, values


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Of each text: a key of its word sequence, and its sorted distinct shingle hashes.

    A-Z are lower-cased.  A text of fewer than ``size`` words has its whole
    sequence as one shingle, a text without words has none.
    """
    found = factorize(texts, lower=True)
    hashes = found.hashes()
    for a, b in zip(found.offsets[:-1], found.offsets[1:]):
        own = hashes[found.codes[a:b]]
        key = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
        if not len(own):
            yield key, own
            continue
        n = min(size, len(own))
        joined = mix(own[: len(own) - n + 1], n)
        for k in range(1, n):
            joined = mix(joined ^ own[k : len(own) - n + 1 + k], 100 + k)
        yield key, np.unique(joined)


_SEEDS = mix(np.arange(VALUES, dtype=np.uint64), 7)
_BLOCK = 1 << 17  # shingles whose hashes stay in a core's cache


def min_max(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """A row for each set, none of them empty: least values of all permutations, then greatest."""
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    done = 0
    while done < len(sets):
        last, held = done, 0
        while last < len(sets) and (last == done or held + len(sets[last]) <= _BLOCK):
            held += len(sets[last])
            last += 1
        every = np.concatenate(sets[done:last])
        starts = np.cumsum([0] + [len(x) for x in sets[done : last - 1]])
        h = np.empty_like(every)
        for k in range(permutations):
            # an odd factor permutes the 64-bit values
            np.bitwise_xor(every, _SEEDS[2 * k], out=h)
            np.multiply(h, _SEEDS[2 * k + 1] | np.uint64(1), out=h)
            out[done:last, k] = np.minimum.reduceat(h, starts)
            out[done:last, permutations + k] = np.maximum.reduceat(h, starts)
        done = last
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """doc_id, key of the word sequence, number of shingles and band hashes of every row."""
    rows, bands = bands_for(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 5_000, SLICE_BYTES):
            keys, sets = zip(*shingle_sets(part.column(1), size))
            counts = np.array([len(x) for x in sets])
            values = min_max([x for x in sets if len(x)], VALUES // 2)[:, : rows * bands].reshape(-1, rows, bands)
            h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(values), bands))
            for k in range(rows):  # a band takes one value of each block of permutations
                h = mix(h ^ values[:, k], 3)
            hashed = iter(h.view(np.int64))
            banded = [next(hashed) if n else [] for n in counts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(list(keys), pa.binary()), pa.array(counts, pa.int64()), pa.array(banded, pa.list_(pa.int64()))],
                ["doc_id", "key", "n_shingles", "bands"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, key binary, n_shingles long, bands array<long>")


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Shingle sets, as sorted 64-bit hashes, of the documents ``wanted`` names by node and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2_000, SLICE_BYTES):
            nodes, sets = [], []
            for node, expected, (key, own) in zip(
                part.column(0).to_pylist(), part.column(2).to_pylist(), shingle_sets(part.column(1), size)
            ):
                if key == expected:
                    nodes.append(node)
                    sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    side = F.broadcast(wanted) if fits_broadcast(wanted, wanted.count()) else wanted
    rows = _texts(docs).join(side, F.col("doc_id") == F.col("node")).select("doc_id", "text", "key")
    return rows.mapInArrow(run, "node long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            linked = []
            x, y = part.column(2), part.column(3)
            xs, ys = (c.values.to_numpy().view(np.uint64) for c in (x, y))
            for xa, xb, ya, yb in zip(*(o.tolist() for c in (x, y) for o in (c.offsets.to_numpy()[:-1], c.offsets.to_numpy()[1:]))):
                both = np.concatenate((xs[xa:xb], ys[ya:yb]))
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return rows.mapInArrow(run, "a long, b long, linked boolean").filter("linked").select("a", "b").distinct()


def _shared_sizes(sets: DataFrame) -> DataFrame:
    """node and how many of its shingles some other candidate has too.

    Two sets can't share more than the smaller of these numbers, which rules
    out most pairs of a large group of loose copies without forming them.
    """
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    private = each.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).filter("node = other")
    counts = private.groupBy("node").agg(F.count("*").alias("private"))
    return sets.select("node", F.size("shingles").alias("n")).distinct().join(counts, "node", "left").select(
        "node", (F.col("n") - F.coalesce("private", F.lit(0))).alias("most")
    )


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of all linked nodes; a component is named by its least node.

    Alternates large-star and small-star steps until the edges no longer
    change.  A step groups edges by node with plain aggregates, so no
    neighbour list is held in a task.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = materialize(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct(),
            "edges",
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _may_link(most, n2, percent: int):
    """Can a set of n, of which ``most`` could be shared, reach the threshold with one of n2?"""
    shared = F.least(most, F.col("n"), n2)
    return 100 * shared >= percent * (F.col("n") + n2 - shared)


def _may_link_any(most, least2, percent: int):
    """Can a set of n, of which ``most`` could be shared, reach the threshold with a set of any size from ``least2`` on?

    The best size is all that could be shared, or the least there is if that is more.
    """
    return _may_link(most, F.greatest(F.least(most, F.col("n")), least2), percent)


def _cross_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components that meet in a bucket: a row (a, b) for each document and block it links to.

    Each document of the smaller component is compared with all of the larger
    one, which comes in blocks, so neither pairs nor whole components are
    formed.  Components that cannot reach the threshold are passed over.
    """
    nodes = materialize(members.select("node", "component", "n", "most").distinct(), "members")
    comps = nodes.groupBy("component").agg(F.count("*").alias("size"), F.max("most").alias("top"), F.min("n").alias("least"))
    sized = members.join(comps, "component")
    inside = sized.select(
        "band", "hash", F.col("component").alias("other"), F.col("size").alias("size2"), F.col("top").alias("top2"), F.col("least").alias("least2")
    ).distinct()
    smaller = (F.col("size") < F.col("size2")) | ((F.col("size") == F.col("size2")) & (F.col("component") < F.col("other")))
    asked = (
        sized.join(inside, ["band", "hash"])
        .filter(smaller & _may_link_any(F.least("most", "top2"), F.col("least2"), percent))
        .select("node", "other")
        .distinct()
    )
    asked = materialize(asked, "asked")
    held = nodes.join(asked.select(F.col("other").alias("component")).distinct(), "component", "left_semi").join(comps.select("component", "size"), "component")
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / _BLOCK_SETS))
    blocks = (
        held.withColumn("block", block)
        .join(sets.select("node", "shingles"), "node")
        .groupBy(F.col("component").alias("other"), "block")
        .agg(F.collect_list(F.struct("node", "shingles")).alias("held"))
    )
    kind = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for k in range(batch.num_rows):
                x = batch.column(1)[k].values.to_numpy().view(np.uint64)
                block = batch.column(2)[k].values
                for node, y in zip(block.field("node").to_pylist(), block.field("shingles")):
                    y = y.values.to_numpy().view(np.uint64)
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    both = np.concatenate((x, y))
                    both.sort(kind="stable")
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    if 100 * shared >= percent * (len(both) - shared):
                        left.append(batch.column(0)[k].as_py())
                        right.append(node)
                        break  # one link joins the components
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    rows = asked.join(sets.select("node", "shingles"), "node").join(blocks, "other").select("node", "shingles", "held")
    return rows.mapInArrow(run, kind)


def _with_component(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for
    their shingle sets; component_id is the least doc_id that links reach.
    Texts that are null, empty or without words are linked with nothing.  Rows
    that repeat a doc_id with one text share its component; where a doc_id
    comes with several texts, one of them (by its key) is compared and rows
    with the others are linked with nothing.  A null doc_id stays null in
    component_id and is kept.  An empty table gives an empty result.
    """
    threshold = percent / 100
    table = materialize(signatures(docs, size, threshold), "signatures")
    # one representative for each word sequence, and one sequence for each doc_id
    by_key = (
        table.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("key")
        .agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r"))
    )
    by_node = by_key.groupBy(F.col("r.doc_id").alias("node")).agg(F.min(F.struct("key", "r")).alias("k"))
    reps = materialize(
        by_node.select("node", "k.key", F.col("k.r.n_shingles").alias("n"), F.col("k.r.bands").alias("bands")), "representatives"
    )
    buckets = reps.select("node", "n", F.posexplode("bands").alias("band", "hash"))
    crowded = buckets.groupBy("band", "hash").agg(F.count("*").alias("members")).filter("members > 1").select("band", "hash")
    members = materialize(buckets.join(crowded, ["band", "hash"]), "buckets")
    wanted = materialize(reps.select("node", "key").join(members.select("node").distinct(), "node", "left_semi"), "nodes")
    sets = materialize(_sets_of(docs, wanted, size), "sets")
    # a link needs 100 * shared >= percent * union, and the union is at least n
    sizes = _shared_sizes(sets).filter(F.col("most") > 0)
    members = materialize(members.join(sizes, "node").filter(100 * F.col("most") >= percent * F.col("n")), "members")
    centres = members.groupBy("band", "hash").agg(
        # the member with the fewest shingles of its own
        F.min(F.struct((F.col("n") - F.col("most")).alias("own"), "node", "n", "most")).alias("c")
    )
    other = [F.col("c.node").alias("node2"), F.col("c.n").alias("n2"), F.col("c.most").alias("most2")]
    pairs = (
        members.join(centres.select("band", "hash", *other), ["band", "hash"])
        .filter((F.col("node") != F.col("node2")) & _may_link(F.least("most", "most2"), F.col("n2"), percent))
        .select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
        .distinct()
    )
    links = materialize(confirm(materialize(pairs, "pairs"), sets, percent), "links")
    comps = materialize(components(links), "components")
    more = materialize(_cross_links(_with_component(members, comps), sets, percent), "cross-links")
    if not more.isEmpty():
        comps = materialize(components(links.unionByName(more)), "components")
    return _result(table, reps, comps)


def _result(table: DataFrame, reps: DataFrame, comps: DataFrame | None) -> DataFrame:
    placed = _with_component(reps.select("node", "key"), comps).select("key", "component")
    rows = table.select("doc_id", "n_shingles", "key").join(placed, "key", "left")
    rows = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the least doc_id.

    All columns are as they were.  Of rows that repeat a doc_id and its text one is kept.
    """
    result = materialize(near_duplicates(docs, size, percent), "classes")
    dropped = result.filter("not kept").select(F.col("doc_id").alias("_dropped")).distinct()
    repeated = result.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_again"))
    side = F.broadcast(dropped) if fits_broadcast(dropped, dropped.count()) else dropped
    kept = docs.join(side, F.col("doc_id").cast("long") == F.col("_dropped"), "left_anti")
    n = repeated.count()
    if not n:
        return kept
    again = F.broadcast(repeated) if fits_broadcast(repeated, n) else repeated
    same = F.col("doc_id").cast("long") == F.col("_again")
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
