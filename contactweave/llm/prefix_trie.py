"""Trie of conversation prefixes, its subtree totals by time-forward processing.

A turn is named by a digest of role and text, a prefix by a polynomial of its
turns' names, which can be worked out in pieces: conversations are sorted by
range, so a very long one lies in several tasks, and each task goes on from
the value the task before ended with.

Totals go from the leaves up.  Nodes are dealt out in shards and stand in
reverse level order inside (Spark sorts and spills); a task takes one node
after the other, fetches from a priority queue what its children sent and
sends its own totals on to its parent.  The totals of a shard's root are
summed for each parent and wait for the shard that holds it.

A shard is a connected piece of the trie whose nodes have between 64**k and
64**(k + 1) members, and which reaches over at most ``SLICE`` levels.  So a
level of a shard has at most 64 nodes, a node's children are in the same
shard or in one that comes earlier, and there are as many rounds as there are
powers of 64 in the number of conversations, not levels (one more for each
``SLICE`` levels).
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contactweave.plans.lookups import lookup
from contactweave.plans.ordering import global_rank
from contactweave.plans.storage import materialize

SHARED_MOST = 5  # most turns a conversation takes over from another
GROUP = 100
BAND_BITS = 6
SLICE = 65_536
QUEUE = 1 << 18
IDS_IN_PIECE = 65_536
_PRIME = (1 << 61) - 1
_BASES = (0x9E3779B97F4A7C1 % _PRIME, 0xC2B2AE3D27D4EB4 % _PRIME)
_NAME = ["depth", "k1", "k2"]
_TO = ["to_depth", "to1", "to2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, a and b (halves of a digest of role and text) and chars (code points) of every turn.

    A null role or text is empty.  Rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            digest.alias("d"),
            F.length(text).cast("long").alias("chars"),
        )
        .filter("conv_id is not null")
        .select(
            "conv_id",
            "turn",
            F.conv(F.substring("d", 1, 15), 16, 10).cast("long").alias("a"),
            F.conv(F.substring("d", 17, 15), 16, 10).cast("long").alias("b"),
            "chars",
        )
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Rows conv_id, depth, a, b, chars, ended of rebuilt conversations; depth 0 is a row of every conversation.

    Conversation c takes the first h turns of conversation c - c % 100 (all if
    fewer, none if absent) and its own after its first h, where h is the crc32
    of c in decimal, modulo 6.  % takes the sign of c.  Turns stand by turn,
    null first; turns with one number by the digest of role and text.
    """
    turns = materialize(turns_of(conversations), "turns")
    numbered = global_rank(turns, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")], "at", copies=True)
    known = materialize(numbered.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n")), "conversations")
    n_known = known.count()
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED_MOST + 1)
    sized = known.withColumn("group", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("own", taken)
    sizes = known.select(F.col("conv_id").alias("head"), F.col("n").alias("head_n"))
    plan = lookup(sized, sizes, {"group": "head"}, n_known, how="left").withColumn("shared", F.least("own", F.coalesce("head_n", F.lit(0))))
    plan = plan.withColumn("last", F.col("shared") + F.greatest(F.col("n") - F.col("own"), F.lit(0)))
    plan = materialize(plan.select("conv_id", "group", "first", "own", "shared", "last"), "plan")
    placed = lookup(numbered, plan.withColumnRenamed("conv_id", "conv"), {"conv_id": "conv"}, n_known)
    placed = placed.withColumn("place", F.col("at") - F.col("first"))
    columns = ["conv_id", "depth", "a", "b", "chars", (F.col("depth") == F.col("last")).alias("ended")]
    tails = placed.filter("place >= own").withColumn("depth", F.col("place") - F.col("own") + F.col("shared") + 1).select(*columns)
    heads = placed.filter((F.col("conv_id") == F.col("group")) & (F.col("place") < SHARED_MOST)).select("group", "place", "a", "b", "chars")
    # at most five turns for each conversation, and a hundred or two of them for a head
    shared = plan.join(heads, "group").filter("place < shared").withColumn("depth", F.col("place") + 1).select(*columns)
    zero = F.lit(0).cast("long")
    tops = plan.select("conv_id", *[zero.alias(c) for c in ("depth", "a", "b", "chars")], (F.col("last") == 0).alias("ended"))
    return tops.unionByName(shared).unionByName(tails)


_NAMED = [("conv_id", pa.int64()), ("depth", pa.int64()), ("chars", pa.int64()), ("ended", pa.bool_())]
_NAMED += [(c, pa.int64()) for c in ("k1", "k2", "to1", "to2")]
_LOCAL = [*_NAMED, ("part", pa.int64()), ("since", pa.int64())]


def _ddl(fields) -> str:
    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}
    return ", ".join(f"{n} {kinds[t]}" for n, t in fields)


def named_prefixes(rows: DataFrame) -> DataFrame:
    """``rebuilt`` rows with the name of each prefix (k1, k2) and of the one a turn shorter (to1, to2)."""
    kinds = dict(_LOCAL)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, since, h1, h2 = None, -1, 0, 0
        for batch in batches:
            out = {c: [] for c in ("k1", "k2", "to1", "to2", "since")}
            for c, depth, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if depth == 0:
                    since, h1, h2, before = -1, 0, 0, (0, 0)
                else:
                    if c != conv:  # goes on from the partition before
                        since, h1, h2 = 0, 0, 0
                    before = h1, h2
                    h1, h2 = (h1 * _BASES[0] + a + 1) % _PRIME, (h2 * _BASES[1] + b + 1) % _PRIME
                    since += since >= 0
                conv = c
                for name, value in zip(out, (h1, h2, *before, since)):
                    out[name].append(value)
            columns = [batch.column(0), batch.column(1), batch.column(4), batch.column(5)]
            columns += [pa.array(out[c], pa.int64()) for c in ("k1", "k2", "to1", "to2")]
            columns += [batch.column(6), pa.array(out["since"], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, list(kinds))

    dealt = rows.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    dealt = dealt.select("conv_id", "depth", "a", "b", "chars", "ended", F.spark_partition_id().cast("long").alias("part"))
    local = materialize(dealt.mapInArrow(fold, _ddl(_LOCAL)), "local-prefixes")
    # two short rows for each partition
    ends = local.groupBy("part").agg(
        F.max_by(F.struct("since", "k1", "k2"), F.struct("conv_id", "depth")).alias("last"),
        F.max("since").alias("longest"),
    )
    carries, now = {}, (0, 0)
    for r in ends.orderBy("part").collect():
        if r.longest >= 0:
            carries[r.part] = now
        ahead = r["last"].since
        own = r["last"].k1, r["last"].k2
        now = own if ahead < 0 else tuple((c * pow(x, ahead, _PRIME) + k) % _PRIME for c, x, k in zip(now, _BASES, own))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, since = batch.column(8).to_pylist(), batch.column(9).to_pylist()
            columns = batch.columns[:8]
            if max(since, default=-1) >= 0:
                names = [c.to_pylist() for c in columns[4:]]
                for i, s in enumerate(since):
                    if s < 0:
                        continue
                    for lane, start in enumerate(carries[part[i]]):
                        shift = pow(_BASES[lane], s - 1, _PRIME)
                        names[lane + 2][i] = (start * shift + names[lane + 2][i]) % _PRIME
                        names[lane][i] = (start * shift * _BASES[lane] + names[lane][i]) % _PRIME
                columns = [*columns[:4], *(pa.array(n, pa.int64()) for n in names)]
            yield pa.RecordBatch.from_arrays(columns, [c for c, _ in _NAMED])

    return local.mapInArrow(carry, _ddl(_NAMED)) if carries else local.drop("part", "since")


class SpillingQueue:
    """A priority queue of rows of six numbers, ordered by the first three.

    What goes past ``limit`` is sorted and written as a run; rows come from the
    least of all runs and what is held.  A run is an unnamed file of the task,
    as those Spark's own sort makes, and is gone with it.
    """

    _ROW = struct.Struct("<6q")

    def __init__(self, limit: int = QUEUE):
        self._limit = limit
        self._held: list[tuple[int, ...]] = []
        self._runs: list = []  # first row of each run, its number and its file
        self.spilled = 0

    def push(self, row: tuple[int, ...]) -> None:
        heapq.heappush(self._held, row)
        if len(self._held) > self._limit:
            run = tempfile.TemporaryFile()
            run.writelines(self._ROW.pack(*r) for r in sorted(self._held))
            run.seek(0)
            self._held.clear()
            self.spilled += 1
            self._advance(self.spilled, run)

    def _advance(self, number: int, run) -> None:
        data = run.read(self._ROW.size)
        if data:
            heapq.heappush(self._runs, (self._ROW.unpack(data), number, run))
        else:
            run.close()

    def take(self, key: tuple[int, int, int]) -> tuple[int, int, int]:
        """Sums of the last three numbers of all rows with ``key``, which nothing held may be below."""
        one = two = three = 0
        while True:
            from_run = bool(self._runs) and (not self._held or self._runs[0][0] < self._held[0])
            if not from_run and not self._held:
                break
            row = self._runs[0][0] if from_run else self._held[0]
            if row[:3] != key:
                break
            if from_run:
                _, number, run = heapq.heappop(self._runs)
                self._advance(number, run)
            else:
                heapq.heappop(self._held)
            one, two, three = one + row[3], two + row[4], three + row[5]
        return one, two, three


_NODE = ["conv_id", "n_convs", *_NAME, *_TO, "top_depth", "top1", "top2", "own", "n_children", "n_leaves", "saved_tokens"]
_DONE = [(c, pa.int64()) for c in ("conv_id", "n_convs", *_NAME, *_TO, "n_children", "n_leaves", "saved_tokens")] + [("is_root", pa.bool_())]


def _within_shards(nodes: DataFrame, queue: int) -> DataFrame:
    """Totals of ``nodes``, whose n_children, n_leaves and saved_tokens hold what other shards sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = SpillingQueue(queue)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_children", "n_leaves", "saved_tokens", "is_root")}
            names = dict(zip(batch.schema.names, batch.columns))
            for depth, k1, k2, td, t1, t2, rd, r1, r2, own, children, leaves, saved in zip(*(names[c].to_pylist() for c in _NODE[2:])):
                more = waiting.take((-depth, k1, k2))
                children, leaves, saved = children + more[0], leaves + more[1], saved + more[2] + own
                if not children:
                    leaves = 1
                is_root = (depth, k1, k2) == (rd, r1, r2)
                if not is_root:
                    waiting.push((-td, t1, t2, 1, leaves, saved))
                for name, value in zip(out, (children, leaves, saved, is_root)):
                    out[name].append(value)
            columns = [names[c] for c in _NODE[:8]] + [pa.array(v, k) for v, (_, k) in zip(out.values(), _DONE[8:])]
            yield pa.RecordBatch.from_arrays(columns, [c for c, _ in _DONE])

    shard = ["top_depth", "top1", "top2"]
    order = [*shard, F.col("depth").desc(), "k1", "k2"]
    return nodes.select(_NODE).repartition(*shard).sortWithinPartitions(*order).mapInArrow(run, _ddl(_DONE))


def totals(rows: DataFrame, nodes: DataFrame, band_bits: int = BAND_BITS, slice_levels: int = SLICE, queue: int = QUEUE) -> DataFrame:
    """``nodes`` with n_children, n_leaves and saved_tokens; ``rows`` are the named prefixes they were made of."""
    band = F.floor((F.length(F.bin("n_convs")) - 1) / band_bits).cast("long")
    level = F.floor(F.col("depth") / slice_levels).cast("long")
    nodes = nodes.withColumn("band", band).withColumn("slice", level)
    large = materialize(nodes.filter("band > 0").select(*[F.col(c).alias(f"large_{c}") for c in _NAME], F.col("band").alias("known")), "large-nodes")
    path = rows.select("conv_id", *_NAME, level.alias("slice"))
    path = lookup(path, large, {c: f"large_{c}" for c in _NAME}, large.count(), how="left")
    # the ancestors of a node all stand on the path of its least member
    tops = (
        path.groupBy("conv_id", F.coalesce("known", F.lit(0)).alias("band"), "slice")
        .agg(F.min(F.struct(*_NAME)).alias("top"))
        .select("conv_id", "band", "slice", *[F.col(f"top.{c}").alias(t) for c, t in zip(_NAME, ("top_depth", "top1", "top2"))])
    )
    sharded = materialize(nodes.join(tops, ["conv_id", "band", "slice"]), "sharded-nodes")
    rounds = sorted(((r.band, r.slice) for r in sharded.select("band", "slice").distinct().collect()), key=lambda r: (r[0], -r[1]))
    done, sent = None, None
    sums = ["n_children", "n_leaves", "saved_tokens"]
    for b, s in rounds:
        now = sharded.filter((F.col("band") == b) & (F.col("slice") == s))
        if sent is None:
            now = now.select("*", *[F.lit(0).cast("long").alias(c) for c in sums])
        else:
            arrived = sent.groupBy(*_TO).agg(F.sum("one").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
            arrived = arrived.withColumnsRenamed({t: f"for_{t}" for t in _TO})
            same = [F.col(c) == F.col(f"for_{t}") for c, t in zip(_NAME, _TO)]
            now = now.join(arrived, same, "left").select(now["*"], *[F.coalesce(c, F.lit(0)).alias(c) for c in sums])
        here = materialize(_within_shards(now, queue), "totals")
        roots = here.filter("is_root and depth > 0").select(*_TO, F.lit(1).cast("long").alias("one"), "n_leaves", "saved_tokens")
        done = here if done is None else done.unionByName(here)
        sent = roots if sent is None else sent.unionByName(roots)
    return nodes.select(*[c for c, _ in _DONE[:8]], *[F.lit(0).cast("long").alias(c) for c in sums]) if done is None else done.drop("is_root")


def _pieces(members: DataFrame, most: int) -> DataFrame:
    """Decimal conv_ids of each name, ascending and comma-joined, in pieces of up to ``most``; ``first`` orders them."""
    fields = [(c, pa.int64()) for c in (*_NAME, "first")] + [("ids", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in batches:
            out = []
            for *own, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if own != name or len(held) == most:
                    if held:
                        out.append((*name, held[0], ",".join(map(str, held))))
                    name, held = own, []
                held.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out), fields)], [n for n, _ in fields])
        if held:
            last = (*name, held[0], ",".join(map(str, held)))
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, (_, k) in zip(last, fields)], [n for n, _ in fields])

    order = [*_NAME, "conv_id"]
    return members.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _ddl(fields))


def end_digests(rows: DataFrame, most: int = IDS_IN_PIECE) -> DataFrame:
    """depth, k1, k2 and ends_sha256 of every prefix at which a conversation ends.

    A digest can only be worked out in order, so a task streams the pieces of
    a prefix, one in memory at a time.
    """
    fields = [(c, pa.int64()) for c in _NAME] + [("ends_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sha = None, None
        for batch in batches:
            out = []
            for *own, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if own != name:
                    if name is not None:
                        out.append((*name, sha.hexdigest()))
                    name, sha = own, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out), fields)], [n for n, _ in fields])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, (_, k) in zip((*name, sha.hexdigest()), fields)], [n for n, _ in fields])

    pieces = _pieces(rows.filter("ended"), most)
    dealt = pieces.repartition(*_NAME).sortWithinPartitions(*_NAME, "first").select(*_NAME, "first", "ids")
    return dealt.mapInArrow(run, _ddl(fields))


def trie(conversations: DataFrame, band_bits: int = BAND_BITS, slice_levels: int = SLICE, queue: int = QUEUE) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    conv_id (least member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.  Repeated turns are
    turns of their own; an empty table, or one without any conv_id, gives no
    node, not even a root.
    """
    rows = materialize(named_prefixes(materialize(rebuilt(conversations), "rebuilt")), "prefixes")
    nodes = materialize(
        rows.groupBy(*_NAME).agg(
            F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.max(F.col("depth") - 1).alias("to_depth"),
            F.max("to1").alias("to1"),
            F.max("to2").alias("to2"),
            F.max("chars").alias("chars"),
        ),
        "nodes",
    ).withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))
    found = totals(rows, nodes.drop("chars"), band_bits, slice_levels, queue)
    # a parent of one member has that of its child
    several = nodes.filter("n_convs > 1").select(*[F.col(c).alias(f"of_{c}") for c in _NAME], F.col("conv_id").alias("above"))
    several = materialize(several, "shared-nodes")
    found = lookup(found, several, {t: f"of_{c}" for t, c in zip(_TO, _NAME)}, several.count(), how="left")
    ends = end_digests(rows).withColumnsRenamed({c: f"at_{c}" for c in _NAME})
    found = found.join(ends, [F.col(c) == F.col(f"at_{c}") for c in _NAME], "left")
    return found.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
