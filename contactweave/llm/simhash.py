"""Near-duplicates by SimHash fingerprints and an inverted index over byte positions.

Two 64-bit fingerprints that differ in at most four bits share at least four
of their eight positional bytes.  A list of the index holds the fingerprints
with given bytes at some positions; lists are keyed by two positions at once,
chosen so that any four of the eight positions hold one of the seven couples,
so every link meets in a list and no list has to hold 1/256 of all rows.
Inside a list the shared positional bytes of pairs are tallied, pairs below
the guaranteed count are dropped and the rest verified on all bits.

A list over a length is not read: its fingerprints move on to lists with three
and then four bytes fixed.  What is crowded even there meets by middles: two
fingerprints are at most four bits apart just if some value is at most two
bits from both, and no value has more than 2,081 fingerprints that near.  So
the work a fingerprint can cause is bounded, and a list yields a forest of
links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from contactweave.llm.common import slices
from contactweave.llm.near_dedup import components
from contactweave.plans.lookups import fits_broadcast, lookup
from contactweave.plans.storage import materialize

WORDS = 4
SEED = 42
DISTANCE = 4
LONGEST = (1_024, 1_024, 16_384)  # of lists with two, three and four bytes fixed
_SPACE = 32
_HASHES_AT_ONCE = 1 << 16
_LINKS = "a long, b long"


def fingerprint(text: bytes, size: int = WORDS) -> int:
    """SimHash of a UTF-8 text: a bit is 1 if over half of the shingles' hashes have it; 0 without words.

    A-Z are lower-cased, words end at \\x20 and \\x09-\\x0D, repeated shingles count each time.
    """
    words = text.lower().split()  # on bytes both look at ASCII alone
    if not words:
        return 0
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == _SPACE)
    starts, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(joined)]))
    last = max(0, len(words) - size)
    starts, ends = starts[: last + 1].tolist(), ends[len(words) - 1 - last :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _HASHES_AT_ONCE):
        part = slice(at, at + _HASHES_AT_ONCE)
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[part], ends[part])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id and fingerprint, as a signed 64-bit number, of every row; a null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2_000):
            found = np.array([fingerprint(t or b"", size) for t in part.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


_BYTES = [0xFF << s for s in range(0, 64, 8)]


def finer(mask: int) -> list[int]:
    """Masks with more of the eight bytes fixed.

    Whatever pair shares the bytes of ``mask``, and four or more in all,
    shares the bytes of one of the results as well.
    """
    if not mask:  # four of eight bytes hold a couple of one of three groups
        groups = _BYTES[:3], _BYTES[3:6], _BYTES[6:]
        return [a | b for g in groups for i, a in enumerate(g) for b in g[i + 1 :]]
    free = [u for u in _BYTES if not mask & u]
    return [mask | u for u in free[:5]]  # of six bytes two more are shared, of five one


def _signed(value: int) -> np.int64:
    return np.array([value], np.uint64).view(np.int64)[0]


def _lists(rows: DataFrame) -> DataFrame:
    """fp, mask and key of every finer list that the lists of ``rows`` (fp, mask) split into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, masks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for mask in np.unique(masks):
                own = fps[masks == mask]
                for child in map(_signed, finer(int(mask) & (2**64 - 1))):
                    columns = [own, np.full(len(own), child), own & child]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["fp", "mask", "key"])

    return rows.select("fp", "mask").mapInArrow(run, "fp long, mask long, key long")


def _roots(up: np.ndarray) -> np.ndarray:
    while True:
        higher = up[up]
        if np.array_equal(higher, up):
            return up
        up = higher


def forest(fps: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked within each list; rows of one list stand together.

    ``lists`` numbers the list of each row.  Rows are compared with the row
    one place on, then two, and so on while some list is that long.
    """
    n = len(fps)
    up = np.arange(n)
    at, step = np.arange(n), 0
    while True:
        step += 1
        at = at[at + step < n]
        at = at[lists[at] == lists[at + step]]
        if not len(at):
            break
        differs = fps[at] ^ fps[at + step]
        shared = (differs.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        likely = shared >= 8 - DISTANCE
        linked = at[likely][np.bitwise_count(differs[likely]) <= DISTANCE]
        apart = linked[up[linked] != up[linked + step]]
        for i in apart.tolist():
            a, b = i, i + step
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        if len(apart):
            up = _roots(up)
    below = np.flatnonzero(up != np.arange(n))
    return fps[below], fps[up[below]]


def _links_in(lists: DataFrame) -> DataFrame:
    """Links within lists, none of which is long; a task reads its lists one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((3, 0), np.int64)

        def out(rows: np.ndarray) -> pa.RecordBatch:
            new = np.any(rows[:2, 1:] != rows[:2, :-1], axis=0)
            a, b = forest(rows[2].view(np.uint64), np.concatenate(([0], np.cumsum(new))))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = np.concatenate((held, [c.to_numpy() for c in batch.columns]), axis=1)
            cut = np.flatnonzero(np.any(held[:2] != held[:2, -1:], axis=0))
            if len(cut):  # the last list may go on in the next batch
                yield out(np.ascontiguousarray(held[:, : cut[-1] + 1]))
                held = held[:, cut[-1] + 1 :]
        if held.shape[1]:
            yield out(np.ascontiguousarray(held))

    dealt = lists.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.mapInArrow(run, _LINKS)


_ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)
_UP_TO_TWO = np.concatenate(([np.uint64(0)], _ONE, *(_ONE[i] | _ONE[i + 1 :] for i in range(64))))


def _links_by_middles(fps: DataFrame) -> DataFrame:
    """Links among ``fps`` by the values at most two bits from both ends; any two around a value are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(own), 64):
                part = own[at : at + 64]
                middles = (part[:, None] ^ _UP_TO_TWO).ravel()
                columns = [middles, np.repeat(part, len(_UP_TO_TWO))]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["middle", "fp"])

    around = fps.select("fp").mapInArrow(run, "middle long, fp long")
    groups = around.groupBy("middle").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return groups.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a != b").distinct()


def links(fps: DataFrame, longest: tuple[int, int, int] = LONGEST) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fps`` that join whatever differs in at most ``DISTANCE`` bits."""
    found = None
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    for most in longest:
        lists = materialize(_lists(rows).distinct() if found is not None else _lists(rows), "lists")
        crowded = lists.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > most)
        crowded = materialize(crowded.select("mask", "key"), "long-lists")
        n = crowded.count()
        side = F.broadcast(crowded) if fits_broadcast(crowded, n) else crowded
        short = lists.join(side, ["mask", "key"], "left_anti") if n else lists
        here = materialize(_links_in(short), "links")
        found = here if found is None else found.unionByName(here)
        if not n:
            return found
        rows = lists.join(side, ["mask", "key"], "left_semi")
    return found.unionByName(materialize(_links_by_middles(rows.select("fp").distinct()), "links"))


def near_duplicates(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint as 16 hex digits, component_id.

    component_id is the least doc_id that links reach; rows with one
    fingerprint are linked, those without words too.  A row without doc_id
    links what is near it and has the component_id it reaches, null if none.
    Rows that repeat a doc_id each have their own fingerprint and the
    component_id it reaches.  An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, size), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    near = materialize(components(links(fps)), "components")
    named = fps.join(near, F.col("fp") == F.col("node"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    alone = fps.filter("n > 1").join(near, F.col("fp") == F.col("node"), "left_anti").select("fp", F.col("least").alias("component_id"))
    classes = materialize(named.join(lowest, "component").select("fp", "component_id").unionByName(alone), "classes")
    placed = lookup(rows, classes.withColumn("placed", F.lit(True)), {"fp": "fp"}, classes.count(), how="left")
    return placed.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("placed"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
