"""Document fingerprints by randomised I-Match.

A text's distinct terms are kept where their inverse document frequency lies
in a chosen band, sorted, and hashed once for the whole lexicon and once for
each of several random subsets of it.  Subsets come in families: level k of a
family holds a random 1/4**k of the lexicon, so long and short texts both have
levels at which a small edit leaves some hashes as they were.

Document frequencies are counted over all documents in a table of
``2**LEXICON_BITS`` hashed terms; what tasks get of it is one bit for each
entry (in the band or not), 512 KiB whatever the input.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contactweave.llm.common import factorize, mix, slices
from contactweave.plans.lookups import fits_broadcast

LEXICON_BITS = 22
IDF_BAND = (0.25, 0.95)  # of the largest idf, that of a term in one document
FAMILIES, LEVELS = 12, 6
LEAST_TERMS = 4
LEAST_FAMILIES = 4  # a level counts if at least one family in so many has terms there
_HEX = 4


def band_mask(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> bytes:
    """A bit for each lexicon entry: is its share of the largest idf, log(N / df) / log(N), in the band?

    Rows with a null text count as empty documents.  An empty table gives no entry.
    """
    size = 1 << LEXICON_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(size, np.int32)
        rows = 0
        for part in slices(batches, 10_000, 4 << 20):
            found = factorize(part.column(1))
            entry = (found.hashes() >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)[found.codes]
            doc = np.repeat(np.arange(part.num_rows), np.diff(found.offsets))
            pairs = np.unique((doc << LEXICON_BITS) | entry)
            seen, times = np.unique(pairs & (size - 1), return_counts=True)
            totals[seen] += times.astype(np.int32)
            rows += part.num_rows
        seen = np.flatnonzero(totals)
        for at in range(0, len(seen), 1 << 16):
            e = seen[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(e.astype(np.int32)), pa.array(totals[e].astype(np.int64))], ["e", "df"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([rows], pa.int64())], ["e", "df"])

    rows = docs.select(F.lit(0).alias("one"), F.col("text").cast("string"))
    table = rows.mapInArrow(count, "e int, df long").groupBy("e").agg(F.sum("df").alias("df"))
    n = docs.count()
    if n < 2:
        low, high = 1, n
    else:
        low = math.ceil(n ** (1 - band[1]) - 1e-9)
        high = math.floor(n ** (1 - band[0]) + 1e-9)
    chosen = table.filter((F.col("e") >= 0) & F.col("df").between(low, high))
    bits = np.zeros(size, bool)
    # bitmaps of 8,192 entries: at most 512 rows of 1 KiB reach the driver
    parts = (
        chosen.groupBy((F.col("e") / 8192).cast("int").alias("block"))
        .agg(F.bitmap_construct_agg((F.col("e") % 8192).cast("long")).alias("bitmap"))
        .collect()
    )
    for r in parts:
        own = np.unpackbits(np.frombuffer(bytes(r["bitmap"]), np.uint8), bitorder="little")[:8192]
        bits[r["block"] * 8192 : (r["block"] + 1) * 8192] = own.astype(bool)
    return np.packbits(bits).tobytes()


_NAMES = np.array([f"{k:0{_HEX}x}" for k in range(1 << 4 * _HEX)])  # all hash values as text
_EMPTY = "-" * _HEX


def _powers(n: int) -> np.ndarray:
    """1, b, b**2, ... modulo 2**64 for an odd b."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate(([1], np.full(max(0, n - 1), 0x9E3779B97F4A7C15, np.uint64))).astype(np.uint64))


def _sequence_hashes(terms: np.ndarray, keep: np.ndarray, starts: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Text of a hash of each run's kept terms in their order; a run starts at each of ``starts`` and has a term."""
    before = np.cumsum(keep) - keep
    place = before - np.repeat(before[starts], np.diff(np.append(starts, len(terms))))
    with np.errstate(over="ignore"):
        values = np.where(keep, mix(terms, 99) * powers[np.where(keep, place, 0)], np.uint64(0))
        sums = mix(np.add.reduceat(values, starts), 98) >> np.uint64(64 - 4 * _HEX)
    return np.where(np.add.reduceat(keep.astype(np.int64), starts) > 0, _NAMES[sums.astype(np.int64)], _EMPTY)


def signatures(terms: np.ndarray, lengths: np.ndarray) -> list[str]:
    """Of each run of sorted distinct terms: hashes of all, then of each family's levels.

    A hash without terms is dashes.  ``lengths`` are those of the runs, zero allowed.
    """
    slots = np.full((len(lengths), 1 + FAMILIES * LEVELS), _EMPTY)
    full = np.flatnonzero(lengths)
    if len(full):
        starts = np.cumsum(lengths[full]) - lengths[full]
        powers = _powers(int(lengths.max()))
        slots[full, 0] = _sequence_hashes(terms, np.ones(len(terms), bool), starts, powers)
        for family in range(FAMILIES):
            scrambled = mix(terms, family + 1)
            own, runs, first = terms, full, starts
            for level in range(1, LEVELS + 1):
                # the next level holds a quarter of this one, so the work falls off quickly
                keep = scrambled < np.uint64(1 << (64 - 2 * level))
                if not keep.any():
                    break
                slots[runs, 1 + family * LEVELS + level - 1] = _sequence_hashes(own, keep, first, powers)
                counts = np.add.reduceat(keep.astype(np.int64), first)
                own, scrambled, runs = own[keep], scrambled[keep], runs[counts > 0]
                counts = counts[counts > 0]
                first = np.cumsum(counts) - counts
    return np.ascontiguousarray(slots).view(f"<U{slots.shape[1] * _HEX}")[:, 0].tolist()


def likeness(a: str, b: str) -> float:
    """Best share of equal hashes over the levels at which at least a quarter of the families have terms in both.

    Two texts without any term are alike (1.0); one without and one with are
    not (0.0).
    """
    if a == b:
        return 1.0
    best = 0.0
    for level in range(1, LEVELS + 1):
        both = either = equal = 0
        for at in range(_HEX * level, _HEX * (1 + FAMILIES * LEVELS), _HEX * LEVELS):
            x, y = a[at : at + _HEX], b[at : at + _HEX]
            has_x, has_y = x != _EMPTY, y != _EMPTY
            both += has_x and has_y
            either += has_x or has_y
            equal += has_x and x == y
        if LEAST_FAMILIES * both < FAMILIES:
            break
        best = max(best, equal / either)
    return best


class Fingerprinter:
    """Fingerprints texts by a lexicon mask; texts with few terms in the band use all their terms."""

    def __init__(self, mask: bytes):
        self._mask = np.unpackbits(np.frombuffer(mask, np.uint8)).astype(bool)

    def of(self, texts: list[str | None]) -> list[str]:
        found = factorize(pa.array(texts, pa.string()))
        n, doc = len(texts), np.repeat(np.arange(len(texts)), np.diff(found.offsets))
        hashes = found.hashes()
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # (text, rank of the term's hash), sorted and once each
        width = max(1, len(order))
        pairs = np.unique(doc * width + rank[found.codes])
        doc, terms = pairs // width, hashes[order][pairs % width]
        inside = self._mask[(terms >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)]
        few = np.bincount(doc, inside, minlength=n) < LEAST_TERMS
        used = inside | few[doc]
        return signatures(terms[used], np.bincount(doc[used], minlength=n))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprints(docs: DataFrame, mask: bytes, blocks: int | None = None) -> DataFrame:
    """One row for each document with its fingerprint, that of its edited text, and both likenesses.

    The next document is the one with the next doc_id (the first after the
    last); rows with a null doc_id come first, and rows that share a doc_id
    stand in the order of their texts.  A null text is empty.  A table of one
    row is its own next document.

    Documents are dealt out in blocks of neighbouring ids, and the first of
    each block also goes to the block before it, so a text is shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks or 8 * n_parts
    shares = [k / blocks for k in range(1, blocks)]
    edges = sorted({int(x) for x in rows.approxQuantile("doc_id", shares, 0.2 / blocks)}) if shares else []
    # block of a row: number of edges at or below its id; nulls stand in block -1
    numbered = rows.withColumn("block", _block_of(edges))
    firsts = (
        numbered.groupBy("block")
        .agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("h"))).alias("first"))
        .orderBy("block")
        .collect()
    )  # a few numbers for each block of documents
    order = [r["block"] for r in firsts]
    moved = [(r["block"], r["first"]["doc_id"], order[k - 1]) for k, r in enumerate(firsts)]
    if not moved:
        return spark.createDataFrame([], SCHEMA)
    table = spark.createDataFrame(moved, "block int, first long, before int")
    if not fits_broadcast(table, len(moved)):
        raise ValueError("fewer blocks are needed")
    targets = numbered.join(F.broadcast(table), "block")
    leads = F.col("doc_id").eqNullSafe(F.col("first"))
    dealt = targets.select(
        "doc_id",
        "text",
        F.explode(
            F.when(
                leads,
                F.array(
                    F.struct(F.col("block").alias("block"), F.lit(False).alias("tail")),
                    F.struct(F.col("before").alias("block"), F.lit(True).alias("tail")),
                ),
            ).otherwise(F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("tail"))))
        ).alias("to"),
    ).select("to.block", "to.tail", "doc_id", "text")
    laid = dealt.repartition(n_parts, "block").sortWithinPartitions("block", "tail", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(mask)
        held: tuple | None = None  # block, doc_id, text, fingerprint: waits for its next document
        closed = None  # block whose tail has been used
        for part in slices((b.select(["block", "text", "doc_id", "tail"]) for b in batches), 2_000, 2 << 20):
            block, text, doc, tail = (part.column(k).to_pylist() for k in range(4))
            prints = maker.of(text)
            ready: list[tuple] = []
            for b, t, d, last, p in zip(block, text, doc, tail, prints):
                if b != closed and held is not None and held[0] == b:
                    ready.append((held[1], held[2], held[3], t, p))
                if last:
                    held, closed = None, b
                elif b != closed:
                    held = (b, d, t, p)
            if ready:
                changed = [edited(t, following) for _, t, _, following, _ in ready]
                theirs = maker.of(changed)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in ready], pa.int64()),
                        pa.array([len(r[1]) for r in ready], pa.int64()),
                        pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
                        pa.array([r[2] for r in ready], pa.string()),
                        pa.array(theirs, pa.string()),
                        pa.array([likeness(r[2], e) for r, e in zip(ready, theirs)], pa.float64()),
                        pa.array([likeness(r[2], r[4]) for r in ready], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return laid.mapInArrow(run, SCHEMA)


def _block_of(edges: list[int]):
    """Column with the number of ``edges`` at or below doc_id; -1 for a null."""
    known = np.array(edges, np.int64)

    @F.pandas_udf("int")
    def block(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(known, ids.to_numpy(), "right").astype("int32"))

    return F.when(F.col("doc_id").isNull(), -1).otherwise(block(F.coalesce("doc_id", F.lit(0))))
