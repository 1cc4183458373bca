"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features, one shallow tree on one feature's bins at a
time, so each feature ends up with a lookup table over its bins; the pairs of
features that explain most of what is left get tables of their own the same
way.  A score is the sum of the looked-up values, so tasks score whole batches
with a few array additions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from contactweave.llm.common import crc_bucket, factorize, slices
from contactweave.plans.lookups import fits_broadcast

LABELLED = 20_000  # most labelled rows the model is fitted on
THRESHOLD = 0.7
SLICE_BYTES = 2 << 20  # of text whose words a task holds at once
BINS, PAIR_BINS, PAIRS = 32, 16, 8
ROUNDS, PAIR_ROUNDS, RATE = 200, 80, 0.15
FEATURES = (
    "words", "mean_word", "variety", "commonest", "same_as_last", "same_pair", "capitals", "digits", "symbols",
    "bars", "shouts", "stops", "commas", "lines", "repeated_lines", "line_words", "non_ascii",
)
_CLASSES = {"capitals": range(65, 91), "digits": range(48, 58), "symbols": b"#*$%&<>", "bars": b"|", "shouts": b"!?", "stops": b".", "commas": b",", "lines": b"\n"}


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; a null or empty text has zeros."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    put = lambda name, x: out.__setitem__((slice(None), FEATURES.index(name)), x)
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    data = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    size = np.maximum(ends - starts, 1)

    filled = starts < ends

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(n, np.int64)
        if filled.any():
            total[filled] = np.add.reduceat(mask, starts[filled], dtype=np.int64)
        return total

    found = factorize(texts)
    counts = np.diff(found.offsets)
    words = np.maximum(counts, 1)
    for name, members in _CLASSES.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        put(name, share(table[data]) / (words if name in ("symbols", "bars", "shouts", "stops", "commas", "lines") else size))
    put("non_ascii", share(data > 127) / size)
    put("words", counts)
    put("mean_word", size / words)
    codes, offsets = found.codes, found.offsets
    doc = np.repeat(np.arange(n), counts)
    if len(codes):
        same = np.zeros(len(codes), bool)
        same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
        put("same_as_last", np.bincount(doc, same, minlength=n) / words)
        pairs = np.zeros(len(codes), np.int64)
        pairs[1:] = codes[:-1].astype(np.int64) * len(found.distinct) + codes[1:]
        variety, commonest, repeats = np.zeros(n), np.zeros(n), np.zeros(n)
        for k in range(n):
            a, b = offsets[k], offsets[k + 1]
            if a == b:
                continue
            uses = np.bincount(np.unique(codes[a:b], return_inverse=True)[1])
            variety[k], commonest[k] = len(uses), uses.max()
            repeats[k] = max(0, b - a - 1) - len(np.unique(pairs[a + 1 : b]))
        put("variety", variety / np.sqrt(words))
        put("commonest", commonest / words)
        put("same_pair", repeats / words)
    lines = pc.split_pattern(texts, "\n")
    encoded = lines.values.dictionary_encode()
    line, at = encoded.indices.to_numpy(), lines.offsets.to_numpy()
    repeated = np.array([len(line[a:b]) - len(np.unique(line[a:b])) for a, b in zip(at[:-1], at[1:])])
    put("repeated_lines", repeated / np.maximum(np.diff(at), 1))
    put("line_words", words / np.maximum(np.diff(at), 1))
    return out


@dataclass
class Model:
    """edges by feature, a table by feature, and by pair of features a table over coarse bins."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            logit += table[np.searchsorted(edges, x[:, j], "left")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            logit += table[np.searchsorted(self.coarse[a], x[:, a], "left"), np.searchsorted(self.coarse[b], x[:, b], "left")]
        return 1 / (1 + np.exp(-logit))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values near the quantiles."""
    u = np.unique(v)
    if len(u) > bins:
        u = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1), method="nearest"))
    return (u[1:] + u[:-1]) / 2


def _step(g: np.ndarray, h: np.ndarray, leaves: int, penalty: float = 1.0) -> np.ndarray:
    """Values of a shallow tree on ordered bins with gradient and curvature sums: greedy best cuts."""
    cuts = [0, len(g)]
    cg, ch = (np.concatenate(([0.0], np.cumsum(x))) for x in (g, h))
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + penalty)
    while len(cuts) <= leaves:
        best = (1e-12, None)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gain = worth(a, m) + worth(m, b) - worth(a, b)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(m[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + penalty)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, penalty: float = 1.0) -> tuple[float, np.ndarray]:
    """Gain and values of the best two-level tree on a grid: one cut on each axis."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best = (-1.0, np.zeros_like(g))
    whole = cg[-1, -1] ** 2 / (ch[-1, -1] + penalty)
    for i, j in itertools.product(range(1, g.shape[0]), range(1, g.shape[1])):
        value, gain = np.zeros_like(g), -whole
        for a, b in ((0, i), (i, g.shape[0])):
            for c, d in ((0, j), (j, g.shape[1])):
                sg = cg[b, d] - cg[a, d] - cg[b, c] + cg[a, c]
                sh = ch[b, d] - ch[a, d] - ch[b, c] + ch[a, c] + penalty
                value[a:b, c:d] = sg / sh
                gain += sg**2 / sh
        if gain > best[0]:
            best = (gain, value)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting with a fifth of the rows held back; the round that does best on those ends it.

    Rows must come in an order that says nothing about the label.  With one
    class only, or no rows, scores are constant.
    """
    n, width = x.shape if x.size else (0, len(FEATURES))
    share = (y.sum() + 1) / (n + 1) if n else 1.0
    share = min(max(share, 1e-3), 1 - 1e-3)
    edges = [_edges(x[:, j], BINS) if n else np.zeros(0) for j in range(width)]
    coarse = [_edges(x[:, j], PAIR_BINS) if n else np.zeros(0) for j in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(float(np.log(share / (1 - share))), edges, tables, [], coarse, [])
    if not n or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]
    small = [np.searchsorted(e, x[:, j], "left") for j, e in enumerate(coarse)]
    back = np.arange(n) % 5 == 4
    own = ~back
    logit = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return np.where(own, y - p, 0.0), np.where(own, p * (1 - p), 0.0)

    def loss() -> float:
        rows = back if back.any() else own
        p = np.clip(1 / (1 + np.exp(-logit[rows])), 1e-9, 1 - 1e-9)
        return float(-(y[rows] * np.log(p) + (1 - y[rows]) * np.log(1 - p)).mean())

    best, kept, waited = loss(), [t.copy() for t in tables], 0
    for _ in range(ROUNDS):
        for j, table in enumerate(tables):
            if len(table) < 2:
                continue
            g, h = slopes()
            step = RATE * _step(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)), leaves=3)
            table += step
            logit += step[at[j]]
        now = loss()
        if now < best - 1e-6:
            best, kept, waited = now, [t.copy() for t in tables], 0
        else:
            waited += 1
            if waited == 10:
                break
    model.tables = kept
    logit = model.intercept + sum(t[a] for t, a in zip(kept, at))
    g, h = slopes()
    ranked = []
    for a, b in itertools.combinations(range(width), 2):
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        if min(shape) > 1:
            cell = small[a] * shape[1] + small[b]
            sums = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))
            ranked.append((_quadrants(*sums)[0], a, b))
    model.pairs = [(a, b) for _, a, b in sorted(ranked, reverse=True)[:PAIRS]]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    best, kept, waited = loss(), [t.copy() for t in pair_tables], 0
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, pair_tables):
            g, h = slopes()
            cell = small[a] * table.shape[1] + small[b]
            sums = (np.bincount(cell, v, table.size).reshape(table.shape) for v in (g, h))
            step = RATE * _quadrants(*sums)[1]
            table += step
            logit += step[small[a], small[b]]
        now = loss()
        if now < best - 1e-6:
            best, kept, waited = now, [t.copy() for t in pair_tables], 0
        else:
            waited += 1
            if waited == 5:
                break
    model.pair_tables = kept
    return model


def learn(docs: DataFrame, labels: DataFrame, held_out_remainder: int = 2, modulus: int = 4, limit: int = LABELLED) -> Model:
    """A model of ``quality`` from at most ``limit`` labelled documents, chosen by a hash of doc_id.

    Documents whose crc32(doc_id as text) modulo ``modulus`` is
    ``held_out_remainder`` are never learned from.  Labels without doc_id or
    quality are left out; of several for one doc_id the lowest counts.
    """
    chosen = (
        labels.filter("doc_id is not null and quality is not null")
        .filter(crc_bucket(F.col("doc_id"), modulus) != held_out_remainder)
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg((F.min("quality") > 0).cast("int").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(limit)
    )
    side = F.broadcast(chosen) if fits_broadcast(chosen, limit) else chosen
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = own.join(side, F.col("doc_id") == F.col("label_id")).select("label_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2_000, SLICE_BYTES):
            x = features(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["label_id", "label", "x"]
            )

    rows = (
        texts.mapInArrow(run, "label_id long, label int, x array<double>")
        .orderBy(F.xxhash64("label_id"), "label_id", "x")
        .limit(limit)
        .collect()
    )
    if not rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, model: Model, held_out_remainder: int = 2, modulus: int = 4, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; a null or empty text is scored by zeros in all features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2_000, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(features(part.column(1))))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        (crc_bucket(F.col("doc_id"), modulus) == held_out_remainder).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns as they were."""

    @F.arrow_udf("boolean")
    def good(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = pa.RecordBatch.from_arrays([batch, batch], ["text", "_text"])
            found = [model.score(features(part.column(1))) >= threshold for part in slices(iter([rows]), 2_000, SLICE_BYTES)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0, bool))

    return docs.filter(good(F.col("text").cast("string")))
