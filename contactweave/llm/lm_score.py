"""Language-model scores from a sharded Elias-Fano bigram trie.

The model is a bigram model with Dirichlet smoothing towards the unigram
model: P(w | v) = (c(v w) + mu * P(w)) / (c(v) + mu), P(w) = (c(w) + 1) / (N + V + 1).
The logarithm splits into a part that needs w's counts and one that needs the
context's, so the trie is dealt out by word: a shard answers for its words
alone, and a document's score is the sum of what the shards say.

Every part of the input sends each shard what it counted and what it asks.
The shard adds up the counts, lays them out as a trie, looks its questions up
and returns sums by document.  No table of the vocabulary is ever sent to all
tasks.  Words with over one in ``HOT`` of all tokens (so at most ``HOT`` words)
are the exception: their counts are known to all, and their pairs are dealt
out by word and context, so no shard gets a common word whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from contactweave.llm.common import crc_bucket, factorize, mix, shards_for, slices
from contactweave.llm.elias_fano import Trie
from contactweave.plans.storage import materialize

END, START = np.uint64(0), np.uint64(1)
MU = 200.0
HOT = 1000
TEXT_BYTES_A_SHARD = 8 << 20


def _rows(docs: DataFrame, train) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), train.alias("train"))


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed tokens of all texts in a row, each text's words and then its end; their contexts; their text's number."""
    found = factorize(part.column(1), lower=True)
    hashes = found.hashes()
    hashes = np.where(hashes < 2, hashes + np.uint64(2), hashes)  # 0 and 1 are taken
    lengths = np.diff(found.offsets) + 1
    ends = np.cumsum(lengths) - 1
    token = np.empty(int(lengths.sum()), np.uint64)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner] = hashes[found.codes]
    token[ends] = END
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[ends - lengths + 1] = START
    return token, context, np.repeat(np.arange(part.num_rows), lengths)


def vocabulary(rows: DataFrame) -> DataFrame:
    """(token, n): how often each hashed token occurs in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            token, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            return token, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def emit() -> pa.RecordBatch:
            token, n = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

        for part in slices(batches, 10_000):
            token, _, doc = _tokens(part)
            train = np.array(part.column(2).to_pylist(), bool)
            token = token[train[doc]]
            held.append(np.unique(token, return_counts=True))
            if sum(len(t) for t, _ in held) > 2_000_000:
                held[:] = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield emit()
        if held:
            yield emit()

    return rows.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


_ASKED = [
    ("shard", pa.int32()),
    ("chunk", pa.int64()),
    ("docs", pa.list_(pa.int64())),
    *[(n, pa.binary()) for n in ("words", "runs", "contexts", "context_at", "trained", "uses", "use_doc")],
]
_ANSWERED = [("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), *[(n, pa.binary()) for n in ("doc", "tokens", "known", "base", "score")]]


def _ddl(fields) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.float64(): "double"}
    return ", ".join(f"{n} {names[t]}" for n, t in fields)


def _questions(rows: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    """For each shard and chunk of texts: its distinct pairs, their training counts, and which texts use them.

    A chunk's list of documents goes along on its own, numbered past the shards.
    """
    schema = pa.schema(_ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for part in slices(batches, 10_000):
            token, context, doc = _tokens(part)
            train = np.array(part.column(2).to_pylist(), bool)
            shard = (mix(token, 9) % np.uint64(shards)).astype(np.int32)
            common = np.isin(token, hot)
            shard[common] = (mix(token[common] ^ mix(context[common], 5), 9) % np.uint64(shards)).astype(np.int32)
            order = np.lexsort((context, token, shard))
            token, context, shard, doc = token[order], context[order], shard[order], doc[order].astype(np.uint16)
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (context[1:] != context[:-1]) | (shard[1:] != shard[:-1])
            first = np.flatnonzero(fresh)
            uses = np.diff(np.append(first, len(token))).astype(np.uint32)
            trained = np.add.reduceat(train[doc].astype(np.uint32), first).astype(np.uint32) if len(first) else uses
            token, context, pair_shard = token[first], context[first], shard[first]
            cuts = np.searchsorted(pair_shard, np.arange(shards + 1))
            out: list[list] = [[shards + chunk % shards], [chunk], [part.column(0).to_pylist()], *[[None] for _ in _ASKED[3:]]]
            for s in range(shards):
                a, b = cuts[s], cuts[s + 1]
                if a == b:
                    continue
                at, stop = first[a], first[b] if b < len(first) else len(doc)
                words, runs = np.unique(token[a:b], return_counts=True)
                contexts, context_at = np.unique(context[a:b], return_inverse=True)
                cells = (words, runs.astype(np.uint32), contexts, context_at.astype(np.uint32), trained[a:b], uses[a:b], doc[at:stop])
                for column, cell in zip(out, (s, chunk, None, *[c.tobytes() for c in cells])):
                    column.append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, _ASKED)], schema=schema)
            chunk += 1

    return rows.mapInArrow(run, _ddl(_ASKED))


def _read(column: pa.ChunkedArray, k: int, kind: type) -> np.ndarray:
    return np.frombuffer(column[k].as_buffer(), kind)


def _answers(table: pa.Table, shards: int, hot: dict[int, int], kappa: float, mu: float, start: float) -> pa.Table:
    """One shard's sums for each chunk that asked it."""
    schema = pa.schema(_ANSWERED)
    if table.column("shard")[0].as_py() >= shards:  # documents of chunks, passed on
        empty = [pa.nulls(table.num_rows, pa.binary())] * 5
        return pa.Table.from_arrays([table.column("chunk"), table.column("docs"), *empty], schema=schema)
    columns = {n: table.column(n) for n, _ in _ASKED[3:]}

    def pairs(k: int) -> tuple[np.ndarray, np.ndarray]:
        word = np.repeat(_read(columns["words"], k, np.uint64), _read(columns["runs"], k, np.uint32))
        return word, _read(columns["contexts"], k, np.uint64)[_read(columns["context_at"], k, np.uint32)]

    # only pairs seen in training go into the trie
    kept = []
    for k in range(table.num_rows):
        trained = _read(columns["trained"], k, np.uint32)
        seen = trained > 0
        kept.append([x[seen] for x in (*pairs(k), trained)])
    word, context, trained = (np.concatenate(x) for x in zip(*kept))
    del kept
    trie = Trie.from_buffer(build_shard(word, context, trained, hot, kappa).to_bytes())
    del word, context, trained
    out: list[list] = [[] for _ in _ANSWERED]
    for k in range(table.num_rows):
        word, context = pairs(k)
        times, use_doc = _read(columns["uses"], k, np.uint32), _read(columns["use_doc"], k, np.uint16)
        count, found, value = trie.lookup(word, context)
        for token, total in hot.items():
            count[word == np.uint64(token)] = total
        score = np.where(found, value, np.log10(kappa * (count + 1)))
        # each word is the context of the next token; with each end goes the start of its text
        score -= np.where(word == END, start, np.log10(count + mu))
        docs, local = np.unique(use_doc, return_inverse=True)
        add = lambda x: np.bincount(local, np.repeat(x, times), minlength=len(docs))
        sums = (
            docs, np.bincount(local, minlength=len(docs)).astype(np.uint32), add(count > 0).astype(np.uint32),
            add(np.log10(count + 1)), add(score).astype(np.float32),
        )
        for column, cell in zip(out, (table.column("chunk")[k].as_py(), None, *[x.tobytes() for x in sums])):
            column.append(cell)
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, _ANSWERED)], schema=schema)


_SUMMED = [("doc_id", pa.int64()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]


def _chunk_sums(table: pa.Table) -> pa.Table:
    """Sums over all shards for the documents of one chunk."""
    names = next(x.values for x in table.column("docs") if x.is_valid)
    totals = [np.zeros(len(names)) for _ in range(4)]
    for k in range(table.num_rows):
        if table.column("doc")[k].is_valid:
            docs = _read(table.column("doc"), k, np.uint16)
            for total, name, kind in zip(totals, ("tokens", "known", "base", "score"), (np.uint32, np.uint32, np.float64, np.float32)):
                total[docs] += _read(table.column(name), k, kind)
    return pa.Table.from_arrays([names, *[pa.array(x).cast(t) for x, (_, t) in zip(totals, _SUMMED[1:])]], schema=pa.schema(_SUMMED))


def build_shard(token: np.ndarray, context: np.ndarray, trained: np.ndarray, hot: dict[int, int], kappa: float) -> Trie:
    """The trie of one shard from counted pairs, which may repeat; ``kappa`` is mu / (N + V + 1)."""
    order = np.lexsort((context, token))
    token, context, trained = token[order], context[order], trained[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (context[1:] != context[:-1])
    first = np.flatnonzero(fresh)
    token, context = token[first], context[first]
    pair = np.add.reduceat(trained.astype(np.int64), first) if len(first) else trained
    words, rank = np.unique(token, return_inverse=True)
    counts = np.bincount(rank, pair, minlength=len(words)).astype(np.int64)
    for k in np.flatnonzero(np.isin(words, np.array(list(hot), np.uint64))):
        counts[k] = hot[int(words[k])]
    value = np.log10(pair + kappa * (counts[rank] + 1))
    return Trie.build(token, context, value, words, counts)


def scores(docs: DataFrame, held_out_remainder: int = 2, modulus: int = 7, mu: float = MU) -> DataFrame:
    """One row for each document: counts, the unigram base score and the model's log10 probability.

    Learns from documents whose crc32(doc_id as text) modulo ``modulus`` is not
    ``held_out_remainder``.  A null or empty text is the end token alone.  Rows
    that repeat a doc_id are scored together, as if their texts' tokens were
    summed; rows without doc_id likewise.  With no training text, N and V are 0.
    """
    spark = docs.sparkSession
    rows = _rows(docs, crc_bucket(F.col("doc_id"), modulus) != held_out_remainder)
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.col("train").cast("long")).alias("n")).first()
    n_train = size["n"] or 0
    counted = vocabulary(rows)
    totals = F.struct(F.sum("n").alias("n"), F.count("*").alias("v"))
    counted = materialize(counted, "vocabulary")
    got = counted.agg(totals.alias("t")).first()["t"]
    n, v = got["n"] or 0, got["v"]
    frequent = counted.filter(F.col("n") * HOT >= n).collect() if n else []  # at most HOT rows
    hot = {r["token"] & (2**64 - 1): r["n"] for r in frequent}
    shards = shards_for(size["bytes"] or 0, TEXT_BYTES_A_SHARD, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kappa, log_all, start = mu / (n + v + 1), float(np.log10(n + v + 1)), float(np.log10(n_train + mu))
    asked = _questions(rows, shards, np.array(sorted(hot), np.uint64))
    answers = asked.groupBy("shard").applyInArrow(lambda t: _answers(t, shards, hot, kappa, mu, start), _ddl(_ANSWERED))
    sums = answers.groupBy("chunk").applyInArrow(_chunk_sums, _ddl(_SUMMED))
    return (
        sums.groupBy("doc_id")
        .agg(*[F.sum(c).alias(c) for c in ("tokens", "known", "base", "score")])
        .select(
            "doc_id",
            (crc_bucket(F.col("doc_id"), modulus) == held_out_remainder).alias("held_out"),
            F.col("tokens").alias("n_tokens"),
            F.col("known").alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") - F.col("tokens") * F.lit(log_all)).alias("base_score"),
            "score",
        )
    )
