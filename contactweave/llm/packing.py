"""Best-fit packing of tokenised documents by bin completion.

Documents become pieces of at most ``capacity`` tokens.  How full sequences
are filled depends on the piece lengths alone, so the search works on the
count of every length (at most ``capacity`` numbers, whatever the input) and
its result is a list of runs: a filling and how often it is used.  Pieces are
then numbered within their length by Spark and find their place in a run.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from contactweave.llm.common import give_back, slices, split_words
from contactweave.plans.storage import materialize

CAPACITY = 2048
END_ID = 0
_CACHE_BYTES = 20 << 20  # of a task's cache
_ENTRY_BYTES = 160  # what a dict and its objects take besides their content
_SALTS = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    return table | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in table)}


class WordIds:
    """Token ids of texts, as little-endian bytes.

    The tokenizer cuts at white space before it merges, so a text's ids are
    its words' ids in a row.  Latin-1 words, whose lower-casing and cutting
    need no context, are cut into letters, digits and signs in compiled code,
    and each distinct part of a batch goes straight to the merge model; all
    other words go through the whole tokenizer.  Parts are cached: words, with
    their signs and capitals, seldom come back in another batch.
    """

    _PLAIN = "^[\x21-\x7e\xa1-\xac\xae-\xff]+$"
    _CUT = (
        "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+"
        "|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+"
    )
    _LETTERS = _byte_letters()

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._bytes = [i.to_bytes(4, "little") for i in range(self._tokenizer.get_vocab_size())]
        self._parts: dict[str, bytes] = {"": b""}
        self._held = 0

    def _parts_ids(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts; what is cached is dropped when it grows past its limit."""
        made = [*map(self._parts.get, parts)]
        tokenize, ids, letter = self._model.tokenize, self._bytes, self._LETTERS.__getitem__
        fresh = {}
        for at in [k for k, x in enumerate(made) if x is None]:
            part = parts[at]
            letters = part if part.isascii() else "".join(map(letter, part.encode()))
            made[at] = fresh[part] = b"".join([ids[t.id] for t in tokenize(letters)])
        size = sum(map(len, fresh)) + sum(map(len, fresh.values())) + _ENTRY_BYTES * len(fresh)
        if self._held + size > _CACHE_BYTES:
            self.forget()
        if size <= _CACHE_BYTES:
            self._parts.update(fresh)
            self._held += size
        return made

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all words in a row."""
        plain = pc.and_(pc.match_substring_regex(words, self._PLAIN), pc.invert(pc.match_substring(words, "<|")))
        low = pc.utf8_lower(words.filter(plain))
        # a blank behind every part leaves an empty one at each word's end
        cut = pc.split_pattern(pc.replace_substring_regex(low, self._CUT, "\\0 "), " ")
        parts = cut.values.dictionary_encode()
        made = self._parts_ids(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes, is_plain = parts.indices.to_numpy(), plain.to_numpy(zero_copy_only=False)
        n_parts = np.ones(len(words), np.int64)
        n_parts[is_plain] = np.diff(cut.offsets.to_numpy())
        first = np.cumsum(n_parts) - n_parts
        every = np.empty(int(n_parts.sum()), np.int64)
        alone = np.zeros(len(every), bool)
        alone[first[~is_plain]] = True
        every[~alone] = codes
        every[alone] = len(made) + np.arange(int(alone.sum()))
        for word in words.filter(pc.invert(plain)).to_numpy(zero_copy_only=False):
            made.append(np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes())
        lengths = np.array([len(x) // 4 for x in made], np.int64)
        ids = np.frombuffer(b"".join(made), "<u4")
        before = np.concatenate(([0], np.cumsum(lengths[every])))
        return before[first + n_parts] - before[first], _gathered(np.cumsum(lengths) - lengths, lengths, ids, every)

    def forget(self) -> None:
        """Drop what is cached."""
        self._parts, self._held = {"": b""}, 0

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text."""
        offsets, codes, distinct = split_words(texts)
        lengths, ids = self._words(distinct)
        starts = np.cumsum(lengths) - lengths
        for a, b in zip(offsets[:-1], offsets[1:]):
            yield _gathered(starts, lengths, ids, codes[a:b]).tobytes()


def _gathered(starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The ids of the words or parts ``own`` in a row."""
    n = lengths[own]
    ends = np.cumsum(n)
    return ids[np.repeat(starts[own] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


_ENCODERS: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: its token ids and then ``end_id``, cut only where longer than ``capacity``.

    A null or empty text is one piece that holds ``end_id`` alone.  Repeated
    rows and rows without ``doc_id`` give pieces like any other.
    """
    step, end = 4 * capacity, end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for part in slices(batches, 10_000, 2 << 20):
            out = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, data in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                data += end
                for k, begin in enumerate(range(0, len(data), step)):
                    cut = data[begin : begin + step]
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(begin // 4)
                    out["length"].append(len(cut) // 4)
                    out["ids_crc32"].append(zlib.crc32(cut))
            yield pa.RecordBatch.from_pydict(
                out,
                schema=pa.schema(
                    [("doc_id", pa.int64()), ("piece", pa.int32())]
                    + [(n, pa.int64()) for n in ("start", "length", "ids_crc32")]
                ),
            )
        encoder.forget()  # the worker goes on to other tasks
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


@dataclass
class Run:
    """``times`` sequences, each filled with ``filling`` (length and number of each)."""

    filling: tuple[tuple[int, int], ...]
    times: int


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing over a histogram: the first incumbent.

    Equal lengths are placed together, so the work follows the number of
    distinct fillings and not the number of pieces.
    """
    open_bins: dict[int, Counter] = {}  # room left -> fillings
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_bins if r >= length), default=None)
            if room is None:
                fit = capacity // length
                whole, rest = divmod(left, fit)
                for n, times in ((fit, whole), (rest, 1)):
                    if n and times:
                        open_bins.setdefault(capacity - n * length, Counter())[((length, n),)] += times
                break
            filling, times = next(iter(open_bins[room].items()))
            used = min(times, left)
            open_bins[room][filling] -= used
            if not open_bins[room][filling]:
                del open_bins[room][filling]
                if not open_bins[room]:
                    del open_bins[room]
            left -= used
            grown = dict(filling)
            grown[length] = grown.get(length, 0) + 1
            open_bins.setdefault(room - length, Counter())[tuple(sorted(grown.items(), reverse=True))] += used
    return [Run(f, n) for fillings in open_bins.values() for f, n in fillings.items()]


class _Left:
    """Pieces left, by length: counts, and which lengths there are as bits of a number."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts = [0] * (capacity + 1)
        self.array = np.zeros(capacity + 1, np.int64)
        self.bits = 0
        for x, n in counts.items():
            self.add(x, n)

    def add(self, length: int, n: int) -> None:
        now = self.counts[length] + n
        self.counts[length] = self.array[length] = now
        if now == n:
            self.bits |= 1 << length
        elif not now:
            self.bits ^= 1 << length

    def largest(self, limit: int) -> int:
        """The largest length up to ``limit``, 0 if there is none."""
        return (self.bits & ((2 << limit) - 1)).bit_length() - 1 if limit > 0 and self.bits & ((2 << limit) - 1) else 0


def _least_sequences(counts: np.ndarray, capacity: int) -> int:
    """A lower bound on the sequences for ``counts`` by length (Martello and Toth's L2).

    For each k: pieces over capacity - k share no sequence with pieces of k or
    more, so those of k to capacity / 2 only fit beside the rest of the large ones.
    """
    lengths = np.arange(len(counts))
    number, total = np.cumsum(counts), np.cumsum(counts * lengths)
    half = capacity // 2
    k = np.arange(half + 1)
    alone = number[-1] - number[capacity - k]
    large, large_total = number[capacity - k] - number[half], total[capacity - k] - total[half]
    small = total[half] - np.where(k > 0, total[k - 1], 0)
    over = small - (capacity * large - large_total)
    return int((alone + large + np.maximum(0, -(-over // capacity))).max())


class _Work:
    """Steps taken while looking for fillings, and how many there may be."""

    def __init__(self, most: int):
        self.done, self.most = 0, most


def _fillings(left: _Left, room: int, most_waste: int, work: _Work) -> Iterator[tuple[int, ...]]:
    """Undominated ways to fill ``room`` that waste at most ``most_waste``: least waste first, larger pieces first.

    Made one at a time as the search asks for them, of any number of pieces.
    One piece that fits exactly dominates all other ways.  A way is dominated
    if a piece left over could stand for one or two of its pieces, or for all.
    """
    counts, bits = left.counts[: room + 1], left.bits & ((2 << room) - 1)
    if counts[room]:
        yield (room,)
        return
    lengths = np.flatnonzero(left.array[1 : room + 1]) + 1
    total = int((lengths * left.array[lengths]).sum())
    if total <= room:
        if room - total <= most_waste:
            yield tuple(int(x) for x in lengths[::-1] for _ in range(counts[x]))
        return
    dead: set[tuple[int, int]] = set()  # (limit, sum): no set of pieces up to the limit has this sum

    def sums(limit: int, target: int) -> Iterator[tuple[int, ...]]:
        """Sets of pieces up to ``limit`` with exactly this sum, larger pieces first."""
        if not target:
            yield ()
            return
        found = False
        below = bits & ((2 << min(limit, target)) - 1)
        if not below or (limit, target) in dead:
            return
        while below:
            work.done += 1
            if work.done > work.most:
                return
            x = below.bit_length() - 1
            below ^= 1 << x
            for n in range(min(counts[x], target // x), 0, -1):
                for rest in sums(x - 1, target - n * x):
                    found = True
                    yield (x,) * n + rest
        if not found:
            dead.add((limit, target))

    def between(low: int, high: int, used: Counter) -> bool:
        """Is a piece of this range left over?"""
        high = min(high, room)
        while high >= low:
            x = (bits & ((2 << high) - 1)).bit_length() - 1
            if x < low:
                return False
            if counts[x] > used[x]:
                return True
            high = x - 1
        return False

    for waste in range(min(room, most_waste) + 1):
        for pieces in sums(room - waste, room - waste):
            used = Counter(pieces)
            distinct = list(used)
            if waste and (between(1, waste, used) or any(between(x + 1, x + waste, used) for x in distinct)):
                continue
            pairs = {x + y for k, x in enumerate(distinct) for y in distinct[k if used[x] > 1 else k + 1 :]}
            if any(between(s, s + waste, used) for s in pairs):
                continue
            if len(pieces) > 1 and between(room - waste, room, used):
                continue
            yield pieces
        if work.done > work.most:
            return


def complete_bins(counts: dict[int, int], capacity: int, max_nodes: int | None = None) -> list[Run]:
    """Fewest sequences found for pieces given as ``length -> number``.

    Depth-first bin completion: take the largest piece left, try its
    undominated fillings in order of waste, and go back where the waste so far
    or the lower bound of what is left shows that the incumbent can't be
    beaten.  A filling is first used as often as the counts and the waste
    allow, in one step, and at last once, so that no packing is ruled out.
    The incumbent starts as the best-fit packing; the search ends when a lower
    bound proves it minimal, when all is searched, or after ``max_nodes``
    steps: by default 20,000 and 10 more for each length, many times the way
    down, with 20 looks at a piece for each.
    """
    counts = {x: n for x, n in counts.items() if n > 0}
    if not counts:
        return []
    incumbent = best_fit(counts, capacity)
    best = sum(r.times for r in incumbent)
    left = _Left(counts, capacity)
    total = sum(x * n for x, n in counts.items())
    bound = _least_sequences(left.array, capacity)
    limit = max_nodes if max_nodes is not None else 20_000 + 10 * len(counts)
    work = _Work(20 * limit)
    nodes = used = waste = 0
    path: list[tuple[Run, int]] = []  # with what each wastes

    def ways() -> Iterator[tuple[Counter, int, int]]:
        """The next steps: filling, times and waste."""
        slack = (best - 1) * capacity - total - waste
        if slack < 0 or used + _least_sequences(left.array, capacity) >= best:
            return
        top = left.largest(capacity)
        left.add(top, -1)
        made = _fillings(left, capacity - top, slack, work)
        several, seen = [], 0
        while True:
            # the counts are as they were here whenever the search comes back
            filling = next(made, None)
            if filling is None:
                break
            seen += 1
            need = Counter((top, *filling))
            free = capacity - top - sum(filling)
            left.add(top, 1)
            times = min(left.counts[x] // n for x, n in need.items())
            if free:
                times = min(times, slack // free)
            if times > 1:
                several.append((need, free))
            if times:
                yield need, times, free
            left.add(top, -1)
        left.add(top, 1)
        if seen > 1:  # the only way can be used as often as it goes
            for need, free in several:
                yield need, 1, free

    stack = [ways()]
    while stack and best > bound and nodes < limit and work.done <= work.most:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                run, lost = path.pop()
                for x, n in run.filling:
                    left.add(x, n * run.times)
                used -= run.times
                waste -= lost
            continue
        nodes += 1
        need, times, free = step
        for x, n in need.items():
            left.add(x, -n * times)
        path.append((Run(tuple(sorted(need.items(), reverse=True)), times), free * times))
        used += times
        waste += free * times
        if not left.bits and used < best:
            best, incumbent = used, [run for run, _ in path]
        stack.append(ways() if left.bits else iter(()))
    return incumbent


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and a gapless ``offset``.

    ``pieces`` must give the same rows each time it is read, as a stored table
    does.  Pieces of one length are interchangeable, so ties are settled by a
    hash of doc_id and piece, then doc_id and piece.  An empty table stays empty.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = complete_bins(histogram, capacity)
    # by length: (first rank, number in a sequence, offset of the first, first sequence)
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for run in plan:
        offset = 0
        for length, n in run.filling:
            places.setdefault(length, []).append((ranks[length], n, offset, sequence))
            ranks[length] += n * run.times
            offset += n * length
        sequence += run.times
    spark = pieces.sparkSession
    table = spark.createDataFrame(
        [(length, rows) for length, rows in places.items()],
        "length long, _runs array<struct<first: long, n: long, offset: long, sequence: long>>",
    )
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(_SALTS)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy("length", "_salt")
        .agg(F.count("*").alias("_n"))
        .select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = (
        salted.withColumn("_row", F.row_number().over(within) - 1)
        .join(starts, ["length", "_salt"])
        .withColumn("_rank", F.col("_row") + F.col("_before"))
        .join(F.broadcast(table), "length")  # a row for each length, at most `capacity`
    )
    run = F.element_at(F.filter("_runs", lambda r: r["first"] <= F.col("_rank")), -1)
    return (
        ranked.withColumn("_run", run)
        .withColumn("_in", F.col("_rank") - F.col("_run.first"))
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("_run.sequence") + F.floor(F.col("_in") / F.col("_run.n"))).cast("long").alias("sequence_id"),
            (F.col("_run.offset") + F.col("_in") % F.col("_run.n") * F.col("length")).cast("long").alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(tokenized_pieces(docs, tokenizer, capacity), "pieces"), capacity)
