"""SentencePiece encoding and decoding with the original offsets of every piece.

The model file's own tables drive everything: its compiled character map
normalises the text by longest prefix while it records which bytes each piece
of output came from, its scores order the merges, and its byte pieces stand
for characters without a piece.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from contactweave.llm.common import slices

SPACE = "▁"
_CACHE = 900_000
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes and a pool of replacements."""

    def __init__(self, blob: bytes):
        self._units: tuple[int, ...] = ()
        self._pool = b""
        if blob:
            n = struct.unpack_from("<I", blob)[0]
            self._units = struct.unpack_from(f"<{n // 4}I", blob, 4)
            self._pool = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of ``data[at:]`` in the map, and what replaces it."""
        units, best = self._units, None
        if not units:
            return None
        node = self._step(0, units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node = self._step(node, unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                best = k + 1 - at, self._pool[start : self._pool.index(0, start)]
        return best

    @staticmethod
    def _step(node: int, unit: int) -> int:
        return node ^ (unit >> 10) << ((unit & 1 << 9) >> 6)


class PieceModel:
    """Encodes as the library does for a BPE model whose pieces have the space mark only in front."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not spec.escape_whitespaces:
            raise ValueError("only BPE models with escaped white space are read")
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy_prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        kinds = pb.ModelProto.SentencePiece
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.control = {i for i, k in enumerate(self.kinds) if k in (kinds.CONTROL, kinds.UNKNOWN)}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces) or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces of this model need context that words do not hold")
        self.byte_ids = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == kinds.UNKNOWN)
        self.begin, self.end = self.pieces.index("<s>"), self.pieces.index("</s>")
        self._words: dict[str, tuple[bytes, bytes]] = {}
        # what decoding puts for an id; None for bytes that need their neighbours
        self._shown = [
            None if k == kinds.BYTE and self.bytes_of[i] > 0x7F or k == kinds.UNKNOWN
            else chr(self.bytes_of[i]) if k == kinds.BYTE
            else "" if k == kinds.CONTROL
            else p.replace(SPACE, " ")
            for i, (p, k) in enumerate(zip(self.pieces, self.kinds))
        ]

    def normalize(self, text: str) -> tuple[str, list[int] | None]:
        """Normalised text, and for each of its characters the byte of ``text`` it came from (and one for the end).

        Without a map and without squeezing, characters stand for themselves:
        the alignment is then the identity and None is given for it.
        """
        if not text:
            return "", []
        if not self.map._units and not self.squeeze:
            return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE), None
        data = text.encode()
        out: list[str] = []
        source: list[int] = []
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:
                n = 1
                while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                    n += 1
                piece = data[at : at + n].decode()
            else:
                n, piece = hit[0], hit[1].decode()
            for c in piece:
                out.append(c)
                source.append(at)
            at += n
        end = len(data)
        if self.squeeze:
            kept = [k for k, c in enumerate(out) if c != " " or k and out[k - 1] != " "]
            while kept and out[kept[0]] == " ":
                kept.pop(0)
            while kept and out[kept[-1]] == " ":
                end = source[kept.pop()]  # what is left out belongs to no piece
            out, source = [out[k] for k in kept], [source[k] for k in kept]
        if out and self.dummy_prefix:
            out.insert(0, SPACE)
            source.insert(0, source[0])
        return "".join(out).replace(" ", SPACE), [*source, end]

    def _merge(self, segment: str) -> list[str]:
        """Best-scored neighbours are joined first, the leftmost of equals."""
        scores = self.scores
        parts = list(segment)
        if len(parts) <= 64:
            get = scores.get
            ranks = [get(x + y, -math.inf) for x, y in zip(parts, parts[1:])]
            while ranks:
                best = max(ranks)
                if best == -math.inf:
                    break
                k = ranks.index(best)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                del ranks[k]
                if k:
                    ranks[k - 1] = get(parts[k - 1] + parts[k], -math.inf)
                if k < len(ranks):
                    ranks[k] = get(parts[k] + parts[k + 1], -math.inf)
            return parts
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            if 0 <= k and after[k] < len(parts):
                joined = parts[k] + parts[after[k]]
                if joined in scores:
                    heapq.heappush(queue, (-scores[joined], k, joined))

        for k in range(len(parts) - 1):
            offer(k)
        while queue:
            _, k, joined = heapq.heappop(queue)
            if not parts[k] or after[k] >= len(parts) or parts[k] + parts[after[k]] != joined:
                continue
            gone = after[k]
            parts[k], parts[gone] = joined, ""
            after[k] = after[gone]
            if after[k] < len(parts):
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [p for p in parts if p]

    def _ids_of(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown]

    def _word(self, word: str) -> tuple[bytes, bytes]:
        """Ids of a word with the space before it, and how many bytes of the text each stands for.

        The second is empty where ids share a character, which lengths cannot tell.
        """
        ids, lengths = [], []
        for p in self._merge(SPACE + word):
            ids += self._ids_of(p)
            lengths.append(len(p) if word.isascii() else len(p.encode()) - 2 * p.count(SPACE))
        shared = len(ids) != len(lengths)
        return struct.pack(f"<{len(ids)}I", *ids), b"" if shared else struct.pack(f"<{len(ids)}I", *lengths)

    def aligned(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each whole text: its ids with those for begin and end, and a row of start and end for all but these two.

        Texts with single spaces are cut at them in compiled code and each
        distinct word is merged and aligned once; pieces follow each other, so
        their lengths add up to their places.  Other texts, and those with a
        character of several byte pieces, are normalised and aligned one by one.
        """
        if len(self._words) > _CACHE:
            self._words.clear()
        split = pc.split_pattern(texts, " ")
        encoded = split.values.dictionary_encode()
        codes, offsets = encoded.indices.to_numpy(), split.offsets.to_numpy()
        direct = self.dummy_prefix and not self.squeeze and not self.map._units
        each, words = [], self._words
        distinct = encoded.dictionary.to_pylist()
        for w in distinct:
            got = words.get(w)
            if got is None:
                got = words[w] = self._word(w) if SPACE not in w else (b"", b"")
            each.append(got)
        lengths = np.array([len(x) // 4 for x, _ in each], np.int64)
        starts = np.cumsum(lengths) - lengths
        ids = np.frombuffer(b"".join(x for x, _ in each), "<u4")
        wide = np.frombuffer(b"".join(y or x for x, y in each), "<u4")
        shared = np.array([len(x) != len(y) for x, y in each], bool)
        ends = [np.array([i], "<u4") for i in (self.begin, self.end)]
        for k, text in enumerate(texts.to_pylist()):
            own = codes[offsets[k] : offsets[k + 1]]
            if direct and text and text[0] != " " and "  " not in text and SPACE not in text and not shared[own].any():
                n = lengths[own]
                stop = np.cumsum(n)
                take = np.repeat(starts[own] - stop + n, n) + np.arange(stop[-1])
                inner = ids[take]
                found = np.empty((len(take), 2), "<i8")
                # the first word has no space of its own in the text
                found[:, 1] = np.cumsum(wide[take], dtype=np.int64) - 1
                found[0, 0], found[1:, 0] = 0, found[:-1, 1]
            else:
                rows = self.spans(text)
                inner = np.array([r[0] for r in rows], "<u4")
                found = np.array([r[2:] for r in rows], "<i8").reshape(-1, 2)
            yield np.concatenate((ends[0], inner, ends[1])), found

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each whole text with those for begin and end."""
        for ids, _ in self.aligned(texts):
            yield ids

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all(pa.array([text], pa.string()))).tolist()

    def spans(self, text: str) -> list[tuple[int, str, int, int]]:
        """(id, piece, start, end) of every piece: the bytes of ``text`` it stands for, end exclusive.

        The bytes of one character share its span; an added prefix has none of its own.
        """
        normal, source = self.normalize(text)
        if source is None:
            source, at = [], 0
            for c in text:
                source.append(at)
                at += len(c.encode())
            source = [0] * self.dummy_prefix + source + [at]
        out, at = [], 0
        for segment in _SEGMENT.findall(normal):
            for p in self._merge(segment):
                start, stop = source[at], source[at + len(p)]
                out += [(i, self.pieces[i], start, stop) for i in self._ids_of(p)]
                at += len(p)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces are joined and read as UTF-8, wrong bytes give U+FFFD each."""
        shown = list(map(self._shown.__getitem__, ids))
        if None not in shown:
            text = "".join(shown)
            inner = next((i for i in ids if i not in self.control), None)
            return text[1:] if self.dummy_prefix and inner is not None and self.pieces[inner].startswith(SPACE) else text
        out: list[str] = []
        held = bytearray()
        pieces, bytes_of, first = self.pieces, self.bytes_of, self.dummy_prefix

        def flush() -> None:
            at = 0
            while at < len(held):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(held[at : at + n]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                at += n
            held.clear()

        for i in ids:
            if i in bytes_of:
                held.append(bytes_of[i])
                first = False
                continue
            if held:
                flush()
            if i == self.unknown:
                out.append(" ⁇ ")
                first = False
            elif i not in self.control:
                piece = pieces[i]
                out.append(piece[1:] if first and piece.startswith(SPACE) else piece)
                first = False
        if held:
            flush()
        return "".join(out).replace(SPACE, " ")


_MODELS: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def piece_spans(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and pieces: id, piece, start and end in bytes of the original text.  A null text has no piece."""
    kind = pa.list_(pa.struct([("id", pa.int32()), ("piece", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _model(model)
        for part in slices(batches, 500, 1 << 20):
            rows = [[dict(zip(("id", "piece", "start", "end"), s)) for s in coder.spans(t)] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["doc_id", "pieces"])

    return _rows(docs).mapInArrow(run, "doc_id long, pieces array<struct<id: int, piece: string, start: long, end: long>>")


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """Number and digest of every text's ids, digest of the text decoded from them, and of the ids' spans.

    spans_sha256 is of start and end of each piece in bytes of the original
    text, as little-endian 64-bit numbers.  A null or empty text has the begin
    and end ids alone and decodes to the empty string.  Every row gives one
    row, whatever its doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _model(model)
        for part in slices(batches, 2_000):
            counts, sums, texts, places = [], [], [], []
            for ids, spans in coder.aligned(part.column(1)):
                counts.append(len(ids))
                sums.append(hashlib.sha256(ids.tobytes()).hexdigest())
                texts.append(hashlib.sha256(coder.decode(ids.tolist()).encode()).hexdigest())
                places.append(hashlib.sha256(spans).hexdigest())
            digests = [pa.array(x, pa.string()) for x in (sums, texts, places)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), *digests],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return _rows(docs).mapInArrow(run, kind)
