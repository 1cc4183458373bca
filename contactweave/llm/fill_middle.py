"""Fill-in-middle over seekable compressed text.

A text is stored as independent zstandard frames with the number of code
points before each.  A cut is found by a search in those counts, so choosing
prefix, middle and suffix decompresses only the frames a cut falls in; all
others pass into the output as they are.  Digests stream the frames in order,
one in memory at a time, and the text is rebuilt from the output alone.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from contactweave.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
FRAME_CHARS = 1 << 15
LEVEL = 3
_FRAMES = pa.list_(pa.binary())
_UNITS = pa.list_(pa.int64())
_FORMED = [
    ("doc_id", pa.int64()),
    ("n", pa.int64()),
    ("form", pa.string()),
    ("prefix_chars", pa.int64()),
    ("middle_chars", pa.int64()),
    ("frames", _FRAMES),
    ("units", _UNITS),
]


@dataclass
class Framed:
    """Frames of a text; ``units[i]`` code points stand before frame i, and ``units[-1]`` in all."""

    frames: list[bytes]
    units: list[int]

    @classmethod
    def of(cls, text: str, frame_chars: int = FRAME_CHARS) -> Framed:
        out = cls([], [0])
        for at in range(0, len(text), frame_chars):
            out.put(text[at : at + frame_chars])
        return out

    def put(self, text: str) -> None:
        """Add a text as a frame of its own."""
        if text:
            self.frames.append(zstandard.compress(text.encode(), LEVEL))
            self.units.append(self.units[-1] + len(text))

    def put_range(self, source: Framed, start: int, end: int) -> None:
        """Add code points ``start`` to ``end`` of ``source``; only frames cut by an end are decompressed."""
        at = start
        while at < end:
            k = bisect_right(source.units, at) - 1
            first, last = source.units[k], source.units[k + 1]
            if at == first and last <= end:
                self.frames.append(source.frames[k])
                self.units.append(self.units[-1] + last - first)
            else:
                self.put(zstandard.decompress(source.frames[k]).decode()[at - first : end - first])
            at = last

    def chunks(self) -> Iterator[bytes]:
        """UTF-8 text of each frame in order."""
        return map(zstandard.decompress, self.frames)

    def text(self) -> str:
        return b"".join(self.chunks()).decode()

    def find(self, mark: str, start: int = 0) -> int:
        """Code point at which ``mark`` stands first, from ``start`` on; it may lie over two or more frames."""
        k, tail = max(0, bisect_right(self.units, start) - 1), ""
        for i in range(k, len(self.frames)):
            chunk = zstandard.decompress(self.frames[i]).decode()
            first = self.units[i]
            if first < start:
                chunk, first = chunk[start - first :], start
            place = (tail + chunk).find(mark)
            if place >= 0:
                return first - len(tail) + place
            tail = (tail + chunk)[-(len(mark) - 1) :]
        raise ValueError(f"{mark} is missing")


def form_of(doc_id: int | None, n: int, marked: bool, seed: int, plain_percent: int, spm_percent: int) -> tuple[str, int, int]:
    """Form, and the code points at which the prefix and the middle end."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not n or marked or h3 % 100 >= 100 - plain_percent:
        return PLAIN, 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return SPM if h4 % 100 < spm_percent else PSM, a, b


def arrange(source: Framed, form: str, a: int, b: int) -> Framed:
    """The output of a text cut at a and b."""
    n = source.units[-1]
    if form == PLAIN:
        return source
    out = Framed([], [0])
    ends = {PREFIX: (0, a), SUFFIX: (b, n), MIDDLE: (a, b)}
    for mark in (PREFIX, SUFFIX, MIDDLE) if form == PSM else (SUFFIX, PREFIX, MIDDLE):
        out.put(mark)
        out.put_range(source, *ends[mark])
    return out


def restore(output: Framed, form: str) -> Framed:
    """The text that ``arrange`` had, found from the marks in its output.

    The text holds no mark and every mark begins with the only ``<`` in it, so
    none can arise where a mark and text meet.
    """
    if form == PLAIN:
        return output
    second = output.find(SUFFIX if form == PSM else PREFIX, 3)
    third = output.find(MIDDLE, second + 3)
    one, two, middle = (3, second), (second + 3, third), (third + 3, output.units[-1])
    out = Framed([], [0])
    for part in (one, middle, two) if form == PSM else (two, middle, one):
        out.put_range(output, *part)
    return out


def _digest(framed: Framed) -> str:
    sha = hashlib.sha256()
    for chunk in framed.chunks():
        sha.update(chunk)
    return sha.hexdigest()


def store(docs: DataFrame, frame_chars: int = FRAME_CHARS) -> DataFrame:
    """doc_id, n (code points), marked (holds a mark), frames and units of every row of ``docs``.

    A null text is empty; an empty text has no frame.  Rows are kept as they
    come, repeated ones and those without doc_id too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 500):
            sizes, marked, frames, units = [], [], [], []
            for text in part.column(1).to_pylist():
                text = text or ""
                framed = Framed.of(text, frame_chars)
                sizes.append(len(text))
                marked.append(any(m in text for m in (PREFIX, SUFFIX, MIDDLE)))
                frames.append(framed.frames)
                units.append(framed.units)
            columns = [pa.array(sizes, pa.int64()), pa.array(marked, pa.bool_()), pa.array(frames, _FRAMES), pa.array(units, _UNITS)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n", "marked", "frames", "units"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, marked boolean, frames array<binary>, units array<long>")


def _framed(frames: pa.Array, units: pa.Array) -> Iterator[Framed]:
    for f, u in zip(frames, units):
        yield Framed(f.as_py(), u.as_py())


def transform(stored: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Stored texts rearranged: doc_id, n, form, prefix_chars, middle_chars, and frames and units of the output.

    The cuts follow from ``seed`` and doc_id, so rows that share a doc_id share
    the draw and a null doc_id draws as an empty one.  Texts that are empty or
    hold a mark stay plain, and their two lengths are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out = {name: [] for name, _ in _FORMED}
                ids, sizes, marked = (part.column(c).to_pylist() for c in range(3))
                for doc_id, n, m, source in zip(ids, sizes, marked, _framed(part.column(3), part.column(4))):
                    form, a, b = form_of(doc_id, n, m, seed, plain_percent, spm_percent)
                    made = arrange(source, form, a, b)
                    cut = (None, None) if form == PLAIN else (a, b - a)
                    for name, value in zip(out, (doc_id, n, form, *cut, made.frames, made.units)):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in _FORMED], list(out))

    kind = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>, units array<long>"
    return stored.select("doc_id", "n", "marked", "frames", "units").mapInArrow(run, kind)


def texts(formed: DataFrame) -> DataFrame:
    """doc_id, form and the output as plain text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = [f.text() for f in _framed(part.column(2), part.column(3))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.string())], ["doc_id", "form", "output"])

    return formed.select("doc_id", "form", "frames", "units").mapInArrow(run, "doc_id long, form string, output string")


def digest(formed: DataFrame) -> DataFrame:
    """Each output's lengths and digest, and the digest of the text rebuilt from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, rebuilt = [], []
            for form, output in zip(batch.column(2).to_pylist(), _framed(batch.column(5), batch.column(6))):
                made.append(_digest(output))
                rebuilt.append(_digest(restore(output, form)))
            columns = [*batch.columns[:5], pa.array(made, pa.string()), pa.array(rebuilt, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "output_sha256", "restored_sha256"])

    kind = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return formed.select([c for c, _ in _FORMED]).mapInArrow(run, kind)
