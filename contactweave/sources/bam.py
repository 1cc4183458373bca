"""BAM files as a Spark data source that reads one file in many tasks.

A task owns a byte range of the compressed file: the blocks that start in it
and the records that start in those blocks.  Blocks are found by their
signature.  The first record of a range is the first offset from which a chain
of well-formed records runs through a whole window of data, since record
starts are not marked in the format.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.shipping import ship_package

# Fixed values of the format: the start of a block, and per CIGAR code of
# MIDNSHP=X whether it uses up reference bases.
BLOCK_MAGIC = b"\x1f\x8b\x08\x04"
USES_REF = np.array([1, 0, 1, 1, 0, 0, 0, 1, 1] + [0] * 7, dtype=np.int64)

SPLIT_BYTES = 64 << 20
_READ = 1 << 20
_MAX_BLOCK = 1 << 16
_WINDOW = 1 << 18
_FIXED = 36  # record bytes up to the read name, its length field included

ALIGNMENT_SCHEMA = (
    "qname string, mate int, ref_id bigint, start bigint, `end` bigint, mapq int, "
    "is_mapped boolean, is_reverse boolean, is_secondary boolean, is_supplementary boolean, ord bigint"
)
REFERENCE_SCHEMA = "ref_id bigint, ref_name string, length bigint"


def _open(path: str):
    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path
    return system, inner


def _files(path: str) -> list[tuple[str, int]]:
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner))
    base = path.rstrip("/")
    return sorted((f"{base}/{f.base_name}", f.size) for f in found if f.base_name.endswith(".bam"))


def _block_size(head: bytes) -> int | None:
    """Length of the block that starts here, None if none does."""
    if len(head) < 18 or head[:4] != BLOCK_MAGIC:
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at, stop = 12, min(12 + extra, len(head) - 5)
    while at < stop:
        length = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and length == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + length
    return None


def _inflate(block: bytes) -> bytes:
    extra = struct.unpack_from("<H", block, 10)[0]
    return zlib.decompress(block[12 + extra : -8], wbits=-15)


def _blocks(handle, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every block from ``start`` on, which must be a block start."""
    at, base, buffer = start, start, b""
    while at < size:
        if at + _MAX_BLOCK > base + len(buffer) and base + len(buffer) < size:
            handle.seek(at)
            base, buffer = at, handle.read(_READ)
        length = _block_size(buffer[at - base : at - base + 64])
        if length is None or at + length > size:
            raise ValueError(f"no complete BGZF block at byte {at}")
        yield at, _inflate(buffer[at - base : at - base + length])
        at += length


def _first_block(handle, start: int, size: int) -> int:
    """Offset of the first block at or after ``start`` whose successor is one as well."""
    if start == 0:
        return 0
    handle.seek(start)
    window = handle.read(2 * _MAX_BLOCK + 64)
    at = window.find(BLOCK_MAGIC)
    while at >= 0:
        length = _block_size(window[at : at + 64])
        after = at + length if length else 0
        if length and (start + after == size or _block_size(window[after : after + 64])):
            return start + at
        at = window.find(BLOCK_MAGIC, at + 1)
    return size


@dataclass
class Header:
    names: list[str]
    lengths: list[int]
    block: int  # compressed offset of the block that holds the first record
    within: int  # place of the first record in that block


def read_header(handle, size: int) -> Header:
    data, starts = bytearray(), []
    blocks = _blocks(handle, 0, size)

    def need(n: int) -> None:
        while len(data) < n:
            got = next(blocks, None)
            if got is None:
                raise ValueError("the BAM header is cut short")
            starts.append((len(data), got[0]))
            data.extend(got[1])

    need(8)
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    need(at + 4)
    count = struct.unpack_from("<i", data, at)[0]
    at += 4
    names, lengths = [], []
    for _ in range(count):
        need(at + 4)
        n = struct.unpack_from("<i", data, at)[0]
        need(at + 8 + n)
        names.append(data[at + 4 : at + 3 + n].decode("ascii"))
        lengths.append(struct.unpack_from("<i", data, at + 4 + n)[0])
        at += 8 + n
    first, offset = max((s for s in starts if s[0] <= at), default=(0, 0))
    return Header(names, lengths, offset, at - first)


def _header_of(path: str, size: int) -> Header:
    system, inner = _open(path)
    with system.open_input_file(inner) as handle:
        return read_header(handle, size)


def _well_formed(data: bytes, at: int, n_refs: int) -> int | None:
    """Offset after the record at ``at`` if its fields agree with each other."""
    if at + _FIXED > len(data):
        return None
    size, ref, pos, l_name, _, _, n_ops, _, l_seq, next_ref, next_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    least = _FIXED - 4 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq
    if not (-1 <= ref < n_refs and -1 <= next_ref < n_refs and pos >= -1 and next_pos >= -1):
        return None
    if l_name < 1 or l_seq < 0 or size < least:
        return None
    name = data[at + _FIXED : at + _FIXED + l_name]
    if len(name) == l_name and (name[-1] != 0 or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    return at + 4 + size


def _first_record(data: bytes, n_refs: int, at_end: bool) -> int | None:
    """First offset from which well-formed records run to the end of ``data``."""
    for start in range(len(data)):
        at, seen = start, 0
        while at is not None and at + _FIXED <= len(data):
            at, seen = _well_formed(data, at, n_refs), seen + 1
        if at is not None and seen and (not at_end or at == len(data)):
            return start
    return None


@dataclass
class BamSplit(InputPartition):
    """A byte range of one file, the bytes of the files before it, and the file whose header names the contigs."""

    path: str
    start: int
    end: int
    size: int
    before: int
    lead: tuple[str, int]


def _gather(data: np.ndarray, offsets: np.ndarray, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return data[offsets[:, None] + np.arange(width)].copy().view(dtype).ravel()


def _batch(raw: bytes, offsets: np.ndarray, ords: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Columns of the records at ``offsets``; ``ids`` has each of the file's contigs' number, and -1 at its end."""
    data = np.frombuffer(raw, dtype=np.uint8)
    l_name = data[offsets + 12].astype(np.int64)
    n_ops = _gather(data, offsets + 16, "<u2").astype(np.int64)
    flag = _gather(data, offsets + 18, "<u2").astype(np.int64)
    pos = _gather(data, offsets + 8, "<i4").astype(np.int64)
    if ((flag & 0xC0) == 0).any():
        raise ValueError("alignment is neither first nor last in its pair")
    owner = np.repeat(np.arange(len(offsets)), n_ops)
    inside = np.arange(n_ops.sum()) - np.repeat(np.cumsum(n_ops) - n_ops, n_ops)
    ops = _gather(data, (offsets + _FIXED + l_name)[owner] + 4 * inside, "<u4").astype(np.int64)
    covered = np.bincount(owner, weights=(ops >> 4) * USES_REF[ops & 15], minlength=len(offsets))
    names = [
        raw[o + _FIXED : o + _FIXED + n - 1].decode("ascii") for o, n in zip(offsets.tolist(), l_name.tolist())
    ]
    bit = lambda mask: pa.array((flag & mask) != 0)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names, pa.string()),
            pa.array(np.where(flag & 0x40, 1, 2).astype(np.int32)),
            pa.array(ids[_gather(data, offsets + 4, "<i4").astype(np.int64)]),
            pa.array(pos),
            pa.array(pos + covered.astype(np.int64)),
            pa.array(data[offsets + 13].astype(np.int32)),
            pa.array((flag & 0x4) == 0),
            bit(0x10),
            bit(0x100),
            bit(0x800),
            pa.array(ords),
        ],
        names=[
            "qname", "mate", "ref_id", "start", "end", "mapq",
            "is_mapped", "is_reverse", "is_secondary", "is_supplementary", "ord",
        ],
    )


def _read_split(split: BamSplit) -> Iterator[pa.RecordBatch]:
    system, inner = _open(split.path)
    with system.open_input_file(inner) as handle:
        header = read_header(handle, split.size)
        ids = _contig_ids(split, header)
        if split.end <= header.block:
            return
        if split.start <= header.block:
            first, within = header.block, header.within
        else:
            first, within = _first_block(handle, split.start, split.size), None
        if first >= min(split.end, split.size):
            return
        blocks = _blocks(handle, first, split.size)
        data, starts, open_ended = b"", [], True

        def more() -> bool:
            """Append the next block; remember where it starts."""
            nonlocal data, open_ended
            got = next(blocks, None)
            open_ended = got is not None
            if got:
                starts.append((len(data), got[0]))
                data += got[1]
            return open_ended

        while within is None:
            goal = len(data) + _WINDOW
            while len(data) < goal and more():
                pass
            within = _first_record(data, len(header.names), not open_ended)
            if within is None and (not open_ended or starts[-1][1] >= split.end):
                return  # the range lies inside one record that starts before it
        at = within
        while True:
            while len(data) < at + 4 * _WINDOW and more():
                pass
            offsets, done = [], False
            own = [s for s, offset in starts if offset >= split.end]
            limit = own[0] if own else None
            while at + 4 <= len(data):
                if limit is not None and at >= limit:
                    done = True
                    break
                after = at + 4 + struct.unpack_from("<i", data, at)[0]
                if after > len(data):
                    break
                offsets.append(at)
                at = after
            if offsets:
                places = np.array(offsets, dtype=np.int64)
                held = np.array(starts, dtype=np.int64)
                block = np.searchsorted(held[:, 0], places, side="right") - 1
                ords = (split.before + held[block, 1] << 16) + places - held[block, 0]
                yield _batch(data, places, ords, ids)
            if done or (not open_ended and not offsets):
                if not done and at < len(data):
                    raise ValueError(f"{split.path} ends inside a record")
                return
            # Drop what was read; a record may go on in the next blocks.
            shift = max((s for s, _ in starts if s <= at), default=0)
            data, at = data[shift:], at - shift
            starts = [(s - shift, o) for s, o in starts if s >= shift]
            if not offsets:
                more()


def _contig_ids(split: BamSplit, own: Header) -> np.ndarray:
    """Number of each contig of this file in the lead file's header; the last entry stands for none."""
    if split.path == split.lead[0]:
        return np.append(np.arange(len(own.names)), -1)
    lead = _header_of(*split.lead)
    number = {n: (i, length) for i, (n, length) in enumerate(zip(lead.names, lead.lengths))}
    ids = []
    for name, length in zip(own.names, own.lengths):
        if name not in number:
            raise ValueError(f"{split.path} has a contig {name} that {split.lead[0]} does not have")
        if number[name][1] != length:
            raise ValueError(f"contig {name} is {length} long in {split.path} and {number[name][1]} in {split.lead[0]}")
        ids.append(number[name][0])
    return np.array([*ids, -1], np.int64)


class _AlignmentReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self):
        files, splits, before = _files(self.path), [], 0
        for path, size in files:
            splits += [
                BamSplit(path, start, min(start + self.split_bytes, size), size, before, files[0])
                for start in range(0, size, self.split_bytes)
            ]
            before += size
        return splits

    def read(self, partition):
        yield from _read_split(partition)


class _ReferenceReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition):
        header = _header_of(*_files(self.path)[0])
        for i, (name, length) in enumerate(zip(header.names, header.lengths)):
            yield (i, name, length)


class BamDataSource(DataSource):
    """``spark.read.format("bam")`` with options path, table and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def _wants_references(self) -> bool:
        return self.options.get("table", "alignments") == "references"

    def schema(self) -> str:
        return REFERENCE_SCHEMA if self._wants_references() else ALIGNMENT_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if self._wants_references():
            return _ReferenceReader(self.options["path"])
        return _AlignmentReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_bam(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Alignments and references of one BAM file or of a folder of them.

    Files stand in the order of their names.  Contigs are numbered as in the
    first file; a later file may list them in another order or leave some out,
    and one with a contig of its own or of another length is an error.
    """
    ship_package(spark)
    spark.dataSource.register(BamDataSource)
    source = spark.read.format("bam").option("splitBytes", str(split_bytes))
    return source.load(path), spark.read.format("bam").option("table", "references").load(path)
