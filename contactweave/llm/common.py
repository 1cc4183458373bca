"""Small helpers the text operators share."""

from __future__ import annotations

import ctypes
import gc
import math
import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# White space that str.split() cuts at and WORD does not.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LOWER = {c: c + 32 for c in range(65, 91)}
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def words(text: str) -> list[str]:
    """Runs of characters other than space and \\x09-\\x0D."""
    return WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


@dataclass
class Words:
    """The words of some texts: text i has ``codes[offsets[i]:offsets[i + 1]]``, numbers into ``distinct``."""

    offsets: np.ndarray
    codes: np.ndarray
    distinct: list[str]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every distinct word."""
        return np.array([xxhash.xxh3_64_intdigest(w) for w in self.distinct], np.uint64)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets, codes and distinct words as in ``Words``, the words still as an Arrow array."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    encoded = split.values.dictionary_encode()
    codes, offsets = encoded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    empty = pc.index(encoded.dictionary, "").as_py()
    if empty >= 0:
        real = codes != empty
        offsets = np.concatenate(([0], np.cumsum(real)))[offsets]
        codes = codes[real]
    return offsets, codes, encoded.dictionary


def factorize(texts: pa.Array, lower: bool = False) -> Words:
    """Words of a string array, in compiled code; a null text has none.  ``lower`` turns A-Z into a-z."""
    offsets, codes, distinct = split_words(texts, lower)
    return Words(offsets, codes, distinct.to_numpy(zero_copy_only=False).tolist())  # to_pylist is many times slower


def slices(batches: Iterator[pa.RecordBatch], rows: int, text_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most ``rows`` rows and, from two rows on, about ``text_bytes`` of column 1."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            ends = np.cumsum(sizes[at : at + rows])
            n = max(1, int(np.searchsorted(ends, text_bytes, "right")))
            yield batch.slice(at, n)
            at += n
    give_back()


def give_back() -> None:
    """Return freed memory to the system, since a worker is used again by other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scrambles 64-bit values, each seed in its own way."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def crc_bucket(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; a null counts as the empty string."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def crc_bucket_of(value, modulus: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shards_for(n_bytes: float, bytes_each: float, least: int) -> int:
    """Number of parts that keeps each at about ``bytes_each``, and at least ``least``."""
    return max(least, math.ceil(n_bytes / bytes_each))
