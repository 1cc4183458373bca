"""Square tiles of a matrix, numbered by interleaving the bits of their row and column.

Neighbouring tiles mostly have neighbouring numbers, so files written in the
order of the number hold compact pieces of the matrix, and a rectangle, a row
or a column is a list of numbers known before anything is read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession, functions as F

TILE_PIXELS = 16_000_000
_SIDE_BITS = 7  # at most 128 tiles a side, so lists of tiles stay short


def tile_pixels(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.contactweave.tilePixels", str(TILE_PIXELS)))


def tile_bins(n_bins: int, n_pixels: int, most: int) -> int:
    """Bins a side of a tile, such that tiles hold about ``most`` pixels where pixels lie evenly."""
    wanted = math.sqrt(2 * n_pixels / max(1, most))
    bits = min(_SIDE_BITS, max(0, math.ceil(math.log2(max(1.0, wanted)))))
    return max(1, -(-n_bins >> bits) if n_bins else 1)


def tile_number(row: int, column: int) -> int:
    return sum((row >> k & 1) << (2 * k + 1) | (column >> k & 1) << (2 * k) for k in range(_SIDE_BITS + 1))


def tile_column(bin1: str, bin2: str, bins: int) -> Column:
    """Number of the tile that holds a pixel."""
    row, column = F.expr(f"{bin1} div {bins}"), F.expr(f"{bin2} div {bins}")
    bit = lambda x, k, to: F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1).cast("bigint")), to)
    out = F.lit(0).cast("bigint")
    for k in range(_SIDE_BITS + 1):
        out = out.bitwiseOR(bit(row, k, 2 * k + 1)).bitwiseOR(bit(column, k, 2 * k))
    return out


def tiles_over(bins: int, i0: int, i1: int, j0: int, j1: int) -> list[int]:
    """Stored tiles (those of the upper triangle) that rows [i0, i1) and columns [j0, j1) touch."""
    if i0 >= i1 or j0 >= j1:
        return []
    rows, columns = range(i0 // bins, (i1 - 1) // bins + 1), range(j0 // bins, (j1 - 1) // bins + 1)
    return sorted(tile_number(r, c) for r in rows for c in columns if r <= c)
