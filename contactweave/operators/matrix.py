"""A stored multi-resolution contact matrix and everything asked of it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..errors import ContactWeaveError, MatrixIndexError, ResolutionError
from ..plans.storage import materialize, new_scratch_path, remove
from ..plans.zoom_order import checked_zoom_plan
from ..sources.matrix_store import Level, MatrixStore
from . import balance as bal, contacts as ct, genome as gn, region as rg, scaffold as sc
from .genome import Genome


class Matrix:
    """Handle on a matrix folder; every method reads the stored tables lazily.

    What a method stores counts for other handles once it has ended: a method
    that fails leaves the folder as it was.
    """

    def __init__(self, store: MatrixStore, genome: Genome):
        self.store, self.genome = store, genome
        self.spark = store.spark

    # Opening and building

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "Matrix":
        store = MatrixStore(spark, root).load()
        return cls(store, Genome.from_contigs(store.contigs()))

    @classmethod
    def _begin(cls, spark: SparkSession, root: str, genome: Genome, overwrite: bool = True) -> "Matrix":
        store = MatrixStore(spark, root)
        if not overwrite and store.exists():
            raise ContactWeaveError(f"{root} already holds a matrix")
        contigs = store.write_contigs(genome.contigs)
        return cls(store, Genome(contigs, genome.n_tigs, genome.longest_name, genome.unique_names))

    @classmethod
    def create(cls, spark: SparkSession, root: str, genome: Genome, overwrite: bool = True) -> "Matrix":
        """A matrix without any level."""
        matrix = cls._begin(spark, root, genome, overwrite)
        matrix.store.publish()
        return matrix

    @classmethod
    def build(
        cls,
        spark: SparkSession,
        root: str,
        pairs: DataFrame,
        lengths: DataFrame,
        resolutions: Iterable[int],
        strategy: str | None = None,
        boundary: str = "clamp",
    ) -> "Matrix":
        """Bin pairs at the first resolution, sum up the others, balance them all.

        A matrix already in the folder is read until the new one is whole.
        """
        wanted = list(resolutions)
        if not wanted or min(wanted) <= 0:
            raise ResolutionError("resolutions must be positive")
        checked_zoom_plan(wanted[:1], wanted[1:])
        matrix = cls._begin(spark, root, Genome.from_lengths(lengths))
        first = ct.located_pixels(pairs, matrix.genome, wanted[0], boundary)
        matrix._store_level(wanted[0], materialize(first, "pixels"))
        matrix._store_coarser(wanted[1:])
        matrix._store_weights(wanted, strategy)
        matrix.store.publish()
        return matrix

    def add_level(self, res: int, pixels: DataFrame) -> None:
        if res in self.store.levels:
            raise ResolutionError(f"resolution {res} is already stored")
        if "tig1_id" not in pixels.columns:
            pixels = ct.locate(pixels, self.genome, res)
        self._store_level(res, materialize(pixels, "pixels"))
        self.store.publish()

    def _store_level(self, res: int, pixels: DataFrame) -> None:
        """``pixels`` come from a stored table: they are counted, sampled and written."""
        n_bins, n_pixels = self.genome.n_bins(res), pixels.count()
        bins = self.store.write_table(res, "bins", self.genome.bins(res))
        self.store.write_table(res, "tig_index", self.genome.tig_index(res))
        stored = self.store.write_pixels(res, pixels, n_bins, n_pixels)
        self.store.write_table(res, "bin_index", gn.bin_index(stored, bins, n_bins))

    def zoom(self, resolutions: Iterable[int]) -> None:
        """Add coarser levels, each from the largest stored level that divides it; one scan for each of those."""
        self._store_coarser(resolutions)
        self.store.publish()

    def _store_coarser(self, resolutions: Iterable[int]) -> None:
        have = sorted(self.store.levels)
        sources: dict[int, list[int]] = {}
        for _, target in checked_zoom_plan(have, resolutions):
            sources.setdefault(max(r for r in have if target % r == 0), []).append(target)
        for source, targets in sources.items():
            path = new_scratch_path(self.spark, "pyramid")
            levels = ct.pyramid(self.tiled_pixels(source), self.genome, source, targets, self.n_pixels(source))
            levels.write.partitionBy("res").parquet(path)
            stored = self.spark.read.schema(levels.schema).parquet(path)
            for target in targets:
                self._store_level(target, stored.where(F.col("res") == target).drop("res"))
            remove(self.spark, path)

    def balance(self, resolutions: Iterable[int], strategy: str | None) -> list[int]:
        """Store weights and name the resolutions that got some."""
        done = self._store_weights(resolutions, strategy)
        if done:
            self.store.publish()
        return done

    def _store_weights(self, resolutions: Iterable[int], strategy: str | None) -> list[int]:
        done = []
        for res in resolutions:
            weights = bal.balance_weights(self.pixels(res), self.genome, res, strategy)
            if weights is not None:
                self.store.write_table(res, "weights", weights)
                done.append(res)
        return done

    def update_trans_max(self, cutoff: int = sc.LENGTH_CUTOFF) -> None:
        """Store every bin's largest trans contact at every resolution."""
        for res in self.resolutions():
            best = sc.trans_max(self.tiled_pixels(res), self._facts(res, cutoff), self.n_bins(res))
            self.store.write_table(res, "max_vals", best)
        self.store.publish()

    # Accessors

    def resolutions(self) -> list[int]:
        return sorted(self.store.levels)

    def _sizes(self, res: int) -> Level:
        if res not in self.store.levels:
            raise ResolutionError(f"resolution {res} is not stored, only {self.resolutions()}")
        return self.store.levels[res]

    def n_bins(self, res: int) -> int:
        return self._sizes(res).n_bins

    def n_pixels(self, res: int) -> int:
        return self._sizes(res).n_pixels

    def tile_bins(self, res: int) -> int:
        """Bins a side of a pixel tile."""
        return self._sizes(res).tile_bins

    @property
    def n_contigs(self) -> int:
        return self.genome.n_tigs

    def contigs(self) -> DataFrame:
        return self.genome.contigs

    def tig_id(self, name: str) -> int | None:
        row = self.contigs().where(F.col("tig_name") == name).agg(F.max("tig_id")).first()
        return row[0]

    def tig_name(self, tig_id: int) -> str | None:
        row = self.contigs().where(F.col("tig_id") == tig_id).first()
        return row["tig_name"] if row else None

    def _table(self, res: int, name: str) -> DataFrame:
        self._sizes(res)
        return self.store.table(res, name)

    def pixels(self, res: int) -> DataFrame:
        return self._table(res, "pixels").select("bin1_id", "bin2_id", "count")

    def tiled_pixels(self, res: int) -> DataFrame:
        """Pixels with the contigs of their bins and their tile."""
        return self._table(res, "pixels")

    def tig_index(self, res: int) -> DataFrame:
        return self._table(res, "tig_index")

    def bin_index(self, res: int) -> DataFrame:
        return self._table(res, "bin_index")

    def bins(self, res: int, with_values: bool = False) -> DataFrame:
        """Bin coordinates, on request with stored weight and max_val (null if absent)."""
        table = self._table(res, "bins")
        if not with_values:
            return table
        for name, column in (("weights", "weight"), ("max_vals", "max_val")):
            try:
                table = table.join(self.store.optional_table(res, name), "bin_id", "left")
            except ContactWeaveError:
                table = table.withColumn(column, F.lit(None).cast("double"))
        return table

    def weights(self, res: int) -> DataFrame:
        self._sizes(res)
        return self.store.optional_table(res, "weights")

    def best_trans_weights(self, res: int) -> DataFrame:
        """Stored trans maxima with zero for bins that have none."""
        self._sizes(res)
        stored = self.store.optional_table(res, "max_vals")
        return stored.select("bin_id", F.nanvl("max_val", F.lit(0.0)).alias("max_val"))

    def pixel_slice(self, res: int, start: int, end: int) -> DataFrame:
        if end > self.n_pixels(res):
            raise MatrixIndexError(f"slice [{start}, {end}) does not fit {self.n_pixels(res)} pixels")
        return rg.pixel_slice(self.tiled_pixels(res), self.bin_index(res), start, end, self.n_bins(res), self.tile_bins(res))

    def balanced_pixels(self, res: int) -> DataFrame:
        return ct.balanced_pixels(self.pixels(res), self.weights(res), self.n_bins(res))

    def balanced_pixel_slice(self, res: int, start: int, end: int) -> DataFrame:
        part = self.pixel_slice(res, start, end)
        return ct.balanced_pixels(part, self.weights(res), self.n_bins(res))

    def iter_pixels(self, res: int) -> Iterator[Row]:
        """Rows in stored order, one row range at a time on the driver.

        A range reads the tiles of its rows and is sorted on its own.  Work at
        scale goes over the ``pixels`` DataFrame instead.
        """
        n = self.n_bins(res)
        step = max(1, n // (1 + self.n_pixels(res) // 1_000_000))
        for low in range(0, n + 1, step):
            part = rg.upper_rectangle(self.tiled_pixels(res), low, low + step, low, n + 1, self.tile_bins(res))
            yield from part.select("bin1_id", "bin2_id", "count").sort("bin1_id", "bin2_id").toLocalIterator()

    # Rectangles and rows

    def rectangle(self, res: int, i0: int, i1: int, j0: int, j1: int) -> DataFrame:
        return rg.rectangle(self.tiled_pixels(res), self.n_bins(res), i0, i1, j0, j1, self.tile_bins(res))

    def balanced_rectangle(self, res: int, i0: int, i1: int, j0: int, j1: int) -> DataFrame:
        return rg.balanced_rectangle(
            self.tiled_pixels(res), self.weights(res), self.n_bins(res), i0, i1, j0, j1, self.tile_bins(res)
        )

    def balanced_array(self, res: int, i0: int, i1: int, j0: int, j1: int) -> np.ndarray:
        return rg.to_dense(self.balanced_rectangle(res, i0, i1, j0, j1), i0, i1, j0, j1)

    def dense_rectangle(self, res: int, i0: int, i1: int, j0: int, j1: int) -> DataFrame:
        """Every cell of a balanced rectangle, zeros included."""
        return rg.dense_rectangle(self.balanced_rectangle(res, i0, i1, j0, j1), i0, i1, j0, j1)

    def balanced_row(self, res: int, row: int) -> DataFrame:
        return rg.balanced_row(self.tiled_pixels(res), self.weights(res), self.n_bins(res), row, self.tile_bins(res))

    def dense_row(self, res: int, row: int) -> DataFrame:
        return rg.dense_row(
            self.tiled_pixels(res), self.weights(res), self.bins(res), self.n_bins(res), row, self.tile_bins(res)
        )

    dense_column = dense_row  # the matrix is symmetric

    # Scaffolding

    def _facts(self, res: int, cutoff: int) -> DataFrame:
        return sc.bin_facts(self.bins(res), self.genome, self.weights(res), cutoff)

    def _end_bins(self, res: int, name: str) -> list[int]:
        """First and last bin of the contigs of this name."""
        known = self.contigs().where(F.col("tig_name") == name).select("tig_id")
        row = self.tig_index(res).join(known, "tig_id").where("n_bins > 0")
        return sorted({b for r in row.collect() for b in (r["chrom_offset"], r["chrom_offset"] + r["n_bins"] - 1)})

    def best_neighbors(self, res: int, cutoff: int = sc.LENGTH_CUTOFF, name: str | None = None) -> DataFrame:
        """Best neighbour of every contig end, or of those of one contig; needs stored trans maxima."""
        rows = None if name is None else self._end_bins(res, name)
        return sc.best_neighbors(
            self.tiled_pixels(res), self._facts(res, cutoff), self.best_trans_weights(res), self.n_bins(res), rows, self.tile_bins(res)
        )

    def neighbor_names(
        self, name: str | None = None, is_start: bool | None = None, cutoff: int = sc.LENGTH_CUTOFF
    ) -> DataFrame:
        """Distinct neighbour names over all resolutions, on request of one contig end."""
        found = sc.neighbor_names(
            [self.best_neighbors(r, cutoff, name) for r in self.resolutions()], self.genome
        )
        if name is not None:
            found = found.where(F.col("tig_name") == name)
        if is_start is not None:
            found = found.where(F.col("end") == ("start" if is_start else "end"))
        return found
