"""Parquet layout of a multi-resolution contact matrix.

::

    <root>/manifests/<number>   kind, res, folder and sizes of every table of one version
    <root>/data/<folder>        a table: contigs, pixels, bins, tig_index, bin_index, weights, max_vals

Every table is written to a folder of its own and nothing is overwritten.  A
version is its manifest, written last: readers take the newest manifest that
is complete, so a build that fails leaves the version before it as it was.
Publishing a version removes what neither it nor the one before names, so a
query that runs on the version before still ends.

Pixels are laid out by tile (``plans.tiles``), one folder a tile, and sorted
by ``(bin1_id, bin2_id)`` inside.  They carry the contigs of both bins, so a
coarser bin is a division and no join with bins.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ContactWeaveError, NotBalancedError
from ..plans.storage import remove
from ..plans.tiles import tile_bins, tile_column, tile_pixels

MANIFEST = "kind string, res bigint, folder string, n_bins bigint, n_pixels bigint, tile_bins bigint"
TABLES = {
    "contigs": "tig_id bigint, tig_name string, length bigint",
    "pixels": "bin1_id bigint, bin2_id bigint, count bigint, tig1_id bigint, tig2_id bigint, tile bigint",
    "bins": "bin_id bigint, tig_id bigint, start bigint, `end` bigint",
    "tig_index": "tig_id bigint, chrom_offset bigint, n_bins bigint",
    "bin_index": "bin_id bigint, bin1_offset bigint",
    "weights": "bin_id bigint, weight double",
    "max_vals": "bin_id bigint, max_val double",
}
_ALL = 0  # the resolution of tables that belong to none


@dataclass(frozen=True)
class Level:
    """Sizes of a stored resolution."""

    n_bins: int
    n_pixels: int
    tile_bins: int


class MatrixStore:
    """Tables of one matrix folder; what is written here counts for others once it is published."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folders: dict[tuple[str, int], str] = {}
        self.levels: dict[int, Level] = {}

    # Versions

    def _versions(self) -> list[int]:
        """Numbers of the complete manifests, ascending."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [f.getPath() for f in fs.listStatus(path)]
        return sorted(int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(done(p, "_SUCCESS")))

    def _manifest(self, version: int) -> list:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{version}").collect()

    def exists(self) -> bool:
        return bool(self._versions())

    def load(self) -> "MatrixStore":
        """Take over the newest version."""
        versions = self._versions()
        if not versions:
            raise ContactWeaveError(f"there is no matrix in {self.root}")
        rows = self._manifest(versions[-1])
        self.folders = {(r.kind, r.res): r.folder for r in rows}
        self.levels = {r.res: Level(r.n_bins, r.n_pixels, r.tile_bins) for r in rows if r.kind == "pixels"}
        return self

    def publish(self) -> None:
        """Make the tables of this store the newest version, then remove what older ones alone name."""
        versions = self._versions()
        rows = [
            (kind, res, folder, *((n.n_bins, n.n_pixels, n.tile_bins) if (n := self.levels.get(res)) else (None, None, None)))
            for (kind, res), folder in self.folders.items()
        ]
        number = versions[-1] + 1 if versions else 0
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifests/{number}")
        self._clear(versions)

    def _clear(self, versions: list[int]) -> None:
        kept = set(self.folders.values())
        old = versions[:-1]
        if versions:
            kept |= {r.folder for r in self._manifest(versions[-1])}
        gone = {r.folder for v in old for r in self._manifest(v)} - kept
        for folder in sorted(gone):
            remove(self.spark, self.path(folder))
        for v in old:
            remove(self.spark, f"{self.root}/manifests/{v}")

    # Tables

    def path(self, folder: str) -> str:
        return f"{self.root}/data/{folder}"

    def _new_folder(self, kind: str, res: int) -> str:
        return f"{kind}-{res}-{uuid.uuid4().hex[:12]}"

    def write_table(self, res: int, kind: str, table: DataFrame) -> DataFrame:
        folder = self._new_folder(kind, res)
        table.write.parquet(self.path(folder))
        self.folders[kind, res] = folder
        return self.table(res, kind)

    def write_contigs(self, contigs: DataFrame) -> DataFrame:
        return self.write_table(_ALL, "contigs", contigs)

    def contigs(self) -> DataFrame:
        return self.table(_ALL, "contigs")

    def write_pixels(self, res: int, pixels: DataFrame, n_bins: int, n_pixels: int) -> DataFrame:
        """Store pixels by tile; ``pixels`` is stored itself, as its order is sampled before it is written."""
        side = tile_bins(n_bins, n_pixels, tile_pixels(self.spark))
        order = ["tile", "bin1_id", "bin2_id"]
        tiled = pixels.select("bin1_id", "bin2_id", "count", "tig1_id", "tig2_id", tile_column("bin1_id", "bin2_id", side).alias("tile"))
        folder = self._new_folder("pixels", res)
        tiled.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("tile").parquet(self.path(folder))
        self.folders["pixels", res] = folder
        self.levels[res] = Level(n_bins, n_pixels, side)
        return self.table(res, "pixels")

    def table(self, res: int, kind: str) -> DataFrame:
        return self.spark.read.schema(TABLES[kind]).parquet(self.path(self.folders[kind, res]))

    def optional_table(self, res: int, kind: str) -> DataFrame:
        """Weights or trans maxima, which a level may lack."""
        if (kind, res) not in self.folders:
            raise NotBalancedError(f"resolution {res} has no stored {kind}")
        return self.table(res, kind)


def dump_weights(weights: DataFrame, path: str) -> None:
    """Weights as text, one per line in bin order; for looking at a balancing run."""
    weights.orderBy("bin_id").select(F.col("weight").cast("string")).write.mode("overwrite").text(path)
