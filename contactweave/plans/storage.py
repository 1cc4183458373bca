"""Tables written to shared storage to cut lineage.

Iterative operators and operators that must read the same row order twice
write an intermediate Parquet table and go on from there.  The folder comes
from ``spark.checkpoint.dir``, which a cluster points at storage that outlives
any executor.  Where it is unset, a local session gets a temporary folder that
is removed when the program ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="contactweave-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return _LOCAL_DIRS[app]


def new_scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the stored table."""
    path = new_scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table whose consumers are done."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class AlternatingTable:
    """Two slots written in turn, so a loop of any length keeps two versions."""

    def __init__(self, spark: SparkSession, label: str):
        self._spark = spark
        self._base = new_scratch_path(spark, label)
        self._turn = 0

    def clear(self) -> None:
        """Leave both slots empty; what was read from them must not be used again."""
        for slot in (0, 1):
            remove(self._spark, f"{self._base}/slot{slot}")

    def replace(self, df: DataFrame) -> DataFrame:
        path = f"{self._base}/slot{self._turn % 2}"
        self._turn += 1
        df.write.mode("overwrite").parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)
