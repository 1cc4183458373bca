"""Pairs files that arrive over time, counted into pixels as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.contacts import contact_pixels
from ..operators.genome import Genome
from ..schemas import PAIR_TEXT_COLUMNS, PAIRS
from ..sources.pairs import STRICT_TEXT


def stream_pairs(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Pairs of a growing folder, in the same text format as the batch reader."""
    reader = spark.readStream.schema(PAIRS).options(**STRICT_TEXT, comment="#")
    return reader.option("maxFilesPerTrigger", files_per_batch).csv(folder).fillna("", PAIR_TEXT_COLUMNS)


def append_pixels(
    pairs: DataFrame, genome: Genome, res: int, out: str, checkpoint: str, boundary: str = "clamp"
) -> StreamingQuery:
    """Write each batch's pixels as ``<out>/batch=<id>``; a retried batch replaces its own folder.

    No state is held between batches: ``total_pixels`` sums the parts.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        counted = contact_pixels(batch, genome, res, boundary)
        counted.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        pairs.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def total_pixels(spark: SparkSession, out: str) -> DataFrame:
    """Pixels over all batches so far."""
    parts = spark.read.parquet(out)
    return parts.groupBy("bin1_id", "bin2_id").agg({"count": "sum"}).withColumnRenamed("sum(count)", "count")
