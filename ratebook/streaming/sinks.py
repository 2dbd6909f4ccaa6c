"""Sinks of micro-batches that a replay leaves as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["BATCH", "earlier_batches", "put_batch", "start"]

#: The partition column that tells which micro-batch wrote a row.
BATCH = "batch_id"


def put_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """rows as the partition of their micro-batch at path, put in place of whatever an earlier attempt at the same batch left.

    A batch is one folder, staged beside the table and moved in as a whole by dynamic partition overwrite, so
    readers see all of it or nothing. A batch without rows leaves nothing.
    """
    rows.withColumn(BATCH, F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def earlier_batches(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """What batches before batch_id put at path, with batch_id; no rows where nothing is there yet.

    A replayed batch doesn't see its own first attempt (nor what came later), so whatever it decides by the table it decides
    again. Only the folders of earlier batches are listed for the scan.
    """
    full = f"{schema}, {BATCH} long"
    try:
        found = spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)
    return found.where(F.col(BATCH) < batch_id)


def start(rows: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], once: bool = False):
    """The query that hands micro-batches to write. once: it ends when all that has arrived is done."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
