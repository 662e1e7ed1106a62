"""Frames as a stream: files of atoms arrive in a folder, each micro-batch is analysed
by frame_id and appended. Frames are independent, so no state crosses batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import ATOMS


def read_frames(spark: SparkSession, folder: str, schema: str = ATOMS, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_frames(frames: DataFrame, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append analyse(batch) to out, a folder for each batch, so that a batch that is
    run again after a failure replaces its own output."""

    def each(batch: DataFrame, number: int) -> None:
        analyse(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    writer = frames.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
