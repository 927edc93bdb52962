"""File streams into the keyed prediction store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from varloom.sources.store import file_system, open_run, read_text, upsert, write_text


def file_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    fmt: str = "parquet",
    files_per_batch: int = 100,
    **options,
) -> DataFrame:
    """New files of a folder as a stream; the batch bound keeps a backlog from piling up."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.options(**options).format(fmt).load(folder)


def run_of(spark: SparkSession, store: str, checkpoint: str) -> str:
    """The store run of a checkpoint, named on its first use and kept inside the checkpoint."""
    fs, place = file_system(spark, f"{checkpoint}/store_run")
    if not fs.exists(place):
        write_text(spark, f"{checkpoint}/store_run", open_run(spark, store))
    return read_text(spark, f"{checkpoint}/store_run")


def into_store(
    stream: DataFrame, store: str, checkpoint: str, row_id: str = "row_id"
) -> StreamingQuery:
    """Write each micro-batch under its run and number and stop when the folder is drained.

    Batch numbers start anew with each checkpoint, so the run belongs to the checkpoint: a batch
    that runs again after a failure keeps its place, and a new checkpoint adds to the store. Streams
    that write at once are ordered by the commits of their batches.
    """
    run = run_of(stream.sparkSession, store, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        upsert(batch, store, number, run, row_id)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_stream(
    stream: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    store: str,
    checkpoint: str,
) -> StreamingQuery:
    """Score variants as they are read and keep the predictions by id."""
    return into_store(score(stream), store, checkpoint)
