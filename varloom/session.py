"""Session settings and the shared folder for tables written between steps."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Rows that one task sorts; beyond the session's number of partitions, tasks grow in number and not in size.
ROWS_PER_TASK = 500_000


def range_parts(*tables: DataFrame) -> list[int]:
    """Number of partitions for an exchange of all rows of the largest table, to be put before its keys.

    Empty while the session's own number suffices, which leaves adaptive execution free to join small
    ones. The count reads no columns of a stored table.
    """
    wanted = -(-max(t.count() for t in tables) // ROWS_PER_TASK)
    return [wanted] if wanted > int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


def dealt(tables: Sequence[DataFrame], key: str, like: Sequence[DataFrame]) -> list[DataFrame]:
    """Tables dealt by key over as many partitions as the largest of ``like`` asks for.

    A join on the key then needs no other exchange. They stay as they are while the session's own
    number suffices.
    """
    parts = range_parts(*like)
    return [t.repartition(*parts, key) for t in tables] if parts else list(tables)


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    A session without the setting is refused: any folder chosen here would be local to one machine,
    unseen by the other executors and lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return configured


def remove_written(spark: SparkSession) -> None:
    """Delete the tables that this application has written to the shared folder."""
    root = shared_dir(spark).rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/varloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else has used."""
    root = shared_dir(spark).rstrip("/")
    return f"{root}/varloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def write_through(df, label: str):
    """Write a table to the shared folder and read it back, cutting its lineage."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
