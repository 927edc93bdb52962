"""Tables laid out by a key, with a file index that cuts a read to the files that can hold wanted keys.

``write_ranged`` sorts by range of the key and adds ``_index``: the smallest and the largest key of each
file. A look-up compares wanted keys, or ranges of them, with the index in one distributed pass and
opens only the files whose range they touch. The index has one row per file; beyond ``MOST_FILES`` of
them it is not sent around and the whole table is read, which gives the same rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from varloom.operators import joins
from varloom.session import range_parts

#: Files whose key ranges may be sent to every task, some hundred bytes each.
MOST_FILES = 50_000


def write_ranged(df: DataFrame, path: str, keys: Sequence[str], files: int | None = None) -> None:
    """Write in key order, equal keys in one file, and index the files."""
    ranged = df.repartitionByRange(*([files] if files else range_parts(df)), *keys)
    ranged.sortWithinPartitions(*keys).write.parquet(path)
    index_files(df.sparkSession, path, keys)


def index_files(spark: SparkSession, path: str, keys: Sequence[str]) -> None:
    """Add the index to a table that is there, each file in key order; rows with a null in the key can not be wanted."""
    key = F.struct(*keys)
    ends = file_ends(spark, path, keys).groupBy("file").agg(F.min(key).alias("least"), F.max(key).alias("most"))
    ends.coalesce(1).write.mode("overwrite").parquet(f"{path}/_index")


def file_ends(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The first and the last row with a whole key of each file, found by row number, so that no key is sorted."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    held = spark.read.parquet(path).select(*keys, *place).dropna(subset=list(keys))
    ends = held.groupBy("file").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    return held.join(F.broadcast(ends), "file").filter("row = first OR row = last").select(*keys, "file")


def _touched(least: list[tuple], most: list[tuple]):
    """Numbers of the files that the ranges (low, high) of the rows touch, each once a task."""
    reach = list(accumulate(most, max))

    def run(batches):
        marks = [0] * (len(least) + 1)
        # One text key: whole batches are placed at once; numpy compares by code points, as UTF-8 does.
        plain = bool(least) and len(least[0]) == 1 and isinstance(least[0][0], str)
        edges = [np.array([k[0] for k in keys], np.str_) for keys in (reach, least)] if plain else []
        for batch in batches:
            if plain:
                low, high = (batch.column(c).flatten()[0] for c in ("low", "high"))
                held = pc.and_(pc.is_valid(low), pc.is_valid(high))
                low, high = (x.filter(held).to_numpy(zero_copy_only=False).astype(np.str_) for x in (low, high))
                first, last = np.searchsorted(edges[0], low, "left"), np.searchsorted(edges[1], high, "right")
                for i, j in set(zip(first.tolist(), last.tolist())):
                    if i < j:
                        marks[i] += 1
                        marks[j] -= 1
                continue
            lows, highs = (batch.column(c).to_pylist() for c in ("low", "high"))
            for low, high in zip(lows, highs):
                low, high = tuple(low.values()), tuple(high.values())
                if None in low or None in high:
                    continue
                first, last = bisect_left(reach, low), bisect_right(least, high)
                if first < last:
                    marks[first] += 1
                    marks[last] -= 1
        found = [i for i, n in enumerate(accumulate(marks[:-1])) if n]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], ["file"])

    return run


def files_within(spark: SparkSession, path: str, ranges: DataFrame) -> list[str] | None:
    """Files that may hold keys of the ranges (low, high), both included; None where the index is too long."""
    index = spark.read.parquet(f"{path}/_index")
    rows = index.orderBy("least", "most").limit(MOST_FILES + 1).collect()
    if len(rows) > MOST_FILES:
        return None
    least, most = ([tuple(r[c]) for r in rows] for c in ("least", "most"))
    touched = ranges.select("low", "high").mapInArrow(_touched(least, most), "file int").distinct().collect()
    return [rows[i]["file"] for i in sorted(r["file"] for r in touched)]


def read_within(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """The rows of the files that the ranges touch: all rows of the ranges, and some more."""
    whole = spark.read.parquet(path)
    files = files_within(spark, path, ranges)
    if files is None:
        return whole
    return spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)


def _points(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    key: Column = F.struct(*keys)
    return rows.select(key.alias("low"), key.alias("high"))


def lookup_stored(ids: DataFrame, path: str, key: str = "variant_id") -> DataFrame:
    """``joins.lookup`` in a stored table, opening only the files that can hold the ids.

    A short list names its files id by id, a long one by its smallest and largest id.
    """
    facts = ids.agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    if facts.first()["n"] <= joins.MAX_BROADCAST_IDS:
        ranges = _points(ids, [key])
    else:
        ranges = facts.select(F.struct(F.col("low").alias(key)).alias("low"), F.struct(F.col("high").alias(key)).alias("high"))
    return joins.lookup(ids, read_within(ids.sparkSession, path, ranges), key)


def scored_positions(regions: DataFrame, path: str) -> DataFrame:
    """``joins.scored_regions`` on scores stored by (chrom, pos)."""
    scores = read_within(regions.sparkSession, path, _points(regions, ["chrom", "pos"]))
    return joins.scored_regions(scores, regions)


def scores_between(regions: DataFrame, path: str) -> DataFrame:
    """Scores stored by (chrom, pos) that lie in a region (chrom, start, end), half-open as in BED, each once."""
    ranges = regions.select(
        F.struct("chrom", (F.col("start") + 1).alias("pos")).alias("low"), F.struct("chrom", F.col("end").alias("pos")).alias("high")
    )
    scores = read_within(regions.sparkSession, path, ranges)
    return joins.points_in_spans(scores, regions)
