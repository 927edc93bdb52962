"""Row numbers, seeded orders, batches and gathers.

Row order is an explicit column. None of these operators uses a window over the
whole table: rows are first put into buckets whose order is known, each bucket is
numbered on its own, and the bucket sizes give the offsets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from varloom.session import dealt, range_parts, write_through

# Upper bound on the buckets of one numbering, hence on the broadcast offset table.
MAX_BUCKETS = 65536
_MIN_SPAN = 16384
# Hash digits that name a bucket: 16 ** 3 buckets.
_HASH_DIGITS = 3
# Rows of a bucket that may be ranked on their own.
_MAX_TAKEN = 100_000
_LOCAL_BITS = 33


def bucket_offsets(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Start number per bucket. ``sizes`` has one row per bucket, never one per data row."""
    before = W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))


def number_rows(
    df: DataFrame,
    order_by: Sequence[str | Column],
    name: str = "row_id",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add the 0-based position in a total order.

    ``order_by`` must tell all rows apart. One range exchange on the full key (so a
    frequent first column is still split) into as many ranges as the number of rows asks for,
    one sort inside each range, one write: the written table keeps range number and position of each row fixed for both later
    reads and survives lost executors. The ranges are counted once, right after the write, and
    their offsets are part of every later plan, one number per range. ``keep`` names the
    columns to store when some serve for the order only.
    """
    ranged = (
        df.repartitionByRange(*range_parts(df), *order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("__part", F.spark_partition_id())
        .withColumn(
            "__local",
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)),
        )
    )
    if keep is not None:
        ranged = ranged.select(*keep, "__part", "__local")
    stored = write_through(ranged, "numbered")
    return (
        stored.withColumn(name, F.col("__local") + _counted_offset(stored, "__part"))
        .drop("__part", "__local")
    )


def _counted_offset(stored: DataFrame, part: str) -> Column:
    """Rows in the ranges before a row's own, as an array of as many numbers as there are ranges."""
    sizes = {r[0]: r[1] for r in stored.groupBy(part).agg(F.count("*")).collect()}
    counts = np.array([sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)], np.int64)
    return F.get(F.lit(np.cumsum(counts) - counts), F.col(part))


def order_hash(row_id: Column | str, seed: int) -> Column:
    """Seeded text hash of a row number; equal in every engine that has md5."""
    value = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(value.cast("string"), F.lit(f":{seed}")))


def hash_fraction(row_id: Column | str, seed: int) -> Column:
    """Repeatable number in [0, 1) per row, from the first eight digits of its hash."""
    digits = F.substring(order_hash(row_id, seed), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 32))


def shuffle_positions(
    df: DataFrame, seed: int, row_id: str = "row_id", name: str = "shuffled_id"
) -> DataFrame:
    """Add each row's place in a seeded random permutation.

    The leading hash digits are the bucket, so buckets are even whatever the data
    holds, and their sizes come from one pre-aggregated count. Rows are moved without their
    hashes, to as many tasks as their number asks for.
    """
    bucket = F.substring(order_hash(row_id, seed), 1, _HASH_DIGITS)
    moved = df.repartition(*range_parts(df), bucket)
    hashed = moved.withColumns({"__bucket": bucket, "__hash": F.unhex(order_hash(row_id, seed))})
    sizes = df.select(bucket.alias("__bucket")).groupBy("__bucket").agg(F.count("*").alias("__n"))
    inside = W.partitionBy("__bucket").orderBy("__hash", row_id)
    return (
        hashed.join(F.broadcast(bucket_offsets(sizes, ["__bucket"])), "__bucket")
        .withColumn(name, F.row_number().over(inside) - 1 + F.col("__offset"))
        .drop("__hash", "__bucket", "__offset", "__n")
    )


def renumber(
    df: DataFrame, position: str, name: str = "row_id", source: str | None = None
) -> DataFrame:
    """Close the gaps of a numeric position, or of (source, position) pairs.

    Buckets are equal spans of the position, at most ``MAX_BUCKETS`` per source; a
    bucket cannot hold more rows than its span, so no source is too large.
    """
    top = df.agg(F.max(position)).first()[0] or 0
    span = max(math.ceil((top + 1) / MAX_BUCKETS), _MIN_SPAN)
    keys = ([source] if source else []) + ["__bucket"]
    spanned = df.withColumn("__bucket", F.floor(F.col(position) / F.lit(span)).cast("bigint"))
    sizes = spanned.groupBy(*keys).agg(F.count("*").alias("__n"))
    inside = W.partitionBy(*keys).orderBy(position)
    return (
        spanned.join(F.broadcast(bucket_offsets(sizes, keys)), keys)
        .withColumn("__new", F.row_number().over(inside) - 1 + F.col("__offset"))
        .drop("__bucket", "__offset", "__n", *([name] if name in df.columns else []))
        .withColumnRenamed("__new", name)
    )


def previous_in_order(
    df: DataFrame, columns: Sequence[str], row_id: str = "row_id", span: int = 100_000
) -> DataFrame:
    """Add ``prev_<column>`` from the row before; row numbers must have no gaps.

    Each row goes to its span of row numbers and the last row of a span also visits
    the next one as a ghost, so the lag never needs the table in one task.
    """
    bucket = F.floor(F.col(row_id) / span).cast("bigint")
    is_last = F.pmod(F.col(row_id), F.lit(span)) == span - 1
    spread = df.withColumn(
        "__bucket",
        F.explode(F.when(is_last, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))),
    )
    order = W.partitionBy("__bucket").orderBy(row_id)
    for c in columns:
        spread = spread.withColumn(f"prev_{c}", F.lag(c).over(order))
    return spread.filter(F.col("__bucket") == bucket).drop("__bucket")


def slice_rows(df: DataFrame, first: int, last: int, row_id: str = "row_id") -> DataFrame:
    """Rows ``first`` to ``last - 1``."""
    return df.filter((F.col(row_id) >= first) & (F.col(row_id) < last))


def head_rows(df: DataFrame, n: int, row_id: str = "row_id") -> DataFrame:
    return df.filter(F.col(row_id) < n)


def tail_rows(df: DataFrame, n: int, row_id: str = "row_id") -> DataFrame:
    top = df.agg(F.max(row_id)).scalar()
    return df.filter(F.col(row_id) > top - F.lit(n))


def sample_rows(df: DataFrame, n: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """Exactly ``n`` random rows (all rows if there are fewer), the same ones for the same seed."""
    return df.filter(hash_prefix(df, lambda total: n, seed, row_id))


def hash_prefix(
    df: DataFrame, size: Callable[[int], int], seed: int, row_id: str = "row_id"
) -> Column:
    """Predicate for the first ``size(total)`` rows of the seeded order.

    Counts by leading hash digits tell in which bucket the last wanted row falls, and
    so on inside that bucket until it is small; no row is sorted or moved. The result
    is a comparison with one literal, so the caller's plan gets no exchange from it.
    """
    hashed = df.select(order_hash(row_id, seed).alias("hash"), F.col(row_id).alias("row"))
    prefix, rest = "", None
    while True:
        digits = len(prefix) + _HASH_DIGITS
        bucket = F.substring("hash", 1, digits).alias("bucket")
        inside = hashed.filter(F.col("hash").startswith(prefix)) if prefix else hashed
        sizes = dict(sorted(inside.groupBy(bucket).agg(F.count("*").alias("n")).collect()))
        if rest is None:
            total = sum(sizes.values())
            rest = size(total)
            if rest <= 0 or rest >= total:
                return F.lit(rest > 0)
        for prefix, n in sizes.items():  # noqa: B007
            if rest <= n:
                break
            rest -= n
        if sizes[prefix] <= _MAX_TAKEN or digits >= 30:
            break
    ranked = hashed.filter(F.col("hash").startswith(prefix)).orderBy("hash", "row")
    last = ranked.limit(rest).tail(1)[0]
    value = order_hash(row_id, seed)
    return (value < last["hash"]) | ((value == last["hash"]) & (F.col(row_id) <= last["row"]))


def with_batches(
    df: DataFrame,
    size: int,
    row_id: str = "row_id",
    num_batches: int | None = None,
    drop_last: bool = False,
) -> DataFrame:
    """Add (batch_id, pos_in_batch) over gap-free row numbers; the last batch may be short."""
    batched = df.withColumn("batch_id", F.floor(F.col(row_id) / size).cast("bigint")).withColumn(
        "pos_in_batch", F.pmod(F.col(row_id), F.lit(size)).cast("int")
    )
    if drop_last:
        total = df.agg(F.max(row_id) + 1).scalar()
        batched = batched.filter(F.col("batch_id") < F.floor(total / F.lit(size)))
    if num_batches is not None:
        batched = batched.filter(F.col("batch_id") < num_batches)
    return batched


def batch_index(batched: DataFrame, row_id: str, id_col: str) -> DataFrame:
    """One row per batch with its row numbers and ids in order; a group is one batch long."""
    members = F.sort_array(F.collect_list(F.struct("pos_in_batch", row_id, id_col)))
    return (
        batched.groupBy("batch_id")
        .agg(members.alias("__m"))
        .select(
            "batch_id",
            F.array_distinct(F.col(f"__m.{row_id}")).alias("row_nrs"),
            F.array_distinct(F.col(f"__m.{id_col}")).alias("variant_ids"),
        )
    )


def gather(order: DataFrame, rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows in a given order: ``order`` has (position, row_id) and may repeat a row."""
    order, rows = dealt([order, rows], row_id, [rows])
    return (
        order.join(rows, row_id)
        .withColumnRenamed(row_id, "source_row_id")
        .withColumnRenamed("position", row_id)
    )


def move_surplus(
    df: DataFrame, keep: int, from_shard: int, to_shard: int, shard: str = "shard_id"
) -> DataFrame:
    """Rows of one shard from position ``keep`` on change to another shard.

    ``df`` carries ``pos_in_shard``, the row's place inside its shard.
    """
    surplus = (F.col(shard) == from_shard) & (F.col("pos_in_shard") >= keep)
    return df.withColumn(shard, F.when(surplus, F.lit(to_shard)).otherwise(F.col(shard)))


def iterate_batches(batched: DataFrame, columns: Sequence[str]):
    """Yield the batches in order as lists of rows, for a consumer that pulls.

    The driver holds one partition of batches at a time.
    """
    members = F.sort_array(F.collect_list(F.struct("pos_in_batch", *columns))).alias("rows")
    ordered = batched.groupBy("batch_id").agg(members).orderBy("batch_id")
    for row in ordered.toLocalIterator(prefetchPartitions=False):
        yield row["batch_id"], row["rows"]
