"""Helpers of the training-data operators: text buffers, byte hashes, shared tables, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from varloom.session import fresh_path

#: Bytes of text hashed at once inside a task.
CHUNK = 1 << 20
#: Bits of a filter of hashes.
FILTER_BITS = 26

_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = _inverses = np.ones(0, np.uint64)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``_k1`` and ``_k2``, hashes of id and text: 128 bits that name a row's content.

    Rows that repeat both get the same key on purpose; what is found for one holds for the other.
    """
    return docs.withColumns({"_k1": F.xxhash64(F.col(id_col)), "_k2": F.xxhash64(F.col(text_col))})


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lost executors then cost no recomputation."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, kept: list[str], used: dict[str, Column], run, made: dict[str, str]) -> DataFrame:
    """``mapInArrow`` over the ``used`` columns, with the kept columns carried along in ``_row``.

    In a struct none of their names, dots included, can clash with anything. ``made`` names the new
    columns and their types; ``run`` gives ``_row`` and these.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("_"))
    source = df.select(row.alias("_row"), *[c.alias(n) for n, c in used.items()])
    schema = StructType([source.schema["_row"], *[StructField(n, DataType.fromDDL(t)) for n, t in made.items()]])
    return source.mapInArrow(run, schema).select(*[F.col(f"_row.`{c}`") for c in kept], *made)


def bit_filter(df: DataFrame, column: str) -> np.ndarray:
    """One bit for each hash of a column, by its low ``FILTER_BITS`` bits, put together in Spark.

    Its size is fixed: 64-bit words for 8 MB. What it lets through by chance a join sorts out, and where it
    is full the join does all the work.
    """
    bit = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = df.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")).alias("bits")
    )
    table = words.toArrow()
    filled = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    filled[np.asarray(table.column("word"), np.int64)] = np.asarray(table.column("bits"), np.int64)
    return filled


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a batch and the offsets of each; null is empty."""
    a = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = a.buffers()
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def spans(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or a single longer row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1, start + 1)
        yield start, min(stop, n)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over a 64-bit word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK + 1024)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers, _inverses = np.cumprod(up), np.cumprod(down)
    return _powers, _inverses


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any range of bytes follows."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the bytes lo..hi-1, equal for equal content wherever it stands."""
    return mix((prefix[hi] - prefix[lo]) * powers(len(prefix))[1][lo])


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text modulo n; null where the id is null."""
    return F.crc32(F.col(id_col).cast("string")) % n


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node reachable. Only nodes with an edge are listed.

    Each round takes the smallest label of the neighbours and then the label's own label; every
    round is written to the shared folder, so lineage stays short.
    """
    both = stored(
        edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
        .union(edges.select(F.col(b), F.col(a)))
        .distinct(),
        "edges",
    )
    labels = stored(both.groupBy(F.col("src").alias("node")).agg(F.least("node", F.min("dst")).alias("root")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "dst"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("best"))
        ahead = labels.select(F.col("node").alias("best"), F.col("root").alias("ahead"))
        step = step.join(ahead, "best").select("node", F.least("best", "ahead").alias("new"), "root")
        step = stored(step, "labels")
        labels = step.select("node", F.col("new").alias("root"))
        if not step.filter("new <> root").head(1):
            return labels
