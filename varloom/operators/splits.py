"""Seeded splits of a row-numbered table. Parts never share a row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from varloom.operators.rows import hash_fraction, hash_prefix


def exact_split(
    df: DataFrame, test_size: float, seed: int, row_id: str = "row_id", flag: str = "is_test"
) -> DataFrame:
    """Flag a random test part of exactly ``ceil(test_size * n)`` rows."""
    first = hash_prefix(df, lambda total: math.ceil(test_size * total), seed, row_id)
    return df.withColumn(flag, first)


def hash_split(
    df: DataFrame, shares: Sequence[float], seed: int, row_id: str = "row_id", name: str = "part"
) -> DataFrame:
    """Part number per row by one hash and cumulated shares; no exchange, sizes vary slightly."""
    if not math.isclose(sum(shares), 1.0):
        raise ValueError("shares must sum to 1")
    u = hash_fraction(row_id, seed)
    edge, part = 0.0, F.lit(len(shares) - 1)
    edges = []
    for share in shares[:-1]:
        edge += share
        edges.append(edge)
    for i in reversed(range(len(edges))):
        part = F.when(u < edges[i], F.lit(i)).otherwise(part)
    return df.withColumn(name, part)


def prefix_split(
    df: DataFrame, share: float, row_id: str = "row_id", flag: str = "is_train"
) -> DataFrame:
    """The first ``int(share * n)`` rows of an already shuffled list against the rest."""
    total = df.agg(F.count("*")).scalar()
    return df.withColumn(flag, F.col(row_id) < F.floor(F.lit(float(share)) * total))


def train_test(
    df: DataFrame, test_size: float, seed: int, row_id: str = "row_id"
) -> tuple[DataFrame, DataFrame]:
    flagged = exact_split(df, test_size, seed, row_id)
    return (
        flagged.filter(~F.col("is_test")).drop("is_test"),
        flagged.filter("is_test").drop("is_test"),
    )


def synthetic_positives(
    df: DataFrame, share: float, seed: int, row_id: str = "row_id", target: str = "target"
) -> DataFrame:
    """Set the target to 1 on a seeded share of the rows."""
    chosen = hash_fraction(row_id, seed) < share
    return df.withColumn(target, F.when(chosen, F.lit(1)).otherwise(F.col(target)))
