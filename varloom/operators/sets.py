"""Set operations, de-duplication and merged orders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from varloom.operators.joins import VARIANT_KEY
from varloom.operators.rows import previous_in_order, renumber


def concat_variants(sources: Sequence[DataFrame], fill: Sequence[str] = ()) -> DataFrame:
    """Union of variant tables with dot-filled extra columns."""
    merged = reduce(DataFrame.unionByName, sources)
    return merged.withColumns({c: F.lit(".") for c in fill})


def concat_ordered(sources: Sequence[DataFrame], row_id: str = "row_id") -> DataFrame:
    """Tables one after the other, with row numbers running on; keeps ``source_no``.

    Sources whose numbers run from 0 without gaps only get an offset, so no row moves; with gaps
    the rows are renumbered.
    """
    tagged = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)]
    facts = reduce(
        DataFrame.unionByName,
        [
            t.select("source_no", row_id)
            .groupBy("source_no")
            .agg(F.count("*").alias("n"), F.min(row_id).alias("first"), F.max(row_id).alias("last"))
            for t in tagged
        ],
    ).collect()
    if any(r["first"] != 0 or r["last"] + 1 != r["n"] for r in facts):
        return renumber(reduce(DataFrame.unionByName, tagged), row_id, row_id, "source_no")
    sizes = {r["source_no"]: r["n"] for r in facts}
    moved, start = [], 0
    for i, t in enumerate(tagged):
        moved.append(t.withColumn(row_id, (F.col(row_id) + F.lit(start)).cast("long")))
        start += sizes.get(i, 0)
    return reduce(DataFrame.unionByName, moved)


def sorted_distinct(df: DataFrame, key: Sequence[str] = VARIANT_KEY) -> DataFrame:
    return df.dropDuplicates().orderBy(*key)


def merge_sorted(sources: Sequence[DataFrame], key: Sequence[str] = VARIANT_KEY) -> DataFrame:
    """Union without removing repeats, sorted."""
    return reduce(DataFrame.unionByName, sources).orderBy(*key)


def overlap_counts(sets: dict[str, DataFrame], key: str = "variant_id") -> DataFrame:
    """(members, n): for each combination of the named sets, the ids in exactly those.

    One union and one grouping answer every pairwise and triple overlap at once.
    """
    tagged = reduce(
        DataFrame.unionByName,
        [s.select(key, F.lit(name).alias("__set")) for name, s in sets.items()],
    )
    marks = tagged.groupBy(key).agg(
        *[F.max(F.col("__set") == name).alias(f"in_{name}") for name in sets]
    )
    return marks.groupBy(*[f"in_{name}" for name in sets]).agg(F.count("*").alias("n"))


def shared_count(sets: Sequence[DataFrame], key: str = "variant_id") -> DataFrame:
    """Number of ids that all sets hold."""
    common = reduce(DataFrame.intersect, [s.select(key) for s in sets])
    return common.agg(F.count("*").alias("n_shared"))


def keep_first(
    df: DataFrame, key: Sequence[str] = VARIANT_KEY, row_id: str = "row_id"
) -> DataFrame:
    """First row per key. The aggregate combines before the shuffle, so a hot key costs no more."""
    return _keep(df, key, row_id, F.min_by)


def keep_last(df: DataFrame, key: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Last row per key: a repeated key replaces the earlier row."""
    return _keep(df, key, row_id, F.max_by)


def _keep(df: DataFrame, key: Sequence[str], row_id: str, pick) -> DataFrame:
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in key])
    chosen = df.groupBy(*key).agg(pick(rest, F.col(row_id)).alias("__row"))
    return chosen.select(*[c if c in key else F.col("__row")[c].alias(c) for c in df.columns])


def drop_adjacent_repeats(
    df: DataFrame, columns: Sequence[str], row_id: str = "row_id"
) -> DataFrame:
    """Keep a row when it differs from the row before it in the given columns.

    Rows are numbered anew first, so gaps in their numbers, as a filter leaves them, do no harm.
    """
    lagged = previous_in_order(renumber(df, row_id, "__place"), [*columns, row_id], "__place")
    same = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"prev_{c}")) for c in columns]
    )
    first = F.col(f"prev_{row_id}").isNull()
    return lagged.filter(first | ~same).select(*df.columns)


def ordered_distinct(df: DataFrame, column: str, row_id: str = "row_id") -> DataFrame:
    """(column, first_row) per distinct value, in order of first appearance."""
    return df.groupBy(column).agg(F.min(row_id).alias("first_row")).orderBy("first_row")
