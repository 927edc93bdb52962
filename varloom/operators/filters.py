"""Row filters and column selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from varloom.operators.stats import distinct_counts

from varloom.functions.features import has_bad_value


def on_chromosome(df: DataFrame, chrom: str, column: str = "chrom") -> DataFrame:
    return df.filter(F.col(column) == F.lit(chrom))


def lines_with_term(df: DataFrame, term: str, text: str = "value", header: str = "#") -> DataFrame:
    """Lines that hold a term anywhere, and header lines."""
    return df.filter(F.col(text).contains(term) | F.col(text).startswith(header))


def split_classes(df: DataFrame, target: str = "target") -> tuple[DataFrame, DataFrame]:
    """(non-zero class, zero class)."""
    return df.filter(F.col(target) != 0), df.filter(F.col(target) == 0)


def first_positives(df: DataFrame, n: int, target: str = "y", row_id: str = "row_id") -> DataFrame:
    """First ``n`` rows of class 1 in row order; a top-n, so no full sort."""
    return df.filter(F.col(target) == 1).orderBy(row_id).limit(n)


def single_base_ref(df: DataFrame, ref: str = "ref") -> DataFrame:
    return df.filter(F.length(ref) == 1)


def bad_rows(df: DataFrame, inputs: str = "inputs", target: str | None = None) -> DataFrame:
    """Rows with NaN or an infinity in their inputs or target."""
    bad = has_bad_value(F.col(inputs))
    if target:
        y = F.col(target).cast("double")
        bad = bad | F.isnan(y) | (F.abs(y) == F.lit(float("inf")))
    return df.filter(bad)


def bad_columns(df: DataFrame, inputs: str = "inputs") -> DataFrame:
    """(idx, n_bad) for every position that holds NaN or an infinity."""
    value = F.col("value")
    cells = bad_rows(df, inputs).select(F.posexplode(inputs).alias("idx", "value"))
    return (
        cells.filter(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))))
        .groupBy("idx")
        .agg(F.count("*").alias("n_bad"))
    )


def find_lines(df: DataFrame, term: str, text: str, row_id: str) -> DataFrame:
    return df.filter(F.col(text).contains(term)).select(row_id)


def non_binary_targets(target: Column) -> Column:
    """Aggregate: number of targets that are neither 0 nor 1."""
    return F.count_if(~target.isin(0, 1))


def varied_columns(
    df: DataFrame,
    columns: Sequence[str],
    min_distinct: int = 20,
    always: Sequence[str] = ("y",),
    relative_error: float | None = None,
) -> list[str]:
    """Columns with at least ``min_distinct`` values, plus those always kept.

    A first pass takes a sketch per column, whose size does not grow with the data. Columns
    whose estimate is within a factor of two of the limit are then counted exactly, unless
    ``relative_error`` is given, which makes the sketch decide.
    """
    checked = [c for c in columns if c not in always]
    if not checked:
        return list(columns)
    sketches = [F.approx_count_distinct(c, relative_error or 0.05).alias(c) for c in checked]
    counts = df.agg(*sketches).first().asDict()
    if relative_error is None:
        near = [c for c in checked if min_distinct <= 2 * counts[c] and counts[c] <= 2 * min_distinct]
        if near:
            counts |= {r["column"]: r["n_distinct"] for r in distinct_counts(df, near).collect()}
    return [c for c in columns if c in always or counts[c] >= min_distinct]


def compare_columns(left: DataFrame, right: DataFrame, suffix: str = ".na") -> dict[str, list[str]]:
    """Columns of one side only, and indicator columns split by whether their base exists."""
    indicators = [c for c in left.columns if c.endswith(suffix)]
    return {
        "left_only": [c for c in left.columns if c not in right.columns],
        "right_only": [c for c in right.columns if c not in left.columns],
        "with_base": [c for c in indicators if c.removesuffix(suffix) in right.columns],
        "without_base": [c for c in indicators if c.removesuffix(suffix) not in right.columns],
    }


def columns_with_max(df: DataFrame, columns: Sequence[str], value: float = 1.0) -> list[str]:
    top = df.agg(*[F.max(c).alias(c) for c in columns]).first()
    return [c for c in columns if top[c] == value]
