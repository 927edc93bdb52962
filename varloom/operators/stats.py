"""Table statistics as mergeable aggregates: each task reduces its rows before any shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from varloom.operators import arrays

QUARTILES = (0.25, 0.5, 0.75)
_SKETCH_ACCURACY = 1_000
# Distinct values of a quantile bracket that may be grouped and put in order.
_MAX_INSIDE = 200_000
_BINS = 4096
# Parallel partial results of a vector aggregate.
_PARTIALS = 64


def confusion(
    df: DataFrame, truth: str, predicted: str, positive: int = 1, by: Sequence[str] = ()
) -> DataFrame:
    """Counts tn, fp, fn, tp; every class but the positive one counts as negative."""
    return df.groupBy(*by).agg(*_confusion_columns(F.col(truth), F.col(predicted), [positive]))


def confusion_over_labels(
    df: DataFrame, truth: str, predicted: str, labels: Sequence[int]
) -> DataFrame:
    """The four counts summed over labels, each label taken as the positive class in turn."""
    return df.agg(*_confusion_columns(F.col(truth), F.col(predicted), labels))


def _confusion_columns(t: Column, p: Column, labels: Sequence[int]) -> list[Column]:
    def total(test) -> Column:
        return reduce(lambda a, b: a + b, [F.count_if(test(label)) for label in labels])

    return [
        total(lambda c: (t != c) & (p != c)).alias("tn"),
        total(lambda c: (t != c) & (p == c)).alias("fp"),
        total(lambda c: (t == c) & (p != c)).alias("fn"),
        total(lambda c: (t == c) & (p == c)).alias("tp"),
    ]


def correct(truth: Column, predicted: Column) -> Column:
    return (truth == predicted).cast("double")


def accuracy(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(correct(F.col(truth), F.col(predicted))).alias("accuracy"),
        F.count("*").alias("n"),
    )


def mean_batch_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Plain mean of the per-batch accuracies; a short batch weighs as much as a full one."""
    per_batch = accuracy(df, truth, predicted, ["batch_id"])
    return per_batch.agg(
        F.avg("accuracy").alias("mean_accuracy"), F.count("*").alias("n_batches")
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    return df.agg(
        F.count_if(F.col(target) == 1).alias("positives"),
        F.count("*").alias("rows"),
        (F.count_if(F.col(target) == 1) / F.count("*")).alias("ratio"),
    )


def summary(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """One row per column: count, mean, std, min, quartiles, max; NaN counts as missing.

    Exact quartiles narrow the brackets of all columns at once (``arrays``); with ``exact`` off they
    come from a sketch of fixed size in one more pass.
    """
    if exact:
        cells = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("cells"))
        names = F.get(F.array(*map(F.lit, columns)), F.col("idx")).alias("column")
        found = arrays.array_summary(cells, "cells", QUARTILES).select(
            names, "count", "mean", "std", "min", *[F.col("quartiles")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "max"
        )
        every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
        return every.join(found, "column", "left").fillna({"count": 0})
    values = df.select(*[_number(c) for c in columns])
    aggs = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
        )
        for c in columns
    ]
    moments = values.agg(F.array(*aggs).alias("__s")).select(F.inline("__s"))
    wide = _sketched_quantiles(values, columns).groupBy("column").agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"p{round(100 * p)}")
            for p in QUARTILES
        ]
    )
    return moments.join(wide, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def _sketched_quantiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(p).alias("prob"), q.alias("quantile"))
        for c in columns
        for p, q in ((p, F.percentile_approx(c, p, _SKETCH_ACCURACY).cast("double")) for p in QUARTILES)
    ]
    return df.agg(F.array(*rows).alias("__q")).select(F.inline("__q"))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = QUARTILES
) -> DataFrame:
    """(column, prob, quantile) with linear interpolation, without gathering a column.

    Each quantile lies between two order statistics, and each of these keeps a bracket
    [low, high] that is known to hold it. While it holds many different values, rows are counted by equal bins and
    the bracket shrinks to the bins around the wanted rank. At last the values of each
    bracket are grouped, and only that short list of distinct values is put in order.
    All counts combine before the shuffle. NaN counts as missing.
    """
    values = df.select(*[_number(c) for c in columns])
    base = values.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.min(_finite(c)).alias(f"min{i}") for i, c in enumerate(columns)],
        *[F.max(_finite(c)).alias(f"max{i}") for i, c in enumerate(columns)],
        *[
            F.count_if(F.col(c) == F.lit(float("-inf"))).alias(f"lowest{i}")
            for i, c in enumerate(columns)
        ],
        *[F.approx_count_distinct(_finite(c)).alias(f"values{i}") for i, c in enumerate(columns)],
    ).first()
    cases = [
        {
            "column": c,
            "prob": p,
            "rank": rank,
            "side": side,
            "share": p * (base[f"n{i}"] - 1) % 1,
            "low": 0.0 if base[f"min{i}"] is None else base[f"min{i}"],
            "high": 0.0 if base[f"max{i}"] is None else base[f"max{i}"],
            "below": base[f"lowest{i}"],
            "crowded": base[f"values{i}"] > _MAX_INSIDE,
        }
        for i, c in enumerate(columns)
        if base[f"n{i}"]
        for p in probs
        for side, rank in enumerate(_neighbours(p * (base[f"n{i}"] - 1)))
    ]
    if not cases:
        return df.sparkSession.createDataFrame([], "column string, prob double, quantile double")
    while any(case["crowded"] for case in cases):
        _count_around(values, cases)
        _narrow(values, cases)
    return _ranked_values(values, cases)


def _neighbours(rank: float) -> tuple[int, int]:
    return math.floor(rank), math.ceil(rank)


def _number(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value).alias(column)


def _finite(column: str) -> Column:
    return F.when(F.abs(F.col(column)) != F.lit(float("inf")), F.col(column))


def _count_around(values: DataFrame, cases: list[dict]) -> None:
    """Rows below and up to the low end, and whether the bracket still holds many values."""
    open_cases = [case for case in cases if case["crowded"]]
    counts = []
    for k, case in enumerate(open_cases):
        c, low, high = F.col(case["column"]), case["low"], case["high"]
        counts += [
            F.count_if(c < low).alias(f"below{k}"),
            F.count_if(c <= low).alias(f"upto{k}"),
            F.approx_count_distinct(F.when((c > low) & (c < high), c)).alias(f"inside{k}"),
        ]
    counted = values.agg(*counts).first()
    for k, case in enumerate(open_cases):
        case["below"], case["upto"] = counted[f"below{k}"], counted[f"upto{k}"]
        case["crowded"] = counted[f"inside{k}"] > _MAX_INSIDE


def _narrow(values: DataFrame, cases: list[dict]) -> None:
    """Shrink the crowded brackets; one that cannot shrink any more counts as done."""
    crowded: dict[tuple, list[dict]] = {}
    for case in cases:
        if case["crowded"]:
            crowded.setdefault((case["column"], case["low"], case["high"]), []).append(case)
    if not crowded:
        return
    binned = [
        F.when(
            (F.col(c) > low) & (F.col(c) < high),
            F.struct(
                F.lit(j).alias("bracket"),
                # Halves, so that a bracket as wide as all numbers has a finite width.
                F.floor((F.col(c) / 2 - low / 2) / (high / 2 - low / 2) * _BINS).cast("int").alias("bin"),
            ),
        )
        for j, (c, low, high) in enumerate(crowded)
    ]
    sizes: list[dict[int, int]] = [{} for _ in crowded]
    grouped = values.select(F.explode(F.array(*binned)).alias("b")).filter("b IS NOT NULL")
    for row in grouped.groupBy("b.bracket", "b.bin").agg(F.count("*").alias("n")).collect():
        sizes[row["bracket"]][row["bin"]] = row["n"]
    for (bracket, members), bins in zip(crowded.items(), sizes, strict=True):
        for case in members:
            case["crowded"] = _shrink(case, bracket[1], bracket[2], bins)


def _shrink(case: dict, low: float, high: float, bins: dict[int, int]) -> bool:
    """Move the ends of a bracket to one bin beyond the bin of the wanted rank.

    A rank before the first bin is the low end itself, one after the last the high end.
    """

    def place(shift: int) -> float:
        passed = case["upto"]
        if case["rank"] < passed:
            return low
        for b in sorted(bins):
            passed += bins[b]
            if case["rank"] < passed:
                part = (b + shift) / _BINS
                return min(high, max(low, low * (1 - part) + high * part))
        return high

    case["low"], case["high"] = place(-1), place(2)
    return (case["low"], case["high"]) != (low, high)


def _ranked_values(values: DataFrame, cases: list[dict]) -> DataFrame:
    brackets = list(dict.fromkeys((c["column"], c["low"], c["high"]) for c in cases))
    inside = F.array(
        *[
            F.when(
                F.col(c).between(low, high),
                F.struct(F.lit(j).alias("bracket"), F.col(c).alias("value")),
            )
            for j, (c, low, high) in enumerate(brackets)
        ]
    )
    counted = (
        values.select(F.explode(inside).alias("__v"))
        .filter("__v IS NOT NULL")
        .groupBy("__v.bracket", "__v.value")
        .agg(F.count("*").alias("n"))
    )
    facts = F.broadcast(
        values.sparkSession.createDataFrame(
            [
                (
                    k,
                    brackets.index((case["column"], case["low"], case["high"])),
                    case["column"],
                    case["prob"],
                    case["side"],
                    case["share"],
                    case["rank"],
                    case["below"],
                )
                for k, case in enumerate(cases)
            ],
            "case int, bracket int, column string, prob double, side int, share double, rank long, below long",
        )
    )
    upto = W.partitionBy("case").orderBy("value")
    ranked = counted.join(facts, "bracket", "right").withColumn(
        "last", F.sum("n").over(upto) + F.col("below") - 1
    )

    # Ranks outside the finite values are infinite.
    found = (
        ranked.groupBy("case", "column", "prob", "side", "share", "rank", "below")
        .agg(F.min(F.when(F.col("last") >= F.col("rank"), F.col("value"))).alias("found"))
        .withColumn(
            "found",
            F.when(F.col("rank") < F.col("below"), float("-inf")).otherwise(
                F.coalesce("found", F.lit(float("inf")))
            ),
        )
    )
    low, high = F.col("low"), F.col("high")
    return (
        found.groupBy("column", "prob", "share")
        .agg(*[F.max(F.when(F.col("side") == i, F.col("found"))).alias(n) for i, n in enumerate(("low", "high"))])
        .select(
            "column",
            "prob",
            F.when(low == high, low).otherwise(low + (high - low) * F.col("share")).alias("quantile"),
        )
    )


def array_summary(df: DataFrame, inputs: str = "inputs") -> DataFrame:
    """Summary per array position for wide rows: (idx, count, mean, std, min, quartiles, max), all exact."""
    return arrays.array_summary(df, inputs, QUARTILES)


def array_order_statistics(df: DataFrame, inputs: str = "inputs", probs: Sequence[float] = QUARTILES) -> DataFrame:
    """(idx, quartiles) per array position: the smallest value with the share ``prob`` of values up to it, exact."""
    return arrays.array_order_statistics(df, inputs, probs)


def column_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, var, scale) with population variance; a constant column has scale 1."""
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.avg(c).alias("mean"),
            F.var_pop(c).alias("var"),
            scale_of(F.var_pop(c)).alias("scale"),
        )
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("__s")).select(F.inline("__s"))


def scale_of(variance: Column) -> Column:
    return F.when(variance == 0, F.lit(1.0)).otherwise(F.sqrt(variance))


def array_scaler(df: DataFrame, inputs: str = "inputs") -> DataFrame:
    """(idx, mean, var, scale) of an array or ML vector column.

    No cell is exploded: each task reduces its rows to one vector aggregate. The tasks'
    results meet in a fixed number of groups, so no single task merges them all, and
    those few groups are combined per position.
    """
    is_vector = isinstance(df.schema[inputs].dataType, VectorUDT)
    vector = F.col(inputs) if is_vector else array_to_vector(F.col(inputs).cast("array<double>"))
    partial = (
        df.select(vector.alias("v"), F.pmod(F.spark_partition_id(), F.lit(_PARTIALS)).alias("g"))
        .groupBy("g")
        .agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s"))
    )
    both = F.arrays_zip(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance")
    )
    n = F.col("s.count").cast("double")
    cells = partial.select(n.alias("n"), F.posexplode(both).alias("idx", "c")).select(
        "n",
        "idx",
        F.col("c.mean").alias("mean"),
        (F.col("c.variance") * (F.col("n") - 1)).alias("squares"),
    )
    position = W.partitionBy("idx")
    centre = F.sum(F.col("n") * F.col("mean")).over(position) / F.sum("n").over(position)
    shift = F.col("mean") - F.col("centre")
    variance = F.sum(F.col("squares") + F.col("n") * shift * shift) / F.sum("n")
    return (
        cells.withColumn("centre", centre)
        .groupBy("idx")
        .agg(F.first("centre").alias("mean"), variance.alias("var"))
        .withColumn("scale", scale_of(F.col("var")))
    )


def density(df: DataFrame, inputs: str = "inputs") -> DataFrame:
    """Cells, non-zero cells, density and sparsity of a feature array."""
    filled = F.sum(F.size(F.filter(inputs, lambda x: x != 0)))
    cells = F.sum(F.size(inputs))
    return df.agg(
        cells.alias("cells"),
        filled.alias("nonzero"),
        (filled / cells).alias("density"),
        (1 - filled / cells).alias("sparsity"),
    )


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("pearson"), F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) over equal bins from minimum to maximum; the last bin is closed, empty ones absent."""
    ends = df.agg(
        F.struct(
            F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high")
        )
    ).scalar()
    low, high = ends["low"], ends["high"]
    place = F.floor((F.col(column) - low) / (high - low) * bins)
    bin_no = F.when(high == low, F.lit(bins // 2)).otherwise(F.least(place, F.lit(bins - 1)))
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(bin_no.cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_distinct), exact.

    Columns of one type are made distinct together in long form, with partial results in each task, and
    then counted; values keep their type.
    """
    kinds: dict[str, list[str]] = {}
    for c in columns:
        kinds.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    counted = []
    for kind, some in kinds.items():
        # Adding zero makes one of the two zeros.
        value = [F.col(c) + F.lit(0.0).cast(kind) if kind in ("double", "float") else F.col(c) for c in some]
        cells = F.array(*[F.struct(F.lit(i).alias("place"), v.alias("value")) for i, v in enumerate(value)])
        distinct = df.select(F.inline(cells)).distinct().groupBy("place").agg(F.count("value").alias("n_distinct"))
        column = F.get(F.array(*map(F.lit, some)), F.col("place")).alias("column")
        counted.append(distinct.select(column, "n_distinct"))
    if not counted:
        return names.withColumn("n_distinct", F.lit(0).cast("long"))
    return names.join(reduce(DataFrame.unionAll, counted), "column", "left").fillna({"n_distinct": 0})


def array_distinct_counts(
    df: DataFrame, inputs: str = "inputs", relative_error: float | None = None
) -> DataFrame:
    """(idx, n_distinct) per array position.

    Exact counts make the values distinct before they are counted; ``relative_error``
    takes a sketch of fixed size per position instead, which suits many features with
    many values.
    """
    cells = df.select(F.posexplode(inputs).alias("idx", "value"))
    if relative_error is not None:
        sketch = F.approx_count_distinct("value", relative_error)
        return cells.groupBy("idx").agg(sketch.alias("n_distinct"))
    return cells.distinct().groupBy("idx").agg(F.count("*").alias("n_distinct"))


def close_to(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def differing_cells(
    left: DataFrame,
    right: DataFrame,
    inputs: str = "inputs",
    row_id: str = "row_id",
    rtol: float | None = None,
    atol: float = 0.0,
) -> DataFrame:
    """(row_id, idx, left_value, right_value) where two tables differ, exactly or by tolerance."""

    def same(a: Column, b: Column) -> Column:
        return a == b if rtol is None else close_to(a, b, rtol, atol)

    pairs = F.arrays_zip(F.col("__l").alias("left_value"), F.col("__r").alias("right_value"))
    cells = (
        left.select(row_id, F.col(inputs).alias("__l"))
        .join(right.select(row_id, F.col(inputs).alias("__r")), row_id)
        .select(row_id, F.posexplode(pairs).alias("idx", "c"))
        .select(row_id, "idx", "c.left_value", "c.right_value")
    )
    return cells.filter(~same(F.col("left_value"), F.col("right_value")))


def strongest_effect(df: DataFrame, key: str, effect: str, row_id: str = "row_id") -> DataFrame:
    """Row with the largest absolute effect per key; the earlier row wins a tie."""
    rest = [c for c in df.columns if c != key]
    order = F.struct(F.abs(F.col(effect)), -F.col(row_id))
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return best.select(key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def widths(df: DataFrame, inputs: str = "inputs") -> DataFrame:
    """Row count and the narrowest and widest feature row."""
    return df.agg(
        F.count("*").alias("rows"),
        F.min(F.size(inputs)).alias("min_width"),
        F.max(F.size(inputs)).alias("max_width"),
    )


def same_columns(tables: Sequence[DataFrame]) -> list[str]:
    """Column names shared, in order, by all prediction tables; anything else is an error."""
    names = [t.columns for t in tables]
    if any(n != names[0] for n in names):
        raise ValueError("prediction tables must have the same columns in the same order")
    return names[0]
