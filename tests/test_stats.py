import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.functions import features as fx, scores as sx
from varloom.operators import filters, sets, stats
from varloom.plans import models

INF = float("inf")


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


@pytest.mark.parametrize("limit", [5, 200_000])
@pytest.mark.parametrize("kind", ["smooth", "hot", "skewed", "tiny", "constant", "hot ends"])
def test_quantiles_equal_numpy(spark, monkeypatch, limit, kind):
    monkeypatch.setattr(stats, "_MAX_INSIDE", limit)
    monkeypatch.setattr(stats, "_BINS", 16)
    rng = np.random.default_rng(3)
    values = {
        "smooth": rng.normal(size=1500),
        "hot": np.concatenate([np.full(600, 0.25), rng.random(900)]),
        "skewed": np.exp(rng.normal(size=1200) * 6),
        "tiny": np.array([3.0, 1.0]),
        "constant": np.full(50, 7.0),
        "hot ends": np.concatenate([np.zeros(400), np.ones(500), rng.random(300)]),
    }[kind]
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = {r["prob"]: r["quantile"] for r in stats.exact_quantiles(frame(spark, values), ["x"], probs).collect()}
    np.testing.assert_allclose([got[p] for p in probs], np.quantile(values, probs), rtol=1e-12)


def test_quantiles_skip_nan_and_reach_infinities(spark):
    values = [-INF, 1, 2, 3, INF, INF, float("nan")]
    got = stats.exact_quantiles(frame(spark, values), ["x"], (0.0, 0.4, 1.0)).collect()
    assert {r["prob"]: r["quantile"] for r in got} == {0.0: -INF, 0.4: 2.0, 1.0: INF}


def test_summary_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "a double, b double")
    got = {r["column"]: r for r in stats.summary(df, ["a", "b"]).collect()}
    assert got["a"]["count"] == 0 and got["a"]["p50"] is None
    assert got["b"]["p50"] == 2.0 and got["b"]["p25"] == 1.5


def test_scaler_matches_population_formula_over_partitions(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(5, 2, 400), np.full(400, 3.0), np.zeros(400), 1e6 + rng.random(400)])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "inputs array<double>").repartition(9)
    dense = stats.array_scaler(df).orderBy("idx").collect()
    np.testing.assert_allclose([r["mean"] for r in dense], x.mean(0), rtol=1e-12)
    np.testing.assert_allclose([r["var"] for r in dense], x.var(0), rtol=1e-6, atol=1e-12)
    assert [r["scale"] for r in dense][1:3] == [1.0, 1.0]
    packed = fx.with_sparse(df, "inputs", "features")
    sparse = stats.array_scaler(packed, "features").orderBy("idx").collect()
    np.testing.assert_allclose([r["var"] for r in sparse], x.var(0), rtol=1e-6, atol=1e-12)


def test_column_scaler_leaves_constant_columns(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "a double, b double")
    got = {r["column"]: (r["mean"], r["var"], r["scale"]) for r in stats.column_scaler(df, ["a", "b"]).collect()}
    assert got == {"a": (2.0, 0.0, 1.0), "b": (2.0, 1.0, 1.0)}


@pytest.mark.parametrize("bins", [30, 60])
def test_histogram_closes_the_last_bin(spark, bins):
    values = np.arange(0, 601) / 2.0
    got = {r["bin"]: r["n"] for r in stats.histogram(frame(spark, values), "x", bins).collect()}
    assert got == dict(enumerate(np.histogram(values, bins=bins)[0]))


def test_histogram_of_one_value(spark):
    got = [tuple(r) for r in stats.histogram(frame(spark, [5, 5]), "x", 30).collect()]
    expected = np.histogram([5, 5], bins=30)[0]
    assert got == [(int(expected.argmax()), 2)]


def test_confusion_over_labels_keeps_errors_apart(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 1), (2, 2)], "t int, p int")
    got = stats.confusion_over_labels(df, "t", "p", [1, 2]).first()
    assert (got.tn, got.fp, got.fn, got.tp) == (1 + 3, 1, 2, 1)


def test_tolerance_is_relative_to_the_right_side(spark):
    left = spark.createDataFrame([(0, [1.0, 2.0, 100.0])], "row_id long, inputs array<double>")
    right = spark.createDataFrame([(0, [1.0, 2.1, 100.0001])], "row_id long, inputs array<double>")
    exact = [r["idx"] for r in stats.differing_cells(left, right).orderBy("idx").collect()]
    loose = [r["idx"] for r in stats.differing_cells(left, right, rtol=1e-5, atol=1e-7).collect()]
    assert exact == [1, 2] and loose == [1]
    assert np.allclose(100.0, 100.0001, rtol=1e-5, atol=1e-7)


def test_strongest_effect_breaks_ties_by_row(spark):
    df = spark.createDataFrame(
        [("v", 0, -3.0), ("v", 1, 3.0), ("w", 2, 1.0)], "k string, row_id long, e double"
    )
    got = {r["k"]: r["row_id"] for r in stats.strongest_effect(df, "k", "e").collect()}
    assert got == {"v": 0, "w": 2}


def test_cap_applies_to_rows_with_an_infinity_only(spark):
    data = [([INF, 70000.0, -INF],), ([70000.0, 1.0, 2.0],)]
    df = spark.createDataFrame(data, "a array<double>")
    got = [r[0] for r in df.select(fx.cap_if_infinite(F.col("a"))).collect()]
    assert got == [[65500.0, 65500.0, -INF], [70000.0, 1.0, 2.0]]
    assert [r[0] for r in df.select(fx.cap_values(F.col("a"))).collect()][1] == [65500.0, 1.0, 2.0]


@pytest.mark.parametrize("col", [0, 1, 3])
def test_target_may_stand_anywhere(spark, col):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "a array<double>")
    got = df.select(fx.split_target(F.col("a"), col).alias("s")).first()["s"]
    rest = [1.0, 2.0, 3.0, 4.0]
    assert got["target"] == rest.pop(col) and got["inputs"] == rest


def test_line_parsing_raises_on_text(spark):
    df = spark.createDataFrame([("1,-2.5,1e3",), ], "t string")
    assert df.select(fx.parse_line(F.col("t"))).first()[0] == [1.0, -2.5, 1000.0]
    bad = spark.createDataFrame([("1,x",)], "t string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad.select(fx.parse_line(F.col("t"))).collect()


def test_sparse_round_trip_stores_no_zeros(spark):
    row = [0.0] * 50 + [2.0]
    df = spark.createDataFrame([(row,)], "a array<double>")
    packed = fx.with_sparse(df, "a", "v").first()["v"]
    assert packed.numNonzeros() == 1 and type(packed).__name__ == "SparseVector"
    dense = fx.with_sparse(df, "a", "v").select(fx.dense_array(F.col("v"))).first()[0]
    assert dense == row


def test_bad_values_are_found_with_their_column(spark):
    data = [([1.0, float("nan")], 1.0), ([INF, 2.0], 0.0), ([1.0, 2.0], float("nan")), ([1.0, 2.0], 1.0)]
    df = spark.createDataFrame(data, "inputs array<double>, target double")
    assert filters.bad_rows(df, "inputs", "target").count() == 3
    got = {(r["idx"], r["n_bad"]) for r in filters.bad_columns(df).collect()}
    assert got == {(0, 1), (1, 1)}


def test_varied_columns_keep_target(spark):
    df = spark.range(100).select(
        (F.col("id") % 2).alias("y"), F.col("id").alias("a"), (F.col("id") % 5).alias("b")
    )
    assert filters.varied_columns(df, df.columns) == ["y", "a"]
    assert filters.varied_columns(df, df.columns, relative_error=0.05) == ["y", "a"]


def test_indicator_columns(spark):
    left = spark.createDataFrame([(1, 1, 1)], "`a.na` int, `b.na` int, c int")
    right = spark.createDataFrame([(1, 1)], "a int, c int")
    got = filters.compare_columns(left, right)
    assert got["with_base"] == ["a.na"] and got["without_base"] == ["b.na"]
    assert got["right_only"] == ["a"]


def test_strand_merging(spark):
    df = spark.createDataFrame([([0.2], [0.6], [0.9], [0.1])], "r array<double>, a array<double>, rr array<double>, ar array<double>")
    cols = [F.col(c) for c in ("r", "a", "rr", "ar")]

    def value(name, merge):
        return df.select(sx.effect_score(name, *cols, merge)[0]).first()[0]

    logit = lambda p: np.log(p / (1 - p))
    assert value("diff", "mean") == pytest.approx((0.4 - 0.8) / 2)
    assert value("diff", "max") == pytest.approx(0.4)
    assert value("diff", "absmax") == pytest.approx(-0.8)
    assert value("logit_ref", "max") == pytest.approx(logit(0.9))
    assert value("logit", "mean") == pytest.approx(
        ((logit(0.6) - logit(0.2)) + (logit(0.1) - logit(0.9))) / 2
    )


def test_array_distinct_counts(spark):
    df = spark.range(50).select(F.array(F.col("id") % 2, F.col("id")).alias("inputs"))
    exact = {r["idx"]: r["n_distinct"] for r in stats.array_distinct_counts(df).collect()}
    near = {r["idx"]: r["n_distinct"] for r in stats.array_distinct_counts(df, relative_error=0.02).collect()}
    assert exact == {0: 2, 1: 50} and near[0] == 2 and abs(near[1] - 50) <= 3


def test_quantiles_of_two_clusters_keep_brackets_small(spark, monkeypatch):
    """The median lies in a gap; each of its two order statistics must get a narrow bracket."""
    monkeypatch.setattr(stats, "_MAX_INSIDE", 50)
    values = [-1 + i * 1e-6 for i in range(2000)] + [1 + i * 1e-6 for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    seen = []
    ranked = stats._ranked_values

    def spy(data, cases):
        for c in cases:
            seen.append(sum(c["low"] <= v <= c["high"] for v in values))
        return ranked(data, cases)

    monkeypatch.setattr(stats, "_ranked_values", spy)
    got = {r["prob"]: r["quantile"] for r in stats.exact_quantiles(df, ["x"]).collect()}
    for p in (0.25, 0.5, 0.75):
        assert math.isclose(got[p], float(np.quantile(values, p)), rel_tol=1e-12, abs_tol=1e-12)
    assert max(seen) <= 70


def test_quantiles_with_extremes(spark, monkeypatch):
    monkeypatch.setattr(stats, "_MAX_INSIDE", 50)
    values = [-1.5e308, 1.5e308, *[float(i) for i in range(3000)]]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["prob"]: r["quantile"] for r in stats.exact_quantiles(df, ["x"]).collect()}
    ordered = sorted(values)
    for p in (0.25, 0.5, 0.75):
        at = p * (len(values) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert math.isclose(got[p], low + (high - low) * (at % 1))


def test_distinct_counts_have_no_expand(spark):
    df = spark.createDataFrame(
        [(0.0, "a", None), (-0.0, "b", None), (2.0, "a", None)], "x double, s string, n int"
    )
    counted = stats.distinct_counts(df, ["x", "s", "n"])
    assert {r["column"]: r["n_distinct"] for r in counted.collect()} == {"x": 2, "s": 2, "n": 0}
    assert "Expand" not in counted._jdf.queryExecution().executedPlan().toString()


def test_constant_features_scale_to_zero(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0]), (1, [3.0, 5.0])], "row_id long, inputs array<double>")
    got = {r["row_id"]: r["inputs"] for r in models.scale_range(df).collect()}
    assert got == {0: [0.0, 0.0], 1: [1.0, 0.0]}


def test_concatenation_moves_no_rows(spark):
    a = spark.range(5).select(F.col("id").alias("row_id"))
    b = spark.range(3).select(F.col("id").alias("row_id"))
    both = sets.concat_ordered([a, b.limit(0), b])
    assert sorted(r["row_id"] for r in both.collect()) == list(range(8))
    assert "Exchange" not in sets.concat_ordered([a, b])._jdf.queryExecution().executedPlan().toString()
    gaps = sets.concat_ordered([a.filter("row_id <> 2"), b])
    assert sorted((r["source_no"], r["row_id"]) for r in gaps.collect()) == [(0, i) for i in range(4)] + [
        (1, i) for i in range(4, 7)
    ]


def test_adjacent_repeats_with_a_gap_at_a_span(spark):
    df = spark.range(99_990, 100_010).select(F.col("id").alias("row_id"), F.lit("x").alias("v"))
    kept = sets.drop_adjacent_repeats(df.filter("row_id <> 99999"), ["v"]).collect()
    assert [r["row_id"] for r in kept] == [99_990]


def test_array_order_statistics_are_exact(spark):
    rows = [([float((i * 7919) % 2003), float(i % 3), 1.5 * i][: 3 if i % 2 else 2],) for i in range(2003)]
    df = spark.createDataFrame(rows, "inputs array<double>")
    got = {r["idx"]: r["quartiles"] for r in stats.array_order_statistics(df).collect()}
    for k in range(3):
        x = sorted(r[0][k] for r in rows if len(r[0]) > k)
        assert got[k] == [x[-(-len(x) * q // 4) - 1] for q in (1, 2, 3)]


def test_wide_summary_is_exact_without_exploded_cells(spark):
    rng = np.random.default_rng(5)
    n, width = 300, 1063
    data = rng.standard_normal((n, width)) * 10.0 ** rng.integers(-6, 7, width)
    data[:, 0] = 4.0
    data[:, 1] = rng.integers(0, 3, n)
    data[:, 2] = np.where(np.arange(n) % 2, 1e-300, 1e300)
    data[:, 3] = -0.0
    data[0, 4], data[1, 4], data[2, 4] = float("inf"), float("-inf"), float("nan")
    df = spark.createDataFrame([(x.tolist(),) for x in data], "inputs array<double>").repartition(4)
    got = {r["idx"]: r for r in stats.array_summary(df).collect()}
    assert len(got) == width
    for i in range(width):
        x = data[:, i][~np.isnan(data[:, i])]
        assert got[i]["count"] == len(x) and got[i]["min"] == x.min() and got[i]["max"] == x.max()
        assert got[i]["quartiles"] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.75]).tolist(), rel=1e-12)
        if i not in (2, 4):
            assert got[i]["mean"] == pytest.approx(x.mean(), rel=1e-9, abs=1e-12)
            assert got[i]["std"] == pytest.approx(x.std(ddof=1), rel=1e-9, abs=1e-12)


def test_wide_summary_of_ragged_and_missing_rows(spark):
    rows = [([1.0, 2.0],), ([3.0],), (None,), ([],), ([None, 5.0, 7.0],)]
    got = {r["idx"]: tuple(r)[1:] for r in stats.array_summary(spark.createDataFrame(rows, "inputs array<double>")).collect()}
    assert got[0][0] == 2 and got[0][1] == 2.0 and got[0][4] == [1.5, 2.0, 2.5]
    assert got[1][0] == 2 and got[1][4] == [2.75, 3.5, 4.25]
    assert got[2] == (1, 7.0, None, 7.0, [7.0, 7.0, 7.0], 7.0)
    assert stats.array_summary(spark.createDataFrame([], "inputs array<double>")).count() == 0
