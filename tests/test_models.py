import json

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from varloom.functions import pluggable
from varloom.functions.features import with_sparse
from varloom.operators import stats
from varloom.plans import jobs, models
from varloom.sources import store
from varloom.streaming import scoring


def make(n=300, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 4.0, 0.2]
    p = 1 / (1 + np.exp(-(x @ [1.0, -0.5, 2.0] + 0.3)))
    return x, (rng.random(n) < p).astype(int)


def table(spark, x, y):
    data = [(i, int(t), r.tolist()) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "row_id long, target int, inputs array<double>")


def newton(x, y, c):
    """Minimum of c * sum(loss) + |w|^2 / 2 with a free intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(a.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        grad = c * a.T @ (p - y) + penalty @ w
        hess = c * (a * (p * (1 - p))[:, None]).T @ a + penalty
        w -= np.linalg.solve(hess, grad)
    return w


@pytest.mark.parametrize("c", [0.05, 1.0])
def test_logistic_regression_reaches_the_newton_minimum(spark, c):
    x, y = make()
    penalty = models.Penalty.from_inverse(c, len(y))
    model = models.fit_logistic(table(spark, x, y), penalty, max_iter=200, tol=1e-10)
    got = [*model.coefficients.toArray(), model.intercept]
    np.testing.assert_allclose(got, newton(x, y, c), rtol=1e-4, atol=1e-5)


def test_penalty_forms_agree():
    assert models.Penalty.from_inverse(0.5, 100).reg_param == pytest.approx(0.02)
    assert models.Penalty.from_alpha(0.02) == models.Penalty.from_layer(0.01)


def test_decision_is_the_log_odds_and_the_linear_score(spark):
    x, y = make()
    df = table(spark, x, y)
    model = models.fit_logistic(df, models.Penalty(0.01))
    got = models.predict(model, df).orderBy("row_id").collect()
    margin = x @ model.coefficients.toArray() + model.intercept
    np.testing.assert_allclose([r["decision"] for r in got], margin, rtol=1e-9)
    p = np.array([r["probability"] for r in got])
    np.testing.assert_allclose(np.log(p / (1 - p)), margin, rtol=1e-6)
    assert [r["predicted"] for r in got] == (margin > 0).astype(int).tolist()


def test_scaling_dense_and_sparse_agree(spark):
    x = np.array([[1.0, 0.0, 5.0], [3.0, 0.0, 1e6], [0.0, 0.0, 2.0]])
    df = table(spark, x, [0, 1, 0])
    scaler = stats.array_scaler(df)
    expected = x / np.where(x.std(0) == 0, 1, x.std(0))
    dense = models.scale_inputs(df, scaler).orderBy("row_id").collect()
    np.testing.assert_allclose([r["inputs"] for r in dense], expected)
    packed = with_sparse(df.withColumnRenamed("inputs", "a"), "a", "inputs")
    for cap in (False, True):
        sparse = models.scale_inputs(packed, scaler, cap=cap).orderBy("row_id").collect()
        np.testing.assert_allclose([r["inputs"].toArray() for r in sparse], expected)
    assert sparse[2]["inputs"] == Vectors.sparse(3, {2: sparse[2]["inputs"][2]})


def test_training_refuses_empty_validation_and_existing_model(spark, tmp_path):
    x, y = make(60)
    df = table(spark, x, y)
    path = str(tmp_path / "m")
    with pytest.raises(ValueError, match="empty"):
        models.train(df, df.limit(0), models.Penalty(0.1), path)
    model, accuracy = models.train(df, df, models.Penalty(0.1), path)
    assert 0.5 < accuracy.first()["accuracy"] <= 1
    assert LogisticRegressionModel.load(path).coefficients == model.coefficients
    with pytest.raises(Exception, match="already exists"):
        models.train(df, df, models.Penalty(0.1), path)


def test_evaluation_report_equals_hand_counts(spark, tmp_path):
    x, y = make(200)
    df = table(spark, x, y)
    model = models.fit_logistic(df, models.Penalty(0.01))
    path = str(tmp_path / "report")
    row = models.evaluate(model, df, report_path=path).first()
    margin = x @ model.coefficients.toArray() + model.intercept
    predicted = margin > 0
    assert row["tp"] == int((predicted & (y == 1)).sum()) and row["fp"] == int((predicted & (y == 0)).sum())
    assert row["accuracy"] == pytest.approx((predicted == y).mean())
    pairs = margin[y == 1][:, None] - margin[y == 0][None, :]
    assert row["auroc"] == pytest.approx((pairs > 0).mean() + (pairs == 0).mean() / 2)
    assert json.loads(spark.read.text(path).first()[0])["tp"] == row["tp"]


def test_learning_curve_has_a_row_per_size(spark):
    x, y = make(150)
    curve = models.learning_curve(table(spark, x, y), [20, 60], 2, lambda n: models.Penalty.from_inverse(1, n), max_iter=10)
    got = {r["size"]: r for r in curve.collect()}
    assert set(got) == {20, 60}
    assert all(0 <= r["test_mean"] <= 1 and r["test_std"] >= 0 for r in got.values())


def test_training_plan_takes_any_callables(spark, tmp_path):
    x, y = make(120)
    df = table(spark, x, y)
    plan = jobs.TrainingPlan(
        train=lambda s: df,
        valid=lambda s: df,
        penalty=lambda n: models.Penalty.from_inverse(1.0, n),
        metric=lambda scored: stats.accuracy(scored, "target", "predicted"),
        scaler=lambda s: stats.array_scaler(df),
    )
    assert jobs.run_training(spark, plan, str(tmp_path / "run")).first()["n"] == 120


def test_dataset_build_skips_what_is_finished(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("#Chr\tPos\tRef\tAlt\n" + "".join(f"1\t{i}\tA\tC,G\n" for i in range(40)))
    (tmp_path / "x.csv").write_text("".join(f"{1 if i % 2 else -1},{i},0\n" for i in range(40)))
    out = str(tmp_path / "out")
    args = ([str(tmp_path / "v.tsv")], [str(tmp_path / "x.csv")], out)
    built = jobs.build_dataset(spark, *args)
    rows = built["train"].unionByName(built["valid"]).collect()
    assert built["valid"].count() == 12 and len(rows) == 40
    for r in rows:
        i = r["row_id"]
        assert r["variant_id"] == f"1:{i}:A:['C', 'G']"
        assert r["target"] == i % 2 and r["features"].toArray().tolist() == [float(i), 0.0]
    assert built["scaler"].filter("idx = 1").first()["scale"] == 1.0
    (tmp_path / "x.csv").write_text("broken")
    again = jobs.build_dataset(spark, *args)
    assert again["train"].count() == 28


def test_scoring_chain(spark):
    key = "chrom string, pos int, ref string, alt string"
    v = spark.createDataFrame([("1", i, "A", "T") for i in (3, 1, 2, 1)], key)
    known = spark.createDataFrame([("1", 1, "A", "T", 9.0, 90.0)], key + ", raw_score double, scaled_score double")
    notes = spark.createDataFrame([("1", 2, "A", "T", 0.5)], key + ", f double")
    table_ = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0)], "threshold double, scaled double")
    got = jobs.score_variants(
        v, [("p", known)], notes, ["f"], {"f": 2.0},
        lambda df: df.withColumn("raw_score", F.col("f")), table_,
    )
    assert [(r["pos"], r["raw_score"], r["scaled_score"]) for r in got.collect()] == [
        (1, 9.0, 90.0), (2, 0.5, 1.0), (3, 2.0, 2.0),
    ]


def test_stream_restarts_without_doubling(spark, tmp_path):
    schema = "variant_id string, row_id long, x double"
    folder, kept, marks = (str(tmp_path / n) for n in ("in", "store", "marks"))

    def arrive(*data):
        spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(folder)

    def drain():
        source = spark.createDataFrame([], schema).schema
        stream = scoring.file_stream(spark, folder, source, files_per_batch=1)
        query = scoring.score_stream(stream, lambda df: df.withColumn("x", F.col("x") * 2), kept, marks)
        query.awaitTermination()
        return query

    arrive(("a", 0, 1.0), ("b", 1, 2.0))
    arrive(("b", 0, 5.0))
    drain()
    first = store.state(spark, kept)
    assert len(first["folders"]) == 2 and list(first["runs"].values()) == [[1]]
    arrive(("c", 0, 7.0))
    drain()
    drain()
    got = {r["variant_id"]: r["x"] for r in store.latest(spark, kept).collect()}
    assert got["a"] == 2.0 and got["c"] == 14.0 and got["b"] in (4.0, 10.0)
    assert list(store.state(spark, kept)["runs"].values()) == [[2]]
    assert sum(spark.read.parquet(f"{kept}/data/{f['name']}").count() for f in store.state(spark, kept)["folders"]) == 4


def test_stream_scores_with_a_fitted_model(spark, tmp_path):
    x, y = make(80)
    df = table(spark, x, y).withColumn("variant_id", F.concat(F.lit("v"), F.col("row_id").cast("string")))
    model = models.fit_logistic(df, models.Penalty(0.05))
    folder, kept, marks = (str(tmp_path / n) for n in ("in", "store", "marks"))
    df.repartition(3).write.parquet(folder)
    stream = scoring.file_stream(spark, folder, df.schema, files_per_batch=2)

    def score(rows):
        return models.predict(model, rows).select("variant_id", "row_id", "decision")

    scoring.score_stream(stream, score, kept, marks).awaitTermination()
    got = {r["row_id"]: r["decision"] for r in store.latest(spark, kept).collect()}
    margin = x @ model.coefficients.toArray() + model.intercept
    np.testing.assert_allclose([got[i] for i in range(80)], margin, rtol=1e-9)


def test_sparse_and_dense_features_give_the_same_model(spark):
    x, y = make(120)
    x[:, 2] = 0.0
    df = table(spark, x, y)
    packed = with_sparse(df.withColumnRenamed("inputs", "a"), "a", "inputs")
    dense, sparse = (models.fit_logistic(d, models.Penalty(0.05)) for d in (df, packed))
    np.testing.assert_allclose(dense.coefficients.toArray(), sparse.coefficients.toArray(), rtol=1e-6)


def test_prediction_tables_must_share_their_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    assert stats.same_columns([a, a]) == ["x", "y"]
    with pytest.raises(ValueError, match="same columns"):
        stats.same_columns([a, a.select("y", "x")])


def test_batch_model_sees_blocks(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "row_id long, inputs array<double>")
    got = pluggable.predict_batches(df, lambda: lambda x: x.sum(axis=1), 2).collect()
    assert {r["row_id"]: r["predictions"] for r in got} == {i: [i + 1.0] for i in range(50)}
    with pytest.raises(Exception, match="must hold 3 values"):
        pluggable.predict_batches(df, lambda: lambda x: x, 3).collect()


def test_compare_coefficients(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "idx int, coef double")
    pairs = models.compare_coefficients(a, a.withColumn("coef", F.col("coef") * -2))
    assert stats.correlation(pairs, "coef_a", "coef_b").first()["pearson"] == pytest.approx(-1)


def plain_areas(y, s):
    """Areas by trapezoids over the distinct scores."""
    tp = fp = area = slope = 0
    before = None
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    for value in sorted(set(s), reverse=True):
        p, q = int(((s == value) & (y == 1)).sum()), int(((s == value) & (y == 0)).sum())
        tp, fp = tp + p, fp + q
        precision = tp / (tp + fp)
        area += q * (tp - p / 2)
        slope += p * (precision + (precision if before is None else before)) / 2
        before = precision
    return area / (n1 * n0), slope / n1


def test_metrics_with_ties_in_one_pass(spark):
    rng = np.random.default_rng(8)
    for ties in (3, 50, 10**9):
        s = rng.integers(0, ties, 500) / 7 - 1
        y = (rng.random(500) < 1 / (1 + np.exp(-(s - s.mean()) / s.std()))).astype(int)
        data = [(int(a), float(b), int(b > 0)) for a, b in zip(y, s)]
        df = spark.createDataFrame(data, "target int, decision double, predicted int").repartition(5)
        row = models.classification_metrics(df).first()
        assert (row["auroc"], row["auprc"]) == pytest.approx(plain_areas(y, s), rel=1e-12)
        assert row["accuracy"] == pytest.approx((y == (s > 0)).mean())
        assert row["tp"] == int(((s > 0) & (y == 1)).sum()) and row["tn"] == int(((s <= 0) & (y == 0)).sum())
    one = spark.createDataFrame([(1, 0.5, 1)], "target int, decision double, predicted int")
    assert models.classification_metrics(one).first().asDict() == {
        "accuracy": 1.0, "auroc": None, "auprc": 1.0, "tn": 0, "fp": 0, "fn": 0, "tp": 1
    }
    assert models.classification_metrics(one.filter("false")).first()["accuracy"] is None


def test_stochastic_fit_resumes_and_ends_near_the_minimum(spark, tmp_path):
    x, y = make(400)
    data = table(spark, x / x.std(0), y)
    penalty = models.Penalty.from_alpha(0.1)
    dealt = models.deal_batches(data, 4, 3)
    whole = models.fit_stochastic(dealt, penalty, 4, 8, 3)
    half = models.fit_stochastic(dealt, penalty, 4, 3, 3)
    half.save(spark, str(tmp_path / "state"))
    rest = models.fit_stochastic(dealt, penalty, 4, 5, 3, models.Stochastic.load(spark, str(tmp_path / "state")))
    assert rest.epochs == whole.epochs == 8
    assert rest.parameters == pytest.approx(whole.parameters, abs=1e-12)
    again = models.fit_stochastic(models.deal_batches(data, 4, 3), penalty, 4, 8, 3)
    assert again.parameters == pytest.approx(whole.parameters, abs=1e-12)
    best = models.fit_logistic(data, penalty, max_iter=100, tol=1e-12)
    assert whole.parameters == pytest.approx([best.intercept, *best.coefficients.toArray()], abs=0.05)
    other = models.fit_stochastic(dealt, penalty, 4, 1, 4)
    assert other.parameters != models.fit_stochastic(dealt, penalty, 4, 1, 3).parameters
