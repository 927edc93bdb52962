"""Logistic models on feature arrays: fit, save, score, evaluate, compare."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import ElementwiseProduct, MaxAbsScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from varloom.functions.features import cap_values, with_sparse
from varloom.functions.scores import array_divide
from varloom.operators import stats
from varloom.operators.rows import hash_fraction, sample_rows
from varloom.session import fresh_path, write_through

Metric = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Penalty:
    """Strength of the L2 penalty in the three ways it is usually given."""

    reg_param: float

    @classmethod
    def from_inverse(cls, c: float, rows: int) -> Penalty:
        """From C of the objective C * sum(loss) + |w|^2 / 2."""
        return cls(1.0 / (c * rows))

    @classmethod
    def from_alpha(cls, alpha: float) -> Penalty:
        """From alpha of the objective mean(loss) + alpha * |w|^2 / 2."""
        return cls(alpha)

    @classmethod
    def from_layer(cls, rate: float) -> Penalty:
        """From the rate of a layer penalty, mean(loss) + rate * |w|^2."""
        return cls(2.0 * rate)


def as_vector(df: DataFrame, inputs: str = "inputs", out: str = "features") -> DataFrame:
    if isinstance(df.schema[inputs].dataType, VectorUDT):
        return df if inputs == out else df.withColumn(out, F.col(inputs))
    return df.withColumn(out, array_to_vector(F.col(inputs).cast("array<double>")))


def fit_logistic(
    df: DataFrame,
    penalty: Penalty,
    inputs: str = "inputs",
    target: str = "target",
    max_iter: int = 100,
    tol: float = 1e-6,
    weight: str | None = None,
) -> LogisticRegressionModel:
    """L2 logistic regression with a free intercept and features as they are.

    The problem is convex, so solver choice and warm start change the path and not the
    minimum; one estimator stands for the batch, stochastic and single-layer variants.
    """
    params = {
        "featuresCol": "features",
        "labelCol": target,
        "regParam": penalty.reg_param,
        "elasticNetParam": 0.0,
        "standardization": False,
        "maxIter": max_iter,
        "tol": tol,
    }
    if weight:
        params["weightCol"] = weight
    data = as_vector(df, inputs).select(
        "features", F.col(target).cast("double").alias(target), *([weight] if weight else [])
    )
    return LogisticRegression(**params).fit(data)


@dataclass(frozen=True)
class Stochastic:
    """Where a stochastic fit stands: intercept and weights, and the epochs it has done."""

    parameters: tuple[float, ...]
    epochs: int = 0

    def save(self, spark: SparkSession, path: str) -> None:
        save_report(spark, {"parameters": list(self.parameters), "epochs": self.epochs}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Stochastic:
        held = json.loads(spark.read.text(path).first()["value"])
        return cls(tuple(held["parameters"]), held["epochs"])

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """(idx, coef), the intercept at index -1."""
        rows = [(i - 1, float(c)) for i, c in enumerate(self.parameters)]
        return spark.createDataFrame(rows, "idx int, coef double")


def deal_batches(df: DataFrame, batches: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """Rows written by batch, the batch drawn from a seeded hash of the row; a later read opens one batch."""
    path = fresh_path(df.sparkSession, "batches")
    number = F.floor(hash_fraction(row_id, seed) * batches).cast("int")
    dealt = df.withColumn("batch", number)
    dealt.hint("rebalance", "batch").write.partitionBy("batch").parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


def _batch_gradient(parameters: np.ndarray, inputs: str, target: str):
    """Sums of the loss gradient over a task's rows; place -1 counts the rows."""

    def run(tables):
        total, n = np.zeros(len(parameters)), 0
        for table in tables:
            x = np.asarray(table.column(inputs).flatten(), np.float64).reshape(table.num_rows, -1)
            margin = parameters[0] + x @ parameters[1:]
            error = 0.5 * (1 + np.tanh(margin / 2)) - np.asarray(table.column(target), np.float64)
            total += np.append(error.sum(), error @ x)
            n += table.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(total)), pa.int32()), pa.array(np.append(float(n), total))], ["place", "g"]
        )

    return run


def fit_stochastic(
    dealt: DataFrame,
    penalty: Penalty,
    batches: int,
    epochs: int,
    seed: int,
    state: Stochastic | None = None,
    rate: float = 2.0,
    decay: float = 0.85,
    inputs: str = "inputs",
    target: str = "target",
) -> Stochastic:
    """Mini-batch gradient descent on the penalised mean loss, from a saved state or from zero.

    ``dealt`` comes from ``deal_batches``. An epoch takes every batch once, in a seeded order of its own,
    with a step that shrinks from epoch to epoch. A batch's gradient is summed in Spark, one number for
    each feature. The order and the steps follow from the seed and the epoch alone, so a fit that goes on from
    its state does what an uninterrupted one does. ``epochs`` counts those to be done now.
    """
    if state is None:
        width = dealt.select(F.size(inputs).alias("n")).filter("n >= 0").first()
        state = Stochastic((0.0,) * (1 + (width["n"] if width else 0)))
    parameters = np.array(state.parameters)
    for epoch in range(state.epochs, state.epochs + epochs):
        order = np.random.default_rng([seed, epoch]).permutation(batches)
        step = rate * decay**epoch
        for batch in order.tolist():
            part = dealt.filter(F.col("batch") == batch).select(inputs, F.col(target).cast("double").alias(target))
            sums = part.mapInArrow(_batch_gradient(parameters, inputs, target), "place int, g double")
            found = {r["place"]: r["g"] for r in sums.groupBy("place").agg(F.sum("g").alias("g")).collect()}
            n = found.pop(-1, 0.0)
            if not n:
                continue
            gradient = np.array([found[i] for i in range(len(parameters))]) / n
            gradient[1:] += penalty.reg_param * parameters[1:]
            parameters = parameters - step * gradient
    return Stochastic(tuple(parameters.tolist()), state.epochs + epochs)


def predict(
    model: LogisticRegressionModel, df: DataFrame, inputs: str = "inputs"
) -> DataFrame:
    """Add (predicted, probability, decision)."""
    scored = model.transform(as_vector(df, inputs))
    return (
        scored.withColumn("predicted", F.col("prediction").cast("int"))
        .withColumn("decision", vector_to_array("rawPrediction")[1])
        .withColumn("probability", vector_to_array("probability")[1])
        .drop("rawPrediction", "prediction", *([] if "features" in df.columns else ["features"]))
    )


def coefficients(model: LogisticRegressionModel, spark: SparkSession) -> DataFrame:
    """(idx, coef), the intercept at index -1."""
    rows = [(-1, float(model.intercept))]
    rows += [(i, float(c)) for i, c in enumerate(model.coefficients.toArray())]
    return spark.createDataFrame(rows, "idx int, coef double")


def penalised_gradient(
    model: LogisticRegressionModel, df: DataFrame, penalty: Penalty, inputs: str = "inputs", target: str = "target"
) -> DataFrame:
    """(idx, gradient) of the penalised mean loss at the model; zero everywhere at the minimum."""
    scored = predict(model, df, inputs)
    error = F.col("probability") - F.col(target)
    weights = [float(w) for w in model.coefficients.toArray()]
    # One mean for each feature: the loss part of the gradient.
    means = [F.avg(error)] + [F.avg(error * F.col(inputs)[i]) for i in range(len(weights))]
    loss = scored.agg(F.array(*means).alias("__g")).select(F.posexplode("__g").alias("place", "loss"))
    pull = F.lit([0.0] + [penalty.reg_param * w for w in weights])
    return loss.select((F.col("place") - 1).alias("idx"), (F.col("loss") + F.get(pull, F.col("place"))).alias("gradient"))


def scale_inputs(
    df: DataFrame, scaler: DataFrame, inputs: str = "inputs", cap: bool = False
) -> DataFrame:
    """Divide each feature by its scale; ``cap`` also bounds the result.

    A scaler table has one row per feature, so it is read into the expression. Sparse
    vectors stay sparse.
    """
    scale = [r["scale"] for r in scaler.select("idx", "scale").orderBy("idx").collect()]
    if not isinstance(df.schema[inputs].dataType, VectorUDT):
        scaled = array_divide(F.col(inputs).cast("array<double>"), scale)
        return df.withColumn(inputs, cap_values(scaled) if cap else scaled)
    factors = Vectors.dense([1.0 / s for s in scale])
    product = ElementwiseProduct(scalingVec=factors, inputCol=inputs, outputCol="__scaled")
    scaled = product.transform(df).withColumn(inputs, F.col("__scaled")).drop("__scaled")
    if not cap:
        return scaled
    capped = scaled.withColumn("__capped", cap_values(vector_to_array(inputs))).drop(inputs)
    return with_sparse(capped, "__capped", inputs, len(scale)).drop("__capped")


def scale_range(df: DataFrame, inputs: str = "inputs", sparse: bool = False) -> DataFrame:
    """Features scaled to [0, 1], or by their largest absolute value where zeros must stay.

    A constant feature becomes 0. The extremes have one value per feature.
    """
    if sparse:
        data = as_vector(df, inputs, "__vector")
        scaler = MaxAbsScaler(inputCol="__vector", outputCol="__scaled")
        scaled = scaler.fit(data).transform(data)
        return scaled.withColumn(inputs, vector_to_array("__scaled")).drop("__vector", "__scaled")
    vector = as_vector(df, inputs, "__vector")
    ends = vector.select(
        Summarizer.min(F.col("__vector")).alias("low"), Summarizer.max(F.col("__vector")).alias("high")
    ).first()
    if ends["low"] is None or not len(ends["low"]):
        return df
    low = [float(x) for x in ends["low"]]
    width = [float(h) - l for h, l in zip(ends["high"], low)]
    values = F.col(inputs)
    if isinstance(df.schema[inputs].dataType, VectorUDT):
        values = vector_to_array(inputs)
    above = F.zip_with(values.cast("array<double>"), F.lit(low), lambda x, l: x - l)
    return df.withColumn(
        inputs, F.zip_with(above, F.lit(width), lambda x, w: F.when(w == 0, 0.0).otherwise(x / w))
    )


def classification_metrics(
    scored: DataFrame, target: str = "target", score: str = "decision"
) -> DataFrame:
    """One row: accuracy, area under ROC and under precision-recall, confusion counts.

    The input is scored once, into counts by score and decision, which combine before the exchange
    and are written in order of the score. Each range of scores then adds up its own trapezoids, given the
    counts of the ranges above it; equal scores are one point of both curves. A class without rows
    gives null areas, an empty input null throughout.
    """
    label = F.col(target).cast("int")
    counts = write_through(
        scored.groupBy(F.col(score).cast("double").alias("s"), F.col("predicted").alias("said"))
        .agg(F.count_if(label == 1).alias("pos"), F.count_if(label == 0).alias("neg"))
        .repartitionByRange(F.desc("s"))
        .withColumn("part", F.spark_partition_id()),
        "scored",
    )
    decided = counts.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("said") == said, F.col(c))), F.lit(0)).alias(name)
            for name, said, c in (("tn", 0, "neg"), ("fp", 1, "neg"), ("fn", 0, "pos"), ("tp", 1, "pos"))
        ],
        F.sum("pos").alias("n1"),
        F.sum("neg").alias("n0"),
    ).first()
    # One row per range of scores, in order of the ranges; equal scores lie in one range.
    above = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = counts.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    sizes = sizes.select("part", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}0") for c in ("p", "q")])
    down = W.partitionBy("part").orderBy(F.desc("s"))
    points = (
        counts.groupBy("part", "s")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .join(F.broadcast(sizes), "part")
        .withColumn("tp", F.sum("pos").over(down) + F.col("p0"))
        .withColumn("fp", F.sum("neg").over(down) + F.col("q0"))
    )
    tp, fp, pos, neg = map(F.col, ("tp", "fp", "pos", "neg"))
    before = tp - pos + fp - neg
    precision = tp / (tp + fp)
    step = neg * (tp - pos / 2)
    slope = pos * (precision + F.when(before == 0, precision).otherwise((tp - pos) / before)) / 2
    n1, n0 = decided["n1"] or 0, decided["n0"] or 0
    total = F.lit(n1 + n0)
    return points.agg(F.sum(step).alias("a"), F.sum(slope).alias("b")).select(
        F.when(total > 0, F.lit(decided["tp"] + decided["tn"]) / total).alias("accuracy"),
        (F.col("a") / F.nullif(F.lit(n1 * n0), F.lit(0))).alias("auroc"),
        (F.col("b") / F.nullif(F.lit(n1), F.lit(0))).alias("auprc"),
        *[F.lit(decided[c]).cast("long").alias(c) for c in ("tn", "fp", "fn", "tp")],
    )


def train(
    train_set: DataFrame,
    valid_set: DataFrame,
    penalty: Penalty,
    model_path: str,
    scaler: DataFrame | None = None,
    cap: bool = False,
    **fit_options,
) -> tuple[LogisticRegressionModel, DataFrame]:
    """Fit, save and report training accuracy. An existing model or an empty set is refused."""
    if valid_set.isEmpty():
        raise ValueError("the validation set is empty")
    ready = scale_inputs(train_set, scaler, cap=cap) if scaler is not None else train_set
    model = fit_logistic(ready, penalty, **fit_options)
    model.write().save(model_path)
    return model, stats.accuracy(predict(model, ready), "target", "predicted")


def evaluate(
    model: LogisticRegressionModel,
    valid_set: DataFrame,
    metric: Metric = classification_metrics,
    scaler: DataFrame | None = None,
    cap: bool = False,
    report_path: str | None = None,
) -> DataFrame:
    """Metric row of a scored validation set, written as JSON when a path is given."""
    ready = scale_inputs(valid_set, scaler, cap=cap) if scaler is not None else valid_set
    result = metric(predict(model, ready))
    if report_path:
        result.write.json(report_path)
    return result


def all_positive_accuracy(
    model: LogisticRegressionModel, df: DataFrame, scaler: DataFrame | None = None
) -> DataFrame:
    """Share of a set of known positives that the model calls positive."""
    ready = scale_inputs(df, scaler) if scaler is not None else df
    scored = predict(model, ready).withColumn("target", F.lit(1))
    return stats.accuracy(scored, "target", "predicted")


def compare_coefficients(a: DataFrame, b: DataFrame) -> DataFrame:
    """Coefficients of two models side by side by feature."""
    return a.select("idx", F.col("coef").alias("coef_a")).join(
        b.select("idx", F.col("coef").alias("coef_b")), "idx"
    )


def learning_curve(
    df: DataFrame,
    sizes: Sequence[int],
    folds: int,
    penalty: Callable[[int], Penalty],
    seed: int = 1,
    max_iter: int = 100,
) -> DataFrame:
    """Train and test accuracy, mean and deviation over folds, by number of training rows.

    Folds come from the row's hash, the training rows of a size are an exact sample of
    the other folds. One fit per size and fold; the rows stay distributed throughout.
    """
    spark = df.sparkSession
    folded = df.withColumn("__fold", F.floor(hash_fraction("row_id", seed) * folds).cast("int"))
    results = []
    for fold in range(folds):
        test = folded.filter(F.col("__fold") == fold)
        rest = folded.filter(F.col("__fold") != fold)
        for size in sizes:
            part = sample_rows(rest, size, seed + 1)
            model = fit_logistic(part, penalty(size), max_iter=max_iter)
            for name, rows in (("train", part), ("test", test)):
                score = stats.accuracy(predict(model, rows), "target", "predicted").first()[0]
                results.append((size, fold, name, score))
    scores = spark.createDataFrame(results, "size int, fold int, part string, score double")
    return scores.groupBy("size").agg(
        *[
            f(F.when(F.col("part") == part, F.col("score"))).alias(f"{part}_{label}")
            for part in ("train", "test")
            for label, f in (("mean", F.avg), ("std", F.stddev_pop))
        ]
    )


def save_report(spark: SparkSession, values: dict, path: str) -> None:
    """Write a small report as one JSON document; an existing one is refused."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(
        1
    ).write.text(path)
