"""Splits, scaling, models, streams and user functions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from varloom.functions import pluggable, scores as sx, variants as vx
from varloom.functions.features import relabel
from varloom.operators import filters, joins, splits, stats
from varloom.plans import jobs, models, views
from varloom.plans.catalog.order import SHUFFLED_SQL
from varloom.plans.catalog.relations import KEY, conversion, prescored
from varloom.plans.registry import query
from varloom.plans.views import FEATURES, counted_fit, with_views
from varloom.session import fresh_path, range_parts
from varloom.sources import store, writers
from varloom.streaming import scoring

# Fixed linear model of the checkable scoring queries.
WEIGHTS = (0.03, -0.00001, 2.5, -1.5)
BIAS = -0.25


def labelled(spark, d) -> DataFrame:
    """Numbered variants as (row_id, variant_id, target, inputs)."""
    v = views.feature_array(views.numbered(spark, d))
    return v.select("row_id", "variant_id", relabel(F.col("y")).alias("target"), "inputs")


@query(
    "ml01_split",
    with_views(
        SHUFFLED_SQL.format(seed=1)
        + "SELECT row_id, variant_id, shuffled_id < ceil(0.3 * (SELECT count(*) FROM v)) AS is_test FROM s"
    ),
)
def ml01(spark, d):
    v = views.numbered(spark, d).select("row_id", "variant_id")
    return splits.exact_split(v, 0.3, 1)


@query(
    "ml01_hash_split",
    with_views(
        "SELECT row_id, CAST(CASE WHEN substr(md5(concat(CAST(row_id AS VARCHAR), ':42')), 1, 8) < 'b3333334' THEN 0 ELSE 1 END AS INT) AS part FROM v"
    ),
)
def ml01_hash(spark, d):
    return splits.hash_split(views.numbered(spark, d).select("row_id"), [0.7, 0.3], 42)


@query(
    "ml02_split_matrix",
    with_views(
        SHUFFLED_SQL.format(seed=42).replace("variant_id,", "variant_id, y, f0, f1, f2, f3,")
        + "SELECT CASE WHEN shuffled_id < ceil(0.3 * (SELECT count(*) FROM v)) THEN 'valid' ELSE 'train' END AS part,"
        " row_id, variant_id, CASE WHEN y = -1 THEN 0 ELSE y END AS target, f0, f1, f2, f3 FROM s"
    ),
)
def ml02(spark, d):
    path = fresh_path(spark, "split")
    train, valid = splits.train_test(labelled(spark, d), 0.3, 42)
    train.write.parquet(f"{path}/train")
    valid.write.parquet(f"{path}/valid")
    parts = [
        spark.read.parquet(f"{path}/{name}").select(
            F.lit(name).alias("part"),
            "row_id",
            "variant_id",
            "target",
            *[F.col("inputs")[i].alias(f) for i, f in enumerate(FEATURES)],
        )
        for name in ("train", "valid")
    ]
    return parts[0].unionAll(parts[1])


@query(
    "ml03_prefix_split",
    with_views("SELECT row_id, row_id < floor(0.6 * (SELECT count(*) FROM v)) AS is_train FROM v"),
)
def ml03(spark, d):
    return splits.prefix_split(views.numbered(spark, d).select("row_id"), 0.6)


@query(
    "ml04_three_way_split",
    with_views(
        "WITH h AS (SELECT row_id, substr(md5(concat(CAST(row_id AS VARCHAR), ':9')), 1, 8) AS u FROM v) "
        "SELECT row_id, CAST(CASE WHEN u <= 'cccccccc' THEN 0 WHEN u <= 'e6666666' THEN 1 ELSE 2 END AS INT) AS part FROM h"
    ),
)
def ml04(spark, d):
    return splits.hash_split(views.numbered(spark, d).select("row_id"), [0.8, 0.1, 0.1], 9)


@query(
    "ml05_random_split",
    with_views(
        "SELECT CASE WHEN substr(md5(concat(CAST(row_id AS VARCHAR), ':7')), 1, 8) <= 'cccccccc' THEN 'train' ELSE 'test' END AS part,"
        " CASE WHEN y = -1 THEN 0 ELSE y END AS target, count(*) AS n FROM v GROUP BY ALL"
    ),
)
def ml05(spark, d):
    """Seeded random parts that are disjoint and complete whatever the scan does."""
    flagged = splits.hash_split(labelled(spark, d).select("row_id", "target"), [0.8, 0.2], 7)
    part = F.when(F.col("part") == 0, "train").otherwise("test").alias("part")
    return flagged.groupBy(part, "target").agg(F.count("*").alias("n"))


@query(
    "ml06_train_valid_pair",
    with_views(
        SHUFFLED_SQL.format(seed=3).replace("variant_id,", "variant_id, y,")
        + "SELECT CASE WHEN shuffled_id < ceil(0.2 * (SELECT count(*) FROM v)) THEN 'valid' ELSE 'train' END AS part,"
        " count(*) AS rows, count(*) FILTER (y = 1) AS positives FROM s GROUP BY 1"
    ),
)
def ml06(spark, d):
    pair = dict(zip(("train", "valid"), splits.train_test(labelled(spark, d), 0.2, 3)))
    counted = [
        stats.class_balance(p, "target").select(F.lit(n).alias("part"), "rows", "positives")
        for n, p in pair.items()
    ]
    return counted[0].unionAll(counted[1])


SCALED_SQL = """
WITH s AS (SELECT stddev_pop(f0) AS s0, stddev_pop(f1) AS s1, stddev_pop(f2) AS s2, stddev_pop(f3) AS s3 FROM v)
SELECT row_id, round(f0 / s0, 6) AS f0, round(f1 / s1, 6) AS f1, round(f2 / s2, 6) AS f2, round(f3 / s3, 6) AS f3 FROM v, s
"""


@query("ml07_apply_scaler", with_views(SCALED_SQL))
def ml07(spark, d):
    data = labelled(spark, d)
    scaled = models.scale_inputs(data, stats.array_scaler(data), cap=True)
    return scaled.select(
        "row_id", *[F.round(F.col("inputs")[i], 6).alias(f) for i, f in enumerate(FEATURES)]
    )


@query(
    "ml08_scale_range",
    with_views(
        "WITH e AS (SELECT min(f0) AS a0, max(f0) AS b0, min(f1) AS a1, max(f1) AS b1, min(f2) AS a2, max(f2) AS b2,"
        " min(f3) AS a3, max(f3) AS b3 FROM v) "
        "SELECT row_id, round((f0 - a0) / (b0 - a0), 6) AS f0, round((f1 - a1) / (b1 - a1), 6) AS f1,"
        " round((f2 - a2) / (b2 - a2), 6) AS f2, round((f3 - a3) / (b3 - a3), 6) AS f3, CAST(0 AS DOUBLE) AS f4 FROM v, e"
    ),
)
def ml08(spark, d):
    """All features and a constant one."""
    data = labelled(spark, d).withColumn("inputs", F.array_append("inputs", F.lit(7.0)))
    scaled = models.scale_range(data)
    return scaled.select(
        "row_id", *[F.round(F.col("inputs")[i], 6).alias(f) for i, f in enumerate([*FEATURES, "f4"])]
    )


# So small that the fit is the one without penalty to far more digits than are compared.
FREE = models.Penalty(1e-9)
FIT = {"max_iter": 100, "tol": 1e-12}


def _scaled(spark, d) -> DataFrame:
    data = views.signs(spark, d)
    return models.scale_inputs(data, stats.array_scaler(data))


def _rounded(coefs: DataFrame) -> DataFrame:
    return coefs.withColumn("coef", F.round("coef", 3))


@query("ml09_logistic_regression", counted_fit("SELECT idx, round(coef * coalesce(scale, 1), 3) AS coef FROM k"))
def ml09(spark, d):
    data = _scaled(spark, d)
    penalty = models.Penalty.from_inverse(1e6, 1000)
    return _rounded(models.coefficients(models.fit_logistic(data, penalty, **FIT), spark))


# At the minimum of a convex loss, and only there, the gradient is zero.
ZERO_SQL = """
SELECT CAST(idx - 1 AS INT) AS idx, CAST(0 AS DOUBLE) AS gradient, (SELECT count(*) FROM embeddings) AS n_rows
FROM range((SELECT max(len(embedding)) + 1 FROM embeddings)) t(idx)"""


def _wide(spark, d) -> DataFrame:
    """All components of every vector, scaled."""
    data = views.vectors(spark, d).select("row_id", "target", "inputs")
    return models.scale_inputs(data, stats.array_scaler(data))


def _gradient(spark, d, penalty: models.Penalty) -> DataFrame:
    data = _wide(spark, d)
    found = models.penalised_gradient(models.fit_logistic(data, penalty, **FIT), data, penalty)
    return found.withColumn("gradient", F.round("gradient", 5) + 0.0).withColumn("n_rows", F.lit(data.count()).cast("long"))


@query("ml09_wide_fit", ZERO_SQL)
def ml09_wide(spark, d):
    return _gradient(spark, d, models.Penalty.from_inverse(0.1, views.vectors(spark, d).count()))


@query("ml10_stochastic_penalty", ZERO_SQL)
def ml10(spark, d):
    return _gradient(spark, d, models.Penalty.from_alpha(0.01))


@query(
    "ml10_stochastic_fit",
    "SELECT CAST(idx - 1 AS INT) AS idx, true AS near FROM range((SELECT max(len(embedding)) + 1 FROM embeddings)) t(idx)",
)
def ml10_fit(spark, d):
    """Fifteen epochs of four batches, stopped and resumed once: within 0.03 of the penalised minimum."""
    penalty, data = models.Penalty.from_alpha(0.1), _wide(spark, d)
    dealt = models.deal_batches(data, 4, 1)
    state, path = models.fit_stochastic(dealt, penalty, 4, 8, 1), fresh_path(spark, "state")
    state.save(spark, path)
    state = models.fit_stochastic(dealt, penalty, 4, 7, 1, models.Stochastic.load(spark, path))
    best = models.coefficients(models.fit_logistic(data, penalty, **FIT), spark)
    both = models.compare_coefficients(state.coefficients(spark), best)
    return both.select("idx", (F.abs(F.col("coef_a") - F.col("coef_b")) < 0.03).alias("near"))


@query("ml11_layer_penalty", ZERO_SQL)
def ml11(spark, d):
    return _gradient(spark, d, models.Penalty.from_layer(0.015))


@query(
    "ml12_train",
    counted_fit(
        "SELECT round(avg(CAST((p > 0.5) = (target = 1) AS DOUBLE)), 9) AS accuracy, count(*) AS n"
        " FROM e JOIN g USING (x, z) WHERE NOT is_test",
        "NOT is_test",
    ),
)
def ml12(spark, d):
    train, valid = splits.train_test(views.signs(spark, d), 0.3, 42)
    scaler = stats.array_scaler(train)
    _, accuracy = models.train(train, valid, FREE, fresh_path(spark, "model"), scaler, **FIT)
    return accuracy.withColumn("accuracy", F.round("accuracy", 9))


METRICS_SQL = """,
c AS (SELECT p, sum(target) AS pos, count(*) - sum(target) AS neg FROM e JOIN g USING (x, z) WHERE is_test GROUP BY p),
q AS (SELECT p, pos, neg, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER () AS n1, sum(neg) OVER () AS n0
      FROM c WINDOW o AS (ORDER BY p DESC)),
r AS (SELECT *, tp / n1 AS recall, tp / (tp + fp) AS prec, lag(tp / n1, 1, 0) OVER (ORDER BY p DESC) AS recall0,
             lag(tp / (tp + fp)) OVER (ORDER BY p DESC) AS prec0 FROM q)
SELECT round(sum(CASE WHEN p > 0.5 THEN pos ELSE neg END) / sum(pos + neg), 9) AS accuracy,
       round(sum(neg * (tp - pos + 0.5 * pos)) / max(n1 * n0), 6) AS auroc,
       round(sum((recall - recall0) * (prec + coalesce(prec0, prec)) / 2), 6) AS auprc,
       CAST(sum(neg) FILTER (p <= 0.5) AS BIGINT) AS tn, CAST(sum(neg) FILTER (p > 0.5) AS BIGINT) AS fp,
       CAST(sum(pos) FILTER (p <= 0.5) AS BIGINT) AS fn, CAST(sum(pos) FILTER (p > 0.5) AS BIGINT) AS tp
FROM r"""


@query("ml13_evaluate", counted_fit(METRICS_SQL, "NOT is_test").replace("FROM w, s)\n,", "FROM w, s),"))
def ml13(spark, d):
    train, valid = splits.train_test(views.signs(spark, d), 0.3, 42)
    scaler = stats.array_scaler(train)
    model = models.fit_logistic(models.scale_inputs(train, scaler), FREE, **FIT)
    found = models.evaluate(model, valid, scaler=scaler, report_path=fresh_path(spark, "evaluation"))
    areas = {c: F.round(c, 6) for c in ("auroc", "auprc")}
    return found.withColumns({"accuracy": F.round("accuracy", 9), **areas})


@query("ml14_train_stacked_sources", counted_fit("SELECT idx, round(coef, 3) AS coef FROM k"))
def ml14(spark, d):
    def block(first: int, size: int, *more: str):
        def read(s):
            return views.signs(s, d).select("row_id", *more, F.slice("inputs", first, size).alias("inputs"))

        return read

    stacked = jobs.assemble(spark, [block(1, 1, "target"), block(2, 2)])
    return _rounded(models.coefficients(models.fit_logistic(stacked, FREE, **FIT), spark))


@query(
    "ml15_predict",
    counted_fit(
        "SELECT row_id, CAST(p > 0.5 AS INT) AS predicted, round(p, 3) AS probability,"
        " round(ln(p / (1 - p)), 3) AS decision FROM e JOIN g USING (x, z)"
    ),
)
def ml15(spark, d):
    data = _scaled(spark, d)
    scored = models.predict(models.fit_logistic(data, FREE, **FIT), data)
    return scored.select(
        "row_id", "predicted", *[F.round(c, 3).alias(c) for c in ("probability", "decision")]
    )


MARGIN_SQL = "-0.25::DOUBLE + f0 * 0.03::DOUBLE + f1 * -0.00001::DOUBLE + f2 * 2.5::DOUBLE + f3 * -1.5::DOUBLE"


@query(
    "ml16_linear_score",
    with_views(
        f"SELECT row_id, round({MARGIN_SQL}, 9) AS decision, round(1 / (1 + exp(-({MARGIN_SQL}))), 9) AS probability FROM v"
    ),
)
def ml16(spark, d):
    margin = sx.linear_margin([F.col(f) for f in FEATURES], WEIGHTS, BIAS)
    return views.numbered(spark, d).select(
        "row_id",
        F.round(margin, 9).alias("decision"),
        F.round(sx.sigmoid(margin), 9).alias("probability"),
    )


@query(
    "ml16_array_score",
    with_views(f"SELECT row_id, round({MARGIN_SQL}, 9) AS decision FROM v"),
)
def ml16_array(spark, d):
    margin = sx.array_margin(F.col("inputs"), WEIGHTS, BIAS)
    return labelled(spark, d).select("row_id", F.round(margin, 9).alias("decision"))


PAIRS_SQL = """
WITH x AS (SELECT label >= 5 AS hi, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS idx, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
p AS (SELECT idx, avg(x) FILTER (hi) AS coef_a, avg(x) FILTER (NOT hi) AS coef_b FROM x GROUP BY idx)
SELECT idx, round(coef_a, 6) AS coef_a, round(coef_b, 6) AS coef_b, round((SELECT corr(coef_a, coef_b) FROM p), 6) AS pearson FROM p
"""


@query("ml17_compare_models", PAIRS_SQL)
def ml17(spark, d):
    x = views.vectors(spark, d)

    def centre(target):
        means = stats.array_scaler(x.filter(F.col("target") == target))
        return means.select("idx", F.col("mean").alias("coef"))

    pairs = models.compare_coefficients(centre(1), centre(0))
    pearson = stats.correlation(pairs, "coef_a", "coef_b").select("pearson").scalar()
    return pairs.select(
        "idx",
        F.round("coef_a", 6).alias("coef_a"),
        F.round("coef_b", 6).alias("coef_b"),
        F.round(pearson, 6).alias("pearson"),
    )


@query(
    "ml18_all_positive_accuracy",
    counted_fit(
        "SELECT round(avg(CAST(p > 0.5 AS DOUBLE)), 9) AS accuracy, count(*) AS n FROM e JOIN g USING (x, z) WHERE target = 1"
    ),
)
def ml18(spark, d):
    x = views.signs(spark, d)
    scaler = stats.array_scaler(x)
    model = models.fit_logistic(models.scale_inputs(x, scaler), FREE, **FIT)
    positives, _ = filters.split_classes(x)
    found = models.all_positive_accuracy(model, positives, scaler)
    return found.withColumn("accuracy", F.round("accuracy", 9))


@query(
    "ml19_synthetic_positives",
    with_views(
        "SELECT row_id, CASE WHEN substr(md5(concat(CAST(row_id AS VARCHAR), ':11')), 1, 8) <= '33333333' THEN 1"
        " ELSE CASE WHEN y = -1 THEN 0 ELSE y END END AS target FROM v"
    ),
)
def ml19(spark, d):
    return splits.synthetic_positives(labelled(spark, d), 0.2, 11).select("row_id", "target")


@query(
    "ml20_build_dataset",
    with_views(
        SHUFFLED_SQL.format(seed=42).replace("variant_id,", "variant_id, y, f0, f1, f2, f3,")
        + "SELECT CASE WHEN shuffled_id < ceil(0.3 * (SELECT count(*) FROM v)) THEN 'valid' ELSE 'train' END AS part,"
        " row_id, variant_id, CAST(CASE WHEN y = -1 THEN 0 ELSE y END AS DOUBLE) AS target, CAST(NULL AS INT) AS idx,"
        " f0, f1, f2, f3, NULL AS scale FROM s UNION ALL SELECT 'scaler', NULL, NULL, NULL, CAST(unnest(range(4)) AS INT), NULL, NULL, NULL,"
        " NULL, round(unnest([stddev_pop(f0), stddev_pop(f1), stddev_pop(f2), stddev_pop(f3)]), 6) FROM s"
        " WHERE shuffled_id >= ceil(0.3 * (SELECT count(*) FROM v))"
    ),
)
def ml20(spark, d):
    """Ids, targets and features of both sets, and the scaler of the train set."""
    path = fresh_path(spark, "build")
    v = views.numbered(spark, d)
    ordered = v.repartitionByRange(*range_parts(v), "row_id").sortWithinPartitions("row_id")
    names = jobs.VARIANT_COLUMNS["GRCh37"]
    writers.write_tabbed(
        ordered.select(*[F.col(c).alias(n) for c, n in zip(KEY, names)], "flag"),
        f"{path}/variants",
        header=True,
    )
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ["y", *FEATURES]])
    ordered.select(line.alias("value")).write.text(f"{path}/rows")
    built = jobs.build_dataset(
        spark, [f"{path}/variants"], [f"{path}/rows"], f"{path}/out", names
    )
    return reduce(
        DataFrame.unionAll,
        [
            *[
                built[p].select(
                    F.lit(p).alias("part"),
                    "row_id",
                    "variant_id",
                    "target",
                    F.lit(None).cast("int").alias("idx"),
                    *[vector_to_array("features")[i].alias(f) for i, f in enumerate(FEATURES)],
                    F.lit(None).cast("double").alias("scale"),
                )
                for p in ("train", "valid")
            ],
            built["scaler"].select(
                F.lit("scaler"),
                *[F.lit(None).cast(t) for t in ("long", "string", "double")],
                "idx",
                *[F.lit(None).cast("double") for _ in FEATURES],
                F.round("scale", 6),
            ),
        ],
    )


CHAIN_SQL = """
WITH u AS (SELECT DISTINCT chrom, pos, ref, alt FROM v),
a AS (SELECT chrom, pos, ref, alt, min(f1) AS s FROM v WHERE status = 'F' AND flag = 'A' GROUP BY ALL),
b AS (SELECT chrom, pos, ref, alt, min(f1) AS s FROM v WHERE flag <> 'N' GROUP BY ALL),
n AS (SELECT chrom, pos, ref, alt, min(CASE WHEN status = 'F' THEN f0 END) AS f0 FROM v GROUP BY ALL),
t AS (SELECT p_retailprice AS threshold, max(CAST(p_size AS DOUBLE)) AS scaled FROM part GROUP BY 1),
k AS (SELECT u.*, coalesce(a.s, b.s) AS known, coalesce(n.f0, 25) * 40 AS fresh FROM u
      LEFT JOIN a USING (chrom, pos, ref, alt) LEFT JOIN b USING (chrom, pos, ref, alt) LEFT JOIN n USING (chrom, pos, ref, alt))
SELECT chrom, pos, ref, alt, coalesce(known, fresh) AS raw_score,
       CASE WHEN known IS NOT NULL THEN 1 ELSE scaled END AS scaled_score
FROM k ASOF LEFT JOIN t ON k.fresh >= t.threshold
"""


@query("ml21_score_variants", with_views(CHAIN_SQL))
def ml21(spark, d):
    v = views.variants(spark, d)
    known = [(n, t.withColumn("scaled_score", F.lit(1.0))) for n, t in prescored(v)]
    # A variant without a measured row has no annotation; the left join then gives the null that the default fills.
    annotations = v.filter("status = 'F'").groupBy(*joins.GROUP_KEY).agg(F.min("f0").alias("f0"))
    return jobs.score_variants(
        v,
        known,
        annotations,
        ["f0"],
        {"f0": 25.0},
        lambda df: df.withColumn("raw_score", F.col("f0") * 40),
        conversion(spark, d),
    )


STREAM_SQL = """
WITH b AS (
  SELECT CASE WHEN status = 'F' THEN 0 ELSE 2 END AS part, variant_id, row_id, f0, f1 FROM v
  UNION ALL SELECT 1, variant_id, row_id, f1, f0 FROM v WHERE flag = 'R'
  UNION ALL SELECT 3, variant_id, row_id, f0, f1 FROM v WHERE flag = 'R' AND row_id % 2 = 0)
SELECT variant_id, row_id, {score} AS {name} FROM b
QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY part DESC, row_id DESC) = 1
"""


def _streamed(spark, d, write) -> DataFrame:
    """Three runs into one store, each with its own checkpoint; ids stand in several files.

    The first run goes on with a further file after the two others have written.
    """
    v = views.numbered(spark, d).select("variant_id", "row_id", "f0", "f1", "status", "flag")
    turned = v.withColumns({"f0": F.col("f1"), "f1": F.col("f0")})
    kept = fresh_path(spark, "store")
    places = {run: (fresh_path(spark, "incoming"), fresh_path(spark, "checkpoint")) for run in "abc"}
    for run, part in (
        ("a", v.filter("status = 'F'")),
        ("b", turned.filter("flag = 'R'")),
        ("c", v.filter("status <> 'F'")),
        ("a", v.filter("flag = 'R' AND row_id % 2 = 0")),
    ):
        folder, marks = places[run]
        rows = part.select("variant_id", "row_id", "f0")
        rows.write.mode("append").parquet(folder)
        write(scoring.file_stream(spark, folder, rows.schema), kept, marks).awaitTermination()
    return store.latest(spark, kept)


@query("str01_stream_upsert", with_views(STREAM_SQL.format(score="f0", name="f0")))
def str01(spark, d):
    return _streamed(spark, d, scoring.into_store)


@query("str02_stream_scores", with_views(STREAM_SQL.format(score="f0 * 2", name="score")))
def str02(spark, d):
    def score(df: DataFrame) -> DataFrame:
        return df.select("variant_id", "row_id", (F.col("f0") * 2).alias("score"))

    return _streamed(spark, d, lambda stream, kept, marks: scoring.score_stream(stream, score, kept, marks))


@query("udf01_column_function", with_views("SELECT variant_id, length(ref) + length(alt) AS size FROM v"))
def udf01(spark, d):
    def size(ref: pd.Series, alt: pd.Series) -> pd.Series:
        return ref.str.len() + alt.str.len()

    fn = pluggable.column_function(size, "bigint")
    return views.variants(spark, d).select("variant_id", fn("ref", "alt").alias("size"))


@query("udf02_partition_function", with_views("SELECT variant_id, f0 + f2 AS total FROM v"))
def udf02(spark, d):
    def add(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"variant_id": batch["variant_id"], "total": batch["f0"] + batch["f2"]})

    v = views.variants(spark, d).select("variant_id", "f0", "f2")
    return pluggable.partition_function(v, add, "variant_id string, total double")


@query(
    "udf03_batch_model",
    with_views(f"SELECT row_id, round({MARGIN_SQL}, 9) AS p0, round(2 * ({MARGIN_SQL}), 9) AS p1 FROM v"),
)
def udf03(spark, d):
    weights, bias = WEIGHTS, BIAS

    def load():
        block = np.outer(np.array(weights), [1.0, 2.0])
        return lambda x: x @ block + np.array([bias, 2 * bias])

    scored = pluggable.predict_batches(labelled(spark, d).select("row_id", "inputs"), load, 4)
    return scored.select(
        "row_id", *[F.round(F.col("predictions")[i], 9).alias(f"p{i}") for i in (0, 1)]
    )


@query(
    "udf04_score_set",
    with_views(
        "WITH p AS (SELECT variant_id, f0 / 51 AS r, (51 - f0) / 52 AS a FROM v) SELECT variant_id,"
        " round(a - r, 9) AS diff, round(ln(r / (1 - r)), 9) AS ref_logit FROM p"
    ),
)
def udf04(spark, d):
    f0 = F.col("f0")
    chosen = pluggable.score_set(
        {"diff": ("diff", "mean"), "ref_logit": ("logit_ref", "max")},
        F.array(f0 / 51),
        F.array((51 - f0) / 52),
    )
    return views.variants(spark, d).select(
        "variant_id", *[F.round(c[0], 9).alias(n) for n, c in chosen.items()]
    )


@query(
    "udf05_training_plan",
    counted_fit(
        "SELECT count(*) FILTER (target = 0 AND p <= 0.5) AS tn, count(*) FILTER (target = 0 AND p > 0.5) AS fp,"
        " count(*) FILTER (target = 1 AND p <= 0.5) AS fn, count(*) FILTER (target = 1 AND p > 0.5) AS tp"
        " FROM e JOIN g USING (x, z) WHERE is_test",
        "NOT is_test",
    ),
)
def udf05(spark, d):
    def part(is_test: bool):
        def read(s):
            flagged = splits.exact_split(views.signs(s, d), 0.3, 42)
            return flagged.filter(F.col("is_test") == is_test).drop("is_test")

        return read

    plan = jobs.TrainingPlan(
        train=part(False),
        valid=part(True),
        penalty=lambda n: models.Penalty.from_inverse(1e9, n),
        metric=lambda scored: stats.confusion(scored, "target", "predicted"),
        scaler=lambda s: stats.array_scaler(part(False)(s)),
        fit_options=FIT,
    )
    return jobs.run_training(spark, plan, fresh_path(spark, "run"))


@query(
    "udf06_readers",
    with_views(
        "SELECT v.row_id, f0, value FROM v JOIN events ON v.row_id = event_id"
    ),
)
def udf06(spark, d):
    sources = [
        lambda s: views.numbered(s, d).select("row_id", F.array("f0").alias("inputs")),
        lambda s: views.predictions(s, d).select("row_id", F.array("value").alias("inputs")),
    ]
    read = [source(spark) for source in sources]
    # The tables differ in length, so each is cut to the rows of the other before they are stacked.
    stacked = joins.hstack([joins.subset(read[0], read[1], "row_id"), joins.subset(read[1], read[0], "row_id")])
    return stacked.select(
        "row_id", F.col("inputs")[0].alias("f0"), F.col("inputs")[1].alias("value")
    )


FLAGSHIP_SQL = f"""
WITH s AS (SELECT row_id, chrom, CASE WHEN y = -1 THEN 0 ELSE y END AS target,
                  least(f0, 65500) AS f0, least(f1, 65500) AS f1, f2, f3,
                  row_number() OVER (ORDER BY md5(concat(CAST(row_id AS VARCHAR), ':42')), row_id) - 1
                    < ceil(0.3 * (SELECT count(*) FROM v)) AS is_test FROM v),
t AS (SELECT stddev_pop(f0) AS s0, stddev_pop(f1) AS s1, stddev_pop(f2) AS s2, stddev_pop(f3) AS s3 FROM s WHERE NOT is_test),
p AS (SELECT chrom, target, CAST(0.1 + 0.4 * f0 / s0 - 0.3 * f1 / s1 + 0.2 * f2 / s2 - 0.2 * f3 / s3 > 0 AS INT) AS predicted
      FROM s, t WHERE is_test)
SELECT chrom, count(*) FILTER (target <> 1 AND predicted <> 1) AS tn, count(*) FILTER (target <> 1 AND predicted = 1) AS fp,
       count(*) FILTER (target = 1 AND predicted <> 1) AS fn, count(*) FILTER (target = 1 AND predicted = 1) AS tp
FROM p GROUP BY chrom
"""


@query("flagship_score_by_chromosome", with_views(FLAGSHIP_SQL))
def flagship(spark, d):
    """Ids, target, cap, split, scaler, linear score, confusion by chromosome."""
    v = views.numbered(spark, d)
    name = vx.variant_id_from_alt(*[F.col(c) for c in KEY]).alias("variant_id")
    capped = [F.least(F.col(f), F.lit(65500.0)).alias(f) for f in FEATURES]
    rows = v.select("row_id", name, relabel(F.col("y")).alias("target"), *capped)
    flagged = splits.exact_split(rows, 0.3, 42)
    scaler = stats.column_scaler(flagged.filter(~F.col("is_test")), FEATURES)
    scale = {r["column"]: r["scale"] for r in scaler.collect()}
    scaled = [F.col(f) / scale[f] for f in FEATURES]
    margin = sx.linear_margin(scaled, (0.4, -0.3, 0.2, -0.2), 0.1)
    scored = flagged.filter("is_test").select(
        vx.parse_variant_id(F.col("variant_id"))["chrom"].alias("chrom"),
        "target",
        (margin > 0).cast("int").alias("predicted"),
    )
    return stats.confusion(scored, "target", "predicted", by=["chrom"])

