"""Aggregates and table statistics. Sums of doubles are rounded: engines add in another order."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import rows, stats
from varloom.plans import models, views
from varloom.plans.registry import query
from varloom.plans.views import FEATURES, SIGNS_SQL, with_views

LABEL_COUNTS = """
count(*) FILTER (quality <> {c} AND toxic <> {c}) AS tn, count(*) FILTER (quality <> {c} AND toxic = {c}) AS fp,
count(*) FILTER (quality = {c} AND toxic <> {c}) AS fn, count(*) FILTER (quality = {c} AND toxic = {c}) AS tp
"""


@query("ag01_confusion", f"SELECT {LABEL_COUNTS.format(c=1)} FROM labels")
def ag01(spark, d):
    return stats.confusion(views.table(spark, d, "labels"), "quality", "toxic")


@query(
    "ag02_confusion_over_labels",
    f"""SELECT CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
               CAST(sum(tp) AS BIGINT) AS tp
        FROM (SELECT {LABEL_COUNTS.format(c=0)} FROM labels UNION ALL SELECT {LABEL_COUNTS.format(c=1)} FROM labels)""",
)
def ag02(spark, d):
    return stats.confusion_over_labels(
        views.table(spark, d, "labels"), "quality", "toxic", [0, 1]
    )


@query(
    "ag03_accuracy",
    "SELECT avg(CAST(quality = toxic AS DOUBLE)) AS accuracy, count(*) AS n FROM labels",
)
def ag03(spark, d):
    return stats.accuracy(views.table(spark, d, "labels"), "quality", "toxic")


@query(
    "ag04_accuracy_by_class",
    "SELECT quality, avg(CAST(quality = toxic AS DOUBLE)) AS accuracy, count(*) AS n FROM labels GROUP BY quality",
)
def ag04(spark, d):
    return stats.accuracy(views.table(spark, d, "labels"), "quality", "toxic", ["quality"])


METRICS_SQL = """
WITH s AS (SELECT CASE WHEN y = -1 THEN 0 ELSE 1 END AS t, f0 - 25 AS score FROM v),
g AS (SELECT score, sum(t) AS p, count(*) - sum(t) AS q FROM s GROUP BY score),
c AS (SELECT score, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq
      FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, lag(tp, 1, 0) OVER (ORDER BY score DESC) AS tp0, lag(fp, 1, 0) OVER (ORDER BY score DESC) AS fp0 FROM c),
a AS (SELECT sum((fp - fp0) * (tp + tp0) / 2.0) / max(np) / max(nq) AS auroc,
             sum((tp - tp0) / np * (tp / (tp + fp) +
                 CASE WHEN tp0 + fp0 = 0 THEN tp / (tp + fp) ELSE tp0 / (tp0 + fp0) END) / 2) AS auprc FROM r)
SELECT round(avg(CAST(t = CAST(score > 0 AS INT) AS DOUBLE)), 9) AS accuracy,
       round((SELECT auroc FROM a), 9) AS auroc, round((SELECT auprc FROM a), 9) AS auprc,
       count(*) FILTER (t = 0 AND score <= 0) AS tn, count(*) FILTER (t = 0 AND score > 0) AS fp,
       count(*) FILTER (t = 1 AND score <= 0) AS fn, count(*) FILTER (t = 1 AND score > 0) AS tp
FROM s
"""


@query("ag05_classification_metrics", with_views(METRICS_SQL))
def ag05(spark, d):
    scored = views.variants(spark, d).select(
        F.when(F.col("y") == -1, 0).otherwise(1).alias("target"),
        (F.col("f0") - 25).alias("decision"),
        (F.col("f0") > 25).cast("int").alias("predicted"),
    )
    rounded = {c: F.round(c, 9) for c in ("accuracy", "auroc", "auprc")}
    return models.classification_metrics(scored).withColumns(rounded)


@query(
    "ag06_class_balance",
    with_views(
        "SELECT count(*) FILTER (y = 1) AS positives, count(*) AS rows, round(avg(CAST(y = 1 AS DOUBLE)), 9) AS ratio FROM v"
    ),
)
def ag06(spark, d):
    balance = stats.class_balance(views.variants(spark, d), "y")
    return balance.withColumn("ratio", F.round("ratio", 9))


SUMMARY_SQL = " UNION ALL ".join(
    f"""SELECT '{f}' AS "column", count({f}) AS count, round(avg({f}), 4) AS mean, round(stddev_samp({f}), 4) AS std,
        min({f}) AS min, round(quantile_cont({f}, 0.25), 6) AS p25, round(quantile_cont({f}, 0.5), 6) AS p50,
        round(quantile_cont({f}, 0.75), 6) AS p75, max({f}) AS max FROM v"""
    for f in FEATURES
)


@query("ag07_summary", with_views(SUMMARY_SQL))
def ag07(spark, d):
    table = stats.summary(views.variants(spark, d), FEATURES)
    quarters = {c: F.round(c, 6) for c in ("p25", "p50", "p75")}
    return table.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4), **quarters})


@query(
    "ag07_array_summary",
    """WITH x AS (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS idx, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
       SELECT idx, count(*) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min,
              round(quantile_cont(x, 0.25), 9) AS p25, round(quantile_cont(x, 0.5), 9) AS p50,
              round(quantile_cont(x, 0.75), 9) AS p75, max(x) AS max
       FROM x GROUP BY idx""",
)
def ag07_array(spark, d):
    """Every position of the wide rows; quartiles are exact at any size, with linear interpolation."""
    table = stats.array_summary(views.vectors(spark, d))
    quarters = {f"p{p}": F.round(F.col("quartiles")[i], 9) for i, p in enumerate((25, 50, 75))}
    return table.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6), **quarters}).select(
        "idx", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


SCALER_SQL = " UNION ALL ".join(
    f"""SELECT '{f}' AS "column", round(avg({f}), 4) AS mean, round(var_pop({f}) / 1000, 3) AS var_k,
        round(CASE WHEN var_pop({f}) = 0 THEN 1 ELSE sqrt(var_pop({f})) END, 4) AS scale FROM v"""
    for f in FEATURES
)


@query("ag08_scaler", with_views(SCALER_SQL))
def ag08(spark, d):
    scaler = stats.column_scaler(views.variants(spark, d), FEATURES)
    return scaler.select(
        "column",
        F.round("mean", 4).alias("mean"),
        F.round(F.col("var") / 1000, 3).alias("var_k"),
        F.round("scale", 4).alias("scale"),
    )


@query(
    "ag08_array_scaler",
    """SELECT idx, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var, round(stddev_pop(x), 6) AS scale
       FROM (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS idx, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
       GROUP BY idx""",
)
def ag08_array(spark, d):
    scaler = stats.array_scaler(views.vectors(spark, d))
    return scaler.withColumns({c: F.round(c, 6) for c in ("mean", "var", "scale")})


@query(
    "ag09_density",
    with_views(
        "SELECT count(*) * 4 AS cells, CAST(sum((f0 <> 0)::INT + (f1 <> 0)::INT + (f2 <> 0)::INT + (f3 <> 0)::INT) AS BIGINT) AS nonzero,"
        " round(sum((f0 <> 0)::INT + (f1 <> 0)::INT + (f2 <> 0)::INT + (f3 <> 0)::INT) / (count(*) * 4), 9) AS density,"
        " round(1 - sum((f0 <> 0)::INT + (f1 <> 0)::INT + (f2 <> 0)::INT + (f3 <> 0)::INT) / (count(*) * 4), 9) AS sparsity FROM v"
    ),
)
def ag09(spark, d):
    table = stats.density(views.feature_array(views.variants(spark, d)))
    return table.withColumns({c: F.round(c, 9) for c in ("density", "sparsity")})


@query(
    "ag10_correlation",
    with_views("SELECT round(corr(f0, f1), 6) AS pearson, count(*) AS n FROM v"),
)
def ag10(spark, d):
    table = stats.correlation(views.variants(spark, d), "f0", "f1")
    return table.withColumn("pearson", F.round("pearson", 6))


HISTOGRAM_SQL = """
WITH e AS (SELECT min(f1) AS low, max(f1) AS high FROM v)
SELECT CAST(bins AS INT) AS bins, CAST(least(floor((f1 - low) / (high - low) * bins), bins - 1) AS INT) AS bin, count(*) AS n
FROM v, e, (VALUES (30), (60)) AS b(bins) GROUP BY 1, 2
"""


@query("ag11_histogram", with_views(HISTOGRAM_SQL))
def ag11(spark, d):
    v = views.variants(spark, d)
    thirty, sixty = (
        stats.histogram(v, "f1", n).select(F.lit(n).alias("bins"), "bin", "n") for n in (30, 60)
    )
    return thirty.unionAll(sixty)


@query("ag12_row_count", "SELECT count(*) AS n FROM lineitem")
def ag12(spark, d):
    return views.variants(spark, d).agg(F.count("*").alias("n"))


DISTINCT_COLUMNS = ["chrom", "ref", "alt", *FEATURES]


@query(
    "ag13_distinct_counts",
    with_views(
        " UNION ALL ".join(
            f'SELECT \'{c}\' AS "column", count(DISTINCT {c}) AS n_distinct FROM v'
            for c in DISTINCT_COLUMNS
        )
    ),
)
def ag13(spark, d):
    return stats.distinct_counts(views.variants(spark, d), DISTINCT_COLUMNS)


@query(
    "ag13_array_distinct_counts",
    """SELECT idx, count(DISTINCT x) AS n_distinct
       FROM (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS idx, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
       GROUP BY idx""",
)
def ag13_array(spark, d):
    return stats.array_distinct_counts(views.vectors(spark, d))


def _altered(v):
    """Copy with f2 moved slightly everywhere and f3 moved clearly in one class."""
    changed = F.when(F.col("flag") == "R", F.col("f3") + 1).otherwise(F.col("f3"))
    return v.select(
        "row_id", F.array("f0", F.col("f2") * (1 + 1e-7), changed).alias("inputs")
    )


@query(
    "ag14_differing_cells",
    with_views(
        "SELECT row_id, CAST(1 AS INT) AS idx, f2 AS left_value, f2 * (1 + 1e-7) AS right_value FROM v WHERE f2 <> f2 * (1 + 1e-7)"
        " UNION ALL SELECT row_id, 2, f3, f3 + 1 FROM v WHERE flag = 'R'"
    ),
)
def ag14(spark, d):
    v = views.numbered(spark, d)
    return stats.differing_cells(
        v.select("row_id", F.array("f0", "f2", "f3").alias("inputs")), _altered(v)
    )


@query(
    "ag14_cells_beyond_tolerance",
    with_views(
        "SELECT row_id, CAST(2 AS INT) AS idx, f3 AS left_value, f3 + 1 AS right_value FROM v WHERE flag = 'R'"
    ),
)
def ag14_tolerance(spark, d):
    v = views.numbered(spark, d)
    left = v.select("row_id", F.array("f0", "f2", "f3").alias("inputs"))
    return stats.differing_cells(left, _altered(v), rtol=1e-5, atol=1e-7)


@query(
    "ag15_strongest_effect",
    """SELECT user_id, event_id AS row_id, value - 20 AS effect FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 20) DESC, event_id) = 1""",
)
def ag15(spark, d):
    p = views.table(spark, d, "events").select(
        "user_id", F.col("event_id").alias("row_id"), (F.col("value") - 20).alias("effect")
    )
    return stats.strongest_effect(p, "user_id", "effect")


@query(
    "ag16_mean_batch_accuracy",
    with_views(
        "SELECT round(avg(a), 9) AS mean_accuracy, count(*) AS n_batches FROM "
        "(SELECT row_id // 256 AS b, avg(CAST((y = 1) = (f0 > 25) AS DOUBLE)) AS a FROM v GROUP BY 1)"
    ),
)
def ag16(spark, d):
    batched = rows.with_batches(views.numbered(spark, d), 256)
    scored = batched.select(
        "batch_id",
        (F.col("y") == 1).cast("int").alias("target"),
        (F.col("f0") > 25).cast("int").alias("predicted"),
    )
    mean = stats.mean_batch_accuracy(scored, "target", "predicted")
    return mean.withColumn("mean_accuracy", F.round("mean_accuracy", 9))


CURVE_SQL = f"""
WITH {SIGNS_SQL.strip()},
f AS (SELECT *, CAST(floor(CAST('0x' || substr(md5(concat(CAST(row_id AS VARCHAR), ':1')), 1, 8) AS BIGINT) / 4294967296.0 * 3) AS INT) AS fold FROM e),
r AS (SELECT k, f.*, row_number() OVER (PARTITION BY k ORDER BY md5(concat(CAST(row_id AS VARCHAR), ':2')), row_id) AS place
      FROM f JOIN range(3) o(k) ON fold <> k),
t AS (SELECT size, r.* FROM r JOIN (VALUES (100), (300)) s(size) ON place <= size),
g AS (SELECT size, k, x, avg(target) AS p FROM t GROUP BY size, k, x),
a AS (SELECT size, k, avg(CAST((p > 0.5) = (target = 1) AS DOUBLE)) AS score FROM t JOIN g USING (size, k, x) GROUP BY size, k),
b AS (SELECT size, k, avg(CAST((p > 0.5) = (target = 1) AS DOUBLE)) AS score FROM f JOIN g ON fold = k AND f.x = g.x GROUP BY size, k)
SELECT CAST(size AS INT) AS size, round(avg(a.score), 9) AS train_mean, round(stddev_pop(a.score), 9) AS train_std,
       round(avg(b.score), 9) AS test_mean, round(stddev_pop(b.score), 9) AS test_std
FROM a JOIN b USING (size, k) GROUP BY size
"""


@query("ag17_learning_curve", CURVE_SQL)
def ag17(spark, d):
    v = views.signs(spark, d).withColumn("inputs", F.slice("inputs", 1, 1))
    curve = models.learning_curve(v, [100, 300], 3, lambda n: models.Penalty(1e-9), max_iter=50)
    return curve.select("size", *[F.round(c, 9).alias(c) for c in curve.columns if c != "size"])


@query(
    "ag18_widths",
    """SELECT count(*) AS rows, CAST(min(len(embedding)) AS INT) AS min_width, CAST(max(len(embedding)) AS INT) AS max_width
       FROM embeddings""",
)
def ag18(spark, d):
    v = views.vectors(spark, d)
    stats.same_columns([v, v.filter("target = 1")])
    return stats.widths(v)


@query(
    "ag19_argmax",
    """SELECT vec_id AS row_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS top FROM embeddings""",
)
def ag19(spark, d):
    from varloom.functions.features import argmax

    return views.vectors(spark, d).select("row_id", argmax(F.col("inputs")).alias("top"))
