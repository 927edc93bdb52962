"""Job chains: data set build, training from a configuration, and the scoring chain."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from varloom.functions import variants as vx
from varloom.functions.features import relabel, with_sparse
from varloom.operators import joins, sets, splits, stats
from varloom.plans import models
from varloom.session import write_through
from varloom.sources import readers

# A reader is any function that gives a table with ``row_id``; see ``assemble``.
Reader = Callable[[SparkSession], DataFrame]

# Header names of the variant columns by genome build; fixed values of the input files.
VARIANT_COLUMNS = {
    "GRCh37": ("#Chr", "Pos", "Ref", "Alt"),
    "GRCh38": ("#Chrom", "Pos", "Ref", "Alt"),
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table stands at a path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def build_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read a table, building it first only when it is not there yet."""
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def numbered_ids(spark: SparkSession, path: str, columns: Sequence[str] | None) -> DataFrame:
    """Ordered id list of one variant file."""
    rows = readers.with_file_row_id(readers.read_variant_table(spark, path, columns))
    vid = vx.variant_id_from_alt(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"))
    return rows.select("row_id", vid.alias("variant_id"))


def build_dataset(
    spark: SparkSession,
    variant_files: Sequence[str],
    feature_files: Sequence[str],
    out: str,
    columns: Sequence[str] | None = VARIANT_COLUMNS["GRCh37"],
    test_size: float = 0.3,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Variant and feature files to train set, validation set and scaler under ``out``.

    Files pair up by their place in the two lists, rows by their place in the file.
    Outputs that are already complete are reused.
    """

    def merged() -> DataFrame:
        pairs = []
        for ids_path, rows_path in zip(variant_files, feature_files, strict=True):
            rows = readers.read_feature_lines(spark, rows_path)
            ids = numbered_ids(spark, ids_path, columns)
            pairs.append(joins.attach_ids(rows, ids))
        joined = sets.concat_ordered(pairs).withColumn("target", relabel(F.col("target")))
        # The width stands in the first line of the first file: target and features.
        line = spark.read.text(feature_files[0]).first()
        width = len(line["value"].split(",")) - 1 if line else 0
        packed = with_sparse(joined, "inputs", "features", width)
        return packed.select("row_id", "variant_id", "target", "features")

    full = build_once(spark, f"{out}/full", merged)
    flagged = splits.exact_split(full, test_size, seed)
    train = build_once(
        spark, f"{out}/train", lambda: flagged.filter(~F.col("is_test")).drop("is_test")
    )
    valid = build_once(spark, f"{out}/valid", lambda: flagged.filter("is_test").drop("is_test"))
    scaler = build_once(
        spark, f"{out}/scaler", lambda: stats.array_scaler(train, "features").coalesce(1)
    )
    return {"train": train, "valid": valid, "scaler": scaler}


def assemble(spark: SparkSession, sources: Sequence[Reader]) -> DataFrame:
    """Stack the feature rows of any readers by row number."""
    return joins.hstack([source(spark) for source in sources])


@dataclass(frozen=True)
class TrainingPlan:
    """What a training run needs; every part that may change is an ordinary callable."""

    train: Reader
    valid: Reader
    penalty: Callable[[int], models.Penalty]
    metric: models.Metric = models.classification_metrics
    scaler: Reader | None = None
    cap: bool = False
    fit_options: dict = field(default_factory=dict)


def run_training(spark: SparkSession, plan: TrainingPlan, out: str) -> DataFrame:
    """Train, save the model under ``out`` and return the validation metric."""
    train, valid = plan.train(spark), plan.valid(spark)
    scaler = plan.scaler(spark) if plan.scaler else None
    model, _ = models.train(
        train,
        valid,
        plan.penalty(train.count()),
        f"{out}/model",
        scaler=scaler,
        cap=plan.cap,
        **plan.fit_options,
    )
    return models.evaluate(
        model, valid, plan.metric, scaler, plan.cap, report_path=f"{out}/evaluation"
    )


def score_variants(
    variants: DataFrame,
    prescored: Sequence[tuple[str, DataFrame]],
    annotations: DataFrame,
    features: Sequence[str],
    defaults: dict[str, float],
    score: Callable[[DataFrame], DataFrame],
    conversion: DataFrame,
) -> DataFrame:
    """Scores of a variant list: known ones looked up, novel ones annotated and scored.

    Steps: sort and drop repeats, take scores from the first prescored table that
    holds a variant, join annotations for the rest, fill missing features, apply
    ``score`` (adds ``raw_score``), convert to the scaled score, merge in order.
    """
    key, by = joins.VARIANT_KEY, joins.GROUP_KEY
    unique = variants.select(*by).dropDuplicates()
    cascade = write_through(
        joins.first_table_holding(unique, prescored, ["raw_score", "scaled_score"], at_most=variants.count()), "cascade"
    )
    known = cascade.filter(F.col("found_in").isNotNull()).select(
        *key, "raw_score", "scaled_score"
    )
    novel = cascade.filter(F.col("found_in").isNull()).select(*key)
    annotated = novel.join(annotations.select(*key, *features), by, "left").select(*key, *features).fillna(defaults)
    fresh = joins.threshold_lookup(score(annotated), conversion).select(
        *key, "raw_score", "scaled_score"
    )
    return sets.merge_sorted([known, fresh.distinct()])
