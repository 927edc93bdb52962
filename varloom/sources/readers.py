"""Readers. Schemas are declared; nothing is inferred and nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from varloom import schemas
from varloom.functions import features, variants
from varloom.operators.rows import bucket_offsets, number_rows
from varloom.session import write_through

# Input splits whose offsets may go to every task, four numbers each.
_MAX_BROADCAST_SPLITS = 250_000
_LINE_SEPARATOR_FREE = {"quote": "", "escape": ""}


def read_vcf(spark: SparkSession, path: str, schema: T.StructType = schemas.VCF5) -> DataFrame:
    """Tab-separated variant text; lines that start with ``#`` are skipped, a dot stays text.

    A file may have more columns than the schema names; they are not parsed.
    """
    return _tabbed(spark, path, schema, comment="#")


def vcf_header_names(spark: SparkSession, path: str) -> list[str]:
    """Column names of the ``#CHROM`` line."""
    line = spark.read.text(path).filter(F.col("value").startswith("#CHROM")).first()
    if line is None:
        raise ValueError(f"no #CHROM line in {path}")
    return line["value"].rstrip("\n").split("\t")


def read_vcf_named(spark: SparkSession, path: str) -> DataFrame:
    """All columns as named by the header line; POS is a number, the rest is text."""
    names = vcf_header_names(spark, path)
    schema = T.StructType(
        [
            T.StructField(n, T.IntegerType() if n == "POS" else T.StringType())
            for n in names
        ]
    )
    return _tabbed(spark, path, schema, comment="#")


def read_variant_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Four variant columns of a wider table.

    ``columns`` are their names in the header (they differ by genome build); without
    them the file has no header, only comment lines, and starts with the four columns.
    """
    if columns is None:
        return _tabbed(spark, path, schemas.VARIANT4, comment="#")
    raw = spark.read.options(**_LINE_SEPARATOR_FREE).csv(path, sep="\t", header=True)
    targets = schemas.VARIANT4.fields
    return raw.select(
        *[
            F.col(f"`{c}`").alias(t.name)
            if isinstance(t.dataType, T.StringType)
            else strict_number(F.col(f"`{c}`"), t.dataType, c).alias(t.name)
            for c, t in zip(columns, targets, strict=True)
        ]
    )


def read_feature_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Headered numeric table, every column DOUBLE."""
    return spark.read.csv(
        path, header=True, schema=schemas.doubles(columns), mode="FAILFAST"
    )


def read_feature_lines(
    spark: SparkSession, path: str, separator: str = ",", target_col: int = 0
) -> DataFrame:
    """Headerless numeric lines as (row_id, target, inputs); the row stays one array."""
    lines = with_file_row_id(spark.read.text(path))
    values = features.split_target(features.parse_line(F.col("value"), separator), target_col)
    return lines.select("row_id", values.alias("__v")).select(
        "row_id", F.col("__v.target").alias("target"), F.col("__v.inputs").alias("inputs")
    )


def read_shards(
    spark: SparkSession, path: str, columns: Sequence[str], index: str = "ix"
) -> DataFrame:
    """Every CSV shard of a folder; the first column is the row number in the master file."""
    schema = T.StructType([T.StructField(index, T.LongType())] + schemas.doubles(columns).fields)
    return spark.read.csv(
        path, header=True, schema=schema, mode="FAILFAST", pathGlobFilter="*.csv"
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("row_id", "variant_id")


def read_batches(spark: SparkSession, path: str, batch_ids: Sequence[int]) -> DataFrame:
    """Rows of the named batches; row groups of other batches are skipped by their statistics."""
    return spark.read.parquet(path).filter(F.col("batch_id").isin(list(batch_ids)))


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """Stored sparse set (row_id, variant_id, target, features); other layouts are refused."""
    df = spark.read.parquet(path)
    missing = {"row_id", "variant_id", "target", "features"} - set(df.columns)
    if missing:
        raise ValueError(f"not a sparse feature table, columns missing: {sorted(missing)}")
    return df


def read_fields(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """Named array fields side by side, in the given order, as (row_id, inputs)."""
    stacked = F.concat(*[F.col(f"`{f}`") for f in fields])
    return spark.read.parquet(path).select("row_id", stacked.alias("inputs"))


def read_predictions(spark: SparkSession, path: str, outputs: Sequence[str]) -> DataFrame:
    """Prediction table without its metadata columns; the line index becomes ``row_id``."""
    schema = T.StructType(
        [
            T.StructField(n, T.LongType() if n == "line_idx" else T.StringType())
            for n in schemas.PREDICTION_META
        ]
        + schemas.doubles(outputs).fields
    )
    raw = spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST")
    return raw.withColumnRenamed("line_idx", "row_id").drop(*schemas.PREDICTION_META)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return _tabbed(spark, path, schemas.SCORED, comment="#")


def read_annotated_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Annotated VCF with the two scores of the first ``CSQ`` entry of each variant."""
    vcf = read_vcf(spark, path, schemas.VCF8)
    scores = variants.first_annotation_scores(variants.info_entry(F.col("info"), "CSQ"))
    return vcf.select("*", scores.alias("__s")).select(
        *vcf.columns,
        F.col("__s.scaled_score").alias("scaled_score"),
        F.col("__s.raw_score").alias("raw_score"),
    )


def read_folder(
    spark: SparkSession, folder: str, extension: str, recursive: bool = False, **options
) -> DataFrame:
    """Text lines of all files in a folder with an extension, with the file each came from."""
    reader = spark.read.option("pathGlobFilter", f"*{extension}").option(
        "recursiveFileLookup", str(recursive).lower()
    )
    return reader.options(**options).text(folder).select(
        "value", F.col("_metadata.file_path").alias("file")
    )


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    gtf = _tabbed(spark, path, schemas.GTF, comment="#")
    return gtf.withColumn("attributes", variants.gtf_attributes(F.col("attributes")))


def read_exons(spark: SparkSession, path: str) -> DataFrame:
    """Exon rows of a gene table with the ids an overlap needs."""
    exons = _tabbed(spark, path, schemas.GTF, comment="#").filter(F.col("feature") == "exon")
    names = ("gene_id", "transcript_id", "exon_number")
    return exons.select(
        "chrom",
        "start",
        "end",
        "strand",
        *[variants.gtf_attribute(F.col("attributes"), n).alias(n) for n in names],
    )


def with_file_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows of a freshly read file source in file order, then line order.

    Rows keep their place: a column-free pass counts the rows of every input split once, and
    each row adds its place in the split to the start of the split. The starts are written,
    so later queries do not count again; a split is named by a hash of its file and its first byte, and
    only whole files are put in order in one task. Wide rows are never shuffled. Apply it directly to
    the reader's result.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__mono"),
    )
    if len(df.inputFiles()) + df.rdd.getNumPartitions() > _MAX_BROADCAST_SPLITS:
        return number_rows(placed, ["__file", "__start", "__mono"], name).drop(
            "__file", "__start", "__mono"
        )
    splits = placed.groupBy("__file", "__start").agg(F.count("*").alias("__k"), F.min("__mono").alias("__first"))
    before = W.partitionBy("__file").orderBy("__start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("__before", F.coalesce(F.sum("__k").over(before), F.lit(0)))
    files = bucket_offsets(splits.groupBy("__file").agg(F.sum("__k").alias("__n")), ["__file"])
    starts = write_through(
        splits.join(files, "__file").select(
            F.xxhash64("__file").alias("__name"),
            "__start",
            (F.col("__offset") + F.col("__before") - F.col("__first")).alias("__shift"),
        ),
        "file-offsets",
    )
    return (
        placed.withColumn("__name", F.xxhash64("__file"))
        .join(F.broadcast(starts), ["__name", "__start"])
        .withColumn(name, F.col("__mono") + F.col("__shift"))
        .drop("__file", "__start", "__mono", "__name", "__shift")
    )


def strict_number(column: Column, kind: T.DataType, name: str) -> Column:
    """A number from text; text that is none, or does not fit the type, stops the query."""
    number = column.try_cast(kind)
    wrong = F.raise_error(F.concat(F.lit(f"column {name}: no {kind.simpleString()}: "), column))
    return F.when(column.isNotNull() & number.isNull(), wrong).otherwise(number)


def _tabbed(spark: SparkSession, path: str, schema: T.StructType, comment: str) -> DataFrame:
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.options(**_LINE_SEPARATOR_FREE).csv(
        path, sep="\t", header=False, comment=comment, schema=text
    )
    return raw.select(
        *[
            F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.StringType)
            else strict_number(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name)
            for f in schema
        ]
    )
