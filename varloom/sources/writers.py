"""Writers. Every write is an ordinary distributed job into a folder of part files.

Output folders that split by a column are rebalanced first: adaptive execution
then joins small pieces and cuts a piece that one value makes too large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from varloom.functions.features import relabel
from varloom.operators.sets import keep_last
from varloom.session import range_parts

FORMATS = ("parquet", "csv", "tsv", "json")


def write_keyed(df: DataFrame, path: str, key: str = "variant_id", row_id: str = "row_id") -> None:
    """One record per key, the last row winning, laid out in key order for pruned lookups."""
    once = keep_last(df, [key], row_id)
    once.repartitionByRange(*range_parts(df), key).sortWithinPartitions(key).write.parquet(path)


def write_keyed_table(
    df: DataFrame, table: str, buckets: int, key: str = "variant_id", row_id: str = "row_id"
) -> None:
    """Keyed records as a bucketed catalog table.

    Tables with the same key and bucket count join on the key without an exchange,
    which pays when one store meets many feature sources.
    """
    once = keep_last(df, [key], row_id).repartition(buckets, key)
    once.write.bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def write_batches(batched: DataFrame, path: str, by_folder: bool = False) -> None:
    """Batches of fixed size. Folders per batch suit a few dozen; files in batch order any number."""
    if by_folder:
        batched.hint("rebalance", "batch_id").write.partitionBy("batch_id").parquet(path)
        return
    order = ["batch_id", "pos_in_batch"]
    batched.repartitionByRange(*range_parts(batched), *order).sortWithinPartitions(*order).write.parquet(path)


def write_by_value(df: DataFrame, path: str, column: str, fmt: str = "parquet", **options) -> None:
    """One folder per value of a column."""
    writer = df.hint("rebalance", column).write.partitionBy(column)
    writer.format(fmt).options(**options).save(path)


def write_sparse(df: DataFrame, path: str) -> None:
    df.select("row_id", "variant_id", "target", "features").write.parquet(path)


def write_tabbed(df: DataFrame, path: str, order_by: Sequence[str] = (), header: bool = False) -> None:
    """Tab-separated text without quoting, in global order when an order is given."""
    out = df.orderBy(*order_by) if order_by else df
    out.write.csv(path, sep="\t", header=header, quote="", emptyValue="")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.csv(path, sep=sep, header=True)


def write_vcf(
    df: DataFrame,
    path: str,
    columns: Sequence[str],
    order_by: Sequence[str],
    header_lines: Sequence[str] = ("##fileformat=VCFv4.0",),
) -> None:
    """VCF text in order under the given meta lines, closed by a ``#CHROM`` line.

    The header goes into a folder that sorts first, so the files joined in path order
    are one VCF; read them with ``path/*``.
    """
    spark = df.sparkSession
    names = [c.upper() for c in columns]
    title = "\t".join(["#" + names[0].lstrip("#"), *names[1:]])
    cells = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns]
    body = df.orderBy(*order_by).select(F.concat_ws("\t", *cells).alias("value"))
    header = _lines(spark, [*header_lines, title])
    header.write.text(f"{path}/0_header")
    body.write.text(f"{path}/1_rows")


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Comment lines at the top of a VCF, without the column line; only the file's start is read."""
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        return []
    lines, wanted = spark.read.text(files[0]), 64
    while True:
        head = [r["value"] for r in lines.take(wanted)]
        for i, line in enumerate(head):
            if not line.startswith("##"):
                return head[:i]
        if len(head) < wanted:
            return head
        wanted *= 4


def save(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write in a format chosen by name; an existing folder is never overwritten."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if fmt == "tsv":
        write_csv(df, path, "\t")
    elif fmt == "csv":
        write_csv(df, path)
    else:
        df.write.format(fmt).save(path)


def relabel_stored(spark: SparkSession, path: str, new_path: str, target: str = "target") -> int:
    """Rewrite a stored table with target -1 as 0 and return how many rows changed."""
    df = spark.read.parquet(path)
    changed = df.agg(F.count_if(F.col(target) == -1)).first()[0]
    df.withColumn(target, relabel(F.col(target))).write.parquet(new_path)
    return changed


def _lines(spark: SparkSession, lines: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1)
