"""Variant, prediction and vector views over the driver tables.

The DataFrame builders and the SQL text below describe the same rows. The SQL text
numbers rows with a plain window, which suits small data; the builders use the
scalable numbering and give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from varloom.functions.variants import variant_id_from_alt
from varloom.operators.rows import number_rows

ROW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
FEATURES = ["f0", "f1", "f2", "f3"]
# What the order and the views are made of.
STORED = [*ROW_ORDER, "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

VARIANTS_SQL = """
variants AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row_id,
         CASE l_partkey % 24 WHEN 22 THEN 'X' WHEN 23 THEN 'Y' ELSE CAST(l_partkey % 24 + 1 AS VARCHAR) END AS chrom,
         CAST((l_orderkey * 10 + l_linenumber) % 2147483647 AS INT) AS pos,
         concat(substr('ACGT', CAST(l_linenumber % 4 + 1 AS INT), 1),
                CASE WHEN CAST(l_quantity AS INT) % 10 = 0 THEN 'GA' ELSE '' END) AS ref,
         concat(substr('ACGT', CAST((l_linenumber + 1 + l_suppkey % 3) % 4 + 1 AS INT), 1),
                CASE WHEN CAST(l_quantity AS INT) > 45 THEN ',TA' ELSE '' END) AS alt,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS y,
         l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3,
         l_returnflag AS flag, l_linestatus AS status
  FROM lineitem),
v AS (
  SELECT *, concat(chrom, ':', CAST(pos AS VARCHAR), ':', ref, ':[''', replace(alt, ',', ''', '''), ''']') AS variant_id
  FROM variants)
"""

_numbered: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """Put the variant view in front of a query that may have its own WITH list."""
    body = sql.strip()
    if body.startswith("WITH "):
        return f"WITH {VARIANTS_SQL.strip()},\n{body[5:]}"
    return f"WITH {VARIANTS_SQL.strip()}\n{body}"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with target, features and id; no row numbers, so no exchange."""
    return _named(table(spark, sf_dir, "lineitem"))


def _named(lines: DataFrame, *kept: str) -> DataFrame:
    part = F.col("l_partkey") % 24
    number, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    chrom = F.when(part == 22, "X").when(part == 23, "Y").otherwise((part + 1).cast("string"))
    pos = ((F.col("l_orderkey") * 10 + number) % 2147483647).cast("int")

    def base(place):
        return F.substring(F.lit("ACGT"), (place % 4 + 1).cast("int"), F.lit(1))

    ref = F.concat(base(number), F.when(quantity % 10 == 0, "GA").otherwise(""))
    alt = F.concat(
        base(number + 1 + F.col("l_suppkey") % 3), F.when(quantity > 45, ",TA").otherwise("")
    )
    df = lines.select(
        *kept,
        chrom.alias("chrom"),
        pos.alias("pos"),
        ref.alias("ref"),
        alt.alias("alt"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(-1).alias("y"),
        F.col("l_quantity").alias("f0"),
        F.col("l_extendedprice").alias("f1"),
        F.col("l_discount").alias("f2"),
        F.col("l_tax").alias("f3"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
    )
    vid = variant_id_from_alt(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"))
    return df.withColumn("variant_id", vid)


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with row numbers, written once per application, folder and state of its table.

    Only the columns that the views are made of are moved and written; names, ids and alleles
    follow from them at every read.
    """
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, f"{sf_dir}/lineitem.parquet"))
    if key not in _numbered:
        _numbered[key] = number_variants(spark, sf_dir)
    return _numbered[key]


def number_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(*STORED)
    return _named(number_rows(lines, ROW_ORDER), "row_id")


def _state(spark: SparkSession, place: str) -> tuple:
    """Names, sizes and times of the files of a table; changes when the table is replaced."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def feature_array(df: DataFrame, out: str = "inputs") -> DataFrame:
    return df.withColumn(out, F.array(*FEATURES))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two predicted values per row, keyed by row number."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        "value",
        F.col("user_id").cast("double").alias("user"),
        "event_type",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty-four features and a binary target per row."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") >= 5).cast("int").alias("target"),
        F.col("embedding").cast("array<double>").alias("inputs"),
        "label",
    )


SIGNS_SQL = """
e AS (
  SELECT vec_id AS row_id, CAST(embedding[1] > 0 AS INT) AS x, CAST(embedding[2] > 0 AS INT) AS z,
         CAST(CASE WHEN vec_id % 4 = 0 THEN label >= 5 ELSE embedding[1] > 0 END AS INT) AS target,
         row_number() OVER (ORDER BY md5(concat(CAST(vec_id AS VARCHAR), ':42')), vec_id) - 1
           < ceil(0.3 * count(*) OVER ()) AS is_test
  FROM embeddings)
"""


def signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two signs of a vector and their product, and a target that mostly follows the first.

    Four groups of rows and four parameters: the fitted probability of a group is its share of
    positives, so a fit without penalty can be checked by counting.
    """
    first, second = (F.element_at("embedding", i) > 0 for i in (1, 2))
    target = F.when(F.col("vec_id") % 4 == 0, F.col("label") >= 5).otherwise(first)
    cells = [first, second, first & second]
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        target.cast("int").alias("target"),
        F.array(*[c.cast("double") for c in cells]).alias("inputs"),
    )


def counted_fit(body: str, rows: str = "TRUE") -> str:
    """SQL with the closed form of the fit on ``rows``: shares ``g.p`` and the parameters ``k``."""
    logit = "max(CASE WHEN x = {} AND z = {} THEN ln(p / (1 - p)) END)"
    a, b, c, d = (logit.format(*xz) for xz in ((0, 0), (1, 0), (0, 1), (1, 1)))
    return f"""WITH {SIGNS_SQL.strip()},
g AS (SELECT x, z, avg(target) AS p FROM e WHERE {rows} GROUP BY x, z),
s AS (SELECT stddev_pop(x) AS s0, stddev_pop(z) AS s1, stddev_pop(x * z) AS s2 FROM e WHERE {rows}),
w AS (SELECT {a} AS b, {b} - {a} AS w0, {c} - {a} AS w1, {d} - {b} - {c} + {a} AS w2 FROM g),
k AS (SELECT CAST(unnest([-1, 0, 1, 2]) AS INT) AS idx, unnest([b, w0, w1, w2]) AS coef,
             unnest([NULL, s0, s1, s2]) AS scale FROM w, s)
{body}"""
