"""Sources and sinks as round trips: write a view in a format, read it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from varloom.functions import features as fx, variants as vx
from varloom.operators import joins, rows, stats
from varloom.plans import models, views
from varloom.plans.registry import query
from varloom.plans.views import counted_fit, with_views
from varloom.session import fresh_path
from varloom.sources import ranged, readers, store, writers

KEY = ["chrom", "pos", "ref", "alt"]
V8 = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"]


def _dots(df: DataFrame, names) -> DataFrame:
    return df.withColumns({n: F.lit(".") for n in names})


@query(
    "src01_read_vcf",
    with_views("SELECT chrom, pos, '.' AS id, ref, alt FROM v"),
)
def src01(spark, d):
    path = fresh_path(spark, "vcf")
    df = _dots(views.variants(spark, d), ["id"])
    writers.write_vcf(df, path, V8[:5], ["chrom", "pos"])
    return readers.read_vcf(spark, f"{path}/*")


@query("src01_read_vcf_named", with_views("SELECT chrom, pos, ref, alt, flag FROM v"))
def src01_named(spark, d):
    path = fresh_path(spark, "vcf")
    df = _dots(views.variants(spark, d), ["id"])
    writers.write_vcf(df, path, [*V8[:5], "flag"], ["chrom", "pos"])
    named = readers.read_vcf_named(spark, f"{path}/*")
    return named.select(
        F.col("`#CHROM`").alias("chrom"),
        F.col("POS").alias("pos"),
        F.col("REF").alias("ref"),
        F.col("ALT").alias("alt"),
        F.col("FLAG").alias("flag"),
    )


@query("src02_read_variant_table", with_views("SELECT chrom, pos, ref, alt FROM v"))
def src02(spark, d):
    path = fresh_path(spark, "tsv")
    df = views.variants(spark, d).select(
        *[F.col(c).alias(n) for c, n in zip(KEY, ["#Chrom", "Pos", "Ref", "Alt"])], *views.FEATURES
    )
    writers.write_tabbed(df, path, header=True)
    return readers.read_variant_table(spark, path, ["#Chrom", "Pos", "Ref", "Alt"])


@query("src02_read_variant_table_headerless", with_views("SELECT chrom, pos, ref, alt FROM v"))
def src02_headerless(spark, d):
    path = fresh_path(spark, "tsv")
    writers.write_tabbed(views.variants(spark, d).select(*KEY, *views.FEATURES), path)
    return readers.read_variant_table(spark, path)


@query(
    "src03_read_feature_csv",
    with_views("SELECT CAST(y AS DOUBLE) AS y, f0, f1, f2, f3 FROM v"),
)
def src03(spark, d):
    path = fresh_path(spark, "csv")
    writers.write_csv(views.variants(spark, d).select("y", *views.FEATURES), path)
    return readers.read_feature_csv(spark, path, ["y", *views.FEATURES])


@query(
    "src04_read_feature_lines",
    with_views("SELECT row_id, CAST(y AS DOUBLE) AS target, f0, f1, f2, f3 FROM v"),
)
def src04(spark, d):
    path = fresh_path(spark, "lines")
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ["y", *views.FEATURES]])
    ordered = views.numbered(spark, d).orderBy("row_id").select(line.alias("value"))
    ordered.write.text(path, compression="gzip")
    read = readers.read_feature_lines(spark, path)
    return read.select("row_id", "target", *_elements("inputs", views.FEATURES))


def _elements(column: str, names) -> list:
    return [F.col(column)[i].alias(n) for i, n in enumerate(names)]


@query(
    "src05_read_shards",
    with_views("SELECT row_id AS ix, CAST(y AS DOUBLE) AS y, f0, f1, f2, f3 FROM v"),
)
def src05(spark, d):
    path = fresh_path(spark, "shards")
    shards = views.numbered(spark, d).select(
        F.col("row_id").alias("ix"), "y", *views.FEATURES, F.pmod("row_id", F.lit(7)).alias("shard_id")
    )
    writers.write_by_value(shards, path, "shard_id", "csv", header=True)
    return readers.read_shards(spark, path, ["y", *views.FEATURES]).drop("shard_id")


@query("src06_read_ids", with_views("SELECT row_id, variant_id FROM v"))
def src06(spark, d):
    path = fresh_path(spark, "ids")
    views.numbered(spark, d).select("row_id", "variant_id").write.parquet(path)
    return readers.read_ids(spark, path)


SAMPLES_SQL = """
WITH store AS (
  SELECT variant_id, y, f0, f1, CASE WHEN f3 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE f2 / f3 END AS f4
  FROM v QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY row_id DESC) = 1)
SELECT ids.row_id, ids.variant_id,
       CASE WHEN s.y = -1 THEN 0 ELSE s.y END AS target,
       CASE WHEN isinf(s.f4) THEN least(s.f0, 65500) ELSE s.f0 END AS f0,
       CASE WHEN isinf(s.f4) THEN least(s.f1, 65500) ELSE s.f1 END AS f1,
       round(CASE WHEN isinf(s.f4) THEN 65500 ELSE s.f4 END, 9) AS f4
FROM (SELECT row_id, variant_id FROM v WHERE status = 'F') ids JOIN store s USING (variant_id)
"""


def sample_store(spark, d) -> str:
    """Where keyed and indexed sample records lie, with an infinite feature where f3 is zero."""
    ratio = F.when(F.col("f3") == 0, F.lit(float("inf"))).otherwise(
        F.col("f2") / F.nullif("f3", F.lit(0.0))
    )
    path = fresh_path(spark, "samples")
    records = views.numbered(spark, d).select(
        "row_id", "variant_id", "y", F.array("f0", "f1", ratio).alias("inputs")
    )
    writers.write_keyed(records, path)
    ranged.index_files(spark, path, ["variant_id"])
    return path


@query("src07_fetch_samples", with_views(SAMPLES_SQL))
def src07(spark, d):
    ids = views.numbered(spark, d).filter("status = 'F'").select("row_id", "variant_id")
    found = ranged.lookup_stored(ids, sample_store(spark, d))
    capped = fx.cap_if_infinite(F.col("inputs"))
    return found.select(
        "row_id",
        "variant_id",
        fx.relabel(F.col("y")).alias("target"),
        capped[0].alias("f0"),
        capped[1].alias("f1"),
        F.round(capped[2], 9).alias("f4"),
    )


@query(
    "src08_read_batches",
    with_views(
        "SELECT row_id // 256 AS batch_id, CAST(row_id % 256 AS INT) AS pos_in_batch, row_id, variant_id, y"
        " FROM v WHERE row_id // 256 IN (0, 3)"
    ),
)
def src08(spark, d):
    path = fresh_path(spark, "batches")
    batched = rows.with_batches(views.numbered(spark, d), 256)
    writers.write_batches(batched, path)
    read = readers.read_batches(spark, path, [0, 3])
    return read.select("batch_id", "pos_in_batch", "row_id", "variant_id", "y")


@query(
    "src09_ordered_scan",
    with_views(
        "SELECT variant_id, row_number() OVER (ORDER BY variant_id) - 1 AS key_rank, f0"
        " FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY row_id DESC) = 1)"
    ),
)
def src09(spark, d):
    path = fresh_path(spark, "keyed")
    writers.write_keyed(views.numbered(spark, d).select("variant_id", "row_id", "f0"), path)
    stored = spark.read.parquet(path).drop("row_id")
    return rows.number_rows(stored, ["variant_id"], "key_rank")


@query(
    "src10_read_sparse",
    """SELECT vec_id AS row_id, CAST(label >= 5 AS INT) AS target, CAST(unnest(range(len(embedding))) AS INT) AS idx,
              CAST(unnest(embedding) AS DOUBLE) AS cell FROM embeddings""",
)
def src10(spark, d):
    path = fresh_path(spark, "sparse")
    packed = fx.with_sparse(views.vectors(spark, d), "inputs", "features", 64).withColumn(
        "variant_id", F.concat(F.lit("vec:"), F.col("row_id").cast("string"))
    )
    writers.write_sparse(packed, path)
    dense = fx.dense_array(F.col("features"))
    return readers.read_sparse(spark, path).select("row_id", "target", F.posexplode(dense).alias("idx", "cell"))


@query(
    "src11_read_fields",
    """SELECT vec_id AS row_id, CAST(unnest(range(len(embedding))) AS INT) AS idx,
              CAST(unnest(list_concat(embedding[33:64], embedding[1:32])) AS DOUBLE) AS cell FROM embeddings""",
)
def src11(spark, d):
    path = fresh_path(spark, "fields")
    views.vectors(spark, d).select(
        "row_id",
        F.slice("inputs", 1, 32).alias("preds/diff"),
        F.slice("inputs", 33, 32).alias("preds/logit_diff"),
    ).write.parquet(path)
    read = readers.read_fields(spark, path, ["preds/logit_diff", "preds/diff"])
    return read.select("row_id", F.posexplode("inputs").alias("idx", "cell"))


@query(
    "src12_read_predictions",
    "SELECT event_id AS row_id, value, CAST(user_id AS DOUBLE) AS user FROM events",
)
def src12(spark, d):
    path = fresh_path(spark, "predictions")
    p = views.predictions(spark, d)
    writers.write_csv(
        p.select(
            F.col("row_id").alias("line_idx"),
            F.lit("A").alias("variant_alt"),
            F.lit("1").alias("variant_chr"),
            F.col("event_type").alias("variant_id"),
            F.col("row_id").alias("variant_pos"),
            F.lit("C").alias("variant_ref"),
            "value",
            "user",
        ),
        path,
        "\t",
    )
    return readers.read_predictions(spark, path, ["value", "user"])


@query("src13_read_labels", with_views("SELECT variant_id AS ID, chrom, pos, ref, alt FROM v"))
def src13(spark, d):
    path = fresh_path(spark, "labels")
    views.variants(spark, d).select(F.col("variant_id").alias("ID"), *KEY).write.parquet(path)
    return spark.read.parquet(path)


@query(
    "src14_read_scored",
    with_views("SELECT chrom, pos, ref, alt, f2 AS raw_score, f1 AS scaled_score FROM v"),
)
def src14(spark, d):
    path = fresh_path(spark, "scored")
    df = views.variants(spark, d).select(
        *KEY, F.col("f2").alias("raw_score"), F.col("f1").alias("scaled_score")
    )
    writers.write_vcf(df, path, df.columns, ["chrom", "pos"], ["## scored variants"])
    return readers.read_scored(spark, f"{path}/*")


@query(
    "src15_read_annotated_vcf",
    with_views(
        "SELECT chrom, pos, ref, alt, f0 AS scaled_score, CASE WHEN f3 = 0 THEN NULL ELSE f2 END AS raw_score FROM v"
    ),
)
def src15(spark, d):
    path = fresh_path(spark, "annotated")
    raw = F.when(F.col("f3") == 0, "").otherwise(F.col("f2").cast("string"))
    csq = F.concat_ws("|", F.col("f0").cast("string"), raw, F.col("flag"))
    info = F.concat(F.lit("AC=1;CSQ="), csq, F.lit(",0|0|x;DP=7"))
    df = _dots(views.variants(spark, d), ["id", "qual", "filter"]).withColumn("info", info)
    writers.write_vcf(df, path, V8, ["chrom", "pos"])
    return readers.read_annotated_vcf(spark, f"{path}/*").select(
        *KEY, "scaled_score", "raw_score"
    )


@query(
    "src16_row_slices",
    with_views(
        "WITH n AS (SELECT max(row_id) AS top FROM v) "
        "SELECT 'head' AS part, row_id, variant_id FROM v WHERE row_id < 1000 UNION ALL "
        "SELECT 'slice', row_id, variant_id FROM v WHERE row_id >= 3000 AND row_id < 4000 UNION ALL "
        "SELECT 'tail', row_id, variant_id FROM v, n WHERE row_id > top - 1000"
    ),
)
def src16(spark, d):
    v = views.numbered(spark, d).select("row_id", "variant_id")
    parts = {
        "head": rows.head_rows(v, 1000),
        "slice": rows.slice_rows(v, 3000, 4000),
        "tail": rows.tail_rows(v, 1000),
    }
    return reduce(
        DataFrame.unionAll,
        [p.select(F.lit(n).alias("part"), "row_id", "variant_id") for n, p in parts.items()],
    )


@query(
    "src17_read_folder",
    with_views("SELECT chrom, count(*) AS n FROM v GROUP BY chrom"),
)
def src17(spark, d):
    path = fresh_path(spark, "folder")
    slim = views.variants(spark, d).select("chrom", "pos")
    writers.write_by_value(slim, path, "chrom", "csv")
    lines = readers.read_folder(spark, path, ".csv", recursive=True)
    chrom = F.regexp_extract("file", "chrom=([^/]+)/", 1)
    return lines.groupBy(chrom.alias("chrom")).agg(F.count("*").alias("n"))


@query(
    "src18_read_gtf",
    """SELECT CAST(o_orderkey % 22 + 1 AS VARCHAR) AS chrom, CAST(o_orderkey * 10 + 1 AS INT) AS "start",
              concat('G', CAST(o_custkey AS VARCHAR)) AS gene_id,
              concat(o_orderstatus, '+', o_orderpriority) AS tags, CAST(3 AS INT) AS n_attributes FROM orders""",
)
def src18(spark, d):
    path = fresh_path(spark, "gtf")
    o = views.table(spark, d, "orders")
    start = F.col("o_orderkey") * 10 + 1
    attributes = F.concat(
        F.lit('gene_id "G'),
        F.col("o_custkey").cast("string"),
        F.lit('"; tag "'),
        F.col("o_orderstatus"),
        F.lit('"; tag "'),
        F.col("o_orderpriority"),
        F.lit('";'),
    )
    writers.write_tabbed(
        o.select(
            (F.col("o_orderkey") % 22 + 1).cast("string").alias("chrom"),
            F.lit("made").alias("source"),
            F.lit("exon").alias("feature"),
            start.alias("start"),
            (start + 99).alias("end"),
            F.lit(".").alias("score"),
            F.lit("-").alias("strand"),
            F.lit(".").alias("frame"),
            attributes.alias("attributes"),
        ),
        path,
    )
    gtf = readers.read_gtf(spark, path)
    tags = F.filter("attributes", lambda a: a["key"] == "tag")
    genes = F.filter("attributes", lambda a: a["key"] == "gene_id")
    return gtf.select(
        "chrom",
        "start",
        genes[0]["value"].alias("gene_id"),
        F.array_join(F.transform(tags, lambda a: a["value"]), "+").alias("tags"),
        F.size("attributes").alias("n_attributes"),
    )


@query(
    "snk01_write_keyed",
    with_views(
        "SELECT variant_id, row_id, y, f0 FROM v"
        " QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY row_id DESC) = 1"
    ),
)
def snk01(spark, d):
    path = fresh_path(spark, "keyed")
    writers.write_keyed(views.numbered(spark, d).select("variant_id", "row_id", "y", "f0"), path)
    return spark.read.parquet(path)


@query(
    "snk02_write_batches",
    with_views(
        "SELECT row_id // 1024 AS batch_id, CAST(row_id % 1024 AS INT) AS pos_in_batch, row_id, variant_id, y FROM v"
    ),
)
def snk02(spark, d):
    path = fresh_path(spark, "batches")
    batched = rows.with_batches(views.numbered(spark, d), 1024)
    writers.write_batches(batched, path)
    return spark.read.parquet(path).select(
        "batch_id", "pos_in_batch", "row_id", "variant_id", "y"
    )


FLAT_SQL = """
WITH b AS (
  SELECT 0 AS batch_no, variant_id, row_id, f0 AS a, CASE WHEN flag = 'R' THEN f2 END AS c FROM v WHERE status = 'F'
  UNION ALL
  SELECT 1, variant_id, row_id, f1, f3 FROM v WHERE flag <> 'N')
SELECT variant_id, row_id, a AS "db:diff_a", c AS "db:logit_c" FROM b
QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY batch_no DESC, row_id DESC) = 1
"""


@query("snk03_upsert_flat", with_views(FLAT_SQL))
def snk03(spark, d):
    v = views.numbered(spark, d)
    path = fresh_path(spark, "store")
    a = v.filter("status = 'F'").select("row_id", F.col("f0").alias("a"))
    c = v.filter("status = 'F' AND flag = 'R'").select("row_id", F.col("f2").alias("c"))
    frames = [fx.prefix_columns(a, "db", "diff", ["a"]), fx.prefix_columns(c, "db", "logit", ["c"])]
    first = joins.attach_ids(joins.outer_join_frames(frames), v)
    second = v.filter("flag <> 'N'").select(
        "row_id", "variant_id", F.col("f1").alias("db:diff_a"), F.col("f3").alias("db:logit_c")
    )
    # Two runs opened at once that number their batches alike: the later commit's rows win, none are lost.
    early, late = store.open_run(spark, path), store.open_run(spark, path)
    store.upsert(first, path, 0, late)
    store.upsert(second, path, 0, early)
    return store.latest(spark, path).select("variant_id", "row_id", "`db:diff_a`", "`db:logit_c`")


NESTED_SQL = """
SELECT event_id, 'diff' AS score, 'value' AS output, value FROM events UNION ALL
SELECT event_id, 'diff', 'user', CAST(user_id AS DOUBLE) FROM events UNION ALL
SELECT event_id, 'ref', 'value', -value FROM events
"""


def _exploded(df: DataFrame, key: str) -> DataFrame:
    outer = df.select(key, F.explode("preds").alias("score", "outputs"))
    return outer.select(key, "score", F.explode("outputs").alias("output", "value"))


@query("snk04_upsert_nested", NESTED_SQL)
def snk04(spark, d):
    path = fresh_path(spark, "store")
    p = views.predictions(spark, d)
    nested = fx.nested_predictions(
        {"diff": {"value": F.col("value"), "user": F.col("user")}, "ref": {"value": -F.col("value")}}
    )
    batch = p.select(
        "row_id", F.col("row_id").cast("string").alias("variant_id"), nested.alias("preds")
    )
    store.upsert(batch, path, 0, store.open_run(spark, path))
    rows_ = store.latest(spark, path).withColumn("event_id", F.col("row_id"))
    return _exploded(rows_, "event_id")


@query(
    "snk05_write_sparse",
    with_views(
        "SELECT row_id, variant_id, y AS target, CAST((f0 <> 0)::INT + (f2 <> 0)::INT + (f3 <> 0)::INT AS BIGINT) AS nonzero FROM v"
    ),
)
def snk05(spark, d):
    path = fresh_path(spark, "sparse")
    v = views.numbered(spark, d).withColumn("inputs", F.array("f0", "f2", "f3"))
    packed = fx.with_sparse(v.withColumnRenamed("y", "target"), "inputs", "features", 3)
    writers.write_sparse(packed, path)
    back = readers.read_sparse(spark, path)
    return back.select(
        "row_id",
        "variant_id",
        "target",
        fx.count_nonzero(fx.dense_array(F.col("features"))).alias("nonzero"),
    )


@query(
    "snk06_write_vcf",
    with_views(
        "SELECT concat_ws(chr(9), chrom, CAST(pos AS VARCHAR), '.', ref, alt, '.', '.', '.') AS line FROM v UNION ALL "
        "SELECT '##fileformat=VCFv4.0' UNION ALL "
        "SELECT concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO')"
    ),
)
def snk06(spark, d):
    path = fresh_path(spark, "vcf")
    df = _dots(views.variants(spark, d), ["id", "qual", "filter", "info"])
    writers.write_vcf(df, path, V8, ["chrom", "pos"])
    return spark.read.text(f"{path}/*").withColumnRenamed("value", "line")


@query(
    "snk07_write_intervals",
    with_views(
        'SELECT chrom AS chr, pos - 1 AS "start", CAST(pos - 1 + length(ref) AS INT) AS "end" FROM v'
    ),
)
def snk07(spark, d):
    from varloom import schemas

    path = fresh_path(spark, "intervals")
    span = vx.interval_from_vcf(F.col("chrom"), F.col("pos"), F.col("ref"))
    spans = views.variants(spark, d).select(span.alias("i")).select("i.*")
    writers.write_tabbed(spans, path, ["chr", "start"])
    return spark.read.csv(path, sep="\t", schema=schemas.INTERVAL)


@query(
    "snk08_write_regions",
    with_views("SELECT chrom, pos, ref, split_part(alt, ',', 1) AS alt FROM v"),
)
def snk08(spark, d):
    path = fresh_path(spark, "regions")
    regions = views.variants(spark, d).select(vx.region_from_id(F.col("variant_id")).alias("r"))
    writers.write_tabbed(regions.select("r.*"), path, ["chrom", "pos"])
    return readers.read_variant_table(spark, path)


@query("snk09_write_by_chromosome", with_views("SELECT chrom, variant_id, y FROM v"))
def snk09(spark, d):
    path = fresh_path(spark, "chromosomes")
    writers.write_by_value(
        views.variants(spark, d).select("chrom", "variant_id", "y"), path, "chrom"
    )
    back = spark.read.schema("variant_id string, y int, chrom string").parquet(path)
    return back.select("chrom", "variant_id", "y")


EXTRACTION_SQL = """
extraction AS (
  SELECT row_id, CAST(row_id % 7 AS INT) AS shard_id FROM v WHERE status = 'F' UNION ALL
  SELECT row_id, CAST(row_id % 3 AS INT) FROM v WHERE flag <> 'N')
"""


def extraction(v: DataFrame) -> DataFrame:
    """Shards' row-number lists; a row may stand in two of them and some stand in none."""
    by_status = v.filter("status = 'F'").select(
        "row_id", F.pmod("row_id", F.lit(7)).cast("int").alias("shard_id")
    )
    by_flag = v.filter("flag <> 'N'").select(
        "row_id", F.pmod("row_id", F.lit(3)).cast("int").alias("shard_id")
    )
    return by_status.unionAll(by_flag)


@query(
    "snk10_route_to_shards",
    with_views(
        f"WITH {EXTRACTION_SQL} SELECT row_id AS ix, s AS shard_id, CAST(y AS DOUBLE) AS y, f1 FROM v "
        "JOIN (SELECT row_id, min(shard_id) AS s FROM extraction GROUP BY row_id) USING (row_id)"
    ),
)
def snk10(spark, d):
    path = fresh_path(spark, "shards")
    v = views.numbered(spark, d)
    routed = joins.route_to_shards(v.select("row_id", "y", "f1"), extraction(v))
    writers.write_by_value(routed.withColumnRenamed("row_id", "ix").select("ix", "y", "f1", "shard_id"), path, "shard_id", "csv", header=True)
    return readers.read_shards(spark, path, ["y", "f1"]).select("ix", "shard_id", "y", "f1")


@query(
    "snk11_save_formats",
    with_views(
        "SELECT format, count(*) AS n, round(sum(f0), 2) AS total FROM v, "
        "(VALUES ('parquet'), ('csv'), ('tsv'), ('json')) AS t(format) GROUP BY format"
    ),
)
def snk11(spark, d):
    df = views.variants(spark, d).select("f0", "f2")
    parts = []
    for fmt in writers.FORMATS:
        path = fresh_path(spark, fmt)
        writers.save(df, path, fmt)
        reader = spark.read.schema("f0 double, f2 double")
        if fmt in ("csv", "tsv"):
            back = reader.csv(path, header=True, sep="\t" if fmt == "tsv" else ",")
        else:
            back = reader.format(fmt).load(path)
        parts.append(
            back.agg(F.count("*").alias("n"), F.round(F.sum("f0"), 2).alias("total")).select(
                F.lit(fmt).alias("format"), "n", "total"
            )
        )
    return reduce(DataFrame.unionAll, parts)


@query(
    "snk12_relabel_stored",
    with_views(
        "SELECT CASE WHEN y = -1 THEN 0 ELSE y END AS target, count(*) AS n,"
        " (SELECT count(*) FROM v WHERE y = -1) AS changed FROM v GROUP BY 1"
    ),
)
def snk12(spark, d):
    old, new = fresh_path(spark, "targets"), fresh_path(spark, "targets")
    views.variants(spark, d).select("variant_id", F.col("y").alias("target")).write.parquet(old)
    changed = writers.relabel_stored(spark, old, new)
    counts = spark.read.parquet(new).groupBy("target").agg(F.count("*").alias("n"))
    return counts.withColumn("changed", F.lit(changed).cast("bigint"))


@query("snk13_export_csv", with_views("SELECT variant_id, y, f0, f1, f2, f3 FROM v"))
def snk13(spark, d):
    path = fresh_path(spark, "export")
    df = views.variants(spark, d).select("variant_id", "y", *views.FEATURES)
    writers.write_csv(df, path)
    return spark.read.csv(path, header=True, schema=df.schema)


@query(
    "snk14_save_model",
    counted_fit("SELECT idx, round(coef, 3) AS coef, round(scale, 6) AS scale, (SELECT count(*) FROM e) AS rows, TRUE AS refused FROM k"),
)
def snk14(spark, d):
    path = fresh_path(spark, "model")
    v = views.signs(spark, d)
    model = models.fit_logistic(v, models.Penalty(1e-9), max_iter=100, tol=1e-12)
    model.write().save(path)
    models.save_report(spark, {"rows": v.count()}, f"{path}-report")
    stats.array_scaler(v).write.parquet(f"{path}-scaler")
    refused = 0
    for again in (model.write().save, lambda p: models.save_report(spark, {}, f"{p}-report")):
        try:
            again(path)
        except Exception:  # each writer has its own error for a place that is taken
            refused += 1
    restored = type(model).load(path)
    scaler = spark.read.parquet(f"{path}-scaler").select("idx", F.round("scale", 6).alias("scale"))
    report = spark.read.text(f"{path}-report").select(F.get_json_object("value", "$.rows").cast("long").alias("rows"))
    kept = models.coefficients(restored, spark).withColumn("coef", F.round("coef", 3))
    return kept.join(scaler, "idx", "left").join(report).withColumn("refused", F.lit(refused == 2))
