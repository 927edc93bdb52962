"""Row numbers, batches, sorts and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import rows, sets
from varloom.plans import views
from varloom.plans.registry import query
from varloom.plans.views import FEATURES, with_views
from varloom.session import fresh_path
from varloom.sources import readers, writers


@query("wn01_row_numbers", with_views("SELECT row_id, variant_id, f1 FROM v"))
def wn01(spark, d):
    return views.number_variants(spark, d).select("row_id", "variant_id", "f1")


@query(
    "wn02_batches",
    with_views(
        "SELECT row_id // 256 AS batch_id, CAST(row_id % 256 AS INT) AS pos_in_batch, row_id, variant_id FROM v"
    ),
)
def wn02(spark, d):
    v = views.numbered(spark, d).select("row_id", "variant_id")
    return rows.with_batches(v, 256)


@query(
    "wn02_batch_index",
    with_views(
        "WITH b AS (SELECT row_id // 256 AS batch_id, row_id, variant_id FROM v),"
        " i AS (SELECT batch_id, variant_id, min(row_id) AS first FROM b GROUP BY ALL),"
        " j AS (SELECT batch_id, string_agg(variant_id, ';' ORDER BY first) AS variant_ids FROM i GROUP BY 1)"
        " SELECT batch_id, string_agg(CAST(row_id AS VARCHAR), ';' ORDER BY row_id) AS row_nrs, any_value(j.variant_ids) AS variant_ids"
        " FROM b JOIN j USING (batch_id) GROUP BY 1"
    ),
)
def wn02_index(spark, d):
    """All row numbers and ids of each batch, in their order."""
    batched = rows.with_batches(views.numbered(spark, d), 256)
    index = rows.batch_index(batched, "row_id", "variant_id")
    return index.select(
        "batch_id",
        F.array_join(F.col("row_nrs").cast("array<string>"), ";").alias("row_nrs"),
        F.array_join("variant_ids", ";").alias("variant_ids"),
    )


BLOCKS_SQL = (
    "SELECT row_id // 4096 AS batch_id, row_id, y, f0 FROM v"
    " WHERE row_id // 4096 < (SELECT count(*) // 4096 FROM v)"
)


@query("wn03_full_blocks", with_views(BLOCKS_SQL))
def wn03(spark, d):
    v = views.numbered(spark, d).select("row_id", "y", "f0")
    return rows.with_batches(v, 4096, drop_last=True).drop("pos_in_batch")


SHUFFLED_SQL = """
WITH s AS (SELECT row_id, variant_id,
  row_number() OVER (ORDER BY md5(concat(CAST(row_id AS VARCHAR), ':{seed}')), row_id) - 1 AS shuffled_id FROM v)
"""


@query(
    "wn04_shuffled_batches",
    with_views(
        SHUFFLED_SQL.format(seed=5)
        + "SELECT shuffled_id // 512 AS batch_id, CAST(shuffled_id % 512 AS INT) AS pos_in_batch, row_id, variant_id FROM s"
        " WHERE shuffled_id // 512 < (SELECT count(*) // 512 FROM v)"
    ),
)
def wn04(spark, d):
    v = views.numbered(spark, d).select("row_id", "variant_id")
    shuffled = rows.shuffle_positions(v, 5)
    return rows.with_batches(shuffled, 512, "shuffled_id", drop_last=True).drop("shuffled_id")


@query("wn05_collate", with_views("SELECT row_id, variant_id, y AS target, f0, f1, f2, f3 FROM v"))
def wn05(spark, d):
    v = views.feature_array(views.numbered(spark, d)).withColumnRenamed("y", "target")
    collated = v.select("row_id", "variant_id", "target", "inputs")
    return collated.select(
        "row_id", "variant_id", "target", *[F.col("inputs")[i].alias(f) for i, f in enumerate(FEATURES)]
    )


@query(
    "wn06_rebatch_shards",
    with_views(
        "WITH s AS (SELECT row_id, y, f0, f1, f2, f3, row_number() OVER (ORDER BY row_id % 7, row_id) - 1 AS place FROM v) "
        "SELECT place // 1000 AS batch_id, CAST(place % 1000 AS INT) AS pos_in_batch, row_id AS ix, CAST(y AS DOUBLE) AS y,"
        " f0, f1, f2, f3 FROM s"
    ),
)
def wn06(spark, d):
    path = fresh_path(spark, "shards")
    v = views.numbered(spark, d).select(
        F.col("row_id").alias("ix"), "y", *FEATURES, F.pmod("row_id", F.lit(7)).cast("int").alias("shard")
    )
    ordered = v.repartitionByRange("shard", "ix").sortWithinPartitions("shard", "ix")
    writers.write_csv(ordered.drop("shard"), path)
    placed = readers.with_file_row_id(readers.read_shards(spark, path, ["y", *FEATURES]))
    return rows.with_batches(placed, 1000).drop("row_id")


@query(
    "wn07_move_surplus",
    with_views(
        "SELECT row_id, CASE WHEN row_id // 5000 = 0 AND row_id >= 3009 THEN 1 ELSE row_id // 5000 END AS shard_id FROM v"
    ),
)
def wn07(spark, d):
    v = views.numbered(spark, d).select("row_id")
    sharded = rows.with_batches(v, 5000).withColumnsRenamed(
        {"batch_id": "shard_id", "pos_in_batch": "pos_in_shard"}
    )
    return rows.move_surplus(sharded, 3009, 0, 1).select("row_id", "shard_id")


@query(
    "srt01_sort_by_position",
    with_views(
        "SELECT row_number() OVER (ORDER BY chrom, pos, ref, alt, row_id) - 1 AS place, row_id, chrom, pos FROM v"
    ),
)
def srt01(spark, d):
    v = views.numbered(spark, d).select("chrom", "pos", "ref", "alt", "row_id")
    order = ["chrom", "pos", "ref", "alt", "row_id"]
    return rows.number_rows(v, order, "place", keep=["row_id", "chrom", "pos"])


@query(
    "srt02_sorted_distinct",
    with_views(
        "SELECT row_number() OVER (ORDER BY chrom, pos, ref, alt) - 1 AS place, * FROM (SELECT DISTINCT chrom, pos, ref, alt FROM v)"
    ),
)
def srt02(spark, d):
    key = ["chrom", "pos", "ref", "alt"]
    distinct = views.variants(spark, d).select(*key).dropDuplicates()
    return rows.number_rows(distinct, key, "place")


@query(
    "srt02_sorted_distinct_rows",
    with_views("SELECT DISTINCT chrom, pos, ref, alt FROM v"),
)
def srt02_rows(spark, d):
    return sets.sorted_distinct(views.variants(spark, d).select("chrom", "pos", "ref", "alt"))


@query(
    "srt03_shuffle",
    with_views(SHUFFLED_SQL.format(seed=42) + "SELECT * FROM s"),
)
def srt03(spark, d):
    return rows.shuffle_positions(views.numbered(spark, d).select("row_id", "variant_id"), 42)


@query(
    "srt04_sample",
    with_views(SHUFFLED_SQL.format(seed=22) + "SELECT row_id, variant_id FROM s WHERE shuffled_id < 2500"),
)
def srt04(spark, d):
    v = views.numbered(spark, d).select("row_id", "variant_id")
    return rows.sample_rows(v, 2500, 22)


@query(
    "srt05_shuffled_slice",
    with_views(
        SHUFFLED_SQL.format(seed=42) + "SELECT * FROM s WHERE shuffled_id >= 1000 AND shuffled_id < 3000"
    ),
)
def srt05(spark, d):
    v = views.numbered(spark, d).select("row_id", "variant_id")
    return rows.slice_rows(rows.shuffle_positions(v, 42), 1000, 3000, "shuffled_id")
