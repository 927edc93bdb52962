"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import features as fx
from varloom.operators import joins, rows, sets
from varloom.plans import views
from varloom.plans.catalog.files import EXTRACTION_SQL, SAMPLES_SQL, extraction, sample_store
from varloom.plans.registry import query
from varloom.plans.views import FEATURES, with_views
from varloom.session import fresh_path, write_through
from varloom.sources import ranged, writers

KEY = joins.VARIANT_KEY


def _blocks(v):
    left = v.select("row_id", F.col("y").alias("target"), F.array("f0", "f1").alias("inputs"))
    return left, v.select("row_id", F.array("f2", "f3").alias("inputs"))


@query("jn01_stack_sources", with_views("SELECT row_id, y AS target, f0, f1, f2, f3 FROM v"))
def jn01(spark, d):
    stacked = joins.hstack(_blocks(views.numbered(spark, d)))
    return stacked.select(
        "row_id", "target", *[F.col("inputs")[i].alias(f) for i, f in enumerate(FEATURES)]
    )


@query(
    "jn02_stack_many_sources",
    with_views(
        "SELECT row_id, target, CAST(unnest(range(len(inputs))) AS INT) AS idx, unnest(inputs) AS cell FROM ("
        "SELECT v.row_id, y AS target, list_concat([f0, f1, value], [CAST(x AS DOUBLE) FOR x IN embedding]) AS inputs"
        " FROM v JOIN events ON v.row_id = event_id JOIN embeddings ON v.row_id = vec_id)"
    ),
)
def jn02(spark, d):
    left, _ = _blocks(views.numbered(spark, d))
    p = views.predictions(spark, d).select("row_id", F.array("value").alias("inputs"))
    x = views.vectors(spark, d).select("row_id", "inputs")
    # The tables differ in length, so they are first cut to the rows that all of them hold.
    common = joins.subset(joins.subset(left.select("row_id"), x, "row_id"), p, "row_id")
    common = write_through(common, "common")
    stacked = joins.hstack([joins.subset(s, common, "row_id") for s in (left, p, x)])
    return stacked.select("row_id", "target", F.posexplode("inputs").alias("idx", "cell"))


@query(
    "jn03_join_predictions",
    "SELECT event_id AS row_id, value, CAST(user_id AS DOUBLE) AS user FROM events WHERE event_type <> 'error'",
)
def jn03(spark, d):
    p = views.predictions(spark, d)
    a = p.select("row_id", "value")
    b = p.filter("event_type <> 'error'").select("row_id", "user")
    return joins.join_predictions([a, b], "row_id")


@query(
    "jn04_outer_join_frames",
    """SELECT coalesce(a.event_id, b.event_id) AS row_id, a.value, CAST(b.user_id AS DOUBLE) AS user
       FROM (SELECT * FROM events WHERE event_type <> 'view') a
       FULL JOIN (SELECT * FROM events WHERE event_type <> 'error') b ON a.event_id = b.event_id""",
)
def jn04(spark, d):
    p = views.predictions(spark, d)
    a = p.filter("event_type <> 'view'").select("row_id", "value")
    b = p.filter("event_type <> 'error'").select("row_id", "user")
    return joins.outer_join_frames([a, b])


@query("jn05_lookup_by_id", with_views(SAMPLES_SQL))
def jn05(spark, d):
    ids = views.numbered(spark, d).filter("status = 'F'").select("row_id", "variant_id")
    found = ranged.lookup_stored(ids, sample_store(spark, d))
    inputs = fx.cap_if_infinite(F.col("inputs"))
    return found.select(
        "row_id",
        "variant_id",
        fx.relabel(F.col("y")).alias("target"),
        *[inputs[i].alias(n) for i, n in enumerate(["f0", "f1"])],
        F.round(inputs[2], 9).alias("f4"),
    )


@query(
    "jn06_four_key_join",
    with_views(
        "SELECT a.chrom, a.pos, a.ref, a.alt, a.f0, b.f1 FROM v a JOIN v b"
        " ON a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt WHERE b.status = 'F'"
    ),
)
def jn06(spark, d):
    v = views.variants(spark, d)
    scores = v.filter("status = 'F'").select(*KEY, "f1")
    return joins.inner_on_variant(v.select(*KEY, "f0"), scores)


@query(
    "jn07_first_shard",
    with_views(
        f"WITH {EXTRACTION_SQL} SELECT row_id, min(shard_id) AS shard_id FROM extraction GROUP BY row_id"
    ),
)
def jn07(spark, d):
    v = views.numbered(spark, d)
    return joins.route_to_shards(v.select("row_id"), extraction(v))


@query(
    "jn08_subset",
    with_views("SELECT row_id, variant_id FROM v WHERE row_id IN (SELECT event_id FROM events)"),
)
def jn08(spark, d):
    v = views.numbered(spark, d).select("row_id", "variant_id")
    return joins.subset(v, views.predictions(spark, d), "row_id")


GATHER_SQL = """
SELECT o.place AS row_id, v.row_id AS source_row_id, variant_id, f1
FROM (SELECT row_id, row_number() OVER (ORDER BY md5(concat(CAST(row_id AS VARCHAR), ':7')), row_id) - 1 AS place FROM v) o
JOIN v USING (row_id)
"""


@query("jn09_gather", with_views(GATHER_SQL))
def jn09(spark, d):
    v = views.numbered(spark, d).select("row_id", "variant_id", "f1")
    order = rows.shuffle_positions(v.select("row_id"), 7, name="position")
    return rows.gather(order, v)


@query(
    "jn10_match_row_numbers",
    with_views(
        "SELECT row_id, variant_id FROM v WHERE variant_id IN (SELECT variant_id FROM v WHERE status = 'F')"
    ),
)
def jn10(spark, d):
    v = views.numbered(spark, d)
    return joins.match_row_numbers(v, v.filter("status = 'F'"))


@query(
    "jn11_merge_with_ids",
    """SELECT coalesce(p.event_id, o.o_orderkey) AS row_id, p.value
       FROM events p FULL JOIN orders o ON p.event_id = o.o_orderkey""",
)
def jn11(spark, d):
    p = views.predictions(spark, d).select("row_id", "value")
    ids = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"))
    return joins.merge_with_ids(p, ids, "row_id")


CASCADE_SQL = """
WITH u AS (SELECT DISTINCT chrom, pos, ref, alt FROM v),
a AS (SELECT chrom, pos, ref, alt, min(f1) AS s FROM v WHERE status = 'F' AND flag = 'A' GROUP BY ALL),
b AS (SELECT chrom, pos, ref, alt, min(f1) AS s FROM v WHERE flag <> 'N' GROUP BY ALL)
SELECT u.chrom, u.pos, u.ref, u.alt,
       CASE WHEN a.s IS NOT NULL THEN 'first' WHEN b.s IS NOT NULL THEN 'second' END AS found_in,
       coalesce(a.s, b.s) AS raw_score
FROM u LEFT JOIN a ON u.chrom = a.chrom AND u.pos = a.pos AND u.ref = a.ref AND u.alt = a.alt
       LEFT JOIN b ON u.chrom = b.chrom AND u.pos = b.pos AND u.ref = b.ref AND u.alt = b.alt
"""


def prescored(v):
    scored = v.select(*KEY, "flag", "status", F.col("f1").alias("raw_score"))
    return [
        ("first", scored.filter("status = 'F' AND flag = 'A'")),
        ("second", scored.filter("flag <> 'N'")),
    ]


@query("jn12_prescored_cascade", with_views(CASCADE_SQL))
def jn12(spark, d):
    v = views.variants(spark, d)
    unique = v.select(*joins.GROUP_KEY).dropDuplicates()
    return joins.first_table_holding(unique, prescored(v), ["raw_score"], at_most=v.count()).select(
        *KEY, "found_in", "raw_score"
    )


@query(
    "jn13_scored_regions",
    with_views(
        "SELECT chrom, pos, ref, alt, f1 FROM v WHERE (chrom, pos) IN (SELECT (chrom, pos) FROM v WHERE status = 'F')"
    ),
)
def jn13(spark, d):
    """Scores laid out by position; only files that can hold a wanted one are opened."""
    v = views.variants(spark, d)
    path = fresh_path(spark, "scores")
    ranged.write_ranged(v.select(*KEY, "f1"), path, ["chrom", "pos"])
    return ranged.scored_positions(v.filter("status = 'F'"), path)


@query(
    "jn13_scores_in_spans",
    with_views(
        """SELECT chrom, pos, ref, alt, f1 FROM v WHERE EXISTS (
             SELECT 1 FROM orders WHERE CAST(o_custkey % 22 + 1 AS VARCHAR) = chrom
             AND pos > o_orderkey * 10 AND pos <= o_orderkey * 10 + (o_orderkey % 5) * 40000 + 30 AND o_orderkey % 7 = 0)"""
    ),
)
def jn13_spans(spark, d):
    """Scores in spans of tens of bases to a part of a chromosome."""
    path = fresh_path(spark, "scores")
    ranged.write_ranged(views.variants(spark, d).select(*KEY, "f1"), path, ["chrom", "pos"])
    key = F.col("o_orderkey")
    regions = views.table(spark, d, "orders").filter(key % 7 == 0).select(
        (F.col("o_custkey") % 22 + 1).cast("string").alias("chrom"),
        (key * 10).alias("start"),
        (key * 10 + (key % 5) * 40000 + 30).alias("end"),
    )
    return ranged.scores_between(regions, path)


@query("jn14_attach_ids", with_views("SELECT row_id, f0, f1, variant_id FROM v"))
def jn14(spark, d):
    v = views.numbered(spark, d)
    return joins.attach_ids(v.select("row_id", "f0", "f1"), v)


THRESHOLD_SQL = """
WITH t AS (SELECT p_retailprice AS threshold, max(CAST(p_size AS DOUBLE)) AS scaled FROM part GROUP BY 1),
s AS (SELECT variant_id, row_id, f0 * 40 AS raw_score FROM v)
SELECT s.variant_id, s.row_id, s.raw_score, t.scaled AS scaled_score
FROM s ASOF LEFT JOIN t ON s.raw_score >= t.threshold
"""


def conversion(spark, d):
    return views.table(spark, d, "part").select(
        F.col("p_retailprice").alias("threshold"), F.col("p_size").cast("double").alias("scaled")
    )


@query("jn15_threshold_lookup", with_views(THRESHOLD_SQL))
def jn15(spark, d):
    scores = views.numbered(spark, d).select(
        "variant_id", "row_id", (F.col("f0") * 40).alias("raw_score")
    )
    return joins.threshold_lookup(scores, conversion(spark, d))


@query("jn15_threshold_lookup_large_table", with_views(THRESHOLD_SQL))
def jn15_large(spark, d):
    scores = views.numbered(spark, d).select(
        "variant_id", "row_id", (F.col("f0") * 40).alias("raw_score")
    )
    slim = (
        conversion(spark, d)
        .groupBy(F.col("threshold").alias("__t"))
        .agg(F.max("scaled").alias("__v"))
    )
    return joins.bucketed_threshold_lookup(scores, slim, "raw_score", "scaled_score", buckets=64)


OVERLAP_SQL = """
WITH e AS (
  SELECT o_orderkey AS exon, CAST(o_custkey % 22 + 1 AS VARCHAR) AS chrom,
         o_orderkey * 10 + 5 - 1 - CASE WHEN o_orderstatus <> 'F' THEN 50 ELSE 13 END AS s,
         o_orderkey * 10 + 5 + 40 + CASE WHEN o_orderstatus <> 'F' THEN 13 ELSE 50 END AS e
  FROM orders)
SELECT v.row_id, v.variant_id, e.exon FROM v JOIN e
ON v.chrom = e.chrom AND v.pos - 1 < e.e AND e.s < v.pos - 1 + length(v.ref)
"""


@query("jn16_exon_overlap", with_views(OVERLAP_SQL))
def jn16(spark, d):
    start = F.col("pos").cast("bigint") - 1
    v = views.numbered(spark, d).select(
        "row_id", "variant_id", "chrom", start.alias("start"), (start + F.length("ref")).alias("end")
    )
    first = F.col("o_orderkey") * 10 + 5
    exons = views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("exon"),
        (F.col("o_custkey") % 22 + 1).cast("string").alias("chrom"),
        first.alias("start"),
        (first + 40).alias("end"),
        F.when(F.col("o_orderstatus") == "F", "-").otherwise("+").alias("strand"),
    )
    pairs = joins.overlap_join(v, joins.flank_exons(exons), bin_size=512)
    return pairs.select("row_id", "variant_id", "exon")


@query(
    "set01_concat_variants",
    with_views(
        "SELECT chrom, pos, ref, alt, '.' AS qual, '.' AS filter, '.' AS info FROM v WHERE status = 'F' UNION ALL "
        "SELECT chrom, pos, ref, alt, '.', '.', '.' FROM v WHERE flag <> 'N'"
    ),
)
def set01(spark, d):
    v = views.variants(spark, d)
    sources = [v.filter("status = 'F'").select(*KEY), v.filter("flag <> 'N'").select(*KEY)]
    merged = sets.concat_variants(sources, ["qual", "filter", "info"])
    return merged.orderBy("chrom", "pos")


RENUMBER_SQL = """
WITH u AS (SELECT 0 AS source_no, row_id, variant_id, f0 FROM v WHERE status = 'F' UNION ALL
           SELECT 1, row_id, variant_id, f0 FROM v WHERE flag <> 'N')
SELECT row_number() OVER (ORDER BY source_no, row_id) - 1 AS row_id, source_no, variant_id, f0 FROM u
"""


def _ordered_sources(spark, d, *columns):
    v = views.numbered(spark, d)
    picked = ["row_id", *columns]
    return [v.filter("status = 'F'").select(*picked), v.filter("flag <> 'N'").select(*picked)]


@query("set02_concat_ids", with_views(RENUMBER_SQL.replace(", f0 FROM u", " FROM u")))
def set02(spark, d):
    return sets.concat_ordered(_ordered_sources(spark, d, "variant_id"))


@query("set03_stack_rows", with_views(RENUMBER_SQL))
def set03(spark, d):
    return sets.concat_ordered(_ordered_sources(spark, d, "variant_id", "f0"))


@query(
    "set03_stack_gap_free",
    with_views(
        """WITH u AS (SELECT 0 AS source_no, row_id, variant_id, f0 FROM v UNION ALL
             SELECT 1, row_number() OVER (ORDER BY row_id) - 1, variant_id, f0 FROM v WHERE flag <> 'N')
           SELECT row_number() OVER (ORDER BY source_no, row_id) - 1 AS row_id, source_no, variant_id, f0 FROM u"""
    ),
)
def set03_gap_free(spark, d):
    """Sources numbered without gaps: no row moves, the second one only gets an offset."""
    v = views.numbered(spark, d).select("row_id", "variant_id", "f0")
    second = rows.number_rows(views.numbered(spark, d).filter("flag <> 'N'"), ["row_id"], "n", ["variant_id", "f0"])
    return sets.concat_ordered([v, second.select(F.col("n").alias("row_id"), "variant_id", "f0")])


SETS_SQL = """
SELECT a AS in_a, b AS in_b, c AS in_c, count(*) AS n FROM (
  SELECT variant_id, bool_or(status = 'F') AS a, bool_or(flag <> 'N') AS b, bool_or(f0 > 25) AS c FROM v GROUP BY 1)
WHERE a OR b OR c GROUP BY 1, 2, 3
"""


def _three_sets(v):
    return {"a": v.filter("status = 'F'"), "b": v.filter("flag <> 'N'"), "c": v.filter("f0 > 25")}


@query("set04_overlap", with_views(SETS_SQL))
def set04(spark, d):
    return sets.overlap_counts(_three_sets(views.variants(spark, d)))


@query(
    "set04_shared_count",
    with_views(
        "SELECT count(*) AS n_shared FROM (SELECT variant_id FROM v WHERE status = 'F' INTERSECT "
        "SELECT variant_id FROM v WHERE flag <> 'N' INTERSECT SELECT variant_id FROM v WHERE f0 > 25)"
    ),
)
def set04_shared(spark, d):
    return sets.shared_count(list(_three_sets(views.variants(spark, d)).values()))


@query(
    "set05_difference",
    with_views("SELECT row_id, variant_id FROM v WHERE row_id NOT IN (SELECT event_id FROM events)"),
)
def set05(spark, d):
    v = views.numbered(spark, d).select("row_id", "variant_id")
    return joins.without(v, views.predictions(spark, d), "row_id")


@query(
    "set06_keep_first",
    with_views(
        "SELECT row_id, chrom, pos, ref, alt, f0, f1 FROM v"
        " QUALIFY row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY row_id) = 1"
    ),
)
def set06(spark, d):
    return sets.keep_first(views.numbered(spark, d).select("row_id", *KEY, "f0", "f1"))


@query(
    "set07_adjacent_repeats",
    with_views(
        "SELECT row_id, pos, ref FROM v QUALIFY row_id = 0"
        " OR pos <> lag(pos) OVER (ORDER BY row_id) OR ref <> lag(ref) OVER (ORDER BY row_id)"
    ),
)
def set07(spark, d):
    v = views.numbered(spark, d).select("row_id", "pos", "ref")
    return sets.drop_adjacent_repeats(v, ["pos", "ref"])


@query(
    "set08_ordered_distinct",
    with_views("SELECT variant_id, min(row_id) AS first_row FROM v GROUP BY variant_id"),
)
def set08(spark, d):
    return sets.ordered_distinct(views.numbered(spark, d), "variant_id")


@query(
    "set09_merge_scored",
    with_views(
        "SELECT chrom, pos, ref, alt, f1 FROM v WHERE status = 'F' UNION ALL SELECT chrom, pos, ref, alt, f1 FROM v WHERE flag <> 'N'"
    ),
)
def set09(spark, d):
    v = views.variants(spark, d)
    path = fresh_path(spark, "merged")
    scored = v.select(*KEY, "f1", "status", "flag")
    merged = sets.merge_sorted(
        [
            scored.filter("status = 'F'").select(*KEY, "f1"),
            scored.filter("flag <> 'N'").select(*KEY, "f1"),
        ]
    )
    writers.save(merged, path)
    return spark.read.parquet(path)
