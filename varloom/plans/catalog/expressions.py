"""Projections and filters over the variant, prediction and document views."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom import schemas
from varloom.functions import features as fx, scores as sx, variants as vx
from varloom.operators import filters
from varloom.plans import views
from varloom.plans.registry import query
from varloom.plans.views import FEATURES, with_views
from varloom.session import fresh_path
from varloom.sources import readers, writers


def _alts():
    return F.split("alt", ",")


def _inputs():
    return F.array(*FEATURES)


def _infinite_inputs():
    """Features with f2 infinite where f3 is zero and minus infinite where f2 is zero."""
    inf = float("inf")
    f2 = F.when(F.col("f3") == 0, inf).when(F.col("f2") == 0, -inf).otherwise(F.col("f2"))
    return F.array(F.col("f0"), F.col("f1"), f2)


@query(
    "prj01_variant_id",
    with_views(
        "SELECT chrom, pos, ref, alt, variant_id, concat('chr', variant_id) AS chr_id,"
        " concat(chrom, ':', CAST(pos AS VARCHAR), ':', ref, ':[''', split_part(alt, ',', 1), ''']') AS scalar_id FROM v"
    ),
)
def prj01(spark, d):
    key = F.col("chrom"), F.col("pos"), F.col("ref")
    return views.variants(spark, d).select(
        "chrom",
        "pos",
        "ref",
        "alt",
        vx.variant_id(*key, _alts()).alias("variant_id"),
        vx.variant_id(*key, _alts(), chr_word=True).alias("chr_id"),
        vx.variant_id(vx.add_chr(key[0]), key[1], key[2], F.array(_alts()[0])).alias("scalar_id"),
    )


@query("prj02_variant_id_from_alt", with_views("SELECT variant_id FROM v"))
def prj02(spark, d):
    parts = F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")
    return views.variants(spark, d).select(vx.variant_id_from_alt(*parts).alias("variant_id"))


@query(
    "prj03_parse_variant_id",
    with_views("SELECT variant_id, chrom, pos, ref, replace(alt, ',', '/') AS alts FROM v"),
)
def prj03(spark, d):
    parsed = vx.parse_variant_id(F.col("variant_id"))
    return views.variants(spark, d).select("variant_id", parsed.alias("p")).select(
        "variant_id", "p.chrom", "p.pos", "p.ref", F.array_join("p.alts", "/").alias("alts")
    )


@query(
    "prj04_chr_prefix",
    with_views("SELECT chrom, concat('chr', chrom) AS prefixed, chrom AS stripped FROM v"),
)
def prj04(spark, d):
    prefixed = vx.add_chr(F.col("chrom"))
    return views.variants(spark, d).select(
        "chrom", vx.add_chr(prefixed).alias("prefixed"), vx.strip_chr(prefixed).alias("stripped")
    )


@query(
    "prj05_interval_from_id",
    with_views(
        "SELECT variant_id, concat('chr', chrom) AS chr, pos AS \"start\", CAST(pos + 1 AS INT) AS \"end\" FROM v"
    ),
)
def prj05(spark, d):
    span = vx.interval_from_id(F.col("variant_id"))
    return views.variants(spark, d).select("variant_id", span.alias("i")).select("variant_id", "i.*")


@query(
    "prj06_interval_from_vcf",
    with_views(
        "SELECT variant_id, chrom AS chr, CAST(pos - 1 AS INT) AS \"start\","
        " CAST(pos - 1 + length(ref) AS INT) AS \"end\" FROM v"
    ),
)
def prj06(spark, d):
    span = vx.interval_from_vcf(F.col("chrom"), F.col("pos"), F.col("ref"))
    return views.variants(spark, d).select("variant_id", span.alias("i")).select("variant_id", "i.*")


@query(
    "prj07_stranded_interval",
    with_views(
        "SELECT variant_id, chrom AS chr, pos AS \"start\", CAST(pos + 1 AS INT) AS \"end\", '*' AS strand FROM v"
    ),
)
def prj07(spark, d):
    span = vx.stranded_interval(F.col("chrom"), F.col("pos"))
    return views.variants(spark, d).select("variant_id", span.alias("i")).select("variant_id", "i.*")


@query(
    "prj08_constant_columns",
    with_views("SELECT variant_id, '.' AS qual, '.' AS filter, '.' AS info FROM v"),
)
def prj08(spark, d):
    dot = F.lit(".")
    return views.variants(spark, d).select(
        "variant_id", dot.alias("qual"), dot.alias("filter"), dot.alias("info")
    )


@query("prj09_drop_metadata", with_views("SELECT chrom, pos, ref, alt FROM v"))
def prj09(spark, d):
    """Variant columns of a written file that has the four metadata columns as well."""
    path = fresh_path(spark, "annotated")
    v = views.variants(spark, d)
    dot = F.lit(".")
    lines = v.select("chrom", "pos", dot.alias("id"), "ref", "alt", *[dot.alias(c) for c in ("qual", "filter", "info")])
    writers.write_tabbed(lines, path)
    return readers.read_vcf(spark, path, schemas.VCF8).drop("id", "qual", "filter", "info")


@query(
    "prj10_relabel",
    with_views(
        "SELECT variant_id, CASE WHEN y = -1 THEN 0 ELSE y END AS target, CASE WHEN y = -1 THEN 0 ELSE 1 END AS two_class FROM v"
    ),
)
def prj10(spark, d):
    y = F.col("y")
    return views.variants(spark, d).select(
        "variant_id", fx.relabel(y).alias("target"), fx.binarise(y).alias("two_class")
    )


@query(
    "prj11_split_target",
    with_views("SELECT variant_id, f1 AS target, f0, f2, f3, CAST(3 AS INT) AS width FROM v"),
)
def prj11(spark, d):
    parts = fx.split_target(_inputs(), 1)
    v = views.variants(spark, d).select("variant_id", parts.alias("p"))
    inputs = F.col("p.inputs")
    return v.select(
        "variant_id",
        F.col("p.target").alias("target"),
        *[inputs[i].alias(n) for i, n in enumerate(["f0", "f2", "f3"])],
        F.size(inputs).alias("width"),
    )


@query("prj12_parse_line", with_views("SELECT variant_id, CAST(y AS DOUBLE) AS y, f0, f1, f2, f3 FROM v"))
def prj12(spark, d):
    names = ["y", *FEATURES]
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in names])
    v = views.variants(spark, d).select("variant_id", fx.parse_line(line, "|").alias("a"))
    return v.select("variant_id", *[F.col("a")[i].alias(n) for i, n in enumerate(names)])


@query(
    "prj13_cast_values",
    with_views(
        "SELECT variant_id, CAST(CAST(f1 AS FLOAT) AS DOUBLE) AS f1, CAST(CAST(f2 AS FLOAT) AS DOUBLE) AS f2,"
        " f1 <= 65504 AS fits_half FROM v"
    ),
)
def prj13(spark, d):
    narrow = fx.to_float(F.array("f1", "f2"))
    return views.variants(spark, d).select(
        "variant_id",
        narrow[0].cast("double").alias("f1"),
        narrow[1].cast("double").alias("f2"),
        (F.col("f1") <= fx.TYPE_LIMITS["float16"][1]).alias("fits_half"),
    )


@query(
    "prj14_cap_infinite_rows",
    with_views(
        "SELECT variant_id, CASE WHEN f3 = 0 OR f2 = 0 THEN least(f0, 65500) ELSE f0 END AS f0,"
        " CASE WHEN f3 = 0 OR f2 = 0 THEN least(f1, 65500) ELSE f1 END AS f1,"
        " CASE WHEN f3 = 0 THEN 65500 WHEN f2 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE f2 END AS f2 FROM v"
    ),
)
def prj14(spark, d):
    v = views.variants(spark, d).select(
        "variant_id", fx.cap_if_infinite(_infinite_inputs()).alias("a")
    )
    return v.select("variant_id", *[F.col("a")[i].alias(f"f{i}") for i in range(3)])


@query(
    "prj15_cap_values",
    with_views(
        "SELECT variant_id, least(f0, 65500) AS f0, least(f1, 65500) AS f1, least(f2, 65500) AS f2, least(f3, 65500) AS f3 FROM v"
    ),
)
def prj15(spark, d):
    v = views.variants(spark, d).select("variant_id", fx.cap_values(_inputs()).alias("a"))
    return v.select("variant_id", *[F.col("a")[i].alias(f) for i, f in enumerate(FEATURES)])


CELLS_SQL = " UNION ALL ".join(
    f"SELECT row_id, CAST({i} AS INT) AS idx, {f} AS value FROM v WHERE {f} <> 0"
    for i, f in enumerate(FEATURES)
)


@query("prj16_dense_to_sparse", with_views(CELLS_SQL))
def prj16(spark, d):
    packed = fx.with_sparse(views.feature_array(views.numbered(spark, d)), "inputs", "packed", len(FEATURES))
    cells = packed.withColumn("dense", fx.dense_array(F.col("packed")))
    return fx.nonzero_cells(cells, "row_id", "dense")


@query("prj17_sparse_to_dense", with_views("SELECT variant_id, f0, f1, f2, f3 FROM v"))
def prj17(spark, d):
    packed = fx.with_sparse(views.feature_array(views.variants(spark, d)), "inputs", "packed", 4)
    dense = fx.dense_array(F.col("packed"))
    return packed.select("variant_id", *[dense[i].alias(f) for i, f in enumerate(FEATURES)])


@query(
    "prj18_prefix_columns",
    'SELECT event_id AS row_id, value AS "db:diff_value", CAST(user_id AS DOUBLE) AS "db:diff_user" FROM events',
)
def prj18(spark, d):
    p = views.predictions(spark, d).select("row_id", "value", "user")
    return fx.prefix_columns(p, "db", "diff", ["value", "user"])


@query(
    "prj19_nested_predictions",
    """SELECT event_id AS row_id, 'diff' AS score, 'value' AS output, value FROM events UNION ALL
       SELECT event_id, 'diff', 'user', CAST(user_id AS DOUBLE) FROM events UNION ALL
       SELECT event_id, 'half', 'value', value / 2 FROM events""",
)
def prj19(spark, d):
    nested = fx.nested_predictions(
        {
            "diff": {"value": F.col("value"), "user": F.col("user")},
            "half": {"value": F.col("value") / 2},
        }
    )
    p = views.predictions(spark, d).select("row_id", F.explode(nested).alias("score", "outputs"))
    return p.select("row_id", "score", F.explode("outputs").alias("output", "value"))


@query(
    "prj20_parse_annotation",
    with_views(
        "SELECT variant_id, f1 AS scaled_score, CASE WHEN f2 = 0 THEN NULL ELSE f3 END AS raw_score FROM v"
    ),
)
def prj20(spark, d):
    raw = F.when(F.col("f2") == 0, "").otherwise(F.col("f3").cast("string"))
    csq = F.concat_ws("|", F.col("f1").cast("string"), raw, F.col("ref"))
    entries = F.concat(csq, F.lit(","), F.lit("9|9|N"))
    scored = vx.first_annotation_scores(entries)
    return views.variants(spark, d).select("variant_id", scored.alias("s")).select("variant_id", "s.*")


@query(
    "prj21_log_odds",
    with_views(
        "SELECT variant_id, round(ln((f0 / 51) / (1 - f0 / 51)), 9) AS log_odds FROM v"
    ),
)
def prj21(spark, d):
    p1 = F.col("f0") / 51
    return views.variants(spark, d).select(
        "variant_id", F.round(sx.log_odds(p1, 1 - p1), 9).alias("log_odds")
    )


@query(
    "prj22_alt_minus_ref",
    """SELECT event_id AS row_id, value - user_id AS d0, round(2 * value - user_id / 2, 9) AS d1,
              CAST(user_id AS DOUBLE) AS s0, round(2 * value, 9) AS s3 FROM events""",
)
def prj22(spark, d):
    alt, ref = F.array(F.col("value"), 2 * F.col("value")), F.array(F.col("user"), F.col("user") / 2)
    p = views.predictions(spark, d).select(
        "row_id", fx.difference(alt, ref).alias("d"), fx.stack(ref, alt).alias("s")
    )
    return p.select(
        "row_id",
        F.col("d")[0].alias("d0"),
        F.round(F.col("d")[1], 9).alias("d1"),
        F.col("s")[0].alias("s0"),
        F.round(F.col("s")[3], 9).alias("s3"),
    )


@query(
    "prj23_flat_record",
    with_views(
        "SELECT chrom, pos, CASE WHEN flag = 'N' THEN '.' ELSE flag END AS id, ref, split_part(alt, ',', 1) AS alt FROM v"
    ),
)
def prj23(spark, d):
    name = F.nullif("flag", F.lit("N"))
    record = vx.flat_record(F.col("chrom"), F.col("pos"), name, F.col("ref"), _alts())
    return views.variants(spark, d).select(record.alias("r")).select("r.*")


@query(
    "prj24_vcf_lines",
    with_views(
        "SELECT concat_ws(chr(9), chrom, CAST(pos AS VARCHAR), concat('v', CAST(row_id + 1 AS VARCHAR)), ref,"
        " split_part(alt, ',', 1)) AS line FROM v"
    ),
)
def prj24(spark, d):
    line = vx.vcf_line_from_id(F.col("variant_id"), F.col("row_id"))
    return views.numbered(spark, d).select(line.alias("line"))


@query(
    "prj25_region_from_id",
    with_views("SELECT chrom, pos, ref, split_part(alt, ',', 1) AS alt FROM v"),
)
def prj25(spark, d):
    region = vx.region_from_id(F.col("variant_id"))
    return views.variants(spark, d).select(region.alias("r")).select("r.*")


@query(
    "prj26_index_column",
    with_views("SELECT CAST(f0 AS BIGINT) AS row_index, f1, f2, f3, CAST(3 AS INT) AS width FROM v"),
)
def prj26(spark, d):
    parts = fx.split_target(_inputs(), 0)
    v = views.variants(spark, d).select(parts.alias("p"))
    rest = F.col("p.inputs")
    return v.select(
        F.col("p.target").cast("bigint").alias("row_index"),
        *[rest[i].alias(n) for i, n in enumerate(FEATURES[1:])],
        F.size(rest).alias("width"),
    )


STRANDS_SQL = """
WITH p AS (SELECT variant_id, f0 / 51 AS r, (51 - f0) / 52 AS a, (f0 + 1) / 53 AS rr, (52 - f0) / 54 AS ar FROM v)
SELECT variant_id, round(((a - r) + (ar - rr)) / 2, 9) AS diff,
       round(greatest(ln(r / (1 - r)), ln(rr / (1 - rr))), 9) AS logit_ref,
       round(((ln(a / (1 - a)) - ln(r / (1 - r))) + (ln(ar / (1 - ar)) - ln(rr / (1 - rr)))) / 2, 9) AS logit
FROM p
"""


@query("prj27_effect_scores", with_views(STRANDS_SQL))
def prj27(spark, d):
    f0 = F.col("f0")
    ref, alt = F.array(f0 / 51), F.array((51 - f0) / 52)
    ref_rc, alt_rc = F.array((f0 + 1) / 53), F.array((52 - f0) / 54)
    chosen = {"diff": ("diff", "mean"), "logit_ref": ("logit_ref", "max"), "logit": ("logit", "mean")}
    return views.variants(spark, d).select(
        "variant_id",
        *[
            F.round(sx.effect_score(score, ref, alt, ref_rc, alt_rc, merge)[0], 9).alias(name)
            for name, (score, merge) in chosen.items()
        ],
    )


@query("flt01_chromosome", with_views("SELECT * EXCLUDE (row_id) FROM v WHERE chrom = '2'"))
def flt01(spark, d):
    return filters.on_chromosome(views.variants(spark, d), "2")


@query(
    "flt02_lines_with_term",
    "SELECT doc_id, source FROM documents WHERE contains(text, 'data') OR starts_with(text, '#')",
)
def flt02(spark, d):
    docs = views.table(spark, d, "documents")
    return filters.lines_with_term(docs, "data", "text").select("doc_id", "source")


@query(
    "flt03_split_classes",
    with_views("SELECT CASE WHEN y = -1 THEN 'zero' ELSE 'nonzero' END AS part, variant_id FROM v"),
)
def flt03(spark, d):
    v = views.variants(spark, d).select("variant_id", fx.relabel(F.col("y")).alias("target"))
    nonzero, zero = filters.split_classes(v)
    return nonzero.select(F.lit("nonzero").alias("part"), "variant_id").unionAll(
        zero.select(F.lit("zero").alias("part"), "variant_id")
    )


@query(
    "flt04_first_positives",
    with_views("SELECT row_id, variant_id FROM v WHERE y = 1 ORDER BY row_id LIMIT 1000"),
)
def flt04(spark, d):
    return filters.first_positives(views.numbered(spark, d), 1000).select("row_id", "variant_id")


@query("flt05_single_base_ref", with_views("SELECT variant_id, ref FROM v WHERE length(ref) = 1"))
def flt05(spark, d):
    return filters.single_base_ref(views.variants(spark, d)).select("variant_id", "ref")


@query(
    "flt06_bad_rows",
    with_views("SELECT variant_id, f0 FROM v WHERE f3 = 0 OR f2 = 0"),
)
def flt06(spark, d):
    v = views.variants(spark, d).select("variant_id", "f0", _infinite_inputs().alias("inputs"))
    return filters.bad_rows(v).select("variant_id", "f0")


@query(
    "flt06_bad_columns",
    with_views("SELECT CAST(2 AS INT) AS idx, count(*) AS n_bad FROM v WHERE f3 = 0 OR f2 = 0"),
)
def flt06_columns(spark, d):
    v = views.variants(spark, d).select(_infinite_inputs().alias("inputs"))
    return filters.bad_columns(v)


@query("flt07_find_lines", "SELECT doc_id FROM documents WHERE contains(text, 'the')")
def flt07(spark, d):
    return filters.find_lines(views.table(spark, d, "documents"), "the", "text", "doc_id")


@query("flt08_varied_columns", with_views("SELECT variant_id, y, f0, f1 FROM v"))
def flt08(spark, d):
    v = views.variants(spark, d)
    return v.select("variant_id", *filters.varied_columns(v, ["y", *FEATURES]))


@query(
    "flt09_compare_columns",
    with_views('SELECT variant_id, f1 AS "f1.na", \'f2\' AS right_only FROM v'),
)
def flt09(spark, d):
    """Rows of one table cut down to the indicator columns whose base the other table has."""
    v = views.variants(spark, d)
    left = v.select(
        "variant_id", F.col("f1").alias("f1.na"), F.col("f0").alias("f9.na"), F.col("f1")
    )
    found = filters.compare_columns(left, v.select("variant_id", "f1", "f2"))
    return left.select(
        "variant_id",
        *[F.col(f"`{c}`") for c in found["with_base"]],
        F.lit(",".join(found["right_only"])).alias("right_only"),
    )


@query("flt10_columns_with_max", with_views("SELECT variant_id, y FROM v"))
def flt10(spark, d):
    v = views.variants(spark, d)
    return v.select("variant_id", *filters.columns_with_max(v, ["y", *FEATURES]))


@query(
    "flt11_nonzero_targets",
    with_views(
        "SELECT row_id, (SELECT count(*) FROM v WHERE y NOT IN (0, 1)) AS non_binary FROM v WHERE y = 1"
    ),
)
def flt11(spark, d):
    v = views.numbered(spark, d)
    bad = v.agg(filters.non_binary_targets(F.col("y"))).scalar()
    return v.filter(fx.relabel(F.col("y")) != 0).select("row_id", bad.alias("non_binary"))
