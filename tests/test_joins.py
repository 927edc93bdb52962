import bisect
import os
import random

import pytest
from pyspark.sql import functions as F

from varloom import session
from varloom.operators import joins, sets


def stackable(spark, ids, width, target=False):
    cols = ["row_id long", "inputs array<double>"] + (["target int"] if target else [])
    data = [(i, [float(i)] * width) + ((i % 2,) if target else ()) for i in ids]
    return spark.createDataFrame(data, ", ".join(cols))


def test_stack_keeps_source_order(spark):
    parts = [stackable(spark, range(5), 2, True), stackable(spark, range(5), 1)]
    got = joins.hstack(parts).orderBy("row_id").collect()
    assert [r["inputs"] for r in got] == [[float(i)] * 3 for i in range(5)]
    assert [r["target"] for r in got] == [0, 1, 0, 1, 0]


def test_stack_refuses_two_targets(spark):
    with pytest.raises(ValueError, match="target"):
        joins.hstack([stackable(spark, range(2), 1, True)] * 2)


@pytest.mark.parametrize("other", [range(4), range(6), range(1, 6)])
def test_stack_refuses_unequal_rows(spark, other):
    parts = [stackable(spark, range(5), 1), stackable(spark, other, 1)]
    with pytest.raises(Exception, match="sources differ"):
        joins.hstack(parts).collect()
    with pytest.raises(Exception, match="sources differ"):
        joins.hstack(parts).select("inputs").collect()
    assert joins.hstack(parts, strict=False).count() == len(set(range(5)) & set(other))


def test_stack_exchanges_each_source_once(spark):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        parts = [stackable(spark, range(100), 1).repartition(3) for _ in range(4)]
        for strict in (True, False):
            plan = joins.hstack(parts, strict=strict)._jdf.queryExecution().executedPlan()
            assert plan.toString().count("Exchange hashpartitioning(row_id") == 4
    finally:
        spark.conf.set(limit, old)


def test_repeated_feature_names_are_refused(spark):
    a = spark.createDataFrame([("v", 1.0)], "variant_id string, x double")
    with pytest.raises(ValueError, match="repeated"):
        joins.join_predictions([a, a])


def test_missing_id_fails_and_repeats_stay(spark):
    store = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "variant_id string, x double")
    ids = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "row_id long, variant_id string")
    got = joins.lookup(ids, store).orderBy("row_id").collect()
    assert [r["x"] for r in got] == [2.0, 1.0, 2.0]
    more = ids.union(spark.createDataFrame([(3, "zz")], ids.schema))
    with pytest.raises(Exception, match="no record for id zz"):
        joins.lookup(more, store).collect()
    with pytest.raises(Exception, match="no record for id zz"):
        joins.lookup(more, store).select("row_id", "x").collect()


def test_merge_with_ids_keeps_both_sides(spark):
    preds = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "variant_id string, x double")
    ids = spark.createDataFrame([("b",), ("b",), ("c",)], "variant_id string")
    got = sorted((r["variant_id"], r["x"] or -1) for r in joins.merge_with_ids(preds, ids).collect())
    assert got == [("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", -1)]


def test_first_table_wins(spark):
    key = "chrom string, pos int, ref string, alt string"
    one = spark.createDataFrame([("1", 1, "A", "T", 5.0)], key + ", s double")
    two = spark.createDataFrame([("1", 1, "A", "T", 9.0), ("1", 2, "A", "T", 7.0)], key + ", s double")
    v = spark.createDataFrame([("1", 1, "A", "T"), ("1", 2, "A", "T"), ("1", 3, "A", "T")], key)
    got = joins.first_table_holding(v, [("one", one), ("two", two)], ["s"]).orderBy("pos").collect()
    assert [(r["found_in"], r["s"]) for r in got] == [("one", 5.0), ("two", 7.0), (None, None)]


def thresholds(spark):
    rng = random.Random(4)
    steps = sorted({round(rng.uniform(-5, 5), 3) for _ in range(300)})
    table = spark.createDataFrame([(t, float(i)) for i, t in enumerate(steps)], "threshold double, scaled double")
    # Two thirds of the scores are one value, some lie below every threshold, some are missing.
    values = [1.2345] * 2000 + [rng.uniform(-7, 7) for _ in range(1000)] + [steps[0], steps[-1], None, float("nan")]
    scores = spark.createDataFrame(list(enumerate(values)), "row_id long, raw_score double")

    def expected(x):
        if x is None or x != x:
            return None
        i = bisect.bisect_right(steps, x) - 1
        return float(i) if i >= 0 else None

    return table, scores, {i: expected(x) for i, x in enumerate(values)}


def test_threshold_lookup(spark):
    table, scores, expected = thresholds(spark)
    got = joins.threshold_lookup(scores, table).collect()
    assert {r["row_id"]: r["scaled_score"] for r in got} == expected


def test_threshold_lookup_beyond_the_bound(spark, monkeypatch):
    table, scores, expected = thresholds(spark)
    monkeypatch.setattr(joins, "MAX_BROADCAST_THRESHOLDS", 10)
    monkeypatch.setattr(joins, "_THRESHOLD_BUCKETS", 16)
    got = joins.threshold_lookup(scores, table).collect()
    assert len(got) == len(expected)
    assert {r["row_id"]: r["scaled_score"] for r in got} == expected


def test_threshold_lookup_in_an_empty_table(spark):
    table = spark.createDataFrame([], "threshold double, scaled double")
    scores = spark.createDataFrame([(0, 1.0)], "row_id long, raw_score double")
    assert joins.threshold_lookup(scores, table).first()["scaled_score"] is None


@pytest.mark.parametrize("bin_size", [8, 64, 4096])
def test_overlap_equals_brute_force(spark, bin_size):
    rng = random.Random(9)
    v = [(i, rng.choice("12"), s := rng.randrange(500), s + rng.randrange(1, 40)) for i in range(300)]
    e = [(i, rng.choice("12"), s := rng.randrange(-60, 500), s + rng.randrange(1, 120)) for i in range(80)]
    variants = spark.createDataFrame(v, "vid long, chrom string, start long, end long")
    spans = spark.createDataFrame(e, "eid long, chrom string, span_start long, span_end long")
    got = [(r["vid"], r["eid"]) for r in joins.overlap_join(variants, spans, bin_size).collect()]
    expected = [
        (a[0], b[0]) for a in v for b in e if a[1] == b[1] and a[2] < b[3] and b[2] < a[3]
    ]
    assert sorted(got) == sorted(expected)


def test_exon_flanks_follow_the_strand(spark):
    exons = spark.createDataFrame([("+", 101, 200), ("-", 101, 200)], "strand string, start int, end int")
    got = {r["strand"]: (r["span_start"], r["span_end"]) for r in joins.flank_exons(exons).collect()}
    assert got == {"+": (50, 213), "-": (87, 250)}


def test_overlap_counts_and_shared_count(spark):
    def ids(*names):
        return spark.createDataFrame([(n,) for n in names], "variant_id string")

    a, b = ids("x", "x", "y", "z"), ids("x", "y", "w")
    got = {(r["in_a"], r["in_b"]): r["n"] for r in sets.overlap_counts({"a": a, "b": b}).collect()}
    assert got == {(True, True): 2, (True, False): 1, (False, True): 1}
    assert sets.shared_count([a, b]).first()[0] == 2


def test_first_shard_wins(spark):
    lists = spark.createDataFrame([(1, 2), (1, 0), (2, 1)], "row_id long, shard_id int")
    rows = spark.range(4).select(F.col("id").alias("row_id"))
    got = {(r["row_id"], r["shard_id"]) for r in joins.route_to_shards(rows, lists).collect()}
    assert got == {(1, 0), (2, 1)}


def test_counting_a_lookup_finds_missing_ids(spark):
    ids = spark.createDataFrame([(0, "a"), (1, "x")], "row_id long, variant_id string")
    kept = spark.createDataFrame([("a", 1.0)], "variant_id string, f double")
    with pytest.raises(Exception, match="no record for id x"):
        joins.lookup(ids, kept).count()
    assert joins.lookup(ids.filter("row_id = 0"), kept).count() == 1


def test_counting_a_stack_finds_unequal_sources(spark):
    def source(n):
        return spark.range(n).select(F.col("id").alias("row_id"), F.array(F.lit(1.0)).alias("inputs"))

    for sizes in ([0, 2], [2, 0], [1, 2], [2, 1], [2, 2, 1]):
        with pytest.raises(Exception, match="differ in their rows"):
            joins.hstack([source(n) for n in sizes]).count()
    assert joins.hstack([source(2), source(2), source(2)]).count() == 2
    assert joins.hstack([source(0), source(0)]).count() == 0


def test_thresholds_without_value_on_both_paths(spark, monkeypatch):
    inf, nan = float("inf"), float("nan")
    table = spark.createDataFrame(
        [(10.0, 1.0), (20.0, None), (30.0, 3.0), (30.0, 2.0), (nan, 9.0), (None, 9.0), (inf, 7.0), (-inf, 0.5)],
        "threshold double, scaled double",
    )
    scores = spark.createDataFrame([(x,) for x in (-inf, 5.0, 10.0, 25.0, 30.0, inf, nan, None)], "raw_score double")
    small = joins.threshold_lookup(scores, table).collect()
    monkeypatch.setattr(joins, "MAX_BROADCAST_THRESHOLDS", 1)
    large = joins.threshold_lookup(scores, table).collect()
    want = [0.5, 0.5, 1.0, 1.0, 3.0, 7.0, None, None]

    def key(r):
        return str(r[0]), str(r[1])

    assert sorted(map(key, small)) == sorted(map(key, large)) == sorted((str(s[0]), str(w)) for s, w in zip(scores.collect(), want))


def brute_pairs(variants, spans):
    return sorted((v, s) for v, c, a, b in variants for s, d, x, y in spans if c == d and a < y and x < b)


def test_spans_of_any_length_meet_once(spark):
    rng = random.Random(11)
    variants = [(i, rng.choice("12"), p, p + rng.choice([1, 1, 2, 700, 90_000])) for i in range(400) for p in [rng.randrange(3_000_000)]]
    spans = [(i, rng.choice("12"), p, p + rng.choice([1, 90, 511, 512, 513, 5_000, 800_000])) for i in range(120) for p in [rng.randrange(3_000_000)]]
    spans += [(900, "1", 0, 250_000_000), (901, "2", -50, 10)]
    v = spark.createDataFrame(variants, "v long, chrom string, start long, end long")
    s = spark.createDataFrame(spans, "s long, chrom string, span_start long, span_end long")
    for size in (512, 4096):
        got = sorted(map(tuple, joins.overlap_join(v, s, size).select("v", "s").collect()))
        assert got == brute_pairs(variants, spans)


def test_a_chromosome_gives_a_few_rows(spark):
    long = spark.createDataFrame([("1", 0, 250_000_000)], "chrom string, start long, end long")
    start, end = F.col("start"), F.col("end")
    assert joins._in_cells(long, start, end, 4096, range(9)).count() < 10
    assert joins._in_cells(long, start, end, 4096, [0]).count() <= 2


def test_cascade_is_cut_before_any_exchange(spark):
    key = joins.VARIANT_KEY
    big = spark.range(50000).select(
        F.lit("1").alias("chrom"), F.col("id").cast("int").alias("pos"), F.lit("A").alias("ref"), F.lit("T").alias("alt"), (F.col("id") * 1.0).alias("score")
    )
    wanted = spark.createDataFrame([("1", p, "A", "T") for p in (5, 7, 49999, 60000)], "chrom string, pos int, ref string, alt string")
    got = joins.first_table_holding(wanted, [("odd", big.filter("pos % 2 = 1")), ("all", big)], ["score"])
    assert {r["pos"]: (r["found_in"], r["score"]) for r in got.collect()} == {
        5: ("odd", 5.0), 7: ("odd", 7.0), 49999: ("odd", 49999.0), 60000: (None, None)
    }
    passed = joins.maybe_wanted(big, joins.wanted_filter(wanted, key), key)
    assert passed.count() < 100
    plan = passed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(chrom" not in plan


def test_long_lists_of_row_numbers_meet_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(joins, "MAX_BROADCAST_IDS", 10)
    rows = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("x"))
    wanted = spark.range(0, 9000, 3).select(F.col("id").alias("row_id"))
    for df, left in ((joins.subset(rows, wanted, "row_id"), 667), (joins.without(rows, wanted, "row_id"), 1333)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # As many tasks as the longer side asks for.
        assert plan.count("30), REPARTITION_BY_NUM") == 2
        assert df.count() == left
    short = joins.subset(rows, spark.range(0, 9).select(F.col("id").alias("row_id")), "row_id")
    assert "BroadcastHashJoin" in short._jdf.queryExecution().executedPlan().toString()
    assert short.count() == 9


def test_long_variant_lists_make_no_filter_and_sort_by_position(spark, monkeypatch):
    import __spark_entry__ as entry

    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    cascade = entry.queries()["jn12_prescored_cascade"]
    before = cascade(spark, sf_dir)
    plan = before._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "hashpartitioning(chrom" not in plan and "Sort [chrom" not in plan
    # More keys than the filter has bits would set nearly all of them.
    monkeypatch.setattr(joins, "_FILTER_BITS", 6)
    after = cascade(spark, sf_dir)
    assert "bit_or" not in after._jdf.queryExecution().executedPlan().toString()
    assert before.exceptAll(after).count() == after.exceptAll(before).count() == 0


def test_score_variants_joins_by_position_first(spark, monkeypatch):
    from varloom.plans import jobs

    seen = []
    plain = jobs.write_through
    monkeypatch.setattr(jobs, "write_through", lambda df, label: (seen.append((df, label)), plain(df, label))[1])
    monkeypatch.setattr(joins, "_FILTER_BITS", 1)
    variants = spark.createDataFrame([("1", p, "A", "T") for p in (3, 1, 2, 3, 4)], "chrom string, pos int, ref string, alt string")
    known = variants.filter("pos = 2").withColumns({"raw_score": F.lit(7.0), "scaled_score": F.lit(1.0)})
    annotations = variants.filter("pos < 4").distinct().withColumn("f", F.col("pos") * 1.0)
    steps = spark.createDataFrame([(0.0, 10.0), (5.0, 20.0)], "threshold double, scaled double")
    got = jobs.score_variants(
        variants, [("known", known)], annotations, ["f"], {"f": 9.0}, lambda df: df.withColumn("raw_score", F.col("f") + 1), steps
    )
    assert [tuple(r) for r in got.select("pos", "raw_score", "scaled_score").collect()] == [
        (1, 2.0, 10.0), (2, 7.0, 1.0), (3, 4.0, 10.0), (4, 10.0, 20.0)
    ]
    plan = seen[0][0]._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" not in plan and "hashpartitioning(chrom" not in plan and "hashpartitioning(pos" in plan
