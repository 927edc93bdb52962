import hashlib
import math
import os

import pytest
from pyspark.sql import functions as F

from varloom import session
from varloom.operators import rows, sets, splits
from varloom.plans import views


def md5_order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i))


def test_numbering_with_a_first_key_that_fills_the_table(spark):
    n = 5000
    df = spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(77).alias("a"), "id"
    )
    got = rows.number_rows(df.repartition(7), ["a", "id"]).collect()
    expected = sorted((r["a"], r["id"]) for r in df.collect())
    assert [(r["a"], r["id"]) for r in sorted(got, key=lambda r: r["row_id"])] == expected
    assert sorted(r["row_id"] for r in got) == list(range(n))


def test_numbering_keeps_named_columns_only(spark):
    df = spark.range(10).select("id", (-F.col("id")).alias("k"))
    got = rows.number_rows(df, ["k"], "place", keep=["id"])
    assert got.columns == ["id", "place"]
    assert {(r["id"], r["place"]) for r in got.collect()} == {(i, 9 - i) for i in range(10)}


def test_shuffle_is_the_hash_order_and_gather_undoes_it(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("x"))
    shuffled = rows.shuffle_positions(df, 13)
    got = {r["shuffled_id"]: r["row_id"] for r in shuffled.collect()}
    assert [got[i] for i in range(3000)] == md5_order(range(3000), 13)
    order = shuffled.select("row_id", F.col("shuffled_id").alias("position"))
    moved = rows.gather(order, df)
    back = order.select(F.col("row_id").alias("position"), F.col("position").alias("row_id"))
    restored = rows.gather(back, moved.drop("source_row_id"))
    assert {(r["row_id"], r["x"]) for r in restored.collect()} == {(i, 2 * i) for i in range(3000)}


def test_gather_repeats_rows(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "row_id long, x string")
    order = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "position long, row_id long")
    got = sorted((r["row_id"], r["x"]) for r in rows.gather(order, df).collect())
    assert got == [(0, "b"), (1, "b"), (2, "a")]


@pytest.mark.parametrize("n", [0, 1, 17, 2999, 3000, 9999])
@pytest.mark.parametrize("taken", [3, 100_000])
def test_exact_sample(spark, monkeypatch, n, taken):
    monkeypatch.setattr(rows, "_MAX_TAKEN", taken)
    monkeypatch.setattr(rows, "_HASH_DIGITS", 1)
    df = spark.range(3000).select(F.col("id").alias("row_id"))
    got = {r["row_id"] for r in rows.sample_rows(df, n, 5).collect()}
    assert got == set(md5_order(range(3000), 5)[:n])


def test_exact_sample_adds_no_exchange(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"))
    plan = rows.sample_rows(df, 100, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("size", [0.3, 0.001, 0.5])
def test_split_is_a_partition_of_exact_size(spark, size):
    df = spark.range(1001).select(F.col("id").alias("row_id"))
    train, test = splits.train_test(df, size, 42)
    a, b = ({r["row_id"] for r in p.collect()} for p in (train, test))
    assert len(b) == math.ceil(size * 1001)
    assert not a & b and a | b == set(range(1001))


def test_three_way_split_is_disjoint_and_near_its_shares(spark):
    df = spark.range(20_000).select(F.col("id").alias("row_id"))
    got = splits.hash_split(df, [0.8, 0.1, 0.1], 3).groupBy("part").count().collect()
    n = {r["part"]: r["count"] for r in got}
    assert sum(n.values()) == 20_000
    assert abs(n[0] / 20_000 - 0.8) < 0.02 and abs(n[1] / 20_000 - 0.1) < 0.02
    with pytest.raises(ValueError):
        splits.hash_split(df, [0.8, 0.1], 3)


def test_batches_when_the_size_divides_the_rows(spark):
    df = spark.range(12).select(F.col("id").alias("row_id"))
    got = rows.with_batches(df, 4).groupBy("batch_id").count().collect()
    assert {(r["batch_id"], r["count"]) for r in got} == {(0, 4), (1, 4), (2, 4)}


def test_short_batch_is_kept_or_dropped(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"))
    assert rows.with_batches(df, 4).filter("batch_id = 2").count() == 2
    assert rows.with_batches(df, 4, drop_last=True).count() == 8
    assert rows.with_batches(df, 4, num_batches=1).count() == 4


def test_batch_index_and_pull_loop(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"), F.lit("v").alias("variant_id"))
    batched = rows.with_batches(df, 4)
    index = {r["batch_id"]: r for r in rows.batch_index(batched, "row_id", "variant_id").collect()}
    assert index[1]["row_nrs"] == [4, 5, 6, 7] and index[1]["variant_ids"] == ["v"]
    pulled = list(rows.iterate_batches(batched, ["row_id"]))
    assert [b for b, _ in pulled] == [0, 1, 2]
    assert [r["row_id"] for _, members in pulled for r in members] == list(range(10))


def test_renumber_closes_gaps_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(rows, "_MIN_SPAN", 10)
    df = spark.range(1000).filter("id % 3 = 0").select(F.col("id").alias("row_id"))
    got = sorted((r["row_id"], r["n"]) for r in rows.renumber(df, "row_id", "n").collect())
    assert got == [(3 * i, i) for i in range(334)]


def test_concat_runs_numbers_on(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b")], "row_id long, v string")
    b = spark.createDataFrame([(0, "c"), (5, "d")], "row_id long, v string")
    got = sets.concat_ordered([a, b]).orderBy("row_id").collect()
    assert [(r["row_id"], r["source_no"], r["v"]) for r in got] == [
        (0, 0, "a"), (1, 0, "b"), (2, 1, "c"), (3, 1, "d"),
    ]


def test_previous_row_crosses_spans(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") * 10).alias("x"))
    got = rows.previous_in_order(df, ["x"], span=7).collect()
    assert len(got) == 100
    assert all(r["prev_x"] == (None if r["row_id"] == 0 else r["x"] - 10) for r in got)


def test_adjacent_repeats_including_nulls(spark):
    values = ["a", "a", None, None, "a", "b", "b"]
    df = spark.createDataFrame(list(enumerate(values)), "row_id long, x string")
    got = [r["row_id"] for r in sets.drop_adjacent_repeats(df, ["x"]).orderBy("row_id").collect()]
    assert got == [0, 2, 4, 5]


def test_first_last_and_ordered_distinct(spark):
    data = [("k", 0, "a"), ("k", 1, "b"), ("m", 2, "c"), ("k", 3, "d")]
    df = spark.createDataFrame(data, "key string, row_id long, v string")
    first = {(r["key"], r["v"]) for r in sets.keep_first(df, ["key"]).collect()}
    last = {(r["key"], r["v"]) for r in sets.keep_last(df, ["key"]).collect()}
    assert first == {("k", "a"), ("m", "c")} and last == {("k", "d"), ("m", "c")}
    assert sets.keep_last(df, ["key"]).columns == df.columns
    assert [r["key"] for r in sets.ordered_distinct(df, "key").collect()] == ["k", "m"]


def test_surplus_moves_to_the_next_shard(spark):
    df = spark.range(20).select(F.col("id").alias("row_id"))
    sharded = rows.with_batches(df, 10).withColumnsRenamed(
        {"batch_id": "shard_id", "pos_in_batch": "pos_in_shard"}
    )
    got = rows.move_surplus(sharded, 6, 0, 1).groupBy("shard_id").count().collect()
    assert {(r["shard_id"], r["count"]) for r in got} == {(0, 6), (1, 14)}


def test_ranges_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"))
    got = rows.number_rows(df, ["k"])
    assert all(r["k"] == r["row_id"] for r in got.collect())
    assert len(got.inputFiles()) > 30
    # The default number of partitions stays while it suffices.
    monkeypatch.setattr(session, "ROWS_PER_TASK", 1000)
    assert len(rows.number_rows(df, ["k"]).inputFiles()) <= 8


def test_numbered_variants_move_and_store_source_columns_only(spark):
    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    v = views.number_variants(spark, sf_dir)
    stored = spark.read.parquet(*v.inputFiles())
    assert set(stored.columns) == {*views.STORED, "__part", "__local"}


def test_shuffle_moves_row_numbers_without_their_hashes(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    shuffled = rows.shuffle_positions(spark.range(3000).withColumnRenamed("id", "row_id"), 13)
    got = {r["shuffled_id"]: r["row_id"] for r in shuffled.collect()}
    assert [got[i] for i in range(3000)] == md5_order(range(3000), 13)
    plan = shuffled._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("Initial Plan")[0].splitlines() if "Exchange hashpartitioning" in line]
    assert sum("REPARTITION_BY_NUM" in line for line in dealt) == 1 and not any("__hash" in line for line in dealt)
    order = shuffled.select("row_id", F.col("shuffled_id").alias("position"))
    moved = rows.gather(order, spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("x")))
    assert moved.filter("x <> 2 * source_row_id").count() == 0
    assert moved.rdd.getNumPartitions() >= 30 and moved.count() == 3000
