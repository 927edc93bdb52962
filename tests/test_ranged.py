"""Tables laid out by key: only files that can hold wanted keys are opened."""

import random

import pytest
from pyspark.sql import functions as F

from varloom.operators import joins
from varloom.sources import ranged


@pytest.fixture(scope="module")
def keyed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ranged") / "t")
    rows = spark.range(20000).select(
        F.format_string("v%07d", F.col("id")).alias("variant_id"), F.col("id").alias("row_id"), (F.col("id") * 2.0).alias("x")
    )
    ranged.write_ranged(rows, path, ["variant_id"], files=40)
    return path


def ids_of(spark, numbers):
    return spark.createDataFrame([(f"v{n:07d}", i) for i, n in enumerate(numbers)], "variant_id string, row_id long")


def test_index_has_a_row_for_each_file(spark, keyed):
    index = sorted(spark.read.parquet(f"{keyed}/_index").collect(), key=lambda r: r["least"])
    assert len(index) >= 30 and len({r["file"] for r in index}) == len(index)
    assert all(a["most"] < b["least"] for a, b in zip(index, index[1:]))


def test_lookup_opens_few_files(spark, keyed):
    wanted = ids_of(spark, [*range(5000, 5400), 12345, 12345])
    points = ranged._points(wanted, ["variant_id"])
    files = ranged.files_within(spark, keyed, points)
    assert 1 < len(files) <= 4
    got = ranged.lookup_stored(wanted, keyed)
    assert sorted(map(tuple, got.select("row_id", "x").collect())) == [
        (i, 2.0 * n) for i, n in enumerate([*range(5000, 5400), 12345, 12345])
    ]
    opened = ranged.read_within(spark, keyed, points)
    names = [{f.rsplit("/", 1)[1] for f in found} for found in (opened.inputFiles(), files)]
    assert names[0] == names[1] and opened.count() < 20000 / 8


def test_missing_id_fails_whatever_is_opened(spark, keyed):
    for bad in (5, 99999999):
        wanted = ids_of(spark, [7, bad]).withColumn("variant_id", F.when(F.col("row_id") == 1, F.concat("variant_id", F.lit("x"))).otherwise(F.col("variant_id")))
        with pytest.raises(Exception, match="no record for id"):
            ranged.lookup_stored(wanted, keyed).count()


def test_no_index_is_sent_when_there_are_too_many_files(spark, keyed, monkeypatch):
    monkeypatch.setattr(ranged, "MOST_FILES", 3)
    wanted = ids_of(spark, [1, 19999])
    assert ranged.files_within(spark, keyed, ranged._points(wanted, ["variant_id"])) is None
    assert {r["x"] for r in ranged.lookup_stored(wanted, keyed).collect()} == {2.0, 39998.0}


def test_nothing_wanted_opens_nothing(spark, keyed):
    none = ids_of(spark, [1]).filter("false")
    assert ranged.files_within(spark, keyed, ranged._points(none, ["variant_id"])) == []
    assert ranged.lookup_stored(none, keyed).count() == 0


def test_long_and_short_lists_give_the_same(spark, keyed, monkeypatch):
    wanted, store = ids_of(spark, [3, 9, 9, 15000]), spark.read.parquet(keyed)
    short = sorted(map(tuple, joins.lookup(wanted, store).select("variant_id", "row_id", "x").collect()))
    monkeypatch.setattr(joins, "MAX_BROADCAST_IDS", 1)
    assert sorted(map(tuple, joins.lookup(wanted, store).select("variant_id", "row_id", "x").collect())) == short
    with pytest.raises(Exception, match="no record for id"):
        joins.lookup(ids_of(spark, [99999999]).union(wanted), store).count()


def test_long_lists_are_cut_by_their_ends(spark, keyed, monkeypatch):
    monkeypatch.setattr(joins, "MAX_BROADCAST_IDS", 10)
    wanted = ids_of(spark, range(700, 900))
    got = ranged.lookup_stored(wanted, keyed)
    assert sorted(r["x"] for r in got.collect()) == [2.0 * n for n in range(700, 900)]
    assert len([f for f in got.inputFiles() if "ranged" in f]) <= 3


def test_scores_in_regions(spark, tmp_path):
    rng = random.Random(3)
    points = [(rng.choice(["1", "2", "X"]), rng.randint(1, 3_000_000), float(i)) for i in range(3000)] + [(None, 5, 0.0), ("1", None, 0.0)]
    regions = [("1", 0, 1), ("2", 1_000_000, 1_000_400), ("2", 1_000_100, 1_200_000), ("X", 0, 3_000_000), ("9", 0, 10), (None, 0, 9)]
    path = str(tmp_path / "scores")
    ranged.write_ranged(spark.createDataFrame(points, "chrom string, pos int, f1 double"), path, ["chrom", "pos"], files=20)
    for part in (regions, regions[:3]):
        frame = spark.createDataFrame(part, "chrom string, start long, end long")
        got = ranged.scores_between(frame, path)
        want = [p for p in points if p[0] and p[1] and any(c == p[0] and s < p[1] <= e for c, s, e in part)]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    ranges = frame.select(F.struct("chrom", F.col("start").alias("pos")).alias("low"), F.struct("chrom", F.col("end").alias("pos")).alias("high"))
    assert len(ranged.files_within(spark, path, ranges)) <= 6


def test_index_takes_ends_of_ordered_files_without_a_sort(spark, tmp_path):
    path = str(tmp_path / "t")
    keys = [None if i % 97 == 0 else f"k{i * 7919 % 4000:05d}" for i in range(4000)]
    ranged.write_ranged(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "variant_id string, n int"), path, ["variant_id"], files=6)
    held = spark.read.parquet(path).select("variant_id", F.col("_metadata.file_path").alias("file")).dropna()
    plain = held.groupBy("file").agg(F.min("variant_id"), F.max("variant_id")).collect()
    index = spark.read.parquet(f"{path}/_index").select("file", "least.variant_id", F.col("most.variant_id").alias("m")).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, index))
    # Only the two ends of each file are read into the comparison.
    assert ranged.file_ends(spark, path, ["variant_id"]).count() <= 2 * len(index)
