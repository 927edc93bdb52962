import gzip
import os

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from varloom import schemas, session
from varloom.functions.features import with_sparse
from varloom.operators import joins
from varloom.streaming import scoring
from varloom.sources import readers, store, writers


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    opener = gzip.open if path.endswith(".gz") else open
    with opener(path, "wt") as f:
        f.write(text)
    return path


def test_vcf_keeps_inner_hash_quotes_and_dots(spark, tmp_path):
    path = put(
        str(tmp_path / "a.vcf.gz"),
        "##fileformat=VCFv4.0\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
        '1\t10\trs#1\tA\tG\t.\t.\tNOTE="a#b"\nX\t20\t.\tC\tT\t.\t.\t"\n',
    )
    got = readers.read_vcf(spark, path, schemas.VCF8).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [
        ("1", 10, "rs#1", "A", "G", ".", ".", 'NOTE="a#b"'),
        ("X", 20, ".", "C", "T", ".", ".", '"'),
    ]
    five = readers.read_vcf(spark, path).filter("chrom = 'X'").first()
    assert tuple(five) == ("X", 20, ".", "C", "T")
    named = readers.read_vcf_named(spark, path)
    assert named.columns[:2] == ["#CHROM", "POS"] and named.count() == 2


def test_header_lines_are_copied_in_order(spark, tmp_path):
    source = put(str(tmp_path / "a.vcf"), "##one\n##two\n#CHROM\tPOS\tID\tREF\tALT\n1\t5\t.\tA\tG\n")
    df = readers.read_vcf(spark, source)
    out = str(tmp_path / "out")
    writers.write_vcf(df, out, df.columns, ["pos"], writers.header_of(spark, source))
    lines = readers.with_file_row_id(spark.read.text(f"{out}/*")).orderBy("row_id").collect()
    assert "\n".join(r["value"] for r in lines) + "\n" == open(source).read()


def test_null_becomes_a_dot_in_vcf(spark, tmp_path):
    df = spark.createDataFrame([("1", 5, None)], "chrom string, pos int, id string")
    out = str(tmp_path / "out")
    writers.write_vcf(df, out, df.columns, ["pos"])
    assert spark.read.text(f"{out}/1_rows").first()[0] == "1\t5\t."


def test_variant_table_by_header_name(spark, tmp_path):
    path = put(str(tmp_path / "t.tsv"), "Extra\t#Chr\tPos\tRef\tAlt\nz\t1\t5\tA\tC,G\n")
    got = readers.read_variant_table(spark, path, ["#Chr", "Pos", "Ref", "Alt"]).first()
    assert tuple(got) == ("1", 5, "A", "C,G")


@pytest.mark.parametrize("split_bytes", ["134217728", "2000"])
def test_file_row_ids_follow_files_and_lines(spark, tmp_path, split_bytes):
    for n, count in (("a", 900), ("b", 5), ("c", 700)):
        put(str(tmp_path / f"in/{n}.txt"), "".join(f"{n}{i}\n" for i in range(count)))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], split_bytes)
        spark.conf.set(names[1], "100")
        numbered = readers.with_file_row_id(spark.read.text(str(tmp_path / "in")))
        got = [r["value"] for r in numbered.orderBy("row_id").collect()]
        ids = sorted(r["row_id"] for r in numbered.collect())
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)
    assert ids == list(range(1605))
    assert got == [f"{n}{i}" for n, c in (("a", 900), ("b", 5), ("c", 700)) for i in range(c)]


def test_many_splits_take_the_sorted_way(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "_MAX_BROADCAST_SPLITS", 0)
    put(str(tmp_path / "in/a.txt"), "x\ny\n")
    put(str(tmp_path / "in/b.txt"), "z\n")
    got = readers.with_file_row_id(spark.read.text(str(tmp_path / "in"))).orderBy("row_id").collect()
    assert [(r["row_id"], r["value"]) for r in got] == [(0, "x"), (1, "y"), (2, "z")]


def test_gzip_feature_lines(spark, tmp_path):
    path = put(str(tmp_path / "m.csv.gz"), "1,0,2.5\n-1,3,0\n")
    got = readers.read_feature_lines(spark, path).orderBy("row_id").collect()
    assert [(r["row_id"], r["target"], r["inputs"]) for r in got] == [
        (0, 1.0, [0.0, 2.5]), (1, -1.0, [3.0, 0.0]),
    ]


def test_bad_number_in_feature_file_fails(spark, tmp_path):
    path = put(str(tmp_path / "m.csv"), "y,a\n1,x\n")
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_feature_csv(spark, path, ["y", "a"]).collect()


def test_folder_reader_filters_by_extension(spark, tmp_path):
    put(str(tmp_path / "in/a.csv"), "1\n")
    put(str(tmp_path / "in/b.txt"), "2\n")
    put(str(tmp_path / "in/sub/c.csv"), "3\n")
    flat = readers.read_folder(spark, str(tmp_path / "in"), ".csv")
    deep = readers.read_folder(spark, str(tmp_path / "in"), ".csv", recursive=True)
    assert {r["value"] for r in flat.collect()} == {"1"}
    assert {r["value"] for r in deep.collect()} == {"1", "3"}


def test_gtf_sample_lines(spark, tmp_path):
    line = (
        '17\tprotein_coding\texon\t101\t200\t.\t-\t.\tgene_id "G1"; transcript_id "T1";'
        ' exon_number "3"; tag "CCDS"; tag "basic";\n'
    )
    row = readers.read_gtf(spark, put(str(tmp_path / "g.gtf"), "#!build\n" + line)).first()
    assert (row["chrom"], row["start"], row["end"], row["strand"]) == ("17", 101, 200, "-")
    assert [a["value"] for a in row["attributes"] if a["key"] == "tag"] == ["CCDS", "basic"]


def test_variants_meet_exons_of_a_gene_table(spark, tmp_path):
    head = '17\tprotein_coding\t{}\t{}\t{}\t.\t-\t.\tgene_id "G1"; transcript_id "T1"; exon_number "{}";\n'
    text = head.format("gene", 1, 900, 0) + head.format("exon", 101, 200, 1) + head.format("exon", 501, 600, 2)
    exons = readers.read_exons(spark, put(str(tmp_path / "g.gtf"), text))
    v = spark.createDataFrame(
        [("a", "17", 150, 151), ("b", "17", 245, 246), ("c", "17", 300, 301), ("d", "1", 150, 151)],
        "variant_id string, chrom string, start long, end long",
    )
    got = joins.overlap_join(v, joins.flank_exons(exons)).collect()
    assert {(r["variant_id"], r["exon_number"]) for r in got} == {("a", "1"), ("b", "1")}


def test_sparse_reader_refuses_other_tables(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="not a sparse"):
        readers.read_sparse(spark, str(tmp_path / "x"))


def test_saves_never_overwrite(spark, tmp_path):
    df = spark.range(1)
    for fmt in writers.FORMATS:
        path = str(tmp_path / fmt)
        writers.save(df, path, fmt)
        with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
            writers.save(df, path, fmt)
    with pytest.raises(ValueError):
        writers.save(df, str(tmp_path / "y"), "hdf5")


def test_keyed_write_lets_the_last_row_win_whole(spark, tmp_path):
    v = "1:1:A:" + str(["ACGT" * 20])
    data = [(v, 0, 1.0, None), (v, 1, None, 2.0), ("w", 2, 3.0, 3.0)]
    df = spark.createDataFrame(data, "variant_id string, row_id long, a double, b double")
    writers.write_keyed(df, str(tmp_path / "k"))
    got = {r["variant_id"]: (r["a"], r["b"]) for r in spark.read.parquet(str(tmp_path / "k")).collect()}
    assert got == {v: (None, 2.0), "w": (3.0, 3.0)}


def test_bucketed_tables_join_without_exchange(spark):
    tables = ["varloom_test_a", "varloom_test_b"]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for t in tables:
            df = spark.range(400).select(
                F.col("id").alias("row_id"),
                (F.col("id") % 100).cast("string").alias("variant_id"),
                F.col("id").cast("double").alias(f"x_{t[-1]}"),
            )
            writers.write_keyed_table(df, t, 4)
        a, b = (spark.table(t).drop("row_id") for t in tables)
        joined = joins.join_predictions([a, b])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 100
        assert joined.filter("variant_id = '7'").first()["x_a"] == 307.0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for t in tables:
            spark.sql(f"DROP TABLE IF EXISTS {t}")


@pytest.mark.parametrize("by_folder", [False, True])
def test_stored_batches_come_back(spark, tmp_path, by_folder):
    from varloom.operators.rows import with_batches

    df = with_batches(spark.range(100).select(F.col("id").alias("row_id")), 10)
    writers.write_batches(df, str(tmp_path / "b"), by_folder)
    got = readers.read_batches(spark, str(tmp_path / "b"), [0, 9]).collect()
    assert sorted(r["row_id"] for r in got) == [*range(10), *range(90, 100)]


def test_store_upsert_repeat_and_compaction(spark, tmp_path):
    path = str(tmp_path / "s")

    def batch(*data):
        return spark.createDataFrame(list(data), "variant_id string, row_id long, x double")

    run = store.open_run(spark, path)
    store.upsert(batch(("a", 0, 1.0), ("a", 1, 2.0), ("b", 2, 3.0)), path, 0, run)
    for _ in range(2):
        store.upsert(batch(("b", 0, 9.0)), path, 1, run)
    got = {r["variant_id"]: r["x"] for r in store.latest(spark, path).collect()}
    assert got == {"a": 2.0, "b": 9.0}
    # A later run may use the same batch numbers: its rows win, no others are lost.
    store.upsert(batch(("b", 0, 10.0), ("c", 1, 5.0)), path, 0, store.open_run(spark, path))
    want = {"a": 2.0, "b": 10.0, "c": 5.0}
    assert {r["variant_id"]: r["x"] for r in store.latest(spark, path).collect()} == want
    folded = str(tmp_path / "t")
    store.compact(spark, path, folded)
    assert {r["variant_id"]: r["x"] for r in store.latest(spark, folded).collect()} == want
    store.upsert(batch(("a", 0, 7.0)), folded, 0, store.open_run(spark, folded))
    again = {r["variant_id"]: r["x"] for r in store.latest(spark, folded).collect()}
    assert again == want | {"a": 7.0}


def batch_of(spark, *rows):
    return spark.createDataFrame(list(rows), "variant_id string, row_id long, x double")


def held(spark, path):
    return {r["variant_id"]: r["x"] for r in store.latest(spark, path).collect()}


def test_later_commit_wins_whoever_opened_first(spark, tmp_path):
    path = str(tmp_path / "s")
    a, b = store.open_run(spark, path), store.open_run(spark, path)
    assert a != b
    store.upsert(batch_of(spark, ("id", 0, 1.0)), path, 0, a)
    store.upsert(batch_of(spark, ("id", 0, 2.0), ("b", 1, 2.0)), path, 0, b)
    store.upsert(batch_of(spark, ("id", 0, 3.0)), path, 1, a)
    assert held(spark, path) == {"id": 3.0, "b": 2.0}
    # A batch that is replayed keeps its place and writes nothing.
    number = store.state(spark, path)["number"]
    store.upsert(batch_of(spark, ("id", 0, 2.0), ("b", 1, 2.0)), path, 0, b)
    assert held(spark, path) == {"id": 3.0, "b": 2.0} and store.state(spark, path)["number"] == number
    # Batches of a run may come out of order.
    for n in (5, 3, 4):
        store.upsert(batch_of(spark, ("id", 0, float(n))), path, n, a)
    assert store.state(spark, path)["runs"][a] == [1, 3, 4, 5] and held(spark, path)["id"] == 4.0
    store.upsert(batch_of(spark, ("id", 0, 9.0)), path, 2, a)
    assert store.state(spark, path)["runs"][a] == [5] and held(spark, path)["id"] == 9.0


def test_commits_at_once_get_one_order(spark, tmp_path):
    path = str(tmp_path / "s")
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(store.upsert, batch_of(spark, (f"v{i}", 0, float(i)), ("all", 0, float(i))), path) for i in range(12)]
        [j.result() for j in jobs]
    got = held(spark, path)
    assert {got.pop("all")} < set(map(float, range(12))) and got == {f"v{i}": float(i) for i in range(12)}


def test_store_stays_small_and_reads_the_same_while_it_folds(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    monkeypatch.setattr(store, "settle", lambda *_: None)
    for i in range(20):
        store.upsert(batch_of(spark, (f"v{i % 7}", i, float(i)), (f"w{i}", i, 0.0)), path)
    before, old = held(spark, path), store.latest(spark, path)
    monkeypatch.undo()
    assert len(store.state(spark, path)["folders"]) == 20
    store.settle(spark, path, fold=4)
    folders = store.state(spark, path)["folders"]
    assert [f["level"] for f in folders] == [2, 1] and held(spark, path) == before
    # A reader of the older list is not disturbed; afterwards its folders can go.
    assert {r["variant_id"]: r["x"] for r in old.collect()} == before
    assert store.clean(spark, path, hours=0) > 20 and held(spark, path) == before
    store.compact(spark, path)
    assert len(store.state(spark, path)["folders"]) == 1 and held(spark, path) == before


def test_new_checkpoint_adds_to_the_store(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "variant_id string, row_id long, x double"
    store.upsert(spark.createDataFrame([("keep", 0, 1.0)], schema), path, 0, store.open_run(spark, path))
    for k in range(2):
        folder = str(tmp_path / f"in{k}")
        spark.createDataFrame([("new", 0, float(k))], schema).write.parquet(folder)
        for _ in range(2):  # the second call has nothing left to do
            stream = scoring.file_stream(spark, folder, spark.read.parquet(folder).schema)
            scoring.into_store(stream, path, str(tmp_path / f"marks{k}")).awaitTermination()
    got = {r["variant_id"]: r["x"] for r in store.latest(spark, path).collect()}
    assert got == {"keep": 1.0, "new": 1.0}


@pytest.mark.parametrize("bad", ["12x", "3000000000"])
def test_bad_positions_stop_the_read(spark, tmp_path, bad):
    (tmp_path / "v.vcf").write_text(f"#CHROM\n1\t{bad}\t.\tA\tT\n")
    with pytest.raises(Exception, match="no int"):
        readers.read_vcf(spark, str(tmp_path / "v.vcf")).collect()
    (tmp_path / "t.tsv").write_text(f"#c\n1\t{bad}\tA\tT\n")
    with pytest.raises(Exception, match="no int"):
        readers.read_variant_table(spark, str(tmp_path / "t.tsv")).collect()


def test_sparse_set_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "v", 1.0, [0.0, 2.0])], "row_id long, variant_id string, target double, a array<double>")
    writers.write_sparse(with_sparse(df, "a", "features"), str(tmp_path / "s"))
    row = readers.read_sparse(spark, str(tmp_path / "s")).first()
    assert row["features"].toArray().tolist() == [0.0, 2.0]


class StubSession:
    """Stands for a session with given settings."""

    def __init__(self, master, **settings):
        self.conf = self
        self.sparkContext = self
        self.master = master
        self.applicationId = "app-1"
        self.settings = settings

    def get(self, name, default):
        return self.settings.get(name, default)


def test_work_folder_comes_from_the_session():
    cluster = StubSession("yarn", **{"spark.checkpoint.dir": "/shared/place/"})
    assert session.fresh_path(cluster, "x").startswith("/shared/place/varloom/app-1/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.fresh_path(StubSession("yarn"), "x")
