"""Keyed prediction store: Parquet folders listed by a commit log, newest row per id on read.

A batch is written to a folder of its own and exists for readers once it is committed. A commit is a
small file ``log/<number>.json`` that lists all live folders, oldest first; its number is taken by
creating the file without overwriting, so commits of any number of runs have one order, and the later
commit wins, whoever opened first. Who finds the number taken reads the list anew and tries the next.

A run is a name for a writer that may repeat itself, such as a stream with its checkpoint. The log
remembers which batches of a run are committed; a repeated one changes nothing and so keeps its place.

Neighbouring folders of one level are folded into one of the next level as soon as there are
``FOLD`` of them. The list therefore holds a few folders for each level, whatever the number of
batches, and a row is rewritten once a level. Folding puts one folder in the place of its sources by a
commit of its own: readers see the list before or after. Folders that no list names any more stay
until ``clean`` removes them, so that readers that still use an older list can finish.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from varloom.operators.sets import keep_last

#: Folders of one level that become one of the next level.
FOLD = 8
_EMPTY = {"number": 0, "folders": [], "runs": {}}


def file_system(spark: SparkSession, place: str):
    """Hadoop file system of a place, and the place as its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def read_text(spark: SparkSession, place: str) -> str:
    fs, path = file_system(spark, place)
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, place: str, text: str) -> None:
    """A new small file; an existing one is an error."""
    fs, path = file_system(spark, place)
    out = fs.create(path, False)
    out.write(bytearray(text.encode()))
    out.close()


def open_run(spark: SparkSession, store: str) -> str:
    """Name of a new run. It says nothing about order, which commits alone decide."""
    return uuid.uuid4().hex


def state(spark: SparkSession, store: str) -> dict:
    """The newest commit: its number, the live folders and the batches of each run."""
    fs, folder = file_system(spark, f"{store}/log")
    if not fs.exists(folder):
        return _EMPTY
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    newest = max((n for n in names if n.endswith(".json")), default=None)
    if newest is None:
        return _EMPTY
    return json.loads(read_text(spark, f"{store}/log/{newest}"))


def _publish(spark: SparkSession, store: str, entry: dict) -> bool:
    """Write a commit unless its number is taken."""
    fs, draft = file_system(spark, f"{store}/log/.{uuid.uuid4().hex}")
    _, final = file_system(spark, f"{store}/log/{entry['number']:010d}.json")
    write_text(spark, draft.toString(), json.dumps(entry))
    if fs.getUri().getScheme() == "file":
        # A local rename replaces its target; a link does not.
        at = [spark._jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(p).toString() for p in (draft, final)]
        try:
            os.link(*at)
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(draft, False)
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(
            fs.makeQualified(draft), fs.makeQualified(final), none
        )
        return True
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        fs.delete(draft, False)
        return False


def _commit(spark: SparkSession, store: str, change) -> bool:
    """Apply ``change`` to the newest list and publish it; a change that gives None is dropped."""
    while True:
        now = state(spark, store)
        entry = change(now)
        if entry is None:
            return False
        if _publish(spark, store, entry | {"number": now["number"] + 1}):
            return True


def _committed(runs: dict, run: str, batch_no: int) -> bool:
    upto, *more = runs.get(run, [-1])
    return batch_no <= upto or batch_no in more


def _with_batch(runs: dict, run: str, batch_no: int) -> dict:
    """Batches of a run: all numbers up to the first entry, and single ones beyond."""
    upto, *more = runs.get(run, [-1])
    more = sorted({*more, batch_no})
    while more and more[0] == upto + 1:
        upto = more.pop(0)
    return runs | {run: [upto, *more]}


def upsert(
    batch: DataFrame, store: str, batch_no: int = 0, run: str | None = None, row_id: str = "row_id"
) -> None:
    """Add a batch of (variant_id, row_id, ...); the last row per id of the batch is kept.

    With a run from ``open_run`` a batch number that is committed already is not written again.
    """
    spark = batch.sparkSession
    if run is not None and _committed(state(spark, store)["runs"], run, batch_no):
        return
    name = uuid.uuid4().hex
    keep_last(batch, ["variant_id"], row_id).write.parquet(f"{store}/data/{name}")

    def add(now: dict) -> dict | None:
        if run is not None and _committed(now["runs"], run, batch_no):
            return None
        runs = now["runs"] if run is None else _with_batch(now["runs"], run, batch_no)
        return {"folders": now["folders"] + [{"name": name, "level": 0}], "runs": runs}

    _commit(spark, store, add)
    settle(spark, store)


def _rows(spark: SparkSession, store: str, folders: list[dict]) -> DataFrame:
    """Rows of the folders, with ``__place`` for the order of their commits."""
    paths = [f"{store}/data/{f['name']}" for f in folders]
    places = F.create_map(*[F.lit(x) for i, f in enumerate(folders) for x in (f["name"], i)])
    folder = F.regexp_extract("_metadata.file_path", "/data/([0-9a-f]{32})/", 1)
    return spark.read.parquet(*paths).withColumn("__place", places[folder])


def _newest(spark: SparkSession, store: str, folders: list[dict]) -> DataFrame:
    if len(folders) == 1:
        # An id stands once in a folder.
        return spark.read.parquet(f"{store}/data/{folders[0]['name']}")
    return keep_last(_rows(spark, store, folders), ["variant_id"], "__place").drop("__place")


def latest(spark: SparkSession, store: str, row_id: str = "row_id") -> DataFrame:
    """Newest record per id: by commit, then by row."""
    folders = state(spark, store)["folders"]
    if not folders:
        raise AnalysisException(f"the store {store} holds no batch")
    return _newest(spark, store, folders)


def _same_level(folders: list[dict], fold: int) -> list[dict]:
    """The oldest ``fold`` neighbours of one level, if there are so many."""
    start = 0
    for i, f in enumerate(folders):
        if f["level"] != folders[start]["level"]:
            start = i
        if i - start + 1 == fold:
            return folders[start : i + 1]
    return []


def settle(spark: SparkSession, store: str, fold: int = FOLD) -> None:
    """Fold neighbours of one level until no level holds ``fold`` of them."""
    while parts := _same_level(state(spark, store)["folders"], fold):
        if not _fold(spark, store, parts):
            return


def _fold(spark: SparkSession, store: str, parts: list[dict]) -> bool:
    name = uuid.uuid4().hex
    rows = _newest(spark, store, parts).repartitionByRange("variant_id").sortWithinPartitions("variant_id")
    rows.write.parquet(f"{store}/data/{name}")

    def swap(now: dict) -> dict | None:
        folders = now["folders"]
        at = folders.index(parts[0]) if parts[0] in folders else -1
        if at < 0 or folders[at : at + len(parts)] != parts:
            return None
        one = {"name": name, "level": parts[0]["level"] + 1}
        return {"folders": [*folders[:at], one, *folders[at + len(parts) :]], "runs": now["runs"]}

    return _commit(spark, store, swap)


def compact(spark: SparkSession, store: str, new_store: str | None = None, row_id: str = "row_id") -> None:
    """Fold all batches into one, laid out by id: in place, or as the first batch of a new store."""
    folders = state(spark, store)["folders"]
    if new_store is None:
        if len(folders) > 1:
            _fold(spark, store, folders)
        return
    name = uuid.uuid4().hex
    rows = latest(spark, store).repartitionByRange("variant_id").sortWithinPartitions("variant_id")
    rows.write.parquet(f"{new_store}/data/{name}")
    one = {"name": name, "level": max(f["level"] for f in folders) + 1}
    _commit(spark, new_store, lambda now: {"folders": [*now["folders"], one], "runs": now["runs"]})


def clean(spark: SparkSession, store: str, hours: float = 24.0, keep: int = 10) -> int:
    """Delete folders that no list names and lists but the last ``keep``, if older than ``hours``.

    The age spares readers of an older list and writers that have not committed yet.
    """
    fs, data = file_system(spark, f"{store}/data")
    before = spark._jvm.java.lang.System.currentTimeMillis() - int(hours * 3_600_000)
    old = [f for f in fs.listStatus(data) if f.getModificationTime() <= before]
    live = {f["name"] for f in state(spark, store)["folders"]}
    gone = [f.getPath() for f in old if f.getPath().getName() not in live]
    lists = sorted(fs.listStatus(file_system(spark, f"{store}/log")[1]), key=lambda f: f.getPath().getName())
    lists = [f for f in lists if f.getPath().getName().endswith(".json")]
    gone += [f.getPath() for f in lists[:-keep] if f.getModificationTime() <= before]
    for path in gone:
        fs.delete(path, True)
    return len(gone)
