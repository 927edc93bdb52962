"""Substring de-duplication by content-defined chunks.

A gear hash rolls over the bytes of each text and cuts where its top bits are zero, so cuts depend
on the last 16 bytes only and find their places again after an insertion. Chunks are compared by a
128-bit digest. The occurrence with the smallest (id, text hash, offset) stays; later ones go where
neighbouring repeated chunks make a run of at least ``min_run`` bytes, so stock phrases that chance
repeats are left alone. Cuts fall between characters, so what is left is valid text.

A passage rarely begins and ends with a chunk. Each run is therefore lengthened byte by byte at both
ends, as long as its neighbours are those of the first occurrences of its outermost chunks; for that
the ``REACH`` bytes beside these occurrences travel, once for each place and one row for each end of a
run. Every removed byte has an equal one at a smaller (id, text hash, offset), so what is removed
somewhere stands somewhere else.

Defined cases: null text counts as empty and stays null; an empty text has no chunk. Null ids sort
first. Rows that repeat id and text are one document here and get the same answer. Further columns
are carried along; those named like the outputs are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from varloom.llm.common import FILTER_BITS, bit_filter, keyed, spans, stored, text_bytes

GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Four bits that the last 13 to 16 bytes decide: chunks of 31 bytes on average, so that a passage of fifty
#: words holds a whole one (none of 2,000 random ones did not; with 45 bytes three did not).
MASK = np.uint32(0xF000)
SHORTEST, LONGEST = 16, 256
#: Bytes beside a run that are compared: an end can lie a whole chunk, and what it skips, inside a passage.
REACH = LONGEST + 64
MIN_RUN = 120
OUTPUTS = ("n_bytes", "n_removed", "n_spans", "n_repeated")


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each text, as offsets into ``data``."""
    if not len(data):
        return [[] for _ in offsets[1:]]
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    inside = np.ones(len(data), bool)
    inside[:-1] = (data[1:] & 0xC0) != 0x80
    found = np.flatnonzero(((h & MASK) == 0) & inside) + 1
    first = np.searchsorted(found, offsets)
    found = found.tolist()
    out = []
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        ends, last = [], lo
        for c in [*found[first[i] : first[i + 1]], hi]:
            if c >= hi:
                c = hi
            elif c - last < SHORTEST:
                continue
            while c - last > LONGEST:
                last += LONGEST
                while last < c and not inside[last - 1]:
                    last += 1
                if last < c:
                    ends.append(last)
                else:
                    break
            if not ends or ends[-1] != c:
                if c > lo:
                    ends.append(c)
            last = c
            if c == hi:
                break
        out.append(ends)
    return out


def _digests(batches):
    """First half of every chunk's digest."""
    for *_, names in _chunks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(names[:, 0]))], ["d1"])


def _chunk_rows(words):
    """Chunks whose half digest passes the filter, with their places."""

    def run(batches):
        filled = words.value
        for batch, row, start, size, edge, names in _chunks(batches):
            bit = names[:, 0] & ((1 << FILTER_BITS) - 1)
            kept = np.flatnonzero((filled[bit >> 6] >> (bit & 63)) & 1)
            rows = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays(
                [
                    pc.take(batch.column("_id"), rows),
                    pc.take(batch.column("_k2"), rows),
                    pa.array(names[kept, 0]),
                    pa.array(names[kept, 1]),
                    pa.array(start[kept].astype(np.int32)),
                    pa.array(size[kept].astype(np.int32)),
                    pa.array(edge[kept]),
                ],
                ["_id", "_k2", "d1", "d2", "start", "size", "edge"],
            )

    return run


def _chunks(batches):
    """(batch, row of the batch, start in the text, size, edge, digest as two numbers) of all chunks.

    ``edge`` is 1 for a text's first chunk, 2 for its last and 3 for its only one.
    """
    for batch in batches:
        data, offsets = text_bytes(batch.column("_text"))
        for i, j in spans(offsets):
            part = data[offsets[i] : offsets[j]]
            edges = offsets[i : j + 1] - offsets[i]
            ends = cuts(part, edges)
            counts = np.array([len(e) for e in ends], np.int64)
            stop = np.array([x for e in ends for x in e], np.int64)
            if not len(stop):
                continue
            row = np.repeat(np.arange(i, j), counts)
            base = edges[row - i]
            start = np.empty_like(stop)
            start[1:] = stop[:-1]
            start[np.cumsum(counts)[counts > 0] - counts[counts > 0]] = edges[:-1][counts > 0]
            view = memoryview(part.tobytes())
            digest = xxhash.xxh3_128_digest
            names = np.frombuffer(
                b"".join([digest(view[a:b]) for a, b in zip(start.tolist(), stop.tolist())]), np.int64
            ).reshape(-1, 2)
            edge = ((start == base) + 2 * (stop == edges[row - i + 1])).astype(np.int8)
            yield batch, row, start - base, stop - start, edge, names


def shared_end(a: bytes, b: bytes) -> int:
    """Length of the longest common suffix."""
    n = min(len(a), len(b))
    if not n:
        return 0
    x, y = np.frombuffer(a, np.uint8)[-n:][::-1], np.frombuffer(b, np.uint8)[-n:][::-1]
    unlike = np.flatnonzero(x != y)
    return int(unlike[0]) if len(unlike) else n


def shared_start(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    return shared_end(a[::-1], b[::-1])


def lengthened(text: bytes, found: list[tuple[int, int, bytes, bytes]], min_run: int) -> list[tuple[int, int]]:
    """Ranges to remove: runs (start, end, bytes before and behind the first occurrence), merged."""
    out: list[list[int]] = []
    for start, end, before, behind in sorted(found):
        start -= shared_end(text[max(start - REACH, 0) : start], before)
        end += shared_start(text[end : end + REACH], behind)
        # Neighbours may agree in a part of a character only.
        while start < end and (text[start] & 0xC0) == 0x80:
            start += 1
        while start < end < len(text) and (text[end] & 0xC0) == 0x80:
            end -= 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out if b - a >= min_run]


def _marked(batch: pa.RecordBatch, filled: np.ndarray) -> np.ndarray:
    """Rows whose key passes a filter."""
    bit = batch.column("_h").to_numpy() & ((1 << FILTER_BITS) - 1)
    return ((filled[bit >> 6] >> (bit & 63)) & 1).astype(bool)


def _packed(words):
    """Texts compressed one by one, of the rows that pass the filter: only these are shuffled."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            batch = batch.filter(pa.array(_marked(batch, words.value))).drop_columns(["_h"])
            texts = [None if t is None else pack(t.encode()) for t in batch.column("_text").to_pylist()]
            at = batch.schema.get_field_index("_text")
            yield batch.set_column(at, "_text", pa.array(texts, pa.binary()))

    return run


def _untouched(words):
    """Rows that no run is in: they stay where they are."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~_marked(batch, words.value)))
            sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).cast(pa.int64())
            zero = pa.array(np.zeros(batch.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_text"), sizes, zero, zero, zero], ["_row", "_text", *OUTPUTS]
            )

    return run


def _beside(batches):
    """The bytes before or behind the places that runs ask for."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows, at, left, near = [], [], [], []
        for i, (packed, asked) in enumerate(zip(batch.column("_text"), batch.column("_asked").to_pylist())):
            text = unpack(packed.as_py())
            for place in asked:
                p = place["at"]
                rows.append(i)
                at.append(p)
                left.append(place["left"])
                near.append(text[max(p - REACH, 0) : p] if place["left"] else text[p : p + REACH])
        taken = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pc.take(batch.column("_k1"), taken),
                pc.take(batch.column("_k2"), taken),
                pa.array(at, pa.int32()),
                pa.array(left, pa.bool_()),
                pa.array(near, pa.binary()),
            ],
            ["f1", "f2", "at", "left", "near"],
        )


def _cut_out(min_run: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, counts = [], []
                for packed, marks in zip(part.column("_text"), part.column("_runs").to_pylist()):
                    text = unpack(packed.as_py()) if packed.is_valid else b""
                    marks = marks or []
                    found = [(m["start"], m["end"], m["before"] or b"", m["behind"] or b"") for m in marks]
                    gone = lengthened(text, found, min_run)
                    body, end = [], 0
                    for a, b in gone:
                        body.append(text[end:a])
                        end = b
                    body.append(text[end:])
                    texts.append(b"".join(body).decode() if packed.is_valid else None)
                    counts.append((len(text), sum(b - a for a, b in gone), len(gone), sum(m["chunks"] for m in marks)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), pa.array(texts, pa.string()), *[pa.array(c, pa.int64()) for c in zip(*counts)]],
                    ["_row", "_text", *OUTPUTS],
                )

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN
) -> DataFrame:
    """``docs`` with repeated runs cut out of the text, and the columns of ``OUTPUTS``."""
    # Carried columns wait in a struct, so that none of their names can clash with a helper.
    named = [f for f in docs.schema if f.name not in OUTPUTS]
    carried = [f for f in named if f.name != text_col]
    base = keyed(
        docs.select(
            F.struct(*[F.col(f"`{f.name}`") for f in carried]).alias("_row"),
            F.col(f"`{id_col}`").alias("_id"),
            F.col(f"`{text_col}`").alias("_text"),
        ),
        "_id",
        "_text",
    )
    kind = docs.schema[id_col].dataType.simpleString()
    texts = base.select("_id", "_k2", "_text")
    # Only digests that come back travel on with their places; a copy group meets in one count, not in one
    # task. Half a digest is enough to sort out the rest: who shares only that half is its own first below.
    digests = texts.select("_text").mapInArrow(_digests, "d1 long")
    again = stored(digests.groupBy("d1").count().filter("count > 1").select("d1"), "repeated-digests")
    words = docs.sparkSession.sparkContext.broadcast(bit_filter(again, "d1"))
    chunks = texts.mapInArrow(_chunk_rows(words), f"_id {kind}, _k2 long, d1 long, d2 long, start int, size int, edge byte")
    hits = stored(chunks.join(again, "d1"), "repeated-chunks")
    firsts = hits.groupBy("d1", "d2").agg(F.min(F.struct("_id", "_k2", "start")).alias("first"))
    later = (
        hits.join(firsts, ["d1", "d2"])
        .filter(~F.struct("_id", "_k2", "start").eqNullSafe(F.col("first")))
        .select(
            F.xxhash64("_id").alias("_k1"),
            "_k2",
            "start",
            (F.col("start") + F.col("size")).alias("end"),
            "edge",
            F.xxhash64("first._id").alias("f1"),
            F.col("first._k2").alias("f2"),
            F.col("first.start").alias("f_start"),
        )
        .dropDuplicates(["_k1", "_k2", "start"])
    )
    # Touching chunks of a document are a run; its ends follow their own first occurrences.
    along = W.partitionBy("_k1", "_k2").orderBy("start")
    first, last = F.struct("f1", "f2", F.col("f_start").alias("at")), F.struct(
        "f1", "f2", (F.col("f_start") + F.col("end") - F.col("start")).alias("at")
    )
    found = stored(
        later.withColumn("new", F.when(F.col("start") == F.lag("end").over(along), 0).otherwise(1))
        .withColumn("run", F.sum("new").over(along))
        .groupBy("_k1", "_k2", "run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.count("*").alias("chunks"),
            F.min_by(first, "start").alias("first"),
            F.max_by(last, "start").alias("last"),
            F.bit_or("edge").alias("edge"),
        ),
        "repeated-runs",
    )
    # Nothing stands before a run at the start of its text, nor behind one at its end.
    sides = F.array(
        F.struct(F.lit(True).alias("left"), (F.col("edge").bitwiseAND(F.lit(1)) == 0).alias("open"), "first.*"),
        F.struct(F.lit(False).alias("left"), (F.col("edge").bitwiseAND(F.lit(2)) == 0).alias("open"), "last.*"),
    )
    ends = found.select("_k1", "_k2", "start", "end", "chunks", F.explode(sides).alias("side"))
    ends = ends.select("_k1", "_k2", "start", "end", "chunks", "side.*")
    open_ends = ends.filter("open")
    asked = stored(
        open_ends.groupBy(F.col("f1").alias("_k1"), F.col("f2").alias("_k2")).agg(
            F.collect_set(F.struct("at", "left")).alias("_asked")
        ),
        "asked-places",
    )
    spark, hashed = docs.sparkSession, F.xxhash64("_k1", "_k2").alias("_h")
    named_texts = base.select("_k1", "_k2", "_row", "_text", hashed)
    kinds = [StructField(f.name, BinaryType()) if f.name == "_text" else f for f in named_texts.schema if f.name != "_h"]

    def packed(keys: DataFrame, *columns: str) -> DataFrame:
        """Texts that ``keys`` may name; few others come along."""
        words = spark.sparkContext.broadcast(bit_filter(keys.select(hashed), "_h"))
        schema = StructType([k for k in kinds if k.name in columns])
        return named_texts.select(*columns, "_h").mapInArrow(_packed(words), schema)

    beside = (
        packed(asked, "_k1", "_k2", "_text")
        .filter("_text is not null")
        .join(asked, ["_k1", "_k2"])
        .mapInArrow(_beside, "f1 long, f2 long, at int, left boolean, near binary")
        .dropDuplicates(["f1", "f2", "at", "left"])
    )
    one = ["_k1", "_k2", "start", "end", "chunks"]
    with_text = open_ends.join(beside, ["f1", "f2", "at", "left"]).select(*one, "left", "near")
    closed = ends.filter("not open").select(*one, "left", F.lit(None).cast("binary").alias("near"))
    runs = (
        with_text.unionByName(closed)
        .groupBy(*one)
        .agg(
            F.max(F.when(F.col("left"), F.col("near"))).alias("before"),
            F.max(F.when(~F.col("left"), F.col("near"))).alias("behind"),
        )
        .groupBy("_k1", "_k2")
        .agg(F.collect_list(F.struct("start", "end", "chunks", "before", "behind")).alias("_runs"))
    )
    made = StructType([base.schema["_row"], StructField("_text", StringType())])
    for name in OUTPUTS:
        made.add(name, LongType())
    with_runs = packed(found, "_k1", "_k2", "_row", "_text").join(runs, ["_k1", "_k2"], "left")
    cut = with_runs.select("_row", "_text", "_runs").mapInArrow(_cut_out(min_run), made)
    words = spark.sparkContext.broadcast(bit_filter(found.select(hashed), "_h"))
    cut = cut.unionByName(named_texts.select("_row", "_text", "_h").mapInArrow(_untouched(words), made))
    return cut.select(
        *[F.col("_text").alias(text_col) if f.name == text_col else F.col(f"_row.`{f.name}`") for f in named], *OUTPUTS
    )
