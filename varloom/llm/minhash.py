"""Near-duplicate groups by min-max hashing over word shingles, every link confirmed on full sets.

Each permutation gives two values, the minimum and the maximum of a document's hashed shingles, so
90 hash evaluations make 180 signature values. Bands of five values put documents into buckets; at
a similarity of 0.8 a pair misses all 36 bands with probability 6e-7.

Documents with equal sets are one node, so copies never meet each other. Inside a bucket every node
is compared with the smallest and the largest node only. Nodes of buckets that then still hold
several components are put into blocks of about ``BLOCK`` neighbours; blocks that share such a
bucket are compared as a whole, by one product of 0/1 matrices. So no candidate is left untested,
and large families cost a row for each pair of blocks, not for each pair of documents.

Defined cases: null text counts as empty; a text without words has an empty set, links with nothing
and is kept; a single word is its own shingle. Rows with a null id take part and count as copies:
their component carries the smallest non-null id, or null. Rows that repeat an id get the same answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from varloom.llm.common import components, keyed, mix, prefix_hash, range_hash, spans, stored, text_bytes

PERMUTATIONS = 90
BAND = 5
BANDS = 2 * PERMUTATIONS // BAND
_rng = np.random.default_rng(7)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_R = _rng.integers(0, 1 << 63, BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROWS = 4096
BLOCK = 128
_COLUMNS = 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 2) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z lower-cased, words split at ASCII white space."""
    for i, j in spans(offsets):
        part = data[offsets[i] : offsets[j]]
        part = part + (((part >= 65) & (part <= 90)) * np.uint8(32)).astype(np.uint8)
        edges = offsets[i : j + 1] - offsets[i]
        space = (part == 32) | ((part >= 9) & (part <= 13))
        before = np.ones(len(part) + 1, bool)
        before[1:] = space
        before[edges] = True
        starts = np.flatnonzero(~space & before[:-1])
        after = np.ones(len(part) + 1, bool)
        after[:-1] = space
        after[edges] = True
        ends = np.flatnonzero(~space & after[1:]) + 1
        hashed = range_hash(prefix_hash(part), starts, ends)
        first = np.searchsorted(starts, edges)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            w = hashed[lo:hi]
            if len(w) >= words:
                h = np.zeros(len(w) - words + 1, np.uint64)
                for k in range(words):
                    h = mix(h + w[k : len(w) - words + 1 + k])
                yield np.unique(h)
            elif len(w):
                h = np.full(1, len(w), np.uint64)
                for x in w:
                    h = mix(h + x)
                yield h
            else:
                yield w


def band_keys(items: np.ndarray) -> np.ndarray:
    """Bucket keys of one set, from the minimum and maximum under each permutation."""
    low, high = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
    for s in range(0, len(items), _ROWS):
        values = items[s : s + _ROWS, None] * _A + _B
        np.minimum(low, values.min(0), out=low)
        np.maximum(high, values.max(0), out=high)
    signature = np.stack([low, high], 1).reshape(BANDS, BAND)
    return mix((mix(signature) * _R).sum(1) + np.arange(BANDS, dtype=np.uint64))


def _sign(words: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            sizes, digests, bands = [], [], []
            for items in shingle_sets(data, offsets, words):
                sizes.append(len(items))
                digests.append(xxhash.xxh3_128_digest(items.tobytes()))
                bands.append(band_keys(items) if len(items) else np.zeros(0, np.uint64))
            counts = np.cumsum([0] + [len(b) for b in bands]).astype(np.int32)
            flat = np.concatenate(bands) if bands else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("_k1"),
                    batch.column("_k2"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(counts), pa.array(flat.view(np.int64))),
                ],
                ["_id", "_k1", "_k2", "n_shingles", "digest", "bands"],
            )

    return run


def _full_sets(words: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            sets = [items.tobytes() for items in shingle_sets(data, offsets, words)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "items"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                place = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[place] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _common(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set with every other, over slices of the items."""
    sizes = [len(x) for x in [*sets, *others]]
    _, column = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(others)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [start, start + _COLUMNS])
        part = np.zeros((len(sizes), _COLUMNS), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        out += (part[: len(sets)] @ part[len(sets) :].T).astype(np.int64)
    return out


def _compare_blocks(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "node"])
        left = pdf[pdf["side"] == 0]
        right = pdf[pdf["side"] == 1] if (pdf["side"] == 1).any() else left
        sets, others = ([np.frombuffer(x, np.uint64) for x in side["items"]] for side in (left, right))
        both = _common(sets, others)
        union = np.array([len(x) for x in sets])[:, None] + np.array([len(x) for x in others]) - both
        apart = left["root"].to_numpy()[:, None] != right["root"].to_numpy()
        a, b = np.nonzero(apart & (100 * both >= percent * union))
        found = pd.DataFrame({"a": left["node"].to_numpy()[a], "b": right["node"].to_numpy()[b]})
        # One link between two components says as much as all of them.
        roots = pd.DataFrame({"x": left["root"].to_numpy()[a], "y": right["root"].to_numpy()[b]})
        return found[~roots.duplicated().to_numpy()].astype("int64")

    return run


def _across(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components among (bucket, node, least, root) rows of buckets that hold several."""
    nodes = open_.groupBy("node").agg(F.min("root").alias("root"), F.min("least").alias("near"))
    in_root = nodes.groupBy("root").agg(F.count("*").alias("n"))
    # Blocks hold nodes of one component, or single nodes that met the same hub.
    near = nodes.join(in_root, "root").withColumn(
        "family", F.when(F.col("n") > 1, F.col("root") * 2).otherwise(F.col("near") * 2 + 1)
    )
    parts = near.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    blocks = stored(
        near.join(parts, "family").select(
            "node", "root", F.xxhash64("family", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")
        ),
        "blocks",
    )
    bounds = blocks.groupBy("block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    seen = open_.select("bucket", "node").join(blocks, "node").select("bucket", "block").distinct().join(bounds, "block")
    one = seen.select("bucket", F.col("block").alias("p"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"))
    two = seen.select("bucket", F.col("block").alias("q"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"))
    pairs = stored(
        one.join(two, "bucket")
        .filter("p <= q AND NOT (p_lo = p_hi AND q_lo = q_hi AND p_lo = q_lo)")
        .select("p", "q")
        .distinct(),
        "block-pairs",
    )
    filled = blocks.join(sets, "node")
    left = pairs.join(filled.withColumnRenamed("block", "p"), "p").withColumn("side", F.lit(0))
    right = pairs.filter("p <> q").join(filled.withColumnRenamed("block", "q"), "q").withColumn("side", F.lit(1))
    return (
        left.unionByName(right).groupBy("p", "q").applyInPandas(_compare_blocks(percent), "a long, b long").distinct()
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 2,
    percent: int = 80,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``; see the module text."""
    texts = keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text")
    id_type = docs.schema[id_col].dataType.simpleString()
    signed = stored(
        texts.mapInArrow(
            _sign(words),
            f"_id {id_type}, _k1 long, _k2 long, n_shingles long, digest binary, bands array<long>",
        ),
        "signatures",
    )
    # One node for each distinct set; the stored number stays the same in every later read.
    nodes = stored(
        signed.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(F.min("_id").alias("first_id"), F.first(F.struct("_k1", "_k2", "n_shingles", "bands")).alias("one"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", "first_id", "one.*"),
        "nodes",
    )
    placed = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = (
        placed.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    )
    members = stored(placed.join(shared, "bucket").select("bucket", "band", "node", "least", "most"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "_k1", "_k2", "n_shingles"), "node")
    sets = (
        texts.select("_k1", "_k2", "_text")
        .join(wanted.select("node", "_k1", "_k2"), ["_k1", "_k2"])
        .mapInArrow(_full_sets(words), "node long, items binary")
        .groupBy("node")
        .agg(F.first("items").alias("items"))
    )
    sets = stored(sets, "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
        right = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "items_a", "items_b")
        return both.mapInArrow(_confirm(percent), "a long, b long")

    # Two hubs for each bucket, its smallest and its largest node.
    hubs = members.select("node", F.explode(F.array("least", "most")).alias("hub")).filter("node <> hub")
    first = stored(
        hubs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs"
    )
    edges = stored(confirmed(first), "links")
    roots = components(edges)
    labelled = stored(
        members.join(roots, "node", "left").select("bucket", "node", "least", F.coalesce("root", "node").alias("root")),
        "labelled",
    )
    mixed = (
        labelled.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("bucket")
    )
    open_ = stored(labelled.join(mixed, "bucket"), "open")
    more = stored(_across(open_, sets, percent), "links")
    if more.head(1):
        edges = edges.union(more)
        roots = components(edges)
    groups = nodes.select("node", "digest", "first_id").join(roots, "node", "left")
    groups = groups.select("digest", "first_id", F.coalesce("root", "node").alias("root"))
    least_ids = groups.groupBy("root").agg(F.min("first_id").alias("component_id"))
    answer = groups.join(least_ids, "root").select("digest", "component_id")
    return (
        signed.select("_id", "n_shingles", "digest")
        .join(answer, "digest", "left")
        .select(
            F.col("_id").alias(id_col),
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))
    )
