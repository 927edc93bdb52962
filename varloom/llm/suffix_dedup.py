"""Removal of repeated byte strings by external induced suffix sorting.

Which suffixes meet. Every window of ``LENGTH`` bytes has an anchor: the smallest hash among its
``GRAM``-byte strings, the leftmost on ties. Windows of equal content have equal anchors, so suffixes
need sorting only among those that follow one anchor hash, and only for hashes that come back.
Neighbouring windows of one anchor form a context (the bytes that they touch). Equal contexts are
counted before the shuffle and sorted once, with their number as weight, so copies cost nothing.

Hot anchors. Where the different contexts of one anchor exceed a shard, they are cut into pieces by the
place of the anchor in the window: windows with that place in [lo, hi] all hold the same stretch around
the anchor, and its hash extends the key. Ranges shrink until every key fits; at a single place all
pieces of a key are one string. Equal windows keep equal keys, so nothing is lost.

How they are sorted. Contexts arrive ordered by key in shards of at most twice ``SHARD_BYTES``.
A shard is one string with separators. Its leftmost-S suffixes are named by an induced
sort of their substrings, ranked by doubling on the string of names, and induce the order of all
others: suffix tuples pass through one first-in first-out queue for each first byte, which
writes to an unnamed scratch file of the task beyond ``QUEUE_BYTES``. Suffixes that stand together and
share their first ``LENGTH`` bytes are one string; its weight says whether it occurs elsewhere. The
common prefix is compared by a 64-bit hash of the window, carried with each suffix.

Defined cases: null text counts as empty; texts shorter than ``LENGTH`` lose nothing; rows that repeat
id and text are separate occurrences and lose all that is long enough; ids may be null. Columns of
other names are not looked at.
"""

from __future__ import annotations

import hashlib
import tempfile
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from varloom.llm.common import CHUNK, keyed, mix, powers, prefix_hash, range_hash, spans, stored, text_bytes

LENGTH = 200
GRAM = 48
SHARD_BYTES = 2 << 20
QUEUE_BYTES = 64 << 20
_PLACE = np.uint64((1 << 22) - 1)
CONTEXT_COLUMNS = ["_k1", "_k2", "key", "content", "start", "n", "ahead"]
_CONTEXT_ROW = "_k1 long, _k2 long, key long, content long, start int, n int, ahead short"


def contexts(part: np.ndarray, edges: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(first window, windows, anchor hash, content hash, place of the anchor in the first window) of each
    context; texts end at ``edges``."""
    n = len(part) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none
    sums = prefix_hash(part)
    at = np.arange(len(part) - gram + 1)
    hashed = range_hash(sums, at, at + gram)
    # Low bits hold the place, so the smallest value is the leftmost of equal hashes.
    least = (hashed & ~_PLACE) | at.astype(np.uint64)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: size - width], least[width - size :])
    anchor = (least & _PLACE).astype(np.int64)
    crossing = np.zeros(n + 1, np.int64)
    inner = edges[(edges > 0) & (edges < len(part))]
    np.add.at(crossing, np.clip(inner - length + 1, 0, n), 1)
    np.add.at(crossing, np.clip(inner, 0, n), -1)
    whole = np.cumsum(crossing[:-1]) == 0
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])) + 1
    first = np.concatenate([[0], change])
    count = np.diff(np.concatenate([first, [n]]))
    keep = whole[first]
    first, count = first[keep], count[keep]
    place = anchor[first]
    content = _content(sums, first, count, place - first, length)
    return first, count, hashed[place].view(np.int64), content, place - first


def _content(sums: np.ndarray, first: np.ndarray, count: np.ndarray, ahead: np.ndarray, length: int) -> np.ndarray:
    whole = range_hash(sums, first, first + count - 1 + length)
    return mix(whole + mix((count * 1024 + ahead).astype(np.uint64))).view(np.int64)


def pieces(body: np.ndarray, base: np.ndarray, count: np.ndarray, ahead: np.ndarray, key: np.ndarray, bits: int, length: int):
    """(context, first window in it, windows, key, content hash, place) of the pieces of contexts that begin at
    ``base``. A piece holds the windows whose anchor place agrees without its last ``bits`` bits."""
    owner = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    span = (ahead[owner] - at) >> bits
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (span[1:] != span[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(owner)))
    owner, at, span = owner[first], at[first], span[first]
    sums = prefix_hash(body)
    anchor = base[owner] + ahead[owner]
    lo = span << bits
    hi = lo + (1 << bits) - 1
    # Every window of the range holds the bytes from ``lo`` before the anchor to the end of the first one.
    common = range_hash(sums, anchor - lo, anchor + np.maximum(length - hi, 1))
    made = mix(key[owner].view(np.uint64) + mix(common + mix((span * 64 + bits + 1).astype(np.uint64))))
    place = ahead[owner] - at
    return owner, at, windows, made.view(np.int64), _content(sums, base[owner] + at, windows, place, length), place


def _context_rows(length: int, gram: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            k1, k2 = (batch.column(c).to_numpy() for c in ("_k1", "_k2"))
            for i, j in spans(offsets):
                lo, hi = int(offsets[i]), int(offsets[j])
                # A text beyond CHUNK is read in pieces that share length - 1 bytes.
                for at in range(lo, max(hi - length + 1, lo + 1), CHUNK - length + 1):
                    end = min(at + CHUNK, hi)
                    first, count, key, content, ahead = contexts(data[at:end], offsets[i : j + 1] - at, length, gram)
                    if not len(first):
                        continue
                    row = np.searchsorted(offsets, first + at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(k1[row]),
                            pa.array(k2[row]),
                            pa.array(key),
                            pa.array(content),
                            pa.array((first + at - offsets[row]).astype(np.int32)),
                            pa.array(count.astype(np.int32)),
                            pa.array(ahead.astype(np.int16)),
                        ],
                        CONTEXT_COLUMNS,
                    )

    return run


def _piece_rows(bits: int, length: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            k1, k2 = (batch.column(c).to_numpy() for c in ("_k1", "_k2"))
            listed = batch.column("_contexts")
            row = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
            start, n, ahead, key = (x.to_numpy().astype(np.int64) for x in listed.flatten().flatten())
            # Only the bytes of the contexts are copied, a few thousand contexts at a time.
            for at in range(0, len(row), 2048):
                part = slice(at, at + 2048)
                size = n[part] - 1 + length
                base = np.cumsum(size) - size
                body = data[np.repeat(offsets[row[part]] + start[part] - base, size) + np.arange(size.sum())]
                owner, ahead_of, windows, made, content, place = pieces(
                    body, base, n[part], ahead[part], key[part], bits, length
                )
                of = row[part][owner]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k1[of]),
                        pa.array(k2[of]),
                        pa.array(made),
                        pa.array(content),
                        pa.array((start[part][owner] + ahead_of).astype(np.int32)),
                        pa.array(windows.astype(np.int32)),
                        pa.array(place.astype(np.int16)),
                    ],
                    CONTEXT_COLUMNS,
                )

    return run


class Queues:
    """First-in first-out queues of suffixes, one for each first symbol, spilling to scratch space."""

    def __init__(self, symbols: int, limit: int = QUEUE_BYTES):
        self.held: list[list] = [[] for _ in range(symbols)]
        self.bytes, self.limit, self.file = 0, limit, None

    def push(self, symbol: int, suffixes: np.ndarray) -> None:
        self.held[symbol].append(suffixes)
        self.bytes += suffixes.nbytes
        if self.bytes > self.limit:
            self._spill()

    def deal(self, symbols: np.ndarray, suffixes: np.ndarray) -> None:
        """Push each suffix to the queue of its symbol, in order."""
        if not len(suffixes):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, suffixes = symbols[order], suffixes[order]
        at = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(symbols)]):
            self.push(int(symbols[a]), suffixes[a:b])

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for queue in self.held:
            for i, x in enumerate(queue):
                if isinstance(x, np.ndarray):
                    at = self.file.seek(0, 2)
                    self.file.write(np.ascontiguousarray(x, np.int64).tobytes())
                    queue[i] = (at, len(x))
        self.bytes = 0

    def pop(self, symbol: int) -> np.ndarray:
        queue, self.held[symbol] = self.held[symbol], []
        parts = []
        for x in queue:
            if isinstance(x, tuple):
                self.file.seek(x[0])
                parts.append(np.frombuffer(self.file.read(8 * x[1]), np.int64))
            else:
                self.bytes -= x.nbytes
                parts.append(x)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, symbols: int, limit: int = QUEUE_BYTES) -> np.ndarray:
    """All suffixes in the order that the order of the leftmost-S suffixes ``seeds`` induces."""
    seed_symbol = text[seeds]
    by_symbol = np.argsort(seed_symbol, kind="stable")
    bounds = np.searchsorted(seed_symbol[by_symbol], np.arange(symbols + 1))
    queues = Queues(symbols, limit)
    larger: list[np.ndarray] = []
    for c in range(symbols):
        front, out = queues.pop(c), []
        while len(front):
            out.append(front)
            before = front[front > 0] - 1
            before = before[~is_s[before]]
            symbol = text[before]
            same = symbol == c
            queues.deal(symbol[~same], before[~same])
            front = before[same]
        larger.append(np.concatenate(out) if out else np.zeros(0, np.int64))
        before = seeds[by_symbol[bounds[c] : bounds[c + 1]]]
        before = before[before > 0] - 1
        queues.deal(text[before], before)
    queues.close()
    queues = Queues(symbols, limit)
    parts: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):
        front, out = queues.pop(c), []
        while len(front):
            out.append(front)
            before = front[front > 0] - 1
            before = before[is_s[before]]
            symbol = text[before]
            same = symbol == c
            queues.deal(symbol[~same], before[~same])
            front = before[same]
        before = larger[c][::-1]
        before = before[before > 0] - 1
        before = before[is_s[before]]
        queues.deal(text[before], before)
        if out:
            parts.append(np.concatenate(out)[::-1])
        parts.append(larger[c])
    queues.close()
    return np.concatenate(parts[::-1])


def rank_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names, by doubling, exact to ``depth`` names at least."""
    rank, length = names, 1
    while length < depth and rank.max(initial=0) + 1 < len(rank):
        ahead = np.full(len(rank), -1, np.int64)
        ahead[:-length] = rank[length:]
        _, rank = np.unique(rank * (len(rank) + 2) + ahead + 1, return_inverse=True)
        length *= 2
    return rank


def suffix_order(text: np.ndarray, symbols: int, depth: int, limit: int = QUEUE_BYTES) -> np.ndarray:
    """Suffixes of ``text`` in order of their first ``depth`` symbols. The last symbol must be 0, once."""
    n = len(text)
    step = text[1:].astype(np.int64) - text[:-1]
    following = np.where(step != 0, np.arange(n - 1), n - 2)
    following = np.minimum.accumulate(following[::-1])[::-1]
    is_s = np.append(step[following] > 0, True)
    seeds = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(seeds) > 1:
        # Name the substrings between seeds in their induced order, then rank the string of names.
        order = induce(text, is_s, seeds, symbols, limit)
        is_seed = np.zeros(n, bool)
        is_seed[seeds] = True
        found = order[is_seed[order]]
        found = np.concatenate([[n - 1], found[found != n - 1]])
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(text.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        ends = np.append(seeds[1:], n - 1)
        place = np.searchsorted(seeds, found)
        lo, hi = found, ends[place] + 1
        print_ = mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))
        new = np.ones(len(found), np.int64)
        new[1:] = print_[1:] != print_[:-1]
        names = np.empty(len(seeds), np.int64)
        names[place] = np.cumsum(new) - 1
        seeds = seeds[np.argsort(rank_names(names, depth // 2 + 2), kind="stable")]
    return induce(text, is_s, seeds, symbols, limit)


def repeated_starts(
    bodies: list[bytes], live: np.ndarray, weights: np.ndarray, length: int = LENGTH, limit: int = QUEUE_BYTES
) -> list[np.ndarray]:
    """For each context: which of its first ``live`` windows occur elsewhere in the shard or copies."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    # Symbols: 0 ends the string, 1 ends a context, bytes follow.
    text = np.ones(int((sizes + 1).sum()) + 1, np.int16)
    text[-1] = 0
    inside = np.ones(len(text), bool)
    inside[base + sizes] = inside[-1] = False
    text[inside] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int16) + 2
    owner = np.repeat(np.arange(len(bodies)), live)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(live) - live, live)
    slot = np.full(len(text), -1, np.int64)
    slot[base[owner] + starts] = np.arange(len(owner))
    order = slot[suffix_order(text, 258, length, limit)]
    order = order[order >= 0]
    at = base[owner] + starts
    up, down = powers(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(mix(text.astype(np.uint64)) * up[: len(text)], out=sums[1:])
    window = mix((sums[at + length] - sums[at]) * down[at])[order]
    new = np.ones(len(order), bool)
    new[1:] = window[1:] != window[:-1]
    run = np.cumsum(new) - 1
    total = np.bincount(run, weights[owner[order]])
    out = np.zeros(len(owner), bool)
    out[order] = total[run] >= 2
    return np.split(out, np.cumsum(live)[:-1])


def _bodies(length: int):
    """The bytes of the contexts that are fetched from each text."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            listed = batch.column("_contexts")
            row = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
            key, content, start, n, weight = listed.flatten().flatten()
            lo = offsets[row] + start.to_numpy()
            hi = lo + n.to_numpy() - 1 + length
            for at in range(0, len(row), 4096):
                part = slice(at, at + 4096)
                bodies = [data[a:b].tobytes() for a, b in zip(lo[part].tolist(), hi[part].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*[x.slice(at, 4096) for x in (key, content, n, weight)], pa.array(bodies, pa.binary())],
                    ["key", "content", "n", "weight", "body"],
                )

    return run


def _sort_shards(length: int, shard_bytes: int, limit: int):
    def flush(rows: list[tuple]):
        marks = repeated_starts(
            [r[4] for r in rows],
            np.array([r[2] for r in rows], np.int64),
            np.array([min(r[3], 2) for r in rows], np.int64),
            length,
            limit,
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([np.packbits(m).tobytes() for m in marks], pa.binary()),
            ],
            ["key", "content", "bits"],
        )

    def run(batches):
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "content", "n", "weight", "body")]):
                if rows and row[:2] == last:
                    continue  # the same context, fetched from a repeated row
                if size >= shard_bytes and row[0] != last[0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row[4]), row[:2]
        if rows:
            yield flush(rows)

    return run


def _cut(length: int, id_col: str):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            made = []
            marks = batch.column("_marks")
            for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                body, n = data[lo:hi], hi - lo
                removed = spans_ = 0
                if marks[i].is_valid:
                    flags = np.zeros(n + 1, np.int64)
                    for m in marks[i].as_py():
                        bits = np.flatnonzero(np.unpackbits(np.frombuffer(m["bits"], np.uint8)))
                        flags[m["start"] + bits] = 1
                    total = np.cumsum(flags)
                    covered = total.copy()
                    covered[length:] -= total[:-length]
                    gone = covered[:n] > 0
                    removed = int(gone.sum())
                    spans_ = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if n else 0
                    body = body[~gone]
                made.append((n, removed, spans_, hashlib.sha256(body.tobytes()).hexdigest()))
            columns = list(zip(*made)) if made else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
                [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def _hot(open_: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Keys whose different contexts hold more than ``shard_bytes``; copies are combined before the shuffle."""
    apart = open_.groupBy("key", "content").agg(F.first("n").alias("n"))
    size = F.sum(F.col("n") + length - 1)
    return apart.groupBy("key").agg(size.alias("b")).filter(F.col("b") > shard_bytes).select("key")


def open_contexts(texts: DataFrame, length: int, gram: int, shard_bytes: int) -> DataFrame:
    """Contexts, or pieces of them, whose key comes back; the different ones of a key fit a shard."""
    found = texts.select("_k1", "_k2", "_text").mapInArrow(_context_rows(length, gram), _CONTEXT_ROW)
    again = found.groupBy("key").count().filter("count > 1").select("key")
    open_ = stored(found.join(again, "key"), "contexts").select(*CONTEXT_COLUMNS)
    fitting, bits = [], (length - gram).bit_length()
    while bits:
        hot = stored(_hot(open_, length, shard_bytes), "hot-anchors")
        if not hot.head(1):
            break
        fitting.append(open_.join(hot, "key", "left_anti"))
        bits = max(bits - 2, 0)
        # One row a document; rows that repeat id and text give the same set once each.
        listed = (
            open_.join(hot, "key", "left_semi")
            .groupBy("_k1", "_k2")
            .agg(F.collect_set(F.struct("start", "n", "ahead", "key")).alias("_contexts"))
        )
        cut = texts.select("_k1", "_k2", "_text").join(listed, ["_k1", "_k2"]).mapInArrow(_piece_rows(bits, length), _CONTEXT_ROW)
        cut = stored(cut, "pieces")
        again = cut.groupBy("key").count().filter("count > 1").select("key")
        open_ = cut.join(again, "key").select(*CONTEXT_COLUMNS)
    return reduce(DataFrame.unionByName, [*fitting, open_])


def repeated_windows(
    texts: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, limit: int = QUEUE_BYTES
) -> DataFrame:
    """(_k1, _k2, _marks): for each text with candidates, the windows that occur elsewhere."""
    open_ = open_contexts(texts, length, gram, shard_bytes)
    distinct = open_.groupBy("key", "content").agg(
        F.count("*").alias("weight"), F.min(F.struct("_k1", "_k2", "start", "n")).alias("one")
    )
    # One row a text, so that a long one does not travel once for each of its contexts.
    listed = (
        distinct.select("key", "content", "weight", "one.*")
        .groupBy("_k1", "_k2")
        .agg(F.collect_list(F.struct("key", "content", "start", "n", "weight")).alias("_contexts"))
    )
    fetched = (
        texts.select("_k1", "_k2", "_text")
        .join(listed, ["_k1", "_k2"])
        .select("_text", "_contexts")
        .mapInArrow(_bodies(length), "key long, content long, n int, weight long, body binary")
    )
    marked = (
        fetched.repartition("key")
        .sortWithinPartitions("key", "content")
        .mapInArrow(_sort_shards(length, shard_bytes, limit), "key long, content long, bits binary")
    )
    marked = stored(marked, "marks")
    return (
        open_.join(marked, ["key", "content"])
        .groupBy("_k1", "_k2")
        .agg(F.collect_set(F.struct("start", "bits")).alias("_marks"))
    )


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    shard_bytes: int = SHARD_BYTES,
    limit: int = QUEUE_BYTES,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    texts = keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text")
    kind = docs.schema[id_col].dataType.simpleString()
    marks = repeated_windows(texts, length, gram, shard_bytes, limit)
    return texts.join(marks, ["_k1", "_k2"], "left").mapInArrow(
        _cut(length, id_col), f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
