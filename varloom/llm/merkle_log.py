"""Merkle manifest of a data set, kept as a postorder append log.

A row is a leaf: the digest of its fields. The leaves of a source, in order of the id, make a tree in
which every ``FANOUT`` consecutive nodes of a level become one node above; the last run of a level may
be shorter. The roots of the sources, in order of their names, make the top tree.

Builders are aligned: each takes ``FANOUT ** SPAN`` consecutive leaves, closes every node when its last
child is there and appends it to the log, so a log holds the nodes of a tree in the order in which they
are completed, which is postorder. The topmost nodes of the builders are the leaves of the next tier of
builders, whose nodes fall between the segments below. Where a node stands follows from the sizes of the
subtrees before it alone (:func:`position`), so builders need not wait for each other, and a proof
addresses the siblings of a node without reading anything else.

Proofs go down the tiers: a builder's segment and the proof of its topmost node give the proofs of all
its leaves. No task holds more than one segment, whatever the size of a source, and a row travels as
two digests and three numbers.

Defined cases: a null field is written ``-``; the null source is a source of its own and the first one;
null ids come first. Rows that share source and id stand in order of their leaves, so equal rows are
leaves of their own with a proof each. A source of one row has that leaf as its root and a set of one
source that source's root; a proof without siblings is the digest of the empty text. An empty table
gives no rows. Columns other than ``FIELDS`` play no part.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from varloom.llm.common import stored
from varloom.operators.rows import number_rows

FANOUT = 16
#: Levels that one builder closes.
SPAN = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a range of numbers; the table of runs has one row for each range and source in it.
RANGE = 1 << 16
#: Runs that may be broadcast: at most 100,000 rows of a source name and three numbers.
MOST_RUNS = 100_000

_WIDTH = 32


def field(value: Column) -> Column:
    """Byte count, colon and value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def position(n: int, level: int, index: int, fanout: int = FANOUT) -> int:
    """Place in the postorder log of a tree of n leaves.

    Up to its own level all nodes that end with it or before are complete, above it those that end
    before it starts.
    """
    width = fanout**level
    start, end = index * width, min((index + 1) * width, n)
    before = sum(-(-end // fanout**low) for low in range(level + 1))
    return before + sum(start // fanout**high for high in range(level + 1, height(n, fanout) + 1)) - 1


def join_digests(nodes: list[bytes]) -> bytes:
    """A node's digest from those of its children."""
    return hashlib.sha256("".join(map(bytes.hex, nodes)).encode()).digest()


def grow(n: int, tier: int, block: int, leaves: list[bytes], fanout: int = FANOUT, span: int = SPAN):
    """Nodes (level, index, digest) that one builder closes, in the order of completion.

    Level and index are those of the tree. The builder's own leaves, nodes of level ``tier * span``, are
    only listed in the lowest tier; a higher tier finds its leaves in the log already.
    """
    bottom, top = tier * span, min((tier + 1) * span, height(n, fanout))
    last = [-(-n // fanout**level) - 1 for level in range(top + 1)]
    open_runs: list[list[bytes]] = [[] for _ in range(top - bottom + 1)]
    for index, digest in enumerate(leaves, block * fanout**span):
        level = bottom
        if tier == 0:
            yield 0, index, digest
        open_runs[0].append(digest)
        # A node that ends a run, or its level, closes its parent.
        while level < top and ((index + 1) % fanout == 0 or index == last[level]):
            digest = join_digests(open_runs[level - bottom])
            open_runs[level - bottom] = []
            index, level = index // fanout, level + 1
            open_runs[level - bottom].append(digest)
            yield level, index, digest


def siblings(n: int, level: int, index: int, read, fanout: int = FANOUT) -> tuple[bytes, bytes]:
    """Digests left and right of a node in its run."""
    first = index - index % fanout
    run = [read(level, i) for i in range(first, min(first + fanout, -(-n // fanout**level)))]
    return b"".join(run[: index - first]), b"".join(run[index - first + 1 :])


def fold(leaf: bytes, sides: list[bytes]) -> bytes:
    """The root that a leaf and its proof, left and right siblings in turn, lead to."""
    for left, right in zip(sides[::2], sides[1::2]):
        leaf = hashlib.sha256((left.hex() + leaf.hex() + right.hex()).encode()).digest()
    return leaf


class Segments:
    """Parts of a log, read by position."""

    def __init__(self, n: int, parts: list[tuple[int, bytes]]):
        self.n, self.parts = n, sorted(parts)
        self.firsts = [first for first, _ in self.parts]

    def read(self, level: int, index: int) -> bytes:
        at = position(self.n, level, index)
        first, nodes = self.parts[bisect_right(self.firsts, at) - 1]
        return nodes[(at - first) * _WIDTH : (at - first + 1) * _WIDTH]


def _builder(tier: int):
    """A builder's segments of the log, and its topmost node as a row without ``first``."""

    def run(key, group):
        group = group.sort_by("idx")
        n, leaves = group.column("n")[0].as_py(), group.column("digest").to_pylist()
        firsts, parts, digest = [], [], b""
        expected = -1
        for level, index, digest in grow(n, tier, key[1].as_py(), leaves):
            at = position(n, level, index)
            # Nodes that follow each other in the log are one segment.
            if at != expected:
                firsts.append(at)
                parts.append([])
            parts[-1].append(digest)
            expected = at + 1
        rows = len(firsts) + 1
        return pa.table(
            {
                "tree": pa.array([key[0].as_py()] * rows, pa.int64()),
                "block": pa.array([key[1].as_py()] * rows, pa.int64()),
                "n": pa.array([n] * rows, pa.int64()),
                "first": pa.array([*firsts, None], pa.int64()),
                "nodes": pa.array([*map(b"".join, parts), digest], pa.binary()),
            }
        )

    return run


def build(leaves: DataFrame, most: int, label: str) -> list[DataFrame]:
    """What the builders of each tier wrote: (tree, block, n, first, nodes).

    ``leaves`` has (tree, n, idx, digest), ``most`` is the largest n. Rows with ``first`` are the log,
    the others hold the topmost nodes.
    """
    tiers, nodes = [], leaves
    while True:
        groups = nodes.select("tree", _block().alias("block"), "n", "idx", "digest").groupBy("tree", "block")
        made = groups.applyInArrow(_builder(len(tiers)), "tree long, block long, n long, first long, nodes binary")
        tiers.append(stored(made, f"{label}-{len(tiers)}"))
        if height(most) <= len(tiers) * SPAN:
            return tiers
        nodes = _leaves_above(tiers)


def _block() -> Column:
    return F.floor(F.col("idx") / FANOUT**SPAN).cast("long")


def _leaves_above(tiers: list[DataFrame]) -> DataFrame:
    """Leaves of the tier above the last one; trees that have their root take no further part."""
    tops = tiers[-1].filter("first is null").filter(F.col("n") > FANOUT ** (len(tiers) * SPAN))
    return tops.select("tree", "n", F.col("block").alias("idx"), F.col("nodes").alias("digest"))


def log_of(tiers: list[DataFrame]) -> DataFrame:
    """The append logs: digests of ``nodes`` stand from place ``first`` of their tree's log on."""
    parts = [t.filter("first is not null").select("tree", "first", "nodes") for t in tiers]
    return reduce(DataFrame.unionByName, parts)


def roots(tiers: list[DataFrame]) -> DataFrame:
    """(tree, n, root): the topmost node of each tree's last builder."""
    parts = []
    for i, tier in enumerate(tiers):
        ends = tier.filter("first is null").filter(F.col("n") <= FANOUT ** ((i + 1) * SPAN))
        parts.append(ends.select("tree", "n", F.col("nodes").alias("root")))
    return reduce(DataFrame.unionByName, parts)


def _prover(tier: int, carried: tuple[str, ...]):
    """Proofs of a builder's leaves, from its part of the log and the proof of its topmost node."""

    def run(key, rows, parts):
        if not rows.num_rows:
            kinds = [("above", pa.list_(pa.binary())), ("subroot", pa.binary())]
            out = rows.select(list(carried))
            for name, kind in kinds:
                out = out.append_column(name, pa.array([], kind))
            return out
        n, indexes = rows.column("n")[0].as_py(), rows.column("idx").to_pylist()
        held, above, subroot = [], [], None
        for first, nodes, up, root in zip(*(parts.column(c).to_pylist() for c in ("first", "nodes", "above", "subroot"))):
            if first is None:
                above, subroot = up, root
            else:
                held.append((first, nodes))
        if tier:
            # The lowest level of this part of the log was written by the tier below.
            level = tier * SPAN
            held += [(position(n, level, i), d) for i, d in zip(indexes, rows.column("digest").to_pylist())]
        segments = Segments(n, held)
        shared: dict[int, list[bytes]] = {}
        proofs = []
        for index in indexes:
            at, steps = index, []
            for level in range(tier * SPAN, min((tier + 1) * SPAN, height(n))):
                if level > tier * SPAN and index // FANOUT in shared:
                    steps += shared[index // FANOUT]
                    break
                steps += siblings(n, level, at, segments.read)
                at //= FANOUT
            # Above the first level the steps of a run are the same.
            shared.setdefault(index // FANOUT, steps[2:])
            proofs.append(steps + above)
        out = rows.select(list(carried))
        out = out.append_column("above", pa.array(proofs, pa.list_(pa.binary())))
        return out.append_column("subroot", pa.array([subroot] * len(proofs), pa.binary()))

    return run


def prove(leaves: DataFrame, tiers: list[DataFrame], above: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """The carried columns of ``leaves`` with ``above``, the proof of each, and ``subroot``.

    ``above`` has (tree, above, subroot): the proof that continues that of a tree's root.
    """
    for tier in reversed(range(len(tiers))):
        rows = leaves if tier == 0 else _leaves_above(tiers[:tier])
        last = tiers[tier].filter("first is null").filter(F.col("n") <= FANOUT ** ((tier + 1) * SPAN))
        tops = last.join(above, "tree").select("tree", "block", "above", "subroot")
        if tier + 1 < len(tiers):
            tops = tops.unionByName(proofs.select("tree", F.col("idx").alias("block"), "above", "subroot"))
        parts = (
            tiers[tier]
            .filter("first is not null")
            .select("tree", "block", "first", "nodes")
            .unionByName(tops, allowMissingColumns=True)
        )
        rows = rows.withColumn("block", _block())
        names = carried if tier == 0 else ("tree", "idx")
        schema = ", ".join(f"`{f}` {rows.schema[f].dataType.simpleString()}" for f in names)
        proofs = (
            rows.groupBy("tree", "block")
            .cogroup(parts.groupBy("tree", "block"))
            .applyInArrow(_prover(tier, names), f"{schema}, above array<binary>, subroot binary")
        )
    return proofs


def leaf_rows(docs: DataFrame, changes: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Numbered leaves (tree, n, idx, doc_id, digest, changed) and the trees (source, tree, n)."""
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        "source",
        leaf_digest(*map(F.col, FIELDS)).alias("digest"),
        leaf_digest(*[changes.get(f, F.col(f)) for f in FIELDS]).alias("changed"),
    )
    # Texts are read once; what is sorted afterwards is narrow.
    rows = number_rows(stored(rows, "leaves"), ["source", "doc_id", "digest"], name="at")
    rows = rows.withColumn("range", F.floor(F.col("at") / RANGE))
    runs = stored(
        rows.groupBy("source", "range").agg(F.min("at").alias("start"), F.count("*").alias("size")), "leaf-runs"
    )
    trees = runs.groupBy("source").agg(F.min("start").alias("start"), F.sum("size").alias("n"))
    trees = number_rows(trees, ["start"], name="tree")
    starts = stored(
        runs.select("source", "range").alias("r")
        .join(trees.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .select("r.source", "range", "start", "n", "tree"),
        "leaf-starts",
    )
    # A key of source and range holds RANGE rows at most, so the plain join has no hot key either.
    small = F.broadcast(starts) if starts.count() <= MOST_RUNS else starts
    leaves = (
        rows.alias("l")
        .join(small.alias("s"), (F.col("l.range") == F.col("s.range")) & F.col("l.source").eqNullSafe(F.col("s.source")))
        .select("tree", "n", (F.col("at") - F.col("start")).alias("idx"), "doc_id", "digest", "changed")
    )
    return leaves, trees.select("source", "tree", "n")


def verify(docs: DataFrame, changes: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row: its leaf, the roots above it, its proof and the root that the proof gives.

    ``changes`` replaces fields before the proof is folded, as somebody who tampered with the data
    would; leaf, roots and siblings stay those of the rows as they are.
    """
    leaves, trees = leaf_rows(docs, changes or {})
    n_trees, most = trees.agg(F.count("*"), F.max("n")).first()
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    tiers = build(leaves.select("tree", "n", "idx", "digest"), most or 1, "merkle")
    subroots = roots(tiers)
    tops = subroots.select(
        F.lit(0).cast("long").alias("tree"),
        F.lit(n_trees).cast("long").alias("n"),
        F.col("tree").alias("idx"),
        F.col("root").alias("digest"),
    )
    top_tiers = build(tops, max(n_trees, 1), "merkle-top")
    root = roots(top_tiers).head(1)
    root = bytes(root[0]["root"]) if root else b""
    no_more = top_tiers[-1].select("tree").distinct()
    no_more = no_more.select("tree", F.array().cast("array<binary>").alias("above"), F.lit(None).cast("binary").alias("subroot"))
    above = stored(
        prove(tops, top_tiers, no_more, ("idx", "digest")).select(
            F.col("idx").alias("tree"), "above", F.col("digest").alias("subroot")
        ),
        "merkle-above",
    )
    proofs = prove(leaves, tiers, above, ("doc_id", "digest", "changed"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = ", ".join(f"{c} string" for c in columns[1:-1])
    out = proofs.mapInArrow(_folded(root), f"doc_id {kind}, {texts}")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _folded(root: bytes):
    def run(batches):
        for batch in batches:
            proofs = batch.column("above").to_pylist()
            changed = batch.column("changed").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([x.hex() for x in batch.column("digest").to_pylist()], pa.string()),
                    pa.array([x.hex() for x in batch.column("subroot").to_pylist()], pa.string()),
                    pa.array([root.hex()] * len(proofs), pa.string()),
                    pa.array([hashlib.sha256(b"".join(p).hex().encode()).hexdigest() for p in proofs], pa.string()),
                    pa.array([fold(x, p).hex() for x, p in zip(changed, proofs)], pa.string()),
                ],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"],
            )

    return run
