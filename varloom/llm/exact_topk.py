"""Exact top-k inner-product search with two cover trees.

Vectors are dealt into cells around at most ``PIVOTS`` pivots, and cells into shards of about
``SHARD`` vectors by a hash of the id, so a crowded cell, or one vector with many copies, is split.
In a task a cover tree over the shard meets a cover tree over a block of queries. A pair of nodes
with centres a, b and covering radii r, s holds no product above a.b + |a| s + |b| r + r s; when
that is below the worst kth score of the query group, the pair is left out.

Two rounds: each query first visits its own cell, which gives it a kth score; then only cells whose
bound reaches that score. A cell's vectors are copied once for each block of the queries that visit it,
and to no other block. Every answer is exact; pivots only steer the work.

Bounds are doubles with a margin for rounding; scores are whole numbers. Where products could pass 2**53
they are multiplied as 64-bit integers, which is exact for every score that fits a long.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part.
Only vectors of equal length are compared. Rows that repeat id and vector count once; rows with the
query's own id are never its answers. Null ids take no part. Components times the scale, and scores,
that do not fit a long count as its largest or smallest value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from varloom.llm.common import stored

PIVOTS = 64
SHARD = 4096
LEAF = 32
#: Stands for no score.
NONE = np.iinfo(np.int64).min
#: Share of a bound's terms that covers their rounding.
MARGIN = 1e-9


class CoverTree:
    """Nodes with a centre and a covering radius; children cover half the radius where that pays."""

    def __init__(self, whole: np.ndarray):
        self.whole, self.points = whole, whole.astype(np.float64)
        self.largest = float(np.abs(self.points).max(initial=0))
        points = self.points
        self.members: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        centres, radii = [], []
        todo = [(np.arange(len(points)), 0, -1)]
        kids: dict[int, list[int]] = {}
        while todo:
            rows, centre, parent = todo.pop()
            dist = self._distance(rows, centre)
            node, radius = len(centres), float(dist.max())
            centres.append(centre)
            radii.append(radius)
            self.members.append(rows)
            kids[node] = []
            if parent >= 0:
                kids[parent].append(node)
            if len(rows) <= LEAF or radius == 0:
                continue
            left, loose, tried = rows, [], 0
            while len(left):
                near = self._distance(left, left[0]) <= radius / 2
                group, tried = left[near], tried + 1
                if len(group) > 1:
                    todo.append((group, int(left[0]), node))
                else:
                    loose.append(group)
                left = left[~near]
                if tried >= 64 and len(rows) - len(left) < 2 * tried:
                    loose.append(left)  # no net to speak of: what is left goes to leaves
                    break
            loose = np.concatenate(loose) if loose else np.zeros(0, np.int64)
            for at in range(0, len(loose), LEAF):
                todo.append((loose[at : at + LEAF], int(loose[at]), node))
        self.centre = points[centres]
        self.norm = np.sqrt((self.centre**2).sum(1))
        self.radius = np.array(radii)
        self.children = [np.array(kids[n], np.int64) for n in range(len(centres))]
        self.is_leaf = np.array([not len(c) for c in self.children])

    def _distance(self, rows: np.ndarray, centre: int) -> np.ndarray:
        gap = self.points[rows] - self.points[centre]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))


class TopK:
    """Running best k of each query, ties to the smaller id."""

    def __init__(self, query_ids: np.ndarray, floors: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.scores = np.full((len(query_ids), k), NONE)
        self.ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)
        self.floors = floors

    def worst(self, rows: np.ndarray) -> float:
        """Smallest score that may still matter to one of the queries."""
        worst = int(np.maximum(self.scores[rows, -1], self.floors[rows]).min())
        return -np.inf if worst == NONE else float(worst)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(ids[None, :] == self.query_ids[rows, None], NONE, scores)
        every = np.hstack([self.scores[rows], scores])
        names = np.hstack([self.ids[rows], np.broadcast_to(ids, scores.shape)])
        best = np.lexsort((names, ~every), axis=-1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(every, best, 1)
        self.ids[rows] = np.take_along_axis(names, best, 1)


def dual_search(queries: CoverTree, data: CoverTree, data_ids: np.ndarray, best: TopK) -> None:
    """Walk both trees together and fill ``best``."""
    todo = [(0, np.zeros(1, np.int64))]
    while todo:
        q, nodes = todo.pop()
        rows, r = queries.members[q], queries.radius[q]
        bound = data.centre[nodes] @ queries.centre[q]
        bound = bound + queries.norm[q] * data.radius[nodes] + r * (data.norm[nodes] + data.radius[nodes])
        bound = bound + MARGIN * (queries.norm[q] + r) * (data.norm[nodes] + data.radius[nodes]) + 1e-6
        # A worst score loses digits as a double, upwards at most by its own share.
        worst = best.worst(rows)
        worst = worst - MARGIN * abs(worst) if worst > -np.inf else worst
        keep = bound >= worst
        nodes, bound = nodes[keep], bound[keep]
        if not len(nodes):
            continue
        inner = nodes[~data.is_leaf[nodes]]
        leaves = nodes[data.is_leaf[nodes]]
        opened = np.concatenate([leaves, *[data.children[n] for n in inner]])
        if not queries.is_leaf[q]:
            todo.extend((int(c), opened) for c in queries.children[q])
        elif len(inner):
            todo.append((q, opened))
        else:
            for n, limit in sorted(zip(nodes.tolist(), bound.tolist()), key=lambda x: -x[1]):
                worst = best.worst(rows)
                if limit < worst - MARGIN * abs(worst):
                    break
                members = data.members[n]
                best.offer(rows, products(queries, rows, data, members), data_ids[members])


def products(a: CoverTree, rows: np.ndarray, b: CoverTree, members: np.ndarray) -> np.ndarray:
    """Whole-number inner products of rows of two trees."""
    rough = a.points[rows] @ b.points[members].T
    if a.largest * b.largest * a.points.shape[1] < 2.0**53:
        return rough.astype(np.int64)
    # Sums wrap around and come back, so they are right wherever the result fits.
    with np.errstate(over="ignore"):
        exact = a.whole[rows] @ b.whole[members].T
    return np.where(rough >= 2.0**63, np.iinfo(np.int64).max, np.where(rough < -(2.0**63), NONE + 1, exact))


def _search_pair(k: int):
    def run(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []}).astype("int64")
        if data.empty or queries.empty:
            return empty
        # Of equal vectors no query can need more than the k + 1 smallest ids.
        data = data.assign(v=[np.array(x, np.int64).tobytes() for x in data["v"]])
        data = data.sort_values("vec_id").drop_duplicates(["v", "vec_id"]).groupby("v", sort=False).head(k + 1)
        tree = CoverTree(np.frombuffer(b"".join(data["v"]), np.int64).reshape(len(data), -1))
        asked = CoverTree(np.array(queries["v"].tolist(), np.int64))
        best = TopK(queries["vec_id"].to_numpy(), queries["floor"].to_numpy(np.int64), k)
        dual_search(asked, tree, data["vec_id"].to_numpy(), best)
        at, place = np.nonzero((best.scores > NONE) & (best.scores >= best.floors[:, None]))
        return pd.DataFrame(
            {
                "query_id": queries["vec_id"].to_numpy()[at],
                "query_key": queries["query_key"].to_numpy()[at],
                "vec_id": best.ids[at, place],
                "score": best.scores[at, place],
            }
        )

    return run


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(vec_id, v) with whole-number components; rows that take no part are left out."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    )


def _placed(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add the nearest pivot among those of the vector's length, and the distance to it."""

    def run(batches):
        for pdf in batches:
            cell, gap = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
            size = pdf["v"].map(len).to_numpy()
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x = np.array(pdf["v"].iloc[at].tolist(), np.float64)
                p = pivots[int(n)]
                d = (x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)
                near = d.argmin(1)
                cell[at] = near
                gap[at] = np.sqrt(((x - p[near]) ** 2).sum(1))
            yield pdf.assign(size=size, cell=cell, gap=gap)

    return vectors.mapInPandas(run, "vec_id long, v array<bigint>, size long, cell long, gap double")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: float = 256.0,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every query row against all other rows."""
    spark = vectors.sparkSession
    ready = quantised(vectors, id_col, vec_col, scale)
    # Pivots: the smallest hashes of each vector length, at most PIVOTS for each of 64 lengths.
    firsts = (
        ready.withColumns({"size": F.size("v").cast("long"), "h": F.xxhash64("v")})
        .groupBy("size", F.pmod("h", F.lit(PIVOTS)).alias("slot"))
        .agg(F.min_by("v", "h").alias("v"))
    ).collect()
    pivots: dict[int, np.ndarray] = {}
    for r in firsts:
        pivots.setdefault(r["size"], []).append(r["v"])
    pivots = {n: np.unique(np.array(v, np.float64), axis=0) for n, v in pivots.items()}
    placed = stored(_placed(ready, pivots), "vectors")
    cells = placed.groupBy("size", "cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect()
    layout = {(c["size"], c["cell"]): (c["radius"], -(-c["n"] // SHARD)) for c in cells}
    queries = placed.filter(is_query).withColumn("query_key", F.xxhash64("vec_id", "v")).dropDuplicates(["vec_id", "v"])
    shards = {f"{s}/{c}": n for (s, c), (_, n) in layout.items()}
    # One entry for each cell: at most PIVOTS for each vector length.
    sizes = F.create_map(*[x for name, n in shards.items() for x in (F.lit(name), F.lit(n))]) if shards else None
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cell_name = F.concat_ws("/", "size", "cell")
    data = placed.withColumn("shard", F.pmod(F.xxhash64("vec_id"), sizes[cell_name])).select(
        "size", "cell", "shard", "vec_id", "v"
    )
    keys = ["size", "cell", "shard", "block"]
    schema = "query_id long, query_key long, vec_id long, score long"

    def visit(asked: DataFrame) -> DataFrame:
        """Search the cells named by ``asked`` (vec_id, query_key, v, size, cell, floor)."""
        asked = stored(asked.select("vec_id", "query_key", "v", "size", "cell", "floor"), "asked")
        # Blocks of the queries that visit a cell; one entry for each cell.
        visits = {f"{r['size']}/{r['cell']}": -(-r["n"] // SHARD) for r in asked.groupBy("size", "cell").agg(F.count("*").alias("n")).collect()}
        blocks = F.create_map(*[x for name, n in visits.items() for x in (F.lit(name), F.lit(n))]) if visits else None
        if blocks is None:
            return spark.createDataFrame([], schema)
        dealt = asked.withColumn(
            "shard", F.explode(F.sequence(F.lit(0).cast("long"), sizes[cell_name].cast("long") - 1))
        ).withColumn("block", F.pmod(F.col("query_key"), blocks[cell_name]).cast("long"))
        copies = data.filter(blocks[cell_name].isNotNull()).withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("long"), blocks[cell_name].cast("long") - 1))
        )
        return copies.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(
            lambda left, right: _search_pair(k)(left, right), schema
        )

    own = stored(visit(queries.withColumn("floor", F.lit(int(NONE)).cast("long"))), "own-cell")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    kth = (
        own.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") == k)
        .select("query_key", F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    )
    known = queries.join(kth, ["query_key", "vec_id"], "left").withColumn(
        "floor", F.coalesce("floor", F.lit(int(NONE)))
    )
    radii = {n: np.array([layout.get((n, c), (-1.0, 0))[0] for c in range(len(p))]) for n, p in pivots.items()}

    def elsewhere(batches):
        for pdf in batches:
            lists = []
            for v, n, cell, floor in zip(pdf["v"], pdf["size"], pdf["cell"], pdf["floor"]):
                x, p, r = np.array(v, np.float64), pivots[int(n)], radii[int(n)]
                long = np.sqrt((x**2).sum())
                bound = p @ x + long * r
                bound = bound + MARGIN * long * (np.sqrt((p**2).sum(1)) + r) + 1e-6
                open_ = (bound >= (-np.inf if floor == NONE else floor - MARGIN * abs(float(floor)))) & (r >= 0)
                open_[cell] = False
                lists.append(np.flatnonzero(open_).tolist())
            yield pdf[["vec_id", "query_key", "v", "size", "floor"]].assign(cells=lists)

    more = known.mapInPandas(
        elsewhere, "vec_id long, query_key long, v array<bigint>, size long, floor long, cells array<bigint>"
    )
    others = visit(more.withColumn("cell", F.explode("cells")).drop("cells"))
    return (
        own.union(others)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
