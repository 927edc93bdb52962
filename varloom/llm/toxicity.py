"""Toxicity by weak supervision.

1. Lexicon candidates, words and word beginnings hashed to buckets, are counted by label over a
   sample of labelled learning rows (at most ``FIT_ROWS``, the smallest id hashes).
2. The strongest become voters, next to pattern voters for shouting and symbols and to the labels
   themselves, which are one more voter and not the truth. A generative model with a hidden class
   estimates by expectation maximisation how often each voter fires in either class; voters that
   still move together within a class share one vote.
3. A logistic regression on the selected lexicon buckets is fitted to the posterior labels and
   scores every text. A bucket has three levels (seen once, twice, four times), so chance hits of
   a beginning weigh less than a habit.

Only the fitting uses a sample; every text is scored whole. Labels, language, source and id are no
inputs of a score.

Defined cases: a null or empty text has no features and gets the score of the intercept; without
labelled learning rows, or without a positive one, that is 0. Null labels teach nothing, a row
with a null id is held out, repeated label rows count as often as they stand there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from varloom.llm.common import crc_mod, mix, powers

FIT_ROWS = 30_000
BUCKETS = 1 << 18
BEGINNINGS = (4, 5, 6, 7)
LEVELS = (1, 2, 4)
SELECTED = 512
VOTERS = 32
PATTERNS = 2
_PIECE = 1 << 19


def _word_hashes(text: str):
    """Hashes of words and of their beginnings, in pieces of a long text cut between words."""
    text = text.lower()
    at = 0
    while at < len(text):
        end = min(at + _PIECE, len(text))
        while end < len(text) and text[end].isalpha():
            end += 1
        points = np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), "<u4")
        at = end
        letter = ((points >= 97) & (points <= 122)) | (points >= 0xAA)
        edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            continue
        up, down = powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
        for n in (0, *BEGINNINGS):
            long = ends - starts > n if n else slice(None)
            lo = starts[long]
            hi = lo + n if n else ends
            yield mix((sums[hi] - sums[lo]) * down[lo] + np.uint64(n))


def features(text: str | None) -> np.ndarray:
    """Distinct feature buckets of a text, one for each level reached."""
    parts = list(_word_hashes(text)) if text else []
    if not parts:
        return np.zeros(0, np.int64)
    found, counts = np.unique(np.concatenate(parts), return_counts=True)
    leveled = [found[counts >= level] + np.uint64(level) for level in LEVELS]
    return np.unique(mix(np.concatenate(leveled)) >> np.uint64(64 - 18)).astype(np.int64)


def patterns(text: str | None) -> list[int]:
    """Votes of the pattern voters: shouting, symbols between words."""
    text = text or ""
    n = max(len(text), 1)
    shout = text.count("!!") * 50 > n
    signs = sum(text.count(c) for c in "#*$%&|<>") * 20 > n
    return [int(shout), int(signs)]


def _class_counts(batches):
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column("_text").to_pylist(), batch.column("_label").to_pylist()):
            counts[label, features(text)] += 1
    at = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], ["bucket", "clean", "toxic"]
    )


def _hits(place: np.ndarray):
    def run(batches):
        for batch in batches:
            hits, marks = [], []
            for text in batch.column("_text").to_pylist():
                found = place[features(text)]
                hits.append(np.sort(found[found >= 0]).astype(np.int32))
                marks.append(patterns(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_label"), pa.array(hits, pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.int32()))],
                ["label", "hits", "marks"],
            )

    return run


def pick_voters(dense: np.ndarray, gold: np.ndarray) -> list[int]:
    """Buckets that vote, each the surest on the rows where none picked before it fires.

    Picking by what is still uncovered gives every kind of wording its voters, not only the commonest.
    """
    picked: list[int] = []
    left = np.ones(len(gold), bool)
    while len(picked) < VOTERS:
        toxic, clean = dense[left & gold].sum(0), dense[left & ~gold].sum(0)
        n1, n0 = (left & gold).sum(), (left & ~gold).sum()
        p, q = (toxic + 0.5) / (n1 + 1), (clean + 0.5) / (n0 + 1)
        gain = toxic * np.log(p / q) + (n1 - toxic) * np.log((1 - p) / (1 - q))
        gain[(p <= q) | (toxic < 4 * clean)] = 0
        if not len(gain) or gain.max() < 3:
            break
        picked.append(int(gain.argmax()))
        left &= ~dense[:, picked[-1]]
    return picked


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row, firing rates of each voter by class, and vote shares.

    ``votes`` is a 0/1 matrix; the last voter, ``gold``, starts the estimate and is weighed like
    any other. Voters whose votes are correlated within a class divide their weight among them.
    """
    x = np.column_stack([votes, gold]).astype(float)
    post = 0.05 + 0.9 * gold.astype(float)
    share = np.ones(x.shape[1])
    for step in range(rounds):
        weight = np.stack([1 - post, post])
        prior = (weight.sum(1) + 1) / (len(post) + 2)
        rate = (weight @ x + 0.5) / (weight.sum(1, keepdims=True) + 1)
        if step in (5, 20):
            # Correlation left once the class is known; a full twin halves the vote of both.
            centred = x - post[:, None] * rate[1] - (1 - post)[:, None] * rate[0]
            cov = centred.T @ centred
            scale = np.sqrt(np.outer(np.diag(cov), np.diag(cov))) + 1e-9
            share = 1 / np.maximum((np.abs(cov / scale) > 0.5).sum(0), 1)
        logit = np.log(prior[1] / prior[0]) + (
            (x * np.log(rate[1] / rate[0]) + (1 - x) * np.log((1 - rate[1]) / (1 - rate[0]))) * share
        ).sum(1)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < 1e-5:
            post = new
            break
        post = new
    return post, rate, share


def fit_linear(
    rows: np.ndarray, columns: np.ndarray, target: np.ndarray, width: int, penalty: float = 1e-4, rounds: int = 400
) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 rows with soft targets, by Adam on the whole sample."""
    w, b = np.zeros(width), np.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6))
    m, v, n = np.zeros(width + 1), np.zeros(width + 1), len(target)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[columns], n) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        grad = np.append(np.bincount(columns, error[rows], width) + penalty * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


class Model:
    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.weights = np.zeros(BUCKETS)
        self.weights[buckets] = weights
        self.bias = bias

    def score(self, text: str | None) -> float:
        z = self.bias + self.weights[features(text)].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def fit(labelled: DataFrame) -> Model:
    """Fit on (``_text``, ``_label``) rows; what reaches the driver is bounded by FIT_ROWS and BUCKETS."""
    counted = (
        labelled.mapInArrow(_class_counts, "bucket int, clean long, toxic long")
        .groupBy("bucket")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .toArrow()
    )
    bucket, clean, toxic = (counted.column(c).to_numpy() for c in ("bucket", "clean", "toxic"))
    order = np.argsort(bucket)
    bucket, clean, toxic = bucket[order], clean[order], toxic[order]
    sizes = labelled.groupBy("_label").count().collect()
    n = {r["_label"]: r["count"] for r in sizes}
    if not n.get(1) or not len(bucket):
        return Model(np.zeros(0, np.int64), np.zeros(0), -800.0)
    p, q = (toxic + 0.5) / (n[1] + 1), (clean + 0.5) / (n.get(0, 0) + 1)
    # Signed root of the likelihood ratio: how surely a bucket speaks for a class.
    gain = toxic * np.log(p / q) + (n[1] - toxic) * np.log((1 - p) / (1 - q))
    gain = np.where(p > q, gain, 0)
    best = np.argsort(-gain, kind="stable")[:SELECTED]
    best = best[gain[best] > 3]
    chosen = bucket[best].astype(np.int64)
    place = np.full(BUCKETS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    sample = labelled.mapInArrow(_hits(place), "label int, hits array<int>, marks array<int>").toArrow()
    hits = sample.column("hits").combine_chunks()
    sizes = np.diff(hits.offsets.to_numpy())
    rows, columns = np.repeat(np.arange(len(sizes)), sizes), hits.flatten().to_numpy().astype(np.int64)
    gold = sample.column("label").to_numpy()
    dense = np.zeros((len(gold), len(chosen)), bool)
    dense[rows, columns] = True
    voters = pick_voters(dense, gold == 1)
    votes = np.column_stack([dense[:, voters], np.array(sample.column("marks").to_pylist()).reshape(-1, PATTERNS)])
    posterior, _, _ = label_model(votes, gold)
    weights, bias = fit_linear(rows, columns, posterior, len(chosen))
    return Model(chosen, weights, bias)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    held: int = 0,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """(id, held_out, score, predicted) for every row; rows of fold ``held`` teach nothing."""
    learn = labels.filter(F.col(label_col).isin(0, 1) & (crc_mod(id_col, folds) != held)).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")
    )
    sample = learn.orderBy(F.xxhash64("_id"), "_id", "_label").limit(fit_rows)
    # The sample's ids are at most fit_rows long, which bounds the broadcast.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    labelled = texts.join(F.broadcast(sample), "_id").select("_text", "_label")
    fitted = fit(labelled)
    shared = docs.sparkSession.sparkContext.broadcast((np.arange(BUCKETS), fitted.weights, fitted.bias))

    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            scores = np.array([model.score(t) for t in batch.column("_text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("held_out"),
                    pa.array(scores),
                    pa.array((scores >= 0.5).astype(np.int32)),
                ],
                [id_col, "held_out", "score", "predicted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    held_out = F.coalesce(crc_mod(id_col, folds) == held, F.lit(True)).alias("held_out")
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), held_out).mapInArrow(
        run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int"
    )
