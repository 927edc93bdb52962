"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of 1- to 3-grams of lower-cased code points, hashed to 65,536 buckets, are gathered for each
language from all learning rows. The log-probability matrix has one row for each bucket and one
column for each language, and is cut into blocks of ``BLOCK_LANGS`` languages in order of name, so at
most 16 MB in single precision travel as a broadcast at a time. A text is scored as the product of its
sparse bucket counts with each block in turn; the best score and the log of the summed likelihoods are
merged over the blocks, so every language of the learning rows can be predicted.

Defined cases: a text that is null or has no letter gives ``und`` with score 0; without learning rows
every text does. A row with a null id is held out. Repeated rows are counted and predicted as often
as they stand there. Equal posteriors go to the name that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from varloom.llm.common import crc_mod, mix, stored

BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
BLOCK_LANGS = 64
ALPHA = 0.1
LETTER = re.compile(r"[^\W\d_]")
_PIECE = 1 << 18
#: Entries of the sparse product that are held at a time.
_ENTRIES = 1 << 20


def gram_buckets(text: str):
    """Hashed n-grams of a text, in pieces so that a very long text needs no more memory."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    for at in range(0, len(points), _PIECE):
        part = points[at : at + _PIECE + max(GRAMS) - 1]
        for n in GRAMS:
            # Each position of the piece starts one gram of each length, if the text is long enough.
            m = min(len(part) - n + 1, _PIECE)
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + part[k : k + m]
            yield (mix(h) >> np.uint64(48)).astype(np.int64)


def _count(batches):
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("_text").to_pylist(), batch.column("_lang").to_pylist()):
            if not text or not LETTER.search(text):
                continue
            if lang not in totals and len(totals) >= BLOCK_LANGS:
                # A task holds the counts of one block of languages at most; sums of parts meet later.
                yield from _count_rows(totals)
                totals.clear()
            counts = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for buckets in gram_buckets(text):
                counts += np.bincount(buckets, minlength=BUCKETS)
    yield from _count_rows(totals)


def _count_rows(totals: dict[str, np.ndarray]):
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])],
            ["lang", "bucket", "n"],
        )


class Model:
    """Languages of a block and their log-probabilities by bucket."""

    def __init__(self, langs: list[str], prior: np.ndarray, log_prob: np.ndarray):
        self.langs, self.prior, self.log_prob = langs, prior, log_prob

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, its score, sum of the block's likelihoods over the best one) of each text of a batch.

        The grams of the batch are the entries of a sparse matrix of texts by buckets; its product with
        the log-probabilities is summed up by text, in pieces of ``_ENTRIES`` entries.
        """
        if not self.langs:
            return [("und", 0.0, np.inf)] * len(texts)
        total = np.tile(self.prior, (len(texts), 1))
        lettered = np.zeros(len(texts), bool)
        held, rows, n = [], [], 0
        for i, text in enumerate(texts):
            if not text or not LETTER.search(text):
                continue
            lettered[i] = True
            for buckets in gram_buckets(text):
                if len(buckets) > BUCKETS:
                    counts = np.bincount(buckets, minlength=BUCKETS)
                    at = np.flatnonzero(counts)
                    total[i] += counts[at] @ self.log_prob[at].astype(np.float64)
                    continue
                held.append(buckets)
                rows.append(i)
                n += len(buckets)
                if n * len(self.langs) > _ENTRIES:
                    self._add(total, held, rows)
                    held, rows, n = [], [], 0
        self._add(total, held, rows)
        best = total.argmax(1)
        top = total[np.arange(len(texts)), best]
        sums = np.exp(total - top[:, None]).sum(1)
        return [
            (self.langs[b], float(t), float(s)) if ok else ("und", 0.0, np.inf)
            for ok, b, t, s in zip(lettered, best.tolist(), top, sums)
        ]

    def _add(self, total: np.ndarray, held: list[np.ndarray], rows: list[int]) -> None:
        if held:
            starts = np.cumsum([0, *map(len, held[:-1])])
            sums = np.add.reduceat(self.log_prob[np.concatenate(held)], starts, axis=0, dtype=np.float64)
            np.add.at(total, rows, sums)


def fit(docs: DataFrame, text_col: str, lang_col: str, block_langs: int = BLOCK_LANGS) -> Iterator[Model]:
    """Learn from every row of ``docs`` with a language; one model for each block of languages, at least one."""
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    seen = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}
    every = sorted(seen)
    if not every:
        yield Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
        return
    counted = (
        rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    if len(every) > block_langs:
        counted = stored(counted, "language-counts")
    for first in range(0, len(every), block_langs):
        names = every[first : first + block_langs]
        # At most BUCKETS x block_langs rows reach the driver at a time, whatever the corpus holds.
        block = (counted if len(names) == len(every) else counted.filter(F.col("lang").isin(names))).toArrow()
        matrix = np.zeros((BUCKETS, len(names)))
        place = {name: i for i, name in enumerate(names)}
        column = np.array([place[x] for x in block.column("lang").to_pylist()], np.int64)
        matrix[block.column("bucket").to_numpy(), column] = block.column("n").to_numpy()
        log_prob = np.log((matrix + ALPHA) / (matrix.sum(0) + ALPHA * BUCKETS))
        prior = np.log(np.array([seen[n] for n in names], float) / sum(seen.values()))
        yield Model(names, prior, log_prob.astype(np.float32))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 3,
    held: int = 1,
    block_langs: int = BLOCK_LANGS,
) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row; rows of fold ``held`` are never learned from."""
    marked = docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        F.col(lang_col).alias("_lang"),
        F.coalesce(crc_mod(id_col, folds) == held, F.lit(True)).alias("held_out"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    state = marked.select("_id", "_text", "held_out", *[F.lit(None).cast(t).alias(c) for c, t in _STATE.items()])
    made = f"_id {kind}, _text string, held_out boolean, " + ", ".join(f"{c} {t}" for c, t in _STATE.items())
    for k, model in enumerate(fit(marked.filter(~F.col("held_out")), "_text", "_lang", block_langs)):
        if k:
            # Written, so that each block's broadcast is used in one pass only.
            state = stored(state, "language-scores")
        state = state.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast((model.langs, model.prior, model.log_prob))), made)
    score = (1.0 / F.col("_sum")).alias("score")
    return state.select(F.col("_id").alias(id_col), "held_out", F.col("_lang").alias("lang_pred"), score)


_STATE = {"_lang": "string", "_best": "double", "_sum": "double"}


def _score(shared):
    """Merge what the languages of one block say into the best language so far and the sum over its likelihood."""

    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            made = []
            texts = batch.column("_text").to_pylist()
            for new, *old in zip(model.predict(texts), *[batch.column(c).to_pylist() for c in _STATE]):
                # Texts without a letter have an infinite sum, so their score is 0.
                if old[0] is not None and not np.isinf(new[2]):
                    # The earlier block has the smaller names, so it keeps ties.
                    high, low = (new, old) if new[1] > old[1] else (old, new)
                    new = (high[0], high[1], high[2] + low[2] * float(np.exp(low[1] - high[1])))
                made.append(new)
            columns = list(zip(*made)) if made else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("_id", "_text", "held_out")],
                    pa.array(columns[0], pa.string()),
                    *[pa.array(c, pa.float64()) for c in columns[1:]],
                ],
                ["_id", "_text", "held_out", *_STATE],
            )

    return run
