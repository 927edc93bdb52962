"""Statistics of every position of wide array rows, without exploding a cell.

Each task reduces its rows with numpy to a few numbers per position and the tasks' partial results are
summed in Spark. Order statistics narrow one bracket of values for each wanted rank: a pass counts the
values of all brackets in equal bins of their bit patterns, which are ordered as the values are, together
with the least and the greatest value of each bin, and the bin that holds the rank is the next bracket.
A bracket shrinks to one part in ``BINS`` of its bit patterns at least, gaps and extremes included, so
eleven passes are enough for any column; continuous columns of a billion values take about five.

What the driver holds grows with the number of positions and not with the rows. Null and NaN cells
count as missing; rows may have different lengths and null rows count for no position.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BINS = 64
_SIGN = np.uint64(1 << 63)
_MOST = np.uint64((1 << 64) - 1)


def sortable(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the values; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN != 0, ~bits, bits | _SIGN)


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Values and positions of all cells that hold a number."""
    column = batch.column(0)
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    values = column.flatten().cast(pa.float64())
    held = np.asarray(values.is_valid())
    values = np.asarray(values.fill_null(np.nan), np.float64)
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    held &= ~np.isnan(values)
    return values[held], at[held]


def _grown(a: np.ndarray, n: int, fill=0) -> np.ndarray:
    if n <= len(a):
        return a
    return np.concatenate([a, np.full(n - len(a), fill, a.dtype)])


class _Counts:
    """Bin counts of the brackets of a task: rows of low, high and position, sorted by position and low."""

    def __init__(self, brackets):
        self.low = self.high = self.first = None
        if brackets is not None:
            low, high, at = brackets
            self.low, self.high = low, high
            self.first = np.searchsorted(at, np.arange(at[-1] + 2)) if len(at) else np.zeros(1, np.int64)
        self.n, self.least, self.most = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def add(self, values: np.ndarray, at: np.ndarray) -> None:
        keys = sortable(values)
        if self.low is None:
            width = _MOST // np.uint64(BINS) + np.uint64(1)
            self._count(at, (keys // width).astype(np.int64), values)
            return
        known = at < len(self.first) - 1
        values, at, keys = values[known], at[known], keys[known]
        begin, stop = self.first[at], self.first[at + 1]
        for step in range(int((stop - begin).max()) if len(at) else 0):
            row = begin + step
            inside = np.flatnonzero(row < stop)
            row, key = row[inside], keys[inside]
            hit = (key >= self.low[row]) & (key <= self.high[row])
            inside, row, key = inside[hit], row[hit], key[hit]
            width = (self.high[row] - self.low[row]) // np.uint64(BINS) + np.uint64(1)
            self._count(row, ((key - self.low[row]) // width).astype(np.int64), values[inside])

    def _count(self, row: np.ndarray, bins: np.ndarray, values: np.ndarray) -> None:
        if not len(row):
            return
        flat = row * BINS + bins
        size = int(flat.max()) + 1
        self.n = _grown(self.n, size)
        self.least, self.most = _grown(self.least, size, np.inf), _grown(self.most, size, -np.inf)
        self.n[:size] += np.bincount(flat, minlength=size)
        np.minimum.at(self.least, flat, values)
        np.maximum.at(self.most, flat, values)

    def rows(self) -> pa.RecordBatch:
        held = np.flatnonzero(self.n)
        return pa.RecordBatch.from_arrays(
            [
                pa.array((held // BINS).astype(np.int32)),
                pa.array((held % BINS).astype(np.int32)),
                pa.array(self.n[held]),
                pa.array(self.least[held]),
                pa.array(self.most[held]),
            ],
            ["bracket", "bin", "n", "least", "most"],
        )


def _counter(brackets):
    def run(batches):
        counts = _Counts(brackets)
        for batch in batches:
            counts.add(*_cells(batch))
        yield counts.rows()

    return run


def _count(values: DataFrame, brackets=None) -> dict[str, np.ndarray]:
    """Bins of all brackets that hold values, in order of bracket and bin."""
    partial = values.mapInArrow(_counter(brackets), "bracket int, bin int, n long, least double, most double")
    table = (
        partial.groupBy("bracket", "bin")
        .agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        .toArrow()
        .sort_by([("bracket", "ascending"), ("bin", "ascending")])
    )
    return {c: np.asarray(table.column(c)) for c in table.column_names}


def _summer(means):
    """Sums of a position, or of squared distances from given means."""

    def run(batches):
        sums, n = np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            values, at = _cells(batch)
            if not len(at):
                continue
            size = int(at.max()) + 1
            sums, n = _grown(sums, size), _grown(n, size)
            weights = values if means is None else (values - means[at]) ** 2
            sums[:size] += np.bincount(at, weights, size)
            n[:size] += np.bincount(at, minlength=size)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(sums[held]), pa.array(n[held])], ["idx", "total", "n"]
        )

    return run


def _sums(values: DataFrame, means: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    partial = values.mapInArrow(_summer(means), "idx int, total double, n long")
    table = partial.groupBy("idx").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    table = table.sort_by("idx")
    return tuple(np.asarray(table.column(c)) for c in ("idx", "total", "n"))


class OrderStatistics:
    """Values at given ranks of each position; ``counts`` are the values there are."""

    def __init__(self, df: DataFrame, inputs: str, ranks: Callable[[int], Sequence[int]]):
        values = df.select(inputs)
        first = _count(values)
        self.positions, starts = np.unique(first["bracket"], return_index=True)
        ends = np.append(starts[1:], len(first["bin"])) if len(starts) else starts
        self.counts = np.array([first["n"][a:b].sum() for a, b in zip(starts, ends)], np.int64)
        self.least, self.most = first["least"][starts], first["most"][ends - 1] if len(ends) else first["most"]
        wanted = [list(ranks(int(n))) for n in self.counts]
        self.found = [[None] * len(w) for w in wanted]
        # A case is (position number, case number, rank inside the bracket, bins of the bracket).
        cases = [(p, k, r, starts[p], ends[p]) for p, w in enumerate(wanted) for k, r in enumerate(w)]
        bins = first
        while cases:
            still = [c for c in (self._narrow(bins, *case) for case in cases) if c is not None]
            if not still:
                return
            brackets = sorted({(int(self.positions[p]), low, high) for p, _, _, low, high in still})
            at = np.array([b[0] for b in brackets])
            low, high = (sortable(np.array([b[i] for b in brackets])) for i in (1, 2))
            bins = _count(values, (low, high, at))
            row = {b: i for i, b in enumerate(brackets)}
            edges = np.searchsorted(bins["bracket"], np.arange(len(brackets) + 1))
            cases = []
            for p, k, r, a, b in still:
                i = row[int(self.positions[p]), a, b]
                cases.append((p, k, r, edges[i], edges[i + 1]))

    def _narrow(self, bins: dict, p: int, k: int, rank: int, start: int, stop: int):
        """The bin of a rank as the next bracket, or None where its value is known."""
        upto = np.cumsum(bins["n"][start:stop])
        j = int(np.searchsorted(upto, rank, "right"))
        n, least, most = (bins[c][start + j].item() for c in ("n", "least", "most"))
        rank -= int(upto[j]) - n
        if least == most or rank == 0:
            self.found[p][k] = least
        elif rank == n - 1:
            self.found[p][k] = most
        else:
            return p, k, rank, least, most
        return None


def array_order_statistics(df: DataFrame, inputs: str, probs: Sequence[float]) -> DataFrame:
    """(idx, quartiles) per position: the smallest value with the share ``prob`` of values up to it, exact."""
    found = OrderStatistics(df, inputs, lambda n: [max(math.ceil(p * n) - 1, 0) for p in probs])
    rows = [(int(i), x) for i, x in zip(found.positions, found.found)]
    return df.sparkSession.createDataFrame(rows, "idx int, quartiles array<double>")


def array_summary(df: DataFrame, inputs: str, probs: Sequence[float]) -> DataFrame:
    """(idx, count, mean, std, min, quartiles, max) per position, quartiles with linear interpolation."""

    def ranks(n: int) -> list[int]:
        return [side for p in probs for side in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]

    found = OrderStatistics(df, inputs, ranks)
    values = df.select(inputs)
    idx, totals, n = _sums(values)
    means = np.zeros(int(idx[-1]) + 1 if len(idx) else 0)
    means[idx] = totals / n
    _, squares, _ = _sums(values, means)
    rows = []
    for i, count, least, most, sides, square in zip(found.positions, found.counts, found.least, found.most, found.found, squares):
        quartiles = []
        for p, low, high in zip(probs, sides[::2], sides[1::2]):
            share = p * (int(count) - 1) % 1
            quartiles.append(low if low == high else low + (high - low) * share)
        std = math.sqrt(square / (count - 1)) if count > 1 else None
        rows.append((int(i), int(count), float(means[i]), std, float(least), quartiles, float(most)))
    return df.sparkSession.createDataFrame(
        rows, "idx int, count long, mean double, std double, min double, quartiles array<double>, max double"
    )
