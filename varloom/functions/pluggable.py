"""Places where a user brings Python: row values, partitions, batch models, score sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from varloom.functions.scores import effect_score

Predictor = Callable[[np.ndarray], np.ndarray]


def column_function(fn: Callable[..., pd.Series], returns: str) -> Callable[..., Column]:
    """A vectorised function of columns; ``fn`` gets and gives pandas Series."""
    return F.pandas_udf(fn, returns)


def partition_function(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """Apply ``fn`` to the pandas batches of every partition."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(over, schema)


def predict_batches(
    df: DataFrame,
    load_model: Callable[[], Predictor],
    width: int,
    inputs: str = "inputs",
    out: str = "predictions",
) -> DataFrame:
    """Score feature rows with a model loaded once per task.

    The model maps a (rows, width) block to a (rows, outputs) block.
    """
    schema = T.StructType(
        [f for f in df.schema.fields if f.name != inputs]
        + [T.StructField(out, T.ArrayType(T.DoubleType()))]
    )

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model()
        for batch in batches:
            block = np.asarray(model(_matrix(batch.column(inputs), width)), dtype=np.float64)
            block = block.reshape(batch.num_rows, -1)
            starts = np.arange(batch.num_rows + 1, dtype=np.int32) * block.shape[1]
            values = pa.ListArray.from_arrays(pa.array(starts), pa.array(block.ravel()))
            kept = [n for n in batch.schema.names if n != inputs]
            columns = [batch.column(n) for n in kept] + [values]
            yield pa.RecordBatch.from_arrays(columns, [*kept, out])

    return df.mapInArrow(over, schema)


def _matrix(features: pa.Array, width: int) -> np.ndarray:
    """Batch of equally long arrays as a 2-D block; any other width raises."""
    lengths = features.value_lengths().to_numpy(zero_copy_only=False)
    if not (lengths == width).all():
        raise ValueError(f"every feature row must hold {width} values")
    flat = features.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(features), width)


def score_set(
    choices: dict[str, tuple[str, str]],
    ref: Column,
    alt: Column,
    ref_rc: Column | None = None,
    alt_rc: Column | None = None,
) -> dict[str, Column]:
    """Named columns from ``{name: (score, strand merge)}``."""
    return {
        name: effect_score(score, ref, alt, ref_rc, alt_rc, merge)
        for name, (score, merge) in choices.items()
    }
