"""Column expressions on feature rows.

Feature rows stay in one array (or ML vector) column whatever their width; these
helpers never spread a row over hundreds of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

# Largest value kept after down-scaling, and the limits of the stored types; fixed values.
VALUE_CAP = 65500.0
TYPE_LIMITS = {
    "float16": (-65504.0, 65504.0),
    "float32": (-3.4028234663852886e38, 3.4028234663852886e38),
    "float64": (-1.7976931348623157e308, 1.7976931348623157e308),
    "int16": (-32768, 32767),
    "int32": (-2147483648, 2147483647),
    "int64": (-9223372036854775808, 9223372036854775807),
}


def relabel(target: Column) -> Column:
    """Class -1 becomes 0; other values stay."""
    return F.when(target == -1, F.lit(0)).otherwise(target)


def binarise(target: Column) -> Column:
    """Class -1 becomes 0 and every other value 1."""
    return F.when(target == -1, F.lit(0)).otherwise(F.lit(1))


def drop_element(values: Column, index: int) -> Column:
    """Array without the element at a 0-based index."""
    rest = F.greatest(F.size(values) - (index + 1), F.lit(0))
    return F.concat(
        F.slice(values, F.lit(1), F.lit(index)), F.slice(values, F.lit(index + 2), rest)
    )


def split_target(values: Column, target_col: int = 0) -> Column:
    """Struct (inputs, target) with the target taken from any column of the row."""
    return F.struct(
        drop_element(values, target_col).alias("inputs"),
        F.element_at(values, target_col + 1).alias("target"),
    )


def parse_line(line: Column, separator: str = ",") -> Column:
    """Delimited text to array<double>; text that is not a number raises."""
    return F.split(line, f"\\Q{separator}\\E").cast("array<double>")


def to_float(values: Column) -> Column:
    return values.cast("array<float>")


def has_infinite(values: Column) -> Column:
    return F.exists(values, lambda x: F.abs(x) == F.lit(float("inf")))


def has_bad_value(values: Column) -> Column:
    return F.exists(values, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def cap_values(values: Column, cap: float = VALUE_CAP) -> Column:
    return F.transform(values, lambda x: F.least(x, F.lit(cap)))


def cap_if_infinite(values: Column, cap: float = VALUE_CAP) -> Column:
    """Cap the whole row when any element is infinite; minus infinity stays."""
    return F.when(has_infinite(values), cap_values(values, cap)).otherwise(values)


def stack(*arrays: Column) -> Column:
    """Arrays side by side in the given order."""
    return F.concat(*arrays)


def difference(alt: Column, ref: Column) -> Column:
    return F.zip_with(alt, ref, lambda a, r: a - r)


def argmax(values: Column) -> Column:
    """0-based index of the first largest element."""
    return F.array_position(values, F.array_max(values)) - 1


def count_nonzero(values: Column) -> Column:
    return F.size(F.filter(values, lambda x: x != 0)).cast("bigint")


def dense_array(vector: Column) -> Column:
    return vector_to_array(vector)


def with_sparse(
    df: DataFrame, array_col: str, out: str, width: int | None = None
) -> DataFrame:
    """Add the row as a compressed ML vector: zeros are not stored when that is smaller.

    Rows must be equally wide; without ``width`` the first row is read for it.
    """
    if width is None:
        first = df.select(F.size(array_col).alias("n")).first()
        width = first["n"] if first else 0
    dense = "__dense"
    packed = df.withColumn(dense, array_to_vector(F.col(array_col).cast("array<double>")))
    hint = VectorSizeHint(inputCol=dense, size=width, handleInvalid="error")
    assembler = VectorAssembler(inputCols=[dense], outputCol=out, handleInvalid="keep")
    return assembler.transform(hint.transform(packed)).drop(dense)


def nonzero_cells(df: DataFrame, key: str | Sequence[str], array_col: str) -> DataFrame:
    """Long form (key, idx, value) of the non-zero elements."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.select(*keys, F.posexplode(array_col).alias("idx", "value")).filter(
        F.col("value") != 0
    )


def prefix_columns(
    df: DataFrame, source: str, output: str, columns: Sequence[str]
) -> DataFrame:
    """Rename prediction columns to ``source:output_column``."""
    return df.withColumnsRenamed({c: f"{source}:{output}_{c}" for c in columns})


def nested_predictions(outputs: dict[str, dict[str, Column]]) -> Column:
    """MAP<score, MAP<output, value>> for one row."""

    def entries(items):
        return F.map_from_entries(
            F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in items])
        )

    return entries([(score, entries(values.items())) for score, values in outputs.items()])
