"""Declared schemas of the text inputs. Chromosome names are always text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

VCF5 = T.StructType(
    [
        T.StructField("chrom", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("alt", T.StringType()),
    ]
)

VCF8 = T.StructType(
    VCF5.fields
    + [
        T.StructField("qual", T.StringType()),
        T.StructField("filter", T.StringType()),
        T.StructField("info", T.StringType()),
    ]
)

VARIANT4 = T.StructType(
    [
        T.StructField("chrom", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("ref", T.StringType()),
        T.StructField("alt", T.StringType()),
    ]
)

SCORED = T.StructType(
    VARIANT4.fields
    + [
        T.StructField("raw_score", T.DoubleType()),
        T.StructField("scaled_score", T.DoubleType()),
    ]
)

INTERVAL = T.StructType(
    [
        T.StructField("chr", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]
)

GTF = T.StructType(
    [
        T.StructField("chrom", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("score", T.StringType()),
        T.StructField("strand", T.StringType()),
        T.StructField("frame", T.StringType()),
        T.StructField("attributes", T.StringType()),
    ]
)

# Metadata columns that open a prediction file; fixed values of that format.
PREDICTION_META = (
    "line_idx",
    "variant_alt",
    "variant_chr",
    "variant_id",
    "variant_pos",
    "variant_ref",
)


def doubles(names: Sequence[str]) -> T.StructType:
    """All-DOUBLE schema, as feature files widen every column to float."""
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])
