"""Corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. All
stages but the last return the columns of ``documents``; further columns are left out.

Defined cases: a null or empty text has too few words and goes in the first stage; stages called on
such rows by themselves keep them. Null languages and sources are values like others. Ids need not
be unique or set: near-duplicates are found between rows, each of which has a key of its own, so of
equal rows one stays, and rows that share an id, or have none, are told apart. The row with the
smallest id (null first) stays of each group. Mixing repeats a row under its id. An empty table
passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from varloom.llm import chunk_dedup, minhash, mixing, piece_table, quality_rules
from varloom.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the standard policy rejects."""
    entries = quality_rules.apply_policy(quality_rules.ledger(docs.select(*COLUMNS)))
    return entries.filter("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates on five-word shingles at 0.8."""
    # Written with their numbers, so that each row is the same one in every later read.
    rows = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "pipeline-rows")
    keyed = rows.select(F.struct("doc_id", "row").alias("key"), "text")
    kept = minhash.near_duplicates(keyed, id_col="key", words=5, percent=80).filter("kept").select("key.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated passages are cut out of the texts."""
    return (
        chunk_dedup.remove_repeats(docs)
        .withColumn("n_chars", F.length("text").cast("long"))
        .select(*COLUMNS)
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards smoothed source weights, in random order."""
    return mixing.replicate(docs).select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their count for every row, with a digest of the decoded text."""
    return piece_table.encode(docs.select(*COLUMNS), ("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("source_mixing", mix_sources),
    ("piece_ids", encode_texts),
]

#: Chunk cuts and token merges have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
