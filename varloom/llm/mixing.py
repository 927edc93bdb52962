"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the wanted total, divided by its size.
A hash of the id, mapped to a number in (0, 1), is run through the inverse Poisson distribution of
that rate; the document appears so many times. The copies are then dealt out in the order of a
second hash, a global shuffle by range. Everything is a function of the seed, the id and the
source sizes, so a lost task makes the same rows again.

Without weights the shares follow ``size ** power`` (smoothed proportional mixing).

Defined cases: a null source is a source of its own, and so is the empty one; null text counts as
size 0; a null id hashes like the empty text, and rows that repeat an id get the same count. A source
with target weight but no size is left out of the total. Weights name every source that may appear;
a source without a weight has rate 0. An empty table gives an empty result. Further columns are carried along; columns named like the
outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OUTPUTS = ("rate", "n_copies", "copy_no", "shuffle_key")
#: Rates above this are split into equal parts, each with its own hash, so exp(-rate) keeps digits.
PART = 16.0
SALTS = 8


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in (0, 1) from 52 bits of an md5 of the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])
    whole = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (whole + 0.5) / float(1 << 52)


def poisson_inverse(u: Column, rate: Column) -> Column:
    """Smallest n whose cumulative Poisson probability reaches ``u``; rates up to ``PART``.

    The sum runs to 80 terms: beyond them less than 2**-53 of the probability is left at rate 16.
    """
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("below"), F.lit(0).alias("n"))

    def step(acc, k):
        p = acc["p"] * rate / k
        going = acc["below"] < u
        return F.struct(
            p.alias("p"),
            F.when(going, acc["below"] + p).otherwise(acc["below"]).alias("below"),
            F.when(going, k).otherwise(acc["n"]).alias("n"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, step, lambda acc: acc["n"])


def rates(
    docs: DataFrame,
    source_col: str,
    size: Column,
    weights: dict[str, float] | None,
    total: float | None,
    power: float,
) -> DataFrame:
    """(source key, rate) with one row for each source."""
    by_source = docs.groupBy(F.col(source_col).alias("_source")).agg(F.sum(size).cast("double").alias("_size"))
    by_source = by_source.filter("_size > 0")
    if weights is None:
        share = F.pow(F.col("_size"), F.lit(power))
    else:
        pairs = [x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))]
        named = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
        share = F.coalesce(F.element_at(named, F.coalesce("_source", F.lit(""))), F.lit(0.0))
    by_source = by_source.withColumn("_share", share)
    # Two numbers come to the driver, whatever the number of sources.
    shares, whole = by_source.agg(F.sum("_share"), F.sum("_size")).first()
    wanted = whole if total is None else float(total)
    if not shares:
        return by_source.select("_source", F.lit(0.0).alias("rate"))
    # Rounded, since the order of a sum may change its last digits.
    rate = F.round(F.col("_share") / F.lit(shares) * F.lit(wanted) / F.col("_size"), 9)
    return by_source.select("_source", rate.alias("rate"))


def replicate(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total: float | None = None,
    seed: int = 17,
    power: float = 0.7,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Documents repeated by their rate and dealt out in a global random order."""
    docs = docs.drop(*OUTPUTS)
    size = F.coalesce(F.length("text"), F.lit(0)) if size is None else size
    by_source = rates(docs, source_col, size, weights, total, power)
    # A source may hold a third of all rows: its rate stands under eight keys, over which rows are dealt.
    spread = by_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_from"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("_deal"),
    )
    match = F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_deal") == F.col("_salt"))
    joined = dealt.join(spread, match, "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    n_parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    part_rate = F.col("rate") / n_parts
    # The hashes are array elements, so each is made once and not at every step of the sum.
    draws = F.transform(F.sequence(F.lit(0), n_parts - 1), lambda k: uniform(seed, "_id", k))
    count = F.aggregate(draws, F.lit(0), lambda n, u: n + poisson_inverse(u, part_rate))
    copies = (
        joined.withColumn("n_copies", count)
        .filter("n_copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
        .withColumn("shuffle_key", uniform(seed + 1, "_id", "copy_no"))
    )
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shuffled = copies.select("_row", *OUTPUTS).repartitionByRange(n, "shuffle_key")
    return shuffled.sortWithinPartitions("shuffle_key").select("_row.*", *OUTPUTS)
