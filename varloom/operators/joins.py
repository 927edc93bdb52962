"""Joins by id, by position and by threshold.

No side is forced into a broadcast unless its size has been checked; the others
are left to the optimizer and to adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from varloom.session import dealt

VARIANT_KEY = ["chrom", "pos", "ref", "alt"]
# The same key for groups and joins: their sorts then compare a number first, and texts only where it is equal.
GROUP_KEY = ["pos", "chrom", "ref", "alt"]

# Conversion tables up to this many rows go to every task (16 bytes a row).
MAX_BROADCAST_THRESHOLDS = 1_000_000
_THRESHOLD_BUCKETS = 1024
# Id lists up to this many entries go to every task (some tens of bytes an entry).
MAX_BROADCAST_IDS = 250_000
# Bits of the filter of wanted keys: 131,072 words of 64 bits, a broadcast of 3 MB at most.
_FILTER_BITS = 23
# Each level of span cells is so many times as wide as the one below.
_LEVEL_STEP = 8
_LEVELS = 8


def hstack(
    sources: Sequence[DataFrame],
    inputs: str = "inputs",
    row_id: str = "row_id",
    strict: bool = True,
) -> DataFrame:
    """Put the feature arrays of several sources side by side, row by row.

    At most one source may carry ``target``. With ``strict`` all sources must hold the
    same row numbers, else the query fails, a mere count included: a filter refuses rows of the
    first source without partner, and one more row, itself always filtered, compares the row
    counts even where nothing is joined. Every join is on the same key, so each source is
    exchanged once whatever their number.
    """
    owners = [i for i, s in enumerate(sources) if "target" in s.columns]
    if len(owners) > 1:
        raise ValueError("only one source may provide the target")

    def narrowed(i: int, source: DataFrame) -> DataFrame:
        kept = [F.col(row_id), F.col(inputs).alias(f"__in{i}"), F.lit(True).alias(f"__has{i}")]
        return source.select(*kept, *(["target"] if i in owners else []))

    how = "left" if strict else "inner"
    parts = [narrowed(i, s) for i, s in enumerate(sources)]
    joined = reduce(lambda a, b: a.join(b, row_id, how), parts)
    blocks = [F.col(f"__in{i}") for i in range(len(sources))]
    out = {row_id: F.col(row_id), inputs: F.concat(*blocks)}
    if owners:
        out["target"] = F.col("target")
    if not strict or len(sources) < 2:
        return joined.select(*[c.alias(name) for name, c in out.items()])
    refused = F.raise_error(F.lit("sources differ in their rows"))
    missing = reduce(lambda a, b: a | b, [F.col(f"__has{i}").isNull() for i in range(1, len(sources))])
    matched = joined.filter(F.when(missing, refused).otherwise(True))
    matched = matched.select(*[c.alias(name) for name, c in out.items()])
    sizes = [s.agg(F.count("*")).scalar() for s in sources]
    unequal = reduce(lambda a, b: a | b, [n != sizes[0] for n in sizes[1:]])
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in matched.schema]
    one = joined.sparkSession.range(1).filter(F.when(unequal, refused).otherwise(F.col("id") < 0))
    return matched.unionAll(one.select(*nothing))


def join_predictions(sources: Sequence[DataFrame], key: str = "variant_id") -> DataFrame:
    """Inner join of prediction tables; a feature name may occur in one source only."""
    seen: set[str] = set()
    for source in sources:
        names = set(source.columns) - {key}
        repeated = sorted(names & seen)
        if repeated:
            raise ValueError(f"repeated feature names: {repeated}")
        seen |= names
    return reduce(lambda a, b: a.join(b, key, "inner"), sources)


def outer_join_frames(frames: Sequence[DataFrame], key: str = "row_id") -> DataFrame:
    """Full join of score frames; a row missing in one frame gives null there."""
    return reduce(lambda a, b: a.join(b, key, "full"), frames)


def lookup(ids: DataFrame, store: DataFrame, key: str = "variant_id") -> DataFrame:
    """Records of a keyed table for an id list, one per list entry; a missing id fails.

    ``store`` holds each id once. The list's ``row_id`` keeps its order. The check is a filter, so a
    count alone fails as well. A list of at most ``MAX_BROADCAST_IDS`` entries goes to the records, which
    then stay where they are, once a count over the keys has found them all; a longer one meets them by key.
    """
    found = store.drop("row_id")
    absent = F.raise_error(F.concat(F.lit("no record for id "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    n_ids = ids.limit(MAX_BROADCAST_IDS + 1).count()
    checked = found.withColumn("__found", F.lit(True))
    if n_ids <= MAX_BROADCAST_IDS:
        # As many records as entries: no id is missing, and the records need not move.
        if found.select(key).join(F.broadcast(ids.select(key)), key).count() == n_ids:
            rest = [[c for c in df.columns if c != key] for df in (ids, found)]
            return found.join(F.broadcast(ids), key).select(key, *rest[0], *rest[1])
    joined = ids.join(checked, key, "left")
    return joined.filter(F.when(F.col("__found"), True).otherwise(absent)).drop("__found")


def inner_on_variant(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, VARIANT_KEY, "inner")


def attach_ids(rows: DataFrame, ids: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Give feature rows the ids that stand at the same position."""
    return rows.join(ids.select(row_id, "variant_id"), row_id)


def first_shard(extraction: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One shard per row number: the first in list order that names it."""
    return extraction.groupBy(row_id).agg(F.min("shard_id").alias("shard_id"))


def route_to_shards(rows: DataFrame, extraction: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows that a shard claims, with their shard; unclaimed rows are left out."""
    return rows.join(first_shard(extraction, row_id), row_id)


def subset(rows: DataFrame, wanted: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is wanted. Wanted keys are made distinct on the way, in the same exchange."""
    return _by_key(rows, wanted, key, "left_semi")


def without(rows: DataFrame, done: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not in the other table."""
    return _by_key(rows, done, key, "left_anti")


def _by_key(rows: DataFrame, other: DataFrame, key: str | Sequence[str], how: str) -> DataFrame:
    """A short list of keys goes to the rows; a longer one meets them by key.

    Row numbers do not repeat, so they are dealt over tasks of bounded size; a key that may fill a
    task is left to adaptive skew handling.
    """
    if other.count() <= MAX_BROADCAST_IDS:
        return rows.join(F.broadcast(_keys(other, key)), key, how)
    if key == "row_id":
        rows, other = dealt([rows, other.select(key)], key, [rows, other])
    return rows.join(_keys(other, key), key, how)


def _keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return df.select(key if isinstance(key, str) else list(key)).distinct()


def match_row_numbers(rows: DataFrame, wanted: DataFrame, key: str = "variant_id") -> DataFrame:
    """Row numbers whose id is wanted; a repeated id gives each of its rows once."""
    return subset(rows, wanted, key).select("row_id", key)


def merge_with_ids(predictions: DataFrame, ids: DataFrame, key: str = "variant_id") -> DataFrame:
    """All predictions and all wanted ids; an id without prediction stays, with nulls.

    A full join cannot be split when one id fills the list, so the ids take a left
    join, which can, and the predictions nobody asked for are added to it.
    """
    asked = ids.select(key).join(predictions, key, "left").select(*predictions.columns)
    return asked.unionByName(without(predictions, ids, key))


def scored_regions(scores: DataFrame, regions: DataFrame) -> DataFrame:
    """Score rows at the positions of a region list, each once."""
    return subset(scores, regions, ["chrom", "pos"])


def first_table_holding(
    variants: DataFrame,
    tables: Sequence[tuple[str, DataFrame]],
    values: Sequence[str],
    key: Sequence[str] = GROUP_KEY,
    at_most: int | None = None,
) -> DataFrame:
    """Attach (found_in, values) from the first table, in list order, that holds the variant.

    Prescored tables are far larger than a variant list, so their rows are first cut at the scan by a
    filter of the wanted keys, before anything is exchanged; what passes is reduced to the first
    row per variant, with partial sums before the exchange, and joined once. ``found_in`` is null for
    a novel variant. ``at_most`` bounds the keys of ``variants`` where a count of them is at hand: a list with
    more keys than the filter has bits would fill it, so none is made.
    """
    parts = [t.select(*key, *values) for _, t in tables]
    if at_most is None or at_most <= 1 << _FILTER_BITS:
        words = wanted_filter(variants, key)
        parts = [maybe_wanted(t, words, key) for t in parts]
    stacked = reduce(DataFrame.unionByName, [t.withColumn("__rank", F.lit(i)) for i, t in enumerate(parts)])
    best = F.min(F.struct("__rank", *values))
    names = F.array(*[F.lit(name) for name, _ in tables])
    first = stacked.groupBy(*key).agg(best.alias("__best"))
    return variants.join(first, list(key), "left").select(
        *variants.columns,
        F.get(names, F.col("__best.__rank")).alias("found_in"),
        *[F.col(f"__best.{v}").alias(v) for v in values],
    )


def _filter_place(key: Sequence[str]) -> tuple[Column, Column]:
    """Word and mask of a key's bit."""
    place = F.xxhash64(*key).bitwiseAND(F.lit((1 << _FILTER_BITS) - 1))
    names = ", ".join(f"`{k}`" for k in key)
    mask = F.expr(f"shiftleft(1L, cast(xxhash64({names}) & 63 as int))")
    return F.shiftright(place, 6).cast("int"), mask


def wanted_filter(wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    """(word, bits): one bit for each key that is wanted. It has a fixed size, whatever the list holds."""
    word, mask = _filter_place(key)
    return wanted.groupBy(word.alias("__word")).agg(F.bit_or(mask).alias("__bits"))


def maybe_wanted(rows: DataFrame, words: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key may be wanted; only few others pass while the filter is not full."""
    word, mask = _filter_place(key)
    hit = F.col("__bits").bitwiseAND(mask) != 0
    return rows.withColumn("__word", word).join(F.broadcast(words), "__word").filter(hit).select(*rows.columns)


def threshold_lookup(
    scores: DataFrame,
    table: DataFrame,
    score: str = "raw_score",
    threshold: str = "threshold",
    value: str = "scaled",
    out: str = "scaled_score",
) -> DataFrame:
    """Value at the highest threshold not above the score; null below the lowest.

    Thresholds that are null or NaN, or have no value, are left out before anything else. A table
    small by count goes to each task as two sorted arrays. A larger one is cut into buckets and
    both sides meet per bucket.
    """
    at = F.col(threshold).cast("double")
    usable = table.filter(at.isNotNull() & ~F.isnan(at) & F.col(value).isNotNull())
    slim = usable.groupBy(F.col(threshold).alias("__t")).agg(F.max(value).alias("__v"))
    head = slim.limit(MAX_BROADCAST_THRESHOLDS + 1).toArrow()
    if head.num_rows <= MAX_BROADCAST_THRESHOLDS:
        head = head.sort_by("__t")
        steps = head["__t"].to_numpy().astype(np.float64)
        values = head["__v"].to_numpy().astype(np.float64)
        return scores.withColumn(out, _step_function(steps, values)(F.col(score).cast("double")))
    return bucketed_threshold_lookup(scores, slim, score, out)


def _step_function(steps: np.ndarray, values: np.ndarray):
    @F.arrow_udf("double")
    def at(raw: pa.Array) -> pa.Array:
        numbers = raw.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        index = np.searchsorted(steps, numbers, side="right") - 1
        missing = (index < 0) | np.isnan(numbers)
        if not len(values):
            return pa.nulls(len(numbers), pa.float64())
        return pa.array(values[np.maximum(index, 0)], mask=missing)

    return at


def bucketed_threshold_lookup(
    scores: DataFrame, slim: DataFrame, score: str, out: str, buckets: int = _THRESHOLD_BUCKETS
) -> DataFrame:
    """Threshold lookup for a conversion table too large for every task.

    Bucket edges are thresholds themselves, so each bucket starts with a usable one and
    nothing is carried between buckets. A bucket that draws many scores is salted, with
    its thresholds repeated per salt; the salts together are at most twice the buckets.
    """
    probs = [i / buckets for i in range(1, buckets)]
    edges = np.unique(
        [slim.agg(F.min("__t")).first()[0]]
        + slim.agg(F.percentile_approx("__t", probs, 10 * buckets)).first()[0]
    ).astype(np.float64)
    bucket = _step_function(edges, np.arange(len(edges), dtype=np.float64))
    placed_in = scores.withColumn("__bucket", bucket(F.col(score).cast("double")))
    drawn = placed_in.groupBy("__bucket").agg(F.count("*").alias("n")).filter("__bucket IS NOT NULL")
    sizes = {int(r["__bucket"]): r["n"] for r in drawn.collect()}
    fair = max(1, sum(sizes.values()) // len(edges))
    counts = F.lit(np.array([-(-sizes.get(i, 1) // fair) for i in range(len(edges))], dtype=np.int64))

    def salts(at: Column) -> Column:
        return F.get(counts, at.cast("int"))

    mixed = F.xxhash64(*scores.columns, F.spark_partition_id())
    spread = placed_in.withColumn("__salt", F.pmod(mixed, salts(F.col("__bucket"))))
    fields = F.struct(*scores.columns)
    left = spread.select(
        "__bucket",
        "__salt",
        F.col(score).cast("double").alias("__t"),
        F.lit(1).alias("__kind"),
        F.lit(None).cast("double").alias("__v"),
        fields.alias("__row"),
    )
    steps = slim.withColumn("__bucket", bucket(F.col("__t").cast("double")))
    right = steps.select(
        "__bucket",
        F.explode(F.sequence(F.lit(0).cast("bigint"), salts(F.col("__bucket")) - 1)).alias("__salt"),
        F.col("__t").cast("double").alias("__t"),
        F.lit(0).alias("__kind"),
        F.col("__v").cast("double").alias("__v"),
        F.lit(None).cast(left.schema["__row"].dataType).alias("__row"),
    )
    unplaced = left.filter(F.col("__bucket").isNull()).select("__row.*").withColumn(
        out, F.lit(None).cast("double")
    )
    order = W.partitionBy("__bucket", "__salt").orderBy("__t", "__kind")
    placed = (
        left.filter(F.col("__bucket").isNotNull())
        .unionByName(right)
        .withColumn(out, F.last("__v", ignorenulls=True).over(order))
        .filter(F.col("__kind") == 1)
        .select("__row.*", out)
    )
    return placed.unionByName(unplaced)


def _level(start: Column, end: Column, bin_size: int) -> Column:
    """Lowest level whose cells are as wide as the span: the span then touches two cells at most."""
    level = F.lit(_LEVELS)
    for k in reversed(range(_LEVELS)):
        level = F.when(end - start <= bin_size * _LEVEL_STEP**k, k).otherwise(level)
    return level


def _width(level: Column, bin_size: int) -> Column:
    return (F.lit(float(bin_size)) * F.pow(F.lit(float(_LEVEL_STEP)), level)).cast("bigint")


def _in_cells(df: DataFrame, start: Column, end: Column, bin_size: int, above: Sequence[int]) -> DataFrame:
    """Rows in the cells of their own level, and as guests in those levels of ``above`` that lie higher."""
    own = df.withColumn("__own", _level(start, end, bin_size))
    levels = F.filter(F.array(*[F.lit(k) for k in above]).cast("array<int>"), lambda k: k > F.col("__own"))
    spread = own.withColumn("__level", F.explode(F.concat(F.array(F.col("__own")), levels)))
    width = _width(F.col("__level"), bin_size)
    cells = F.sequence(F.floor(start / width), F.floor((end - 1) / width))
    return spread.withColumn("__bin", F.explode(cells)).withColumn("__guest", F.col("__level") > F.col("__own")).drop("__own")


def overlap_join(variants: DataFrame, spans: DataFrame, bin_size: int = 4096) -> DataFrame:
    """Pairs of a variant and a span on the same chromosome that share a base.

    Variants have (chrom, start, end) and spans (chrom, span_start, span_end), all half-open and not
    empty. Each is put into the one or two cells of the level that fits its length, and as a guest into
    the higher levels that the other side uses, so a span of any length gives a few rows. A pair meets at
    the higher of its two levels and is kept in the first cell both touch, so it appears once. Crowded
    cells are split at run time by adaptive skew handling, since the join is an ordinary equi-join.
    """
    start, end, s_start, s_end = map(F.col, ("start", "end", "span_start", "span_end"))
    # One bit for each of the nine levels that a side uses.
    used = []
    for df, a, b in ((variants, start, end), (spans, s_start, s_end)):
        level = _level(a, b, bin_size)
        bit = reduce(lambda other, k: F.when(level == k, 1 << k).otherwise(other), range(_LEVELS + 1), F.lit(0))
        bits = df.select(bit.alias("b")).agg(F.bit_or("b")).first()[0] or 0
        used.append([k for k in range(_LEVELS + 1) if bits >> k & 1])
    v = _in_cells(variants, start, end, bin_size, used[1]).withColumnRenamed("__guest", "__v_guest")
    s = _in_cells(spans, s_start, s_end, bin_size, used[0]).withColumnRenamed("__guest", "__s_guest")
    first_bin = F.floor(F.greatest("start", "span_start") / _width(F.col("__level"), bin_size))
    return (
        v.join(s, ["chrom", "__level", "__bin"])
        .filter(
            (start < s_end)
            & (s_start < end)
            & ~(F.col("__v_guest") & F.col("__s_guest"))
            & (F.col("__bin") == first_bin)
        )
        .drop("__level", "__bin", "__v_guest", "__s_guest")
    )


def points_in_spans(points: DataFrame, spans: DataFrame, bin_size: int = 4096) -> DataFrame:
    """Rows at a 1-based (chrom, pos) that lies in some half-open span (chrom, start, end), each once.

    Equal positions are looked up once; spans that overlap do not repeat a row.
    """
    at = points.select("chrom", F.col("pos").cast("bigint").alias("pos")).distinct()
    at = at.select("chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))
    named = spans.select("chrom", F.col("start").alias("span_start"), F.col("end").alias("span_end"))
    inside = overlap_join(at, named.distinct(), bin_size).select("chrom", F.col("end").alias("pos")).distinct()
    return points.join(inside, ["chrom", "pos"], "left_semi").select(*points.columns)


def flank_exons(
    exons: DataFrame, acceptor_intron: int = 50, donor_intron: int = 13
) -> DataFrame:
    """Exons (1-based, closed) as half-open spans widened by intron flanks, by strand.

    The acceptor side lies before the exon on the plus strand and after it on the minus.
    """
    plus = F.col("strand") != "-"
    left = F.when(plus, acceptor_intron).otherwise(donor_intron)
    right = F.when(plus, donor_intron).otherwise(acceptor_intron)
    return exons.withColumn("span_start", F.col("start") - 1 - left).withColumn(
        "span_end", F.col("end") + right
    ).drop("start", "end")
