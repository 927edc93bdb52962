"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once and leaves one bit and its measurements in a ledger. A policy is a
versioned mask over those bits; applying one, or comparing many, never reads a text again.

Defined cases: a null text counts as empty; an empty text has no words and fails ``few_words``;
any other column is carried along; an id may be null or repeat, since rows are judged alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[ \t\n\x0B\f\r]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


@dataclass(frozen=True)
class Rule:
    """A name and a SQL condition over the measures that holds when a document fails."""

    name: str
    fails: str


#: The place in this list is the bit; add new rules at the end.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_or_long_words", "2 * word_chars < 5 * n_words OR word_chars > 14 * n_words"),
    Rule("capitals", "100 * n_capitals > 40 * word_chars"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version name and the rules that reject a document under it."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(name) for name in set(self.rules))


POLICIES = (
    Policy("base", BASE),
    Policy("symbols", (*BASE, "symbols")),
    Policy("standard", tuple(r.name for r in RULES)),
)
STANDARD = POLICIES[-1]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of each text; columns of these names are replaced."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    # Carried columns wait in a struct, so that none of their names can clash with a helper.
    docs = docs.select(F.struct(*others).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    body = F.col("_text")
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    df = docs.withColumns(
        {
            "_words": F.array_remove(F.split(body, SPACE + "+", -1), ""),
            "_lines": lines,
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "n_capitals": F.length(F.regexp_replace(body, "[^A-Z]+", "")).cast("long"),
        }
    )
    words = F.col("_words")
    df = df.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            # One hash for each window; empty where fewer than two windows exist.
            "_windows": F.when(
                F.size(words) > WINDOW,
                F.transform(
                    F.sequence(F.lit(0), F.size(words) - WINDOW),
                    # Single look-ups: slice() copies the whole array at each call.
                    lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    # Windows and their places are sorted only where a window comes back.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(placed)))
    at = F.col("_sorted")

    def again(k):
        here = F.get(at, k)["h"]
        return F.coalesce(here == F.get(at, k - 1)["h"], F.lit(False)) | F.coalesce(
            here == F.get(at, k + 1)["h"], F.lit(False)
        )

    hits = F.filter(F.sequence(F.lit(0), F.size(at) - 1), again)
    df = df.withColumn(
        "_places",
        F.when(at.isNotNull(), F.sort_array(F.transform(hits, lambda k: F.get(at, k)["i"]))),
    )
    places = F.col("_places")
    covered = F.aggregate(
        F.sequence(F.lit(1), F.size(places)),
        F.lit(0).cast("long"),
        lambda total, k: total
        + F.coalesce(F.least(F.get(places, k) - F.get(places, k - 1), F.lit(WINDOW)), F.lit(WINDOW)),
    )
    df = df.withColumn("n_repeat_words", F.when(places.isNotNull(), covered).otherwise(F.lit(0).cast("long")))
    # A generator of one row: filters on measures stop here, else each would repeat the whole measuring.
    return df.select("_row", F.inline(F.array(F.struct(*MEASURES)))).select("_row.*", *MEASURES)


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures and ``failure_bits``: bit n is set when rule n fails."""
    if len(rules) > 62:
        raise ValueError("a ledger holds at most 62 rules")
    bits = [F.when(F.expr(r.fails), F.lit(1 << n)).otherwise(F.lit(0)).cast("long") for n, r in enumerate(rules)]
    return measure(docs, text).withColumn(
        "failure_bits", reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long"))
    )


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES, bits: str = "failure_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def apply_policy(
    entries: DataFrame, policy: Policy = STANDARD, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Add ``base_failed``, ``kept`` and ``policy`` to ledger rows."""
    return entries.withColumns(
        {
            "base_failed": ~passes(Policy("base", BASE), rules),
            "kept": passes(Policy("base", BASE), rules) & passes(policy, rules),
            "policy": F.lit(policy.version),
        }
    )


def ablations(
    entries: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """For each policy and rule: documents it rejects, and those that no other rule rejects.

    Ledger rows are first counted by their bits, so what follows works on at most one row for each
    pattern of failures, however many documents there are.
    """
    patterns = entries.groupBy("failure_bits").agg(F.count("*").alias("n_docs"))
    cases = [
        F.struct(
            F.lit(p.version).alias("policy"),
            F.lit(rules[n].name).alias("rule"),
            F.lit(p.mask(rules)).cast("long").alias("mask"),
            F.lit(1 << n).cast("long").alias("bit"),
        )
        for p in policies
        for n in range(len(rules))
        if p.mask(rules) >> n & 1
    ]
    left = F.col("failure_bits").bitwiseAND(F.col("mask"))
    return (
        patterns.withColumn("case", F.explode(F.array(*cases)))
        .select("failure_bits", "n_docs", "case.*")
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(left.bitwiseAND(F.col("bit")) != 0, F.col("n_docs")).otherwise(0)).alias("n_rejected"),
            F.sum(F.when(left == F.col("bit"), F.col("n_docs")).otherwise(0)).alias("n_only_here"),
            F.sum(F.when(left != 0, F.col("n_docs")).otherwise(0)).alias("n_rejected_by_policy"),
        )
    )
