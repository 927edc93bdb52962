"""URL filter: a trie over reversed host labels and path segments.

A rule is a host, a path and a verdict. It fits its host and all subdomains where the url's path
starts with the rule's, letter by letter, so the last segment of a rule may be the beginning of a
segment. Each host label, from the last one on, is an edge of the trie; the paths of a host hang
below it as a trie of whole segments, whose last, unfinished segment is looked up by its lengths.
Of all rules that fit the longest wins, host and path counted together in characters; of equally
long ones the longer host; where one host and path are both allowed and blocked, the block.

Rules are read in blocks of at most ``BLOCK_BYTES`` of text; each block is broadcast as plain
strings and a task builds its trie once. Longer lists take further passes over the rows, each of
which is written and keeps the better of two matches, so that no broadcast grows with the list.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; so
does a rule with a null host or path. An empty host in a rule fits every url. Labels are compared
in lower case (A-Z only). Where no rule fits, the rule is null and the verdict is ``default``.
Further columns are carried along, those named like the outputs are replaced; repeated rows each get
their answer. An empty table gives no rows and an empty rule list the default.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from varloom.llm.common import stored

#: Text of the rules in one broadcast, in bytes.
BLOCK_BYTES = 32 << 20
OUTPUTS = ("host", "path", "rule", "verdict")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to the next ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """``nodes`` lead from label to label (or segment to segment); ``ends`` hold the rules of a node."""

    __slots__ = ("nodes", "paths", "ends", "lengths")

    def __init__(self):
        self.nodes: dict[str, Trie] = {}
        self.paths: Trie | None = None
        self.ends: dict[str, tuple[int, str, str]] = {}
        self.lengths: list[int] = []


def lower_ascii(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def rank(host: str, path: str, verdict: str) -> int:
    """Order of rules that fit one url: length of the whole, then of the host, then blocks first."""
    return (len(host) + len(path)) << 32 | len(host) << 1 | (verdict == "block")


def build(rules: Iterable[Rule]) -> Trie:
    root = Trie()
    for host, path, verdict in rules:
        host = lower_ascii(host)
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.nodes.setdefault(label, Trie())
        node.paths = node.paths or Trie()
        node = node.paths
        *whole, rest = path.split("/")
        for segment in whole:
            node = node.nodes.setdefault(segment, Trie())
        hit = (rank(host, path, verdict), host + path, verdict)
        node.ends[rest] = max(node.ends.get(rest, hit), hit)
        if len(rest) not in node.lengths:
            node.lengths.append(len(rest))
    return root


def host_tries(root: Trie, host: str) -> list[Trie]:
    """Path tries of the host and the hosts above it, shortest first."""
    node, out = root, [root.paths] if root.paths else []
    for label in reversed(host.split(".")) if host else ():
        node = node.nodes.get(label)
        if node is None:
            break
        if node.paths:
            out.append(node.paths)
    return out


def longest(tries: list[Trie], path: str) -> tuple[int, str, str] | None:
    """The longest rule whose path begins this path."""
    best = None
    segments = path.split("/")
    for node in tries:
        for segment in segments:
            for n in node.lengths:
                found = node.ends.get(segment[:n]) if n <= len(segment) else None
                if found and (best is None or found > best):
                    best = found
            node = node.nodes.get(segment)
            if node is None:
                break
    return best


def _match(rules):
    def run(batches):
        root = build(rules.value)
        known: dict[str, list[Trie]] = {}
        for batch in batches:
            found = []
            for host, path, seen, matched in zip(
                batch.column("_host").to_pylist(),
                batch.column("_path").to_pylist(),
                batch.column("_seen").to_pylist(),
                batch.column("_match").to_pylist(),
            ):
                if not seen:
                    found.append(matched)
                    continue
                tries = known.get(host)
                if tries is None:
                    if len(known) > 100_000:
                        known.clear()
                    tries = known[host] = host_tries(root, host)
                hit = longest(tries, path)
                if hit and (matched is None or hit[0] > matched["rank"]):
                    matched = dict(zip(("rank", "rule", "verdict"), hit))
                found.append(matched)
            kept = [n for n in batch.schema.names if n != "_match"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(found, MATCH)], [*kept, "_match"]
            )

    return run


MATCH = pa.struct([("rank", pa.int64()), ("rule", pa.string()), ("verdict", pa.string())])


def blocks(rules: Iterable[Rule], limit: int = BLOCK_BYTES) -> Iterator[list[Rule]]:
    """Rules in lists of at most ``limit`` bytes of text, or of one longer rule."""
    block, size = [], 0
    for host, path, verdict in rules:
        if host is None or path is None or verdict is None:
            continue
        n = len(host.encode()) + len(path.encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((host, path, verdict))
        size += n
    if block:
        yield block


def filter_urls(
    pages: DataFrame,
    rules: DataFrame | Iterable[Rule],
    default: str = "allow",
    url_col: str = "url",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``pages`` with the columns of ``OUTPUTS``: host, path, the winning rule and the verdict.

    ``rules`` are (host, path, verdict) with ``allow`` or ``block``, as a list or a DataFrame with
    these columns, of which the driver holds one block at a time.
    """
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        rules = (tuple(r) for r in rules.select("host", "path", "verdict").toLocalIterator())
    carried = [f for f in pages.schema if f.name not in OUTPUTS]
    url = F.col(f"`{url_col}`")
    # Carried columns wait in a struct, so that none of their names can clash with a helper.
    rows = pages.select(
        F.struct(*[F.col(f"`{f.name}`") for f in carried]).alias("_row"),
        url_host(url).alias("_host"),
        url_path(url).alias("_path"),
        F.coalesce(url.contains("://"), F.lit(False)).alias("_seen"),
        F.lit(None).cast("struct<rank: bigint, rule: string, verdict: string>").alias("_match"),
    )
    for i, block in enumerate(blocks(rules, block_bytes)):
        if i:
            rows = stored(rows, "urls")
        rows = rows.mapInArrow(_match(spark.sparkContext.broadcast(block)), rows.schema)
    return rows.select(
        *[F.col(f"_row.`{f.name}`") for f in carried],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_match.rule").alias("rule"),
        F.coalesce("_match.verdict", F.lit(default)).alias("verdict"),
    )
