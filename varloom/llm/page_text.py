"""Main text of web pages: markup decides, and a suffix array over the host's pages where markup is in doubt.

Text inside ``article`` or ``main`` is the page's own, even where other pages repeat it (copies and
quotations are no boilerplate); menus, footers, forms, adverts, comments and the like are never. Two kinds
of text are in doubt: parts of an article whose class or id only may name something else (``legal``,
``related``, ...), and all free text of pages without a marked part. There the runs of tokens that stand
on ``MIN_PAGES`` pages of the host or more are boilerplate and go; the unique runs stay.

Token streams of a host are not put into one task, however large it is. A window of ``MIN_TOKENS`` tokens
belongs to the smallest hash of its ``GRAM`` tokens; equal windows share that anchor. Windows side by side
with one anchor are a context. Repeats matter where text is in doubt, so only contexts travel whose anchor
stands in such text somewhere, from all text of all pages, and on enough pages; equal ones are one row
with the number of their pages. Where one anchor has many different contexts they are cut
into their windows, whose own tokens are then the anchor. The tokens of each shard of anchors are
concatenated and sorted as a suffix array as deep as a window, whose equal neighbours are the repeats. Pages
count once for a window: a page marks which of its windows it holds for the first time.

``n_covered`` counts the covered tokens of all of a page's text, as far as their windows stand in text in
doubt on some page; where markup decides everywhere, nothing is searched.

Defined cases: null html counts as empty and gives an empty text; a null url belongs to the host
without a name; unclosed tags and cut-off pages are read as far as they go; repeated page ids are
separate pages. ``text`` and ``n_chars`` replace columns of that name, others are carried along.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from varloom.llm.common import FILTER_BITS, bit_filter, mix, stored

MIN_TOKENS = 8
MIN_PAGES = 3
#: Tokens that anchor a window.
GRAM = 4
#: Different contexts that an anchor may have before they are cut into windows, and tokens of a shard.
MOST_CONTEXTS = 20_000
SHARD_TOKENS = 400_000

#: A quote opens a value only behind an equals sign; elsewhere, and inside a bare value, it is a plain sign.
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+)|[^>=]++|=)*+)>""",
    re.S,
)
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "object"}
NEVER = RAW | set("head nav header footer aside form dialog menu button select canvas audio video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MAIN = {"article", "main"}
BLOCK = set(
    "address article blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul aside".split()
)
CLOSES_P = BLOCK - {"html", "body"}
def _words(names: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{names})(?:$|[\s_-])", re.I)


NAMES = _words(
    r"ads?|advert\w*|breadcrumbs?|comments?|consent|cookies?|disqus|masthead|menu|modal|nav\w*|newsletter|overlay"
    r"|pagination|popup|promo\w*|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget"
)
#: Names that articles use for parts of their own as well.
DOUBTFUL = _words(r"banner|footer|legal|notices?|related|reply")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true""", re.I)
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "alertdialog", "menu"}


def _verdict(name: str, attributes: str, in_main: bool) -> str | None:
    """``never``, ``doubt`` or None for an element that says nothing."""
    if name in NEVER:
        return None if name == "header" and in_main else "never"
    if name in MAIN or name in ("html", "body") or not attributes:
        return None
    found = None
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        if key.lower() == "role":
            if value.lower() in ROLES:
                return "never"
        elif NAMES.search(value):
            return "never"
        elif DOUBTFUL.search(value):
            found = "doubt" if in_main else "never"
    return "never" if HIDDEN.search(attributes) else found


def blocks(page: str) -> list[tuple[str, str]]:
    """Text blocks in page order with their zone: ``main``, ``doubt`` inside it, ``never`` or ``free``."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, str]] = []
    zone = "free"

    def close() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append((text, zone))
        held.clear()

    at = 0
    while True:
        tag = TAG.search(page, at)
        if tag is None:
            held.append(html.unescape(page[at:]))
            break
        if tag.start() > at:
            held.append(html.unescape(page[at : tag.start()]))
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            close()
        elif name in ("br", "td", "th", "option"):
            held.append(" ")
        if tag[1]:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), None)
            if depth is None:
                continue
            before = stack[depth][1]
        else:
            if name in CLOSES_P and any(n == "p" for n, _ in stack):
                depth = max(d for d, (n, _) in enumerate(stack) if n == "p")
                if not any(n in CLOSES_P for n, _ in stack[depth + 1 :]):
                    if stack[depth][1] != zone:
                        close()
                    zone = stack[depth][1]
                    del stack[depth:]
            if name in VOID or tag[3].endswith("/"):
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            after = zone
            if zone != "never":
                said = _verdict(name, tag[3], zone in ("main", "doubt"))
                after = said or ("main" if name in MAIN and zone == "free" else zone)
            if after != zone:
                close()
            stack.append((name, zone))
            zone = after
            continue
        if before != zone:
            close()
        zone = before
        del stack[depth:]
    close()
    return out


def repeated_windows(
    tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pages: np.ndarray, first: np.ndarray, min_tokens: int, min_pages: int
) -> np.ndarray:
    """Whether the windows that start at each place of a shard's token stream stand on enough pages.

    ``starts`` and ``sizes`` are the contexts in the stream, ``pages`` on how many pages each stands,
    ``first`` marks the places where these pages hold a window for the first time.
    """
    total = len(tokens)
    stop = np.repeat(starts + sizes, sizes)
    here = np.arange(total)
    # Sorting by pairs doubles the depth until suffixes are in order as far as a window goes.
    rank, length = np.unique(tokens, return_inverse=True)[1], 1
    while length < min_tokens:
        step = min(length, min_tokens - length)
        inside = here + length + step <= stop
        second = np.where(inside, rank[np.minimum(here + step, total - 1)], total + here)
        rank = np.unique(rank * (2 * total + 1) + second, return_inverse=True)[1]
        length += step
    suffixes = np.argsort(rank, kind="stable")
    ordered = rank[suffixes]
    run = np.cumsum(np.append(True, ordered[1:] != ordered[:-1])) - 1 if total else ordered
    weight = np.repeat(pages, sizes) * first
    count = np.bincount(run, weight[suffixes]) if total else np.zeros(0)
    out = np.zeros(total, bool)
    out[suffixes] = count[run] >= min_pages
    return out & (here + min_tokens <= stop)


def _kept(page: list[tuple[str, str]], cover: np.ndarray) -> tuple[str, int, int]:
    """(text, blocks kept, covered tokens) of a page; text in doubt loses its covered tokens."""
    marked = any(zone in ("main", "doubt") for _, zone in page)
    kept, at = [], 0
    for text, zone in page:
        words = text.split(" ")
        gone = cover[at : at + len(words)]
        at += len(words)
        if zone == "main":
            kept.append(text)
        elif (zone == "doubt" or zone == "free" and not marked) and not gone.all():
            kept.append(" ".join(w for w, g in zip(words, gone) if not g))
    return "\n".join(kept), len(kept), int(cover.sum())


def token_names(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def hashed_runs(names: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hash of seed and tokens of each run of ``length`` tokens."""
    n = max(len(names) - length + 1, 0)
    h = np.full(n, seed, np.uint64)
    for k in range(length):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + names[k : k + n])
    return h


def contexts(names: np.ndarray, host: str, min_tokens: int = MIN_TOKENS, gram: int = GRAM):
    """(anchor, first window, windows, which windows are new to the page) of all contexts of a page."""
    n = len(names) - min_tokens + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    grams = hashed_runs(names, gram, xxhash.xxh3_64_intdigest(host))
    view = np.lib.stride_tricks.sliding_window_view(grams, min_tokens - gram + 1)
    at = np.arange(n) + view.argmin(1)
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    sizes = np.diff(np.append(starts, n))
    new = np.zeros(n, bool)
    new[np.unique(hashed_runs(names, min_tokens, 0), return_index=True)[1]] = True
    return grams[at[starts]], starts, sizes, new


def _parse(batches):
    for batch in batches:
        # Slices keep few pages as Python values at a time.
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            parsed = [blocks(page or "") for page in part.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_row"),
                    part.column("_host"),
                    pa.array([[text for text, _ in page] for page in parsed], pa.list_(pa.string())),
                    pa.array([[zone for _, zone in page] for page in parsed], pa.list_(pa.string())),
                    pa.array([bool(in_doubt([zone for _, zone in page])) for page in parsed], pa.bool_()),
                ],
                ["_row", "_host", "_texts", "_zones", "_doubt"],
            )


def in_doubt(zones: list[str]) -> set[str]:
    """Zones whose text repeats decide on a page."""
    marked = "main" in zones or "doubt" in zones
    return {"doubt"} & set(zones) if marked else {"free"} & set(zones)


def _pages(batches):
    """(page, host, token names, tokens, which tokens are in doubt) of each page."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            columns = [part.column(c).to_pylist() for c in ("_page", "_host", "_texts", "_zones")]
            for key, host, texts, zones in zip(*columns):
                words = [text.split(" ") for text in texts]
                tokens = [t for some in words for t in some]
                open_ = in_doubt(zones)
                doubt = np.repeat(np.array([z in open_ for z in zones], bool), list(map(len, words)))
                yield key, host, token_names(tokens), tokens, doubt


def _doubtful_anchors(batches):
    """Anchors of the contexts that touch text in doubt, once a page."""
    for _, host, names, _, doubt in _pages(batches):
        anchor, starts, sizes, _ = contexts(names, host)
        upto = np.append(0, np.cumsum(doubt))
        made = np.unique(anchor[upto[starts + sizes + MIN_TOKENS - 1] > upto[starts]])
        if len(made):
            yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64))], ["anchor"])


def _context_rows(words):
    """Contexts whose anchor passes the filter of anchors in doubt."""

    def run(batches):
        filled = words.value
        for page, host, names, tokens, _ in _pages(batches):
            anchor, starts, sizes, new = contexts(names, host)
            bit = anchor.view(np.int64) & ((1 << FILTER_BITS) - 1)
            kept = np.flatnonzero((filled[bit >> 6] >> (bit & 63)) & 1)
            if not len(kept):
                continue
            anchor, starts, sizes = anchor[kept], starts[kept], sizes[kept]
            ends = (starts + sizes + MIN_TOKENS - 1).tolist()
            body = [" ".join(tokens[a:b]) for a, b in zip(starts.tolist(), ends)]
            flags = ["".join("1" if x else "0" for x in new[a : a + n]) for a, n in zip(starts.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(starts), page)),
                    pa.array(anchor.view(np.int64)),
                    pa.array(starts.astype(np.int32)),
                    pa.array(body, pa.string()),
                    pa.array(flags, pa.string()),
                ],
                _NAMES,
            )

    return run


def _shards(batches):
    """Repeated windows of each context, as 0 and 1; rows come in order of their anchors."""
    held, n_tokens, last = [], 0, None

    def solved():
        bodies = [row[1].split(" ") for row in held]
        sizes = np.array(list(map(len, bodies)), np.int64)
        names: dict[str, int] = {}
        stream = np.fromiter((names.setdefault(t, len(names)) for b in bodies for t in b), np.int64, int(sizes.sum()))
        # Contexts of different anchors never hold equal windows, as each window has one anchor.
        first = np.concatenate([np.array([f == "1" for f in row[2]] + [False] * (MIN_TOKENS - 1)) for row in held])
        pages = np.array([row[3] for row in held], np.int64)
        starts = np.cumsum(sizes) - sizes
        found = repeated_windows(stream, starts, sizes, pages, first, MIN_TOKENS, MIN_PAGES)
        bits = ["".join("1" if x else "0" for x in found[a : a + n - MIN_TOKENS + 1]) for a, n in zip(starts, sizes)]
        some = [i for i, b in enumerate(bits) if "1" in b]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([held[i][0] for i in some], pa.int64()),
                pa.array([held[i][1] for i in some], pa.string()),
                pa.array([held[i][2] for i in some], pa.string()),
                pa.array([bits[i] for i in some], pa.string()),
            ],
            ["anchor", "body", "new", "repeated"],
        )

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "body", "new", "pages")]):
            if n_tokens > SHARD_TOKENS and row[0] != last:
                yield solved()
                held, n_tokens = [], 0
            held.append(row)
            n_tokens += row[1].count(" ") + 1
            last = row[0]
    if held:
        yield solved()


def _windows(batches):
    """Contexts cut into windows; a window's own tokens and its anchor, which knows the host, are the new anchor."""
    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("_page", "anchor", "start", "body", "new")]
        for page, anchor, start, body, new in zip(*columns):
            tokens = body.split(" ")
            for k, flag in enumerate(new):
                text = " ".join(tokens[k : k + MIN_TOKENS])
                name = xxhash.xxh3_64_intdigest(text, seed=anchor & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
                rows.append((page, name, start + k, text, flag))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["_page", "anchor", "start", "body", "new"]
        )


_NAMES = ["_page", "anchor", "start", "body", "new"]
_CONTEXT = "_page long, anchor long, start int, body string, new string"


def covered_places(parsed: DataFrame) -> DataFrame | None:
    """(_page, _repeated): starts of the windows of a page that enough pages of its host hold.

    None where no text is in doubt.
    """
    columns = ["_page", "_host", "_texts", "_zones"]
    doubtful = parsed.filter("_doubt").select(*columns).mapInArrow(_doubtful_anchors, "anchor long").distinct()
    doubtful = stored(doubtful, "anchors-in-doubt")
    if not doubtful.head(1):
        return None
    words = parsed.sparkSession.sparkContext.broadcast(bit_filter(doubtful, "anchor"))
    every = parsed.select(*columns).mapInArrow(_context_rows(words), _CONTEXT)
    met = stored(every.join(doubtful, "anchor").select(*_NAMES), "page-contexts")
    pages = met.select("_page", "anchor").distinct().groupBy("anchor").count()
    often = pages.filter(F.col("count") >= MIN_PAGES).select("anchor")
    open_ = stored(met.join(often, "anchor").select(*_NAMES), "page-contexts")

    def distinct(rows: DataFrame) -> DataFrame:
        return rows.groupBy("anchor", "body", "new").agg(F.count("*").alias("pages"))

    kinds = stored(distinct(open_), "context-kinds")
    hot = kinds.groupBy("anchor").count().filter(F.col("count") > MOST_CONTEXTS).select("anchor")
    hot = stored(hot, "hot-anchors")
    if hot.head(1):
        cut = open_.join(hot, "anchor", "left_semi").mapInArrow(_windows, _CONTEXT)
        open_ = stored(open_.join(hot, "anchor", "left_anti").unionByName(cut), "page-contexts")
        kinds = distinct(open_)
    marked = stored(
        kinds.repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_shards, "anchor long, body string, new string, repeated string"),
        "repeated-windows",
    )
    # A context is named by its anchor and one hash of its tokens on the way back.
    name = F.xxhash64("body", "new")
    marked = marked.select("anchor", name.alias("name"), "repeated")
    return (
        open_.select("_page", "anchor", "start", name.alias("name"))
        .join(marked, ["anchor", "name"])
        .groupBy("_page")
        .agg(F.collect_list(F.struct("start", "repeated")).alias("_repeated"))
    )


OUTPUTS = ("text", "n_chars", "n_blocks", "n_covered")


def _extract(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            made = []
            columns = [part.column(c).to_pylist() for c in ("_texts", "_zones", "_repeated")]
            for texts, zones, repeated in zip(*columns):
                tokens = [t for text in texts for t in text.split(" ")]
                cover = np.zeros(len(tokens), bool)
                if repeated:
                    starts = np.array([r["start"] + k for r in repeated for k, x in enumerate(r["repeated"]) if x == "1"])
                    marks = np.zeros(len(tokens) + 1, np.int64)
                    np.add.at(marks, starts, 1)
                    np.add.at(marks, starts + MIN_TOKENS, -1)
                    cover = np.cumsum(marks)[:-1] > 0
                made.append(_kept(list(zip(texts, zones)), cover))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_row"),
                    pa.array([m[0] for m in made], pa.string()),
                    *[pa.array(c, pa.int64()) for c in zip(*[(len(m[0]), m[1], m[2]) for m in made])],
                ],
                ["_row", *OUTPUTS],
            )


def extract_text(
    pages: DataFrame, html_col: str = "html", url_col: str = "url", parts: int | None = None
) -> DataFrame:
    """``pages`` without the html, with text, n_chars, n_blocks and n_covered (covered tokens)."""
    carried = [f for f in pages.schema if f.name not in OUTPUTS and f.name != html_col]
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    read = pages.select(
        F.struct(*[F.col(f"`{f.name}`") for f in carried]).alias("_row"), F.col(html_col).alias("_html"), host.alias("_host")
    )
    if parts:
        read = read.repartition(parts)
    kind = StructType([read.schema["_row"], StructField("_host", StringType())])
    kind.add("_texts", ArrayType(StringType())).add("_zones", ArrayType(StringType())).add("_doubt", BooleanType())
    # Written once, so that the number of a page is the same in every later pass.
    parsed = stored(read.mapInArrow(_parse, kind).withColumn("_page", F.monotonically_increasing_id()), "parsed-pages")
    found = covered_places(parsed)
    made = StructType([read.schema["_row"], StructField("text", StringType())])
    for name in OUTPUTS[1:]:
        made.add(name, LongType())
    if found is None:
        nothing = F.lit(None).cast("array<struct<start: int, repeated: string>>")
        placed = parsed.withColumn("_repeated", nothing)
    else:
        placed = parsed.join(found, "_page", "left")
    return (
        placed.select("_row", "_texts", "_zones", "_repeated")
        .mapInArrow(_extract, made)
        .select(*[F.col(f"_row.`{f.name}`") for f in carried], *OUTPUTS)
    )
