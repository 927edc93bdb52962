"""Token spans, url rules and the Merkle log against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import prose
from varloom.llm import merkle_log, queries, token_spans, url_trie

# tokenizers

ODD = [
    "héllo 漢字😀 ܐa",
    " lead",
    "trail ",
    "a  b   c",
    "x\n\ny z\t w",
    "with ▁ mark",
    "<|endoftext|> <s> <0x41>",
    "don't we'll",
    "a",
    "  ",
    "　 x   y",
    "日本語テキスト 漢字ܐܒ ܓ",
    "\x1c a 123 4567 !!! ... #$%",
    "é" * 50,
    "👩‍👩‍👧 ok a ​ b",
    "",
    None,
]


@pytest.fixture(scope="module")
def tokenizers():
    (a, a_bytes), (b, b_bytes) = token_spans.load_a(token_spans.default_paths()[0]), token_spans.load_b(token_spans.default_paths()[1])
    return a, a_bytes, b, b_bytes


def plain_groups(text, tokenizers):
    """Whole texts in one call each, ends counted in bytes; None where a text has no tokens."""
    a, a_bytes, b, b_bytes = tokenizers
    if not text:
        return None
    left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    whole = (" " + text).encode()
    if b"".join(a_bytes[i] for i in left) != whole or b"".join(b_bytes[i] for i in right) != whole:
        return None
    ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((a_bytes, left), (b_bytes, right))]
    out, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
        out.append((left[i:x], right[j:y]))
        i, j = x, y
    return out


def test_alignment(spark, tokenizers):
    texts = ODD + [prose(i, 60) for i in range(20)] + [prose(3, 60), "x" * 3000, prose(90, 4000)]
    rows = [(i if i % 7 else None, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links string, n_best int").withColumn("a.b", F.lit(2))
    groups = [plain_groups(t, tokenizers) for t in texts]
    counts = Counter((g[0][-1], g[1][-1]) for x in groups if x for g in x)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = Counter()
    for (i, *_), x in zip(rows, groups):
        links = [(g[0][-1], g[1][-1]) for g in x or ()]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in x or ())
        want[
            i,
            sum(len(g[0]) for g in x or ()),
            sum(len(g[1]) for g in x or ()),
            len(links),
            len(links),
            sum(counts[p] == best[p[1]] for p in links),
            sum(counts[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        ] += 1
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = token_spans.align_scored(docs.repartition(3))
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == want
    assert groups[5] is None and sum(x is None for x in groups) == 3 and "a.b" in got.columns
    spans = token_spans.align(docs).collect()
    for r in spans:
        assert sum(r["a_sizes"]) == len(r["a_ids"]) and sum(r["b_sizes"]) == len(r["b_ids"])
    sizes = Counter(sum(r["group_bytes"]) for r in spans)
    assert sizes == Counter(len((" " + t).encode()) if g else 0 for t, g in zip(texts, groups))


def test_alignment_keeps_small_tables(spark, tokenizers, monkeypatch):
    table = token_spans.PairTable(*token_spans.default_paths())
    monkeypatch.setattr(token_spans, "TABLE", 3)
    monkeypatch.setattr(token_spans, "CALL", 40)
    for text in [t for t in ODD if t] + [prose(1, 30)]:
        parts = token_spans.parts_of(text)
        assert parts == token_spans.GAP.split(text)
        table.add([parts])
        codes = [table.codes[p] for p in parts]
        want = plain_groups(text, tokenizers)
        if want is None:
            assert not table.good[codes].all()
        else:
            text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in want)
            assert "".join(table.digests[c] for c in codes)[:-1] == text


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_spans.align(docs).count() == 0 and token_spans.align_scored(docs).count() == 0


def test_pairs_are_bounded_by_the_vocabularies(tokenizers):
    _, a_bytes, _, b_bytes = tokenizers
    assert token_spans.most_pairs(*token_spans.default_paths()) == sum(map(len, a_bytes)) + sum(map(len, b_bytes)) < 10**6


# urls


def plain_rule(url, rules, default):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)])
        host, path = url_trie.lower_ascii(rest[:cut]), rest[cut:]
        path = path[: min([i for i, c in enumerate(path) if c in "?#"] or [len(path)])]
        fits = [
            (len(h) + len(p), len(h), v == "block", h + p, v)
            for h, p, v in rules
            if (not h or host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        if fits:
            return host, path, *max(fits)[3:]
    return host, path, None, default


RULES = [
    *queries.URL_RULES,
    ("", "/blocked", "block"),
    ("a.net", "", "allow"),
    ("net", "/x/y", "block"),
    ("net", "/x/", "allow"),
    ("a.net", "/x", "block"),
    ("t", "/abc", "allow"),
    ("abc.t", "", "block"),
    ("same", "/p", "allow"),
    ("same", "/p", "block"),
]


def urls():
    rng = random.Random(2)
    hosts = ["example.org", "www.EXAMPLE.org", "notexample.org", "a.net", "b.a.net", "net", "com", "x.com:80", "", "abc.t", "same", "ÄB.com"]
    paths = ["", "/", "/es", "/es/", "/en/12/x", "/en/2", "/fr/", "/de/q", "/blocked", "/x/yz", "/x/", "/xx", "/abc/d", "/p/q", "//"]
    ends = ["", "?a=/es/://", "#t/fr/", "?x#y"]
    out = [rng.choice(["http", "https", ""]) + "://" + rng.choice(hosts) + rng.choice(paths) + rng.choice(ends) for _ in range(900)]
    return out + [None, "", "no scheme/es/", "http:/example.org/", "mailto:a@b", "x\ny://a.net/x\n/z", "http://" + "a." * 500 + "net/x/" + "y/" * 5000]


@pytest.mark.parametrize("block_bytes", [1 << 20, 12])
def test_url_rules(spark, block_bytes):
    rows = [(i, u, "h", "r") for i, u in enumerate(urls())]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, _row string").repartition(3)
    want = {i: plain_rule(u, RULES, "block") for i, u, *_ in rows}
    rules = RULES if block_bytes > 100 else spark.createDataFrame(RULES + [(None, "/", "allow"), ("x", None, "allow")], "host string, path string, verdict string")
    got = url_trie.filter_urls(pages, rules, "block", block_bytes=block_bytes)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == want
    assert {r["_row"] for r in got.collect()} == {"r"}


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [tuple(r) for r in url_trie.filter_urls(pages, []).collect()] == [(1, "http://a/b", "a", "/b", None, "allow")]
    assert url_trie.filter_urls(pages.filter("false"), RULES).count() == 0


# manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def proof_of(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 16
        out.append((level[first:i], level[i + 1 : first + 16]))
        i //= 16
    return out


def plain_manifest(rows):
    sources = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        low = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            low = url_trie.lower_ascii(text)
        leaf, changed = (digest(*map(plain_field, (doc_id, source, lang, n_chars, t))) for t in (text, low))
        sources[source].append(((doc_id is not None, doc_id or 0, leaf), leaf, changed, doc_id))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[1] for x in sorted(sources[s], key=lambda x: x[0])]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    out = Counter()
    for k, s in enumerate(names):
        for i, (_, leaf, changed, doc_id) in enumerate(sorted(sources[s], key=lambda x: x[0])):
            proof, at = proof_of(trees[s], i) + proof_of(top, k), changed
            for left, right in proof:
                at = digest(*left, at, *right)
            siblings = digest(*[x for left, right in proof for x in left + right])
            out[doc_id, leaf, trees[s][-1][0], top[-1][0], siblings, at, at == top[-1][0]] += 1
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def manifest(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit("clash"), "idx": F.lit(0)})
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    low = F.when(hit, F.translate("text", url_trie.UPPER, url_trie.LOWER)).otherwise(F.col("text"))
    got = merkle_log.verify(docs.repartition(3), {"text": low})
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r[c] for c in names) for r in got.collect())


def test_manifest(spark):
    rng = random.Random(1)
    rows = []
    for source, n in (("hot", 4500), ("é", 257), ("Z", 256), ("a", 17), ("b", 16), ("c", 1), (None, 300), ("", 3)):
        rows += [(rng.randrange(10**6), f"Text {rng.random()}", rng.choice(["en", None]), source, rng.choice([1, None])) for _ in range(n)]
    rows += [(5, "Same", "en", "dup", 4)] * 40 + [(None, None, None, "dup", None)] * 3 + [(7, "", "en", "dup", 0), (8, "X" * 300_000, "en", "dup", 0)]
    rows += [(i, "T", "en", f"s{i:03d}", 1) for i in range(300)]
    want = plain_manifest(rows)
    assert {v for *_, v in want} == {True, False}
    assert manifest(spark, rows) == want


@pytest.mark.parametrize("rows", [[(1, "A", "en", "s", 1)], [(None, None, None, None, None)] * 2, [(1, "A", None, None, 1), (2, "B", None, "s", 1)]])
def test_small_manifests(spark, rows):
    assert manifest(spark, rows) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle_log.verify(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_postorder(levels):
    out = []

    def walk(level, i):
        if level:
            for j in range(16 * i, min(16 * i + 16, len(levels[level - 1]))):
                walk(level - 1, j)
        out.append((level, i))

    walk(len(levels) - 1, 0)
    return out


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 4097, 5000])
def test_positions_are_those_of_a_postorder_walk(n):
    order = plain_postorder(levels_of([str(i) for i in range(n)]))
    assert [merkle_log.position(n, level, i) for level, i in order] == list(range(len(order)))


def test_builders_write_one_log(spark):
    n = 1000
    levels = levels_of([digest(str(i)) for i in range(n)])
    leaves = spark.range(n).select(
        F.lit(3).cast("long").alias("tree"), F.lit(n).cast("long").alias("n"), F.col("id").alias("idx"),
        F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"),
    )
    tiers = merkle_log.build(leaves, n, "t")
    log, at = b"", 0
    for r in sorted(merkle_log.log_of(tiers).collect(), key=lambda r: r["first"]):
        assert r["first"] == at
        log, at = log + bytes(r["nodes"]), at + len(r["nodes"]) // 32
    assert log.hex() == "".join(levels[level][i] for level, i in plain_postorder(levels))
    assert [bytes(r["root"]).hex() for r in merkle_log.roots(tiers).collect()] == [levels[-1][0]]


def test_tasks_of_one_worker_share_the_table_of_parts(monkeypatch):
    aligned = []
    plain = token_spans.PairTable._align
    monkeypatch.setattr(token_spans.PairTable, "_align", lambda self, new: (aligned.extend(new), plain(self, new))[1])
    run = token_spans._align(*token_spans.default_paths(), "_text", ("n_a", "groups_sha256"))
    batch = pa.RecordBatch.from_pydict({"_text": ["shared words of zqxv tasks", "more shared words"]})
    first, seen = list(run(iter([batch]))), len(aligned)
    assert seen and list(run(iter([batch]))) == first
    assert len(aligned) == seen


def test_full_table_keeps_parts_that_come_back(monkeypatch):
    monkeypatch.setattr(token_spans, "TABLE", 40)
    aligned = []
    plain = token_spans.PairTable._align
    monkeypatch.setattr(token_spans.PairTable, "_align", lambda self, new: (aligned.extend(new), plain(self, new))[1])
    table = token_spans.PairTable(*token_spans.default_paths(), ("n_a", "links", "groups_sha256"))
    common = [f"common{i}ß" for i in range(10)]
    want = None
    for k in range(12):
        codes = table.add([common, [f"once{k}x{i}" for i in range(20)]])
        got = [(table.digests[c], table.counts["n_a"][c], *table.lists["links"].take(np.array([c]))) for c in codes[:10]]
        assert want is None or got == want
        want = got
        assert len(table.codes) <= 40 + 20 and list(table.codes.values()) == list(range(len(table.codes)))
        assert table.size == table.bytes[: len(table.codes)].sum()
    assert Counter(aligned)[common[0]] == 1 and len(aligned) == 10 + 12 * 20
    # Columns that nobody wants are not held.
    assert set(table.counts) == {"n_a"} and set(table.lists) == {"links"}


def test_scoring_gives_back_the_table_of_parts():
    table, want = token_spans._table, ("n_a", "links")
    list(token_spans._align(*token_spans.default_paths(), "_text", want)(iter([pa.RecordBatch.from_pydict({"_text": ["a b"]})])))
    assert table.cache_info().currsize == 1

    class Counts:
        value = tuple(np.zeros(0, np.int64) for _ in range(3))

    assert list(token_spans._score(Counts, 1)(iter([]))) == []
    assert table.cache_info().currsize == 0
