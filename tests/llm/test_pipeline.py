"""The whole pipeline against a plain version, and its stages one by one."""

import hashlib
import math
import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_llm import plain_components, plain_measures, prose
from varloom.llm import chunk_dedup, piece_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    passage = prose(40, 70)
    out = []
    for i in range(60):
        text = prose(100 + i, rng.randint(25, 250))
        if i % 6 == 0:
            text = text + "\n" + passage + " " + prose(500 + i, 30)
        out.append((i, text, "en", f"s{i % 3}", len(text)))
    for i in range(60, 75):
        words = out[i - 60][1].split(" ")
        words[len(words) // 2] = "edited"
        text = " ".join(words)
        out.append((i, text, "en", "s0", len(text)))
    junk = ["", None, "few words", "again " * 60, "# $ % " * 40, "line\n" * 30, "A" * 40 + " B" * 30]
    out += [(80 + i, t, None, None, None) for i, t in enumerate(junk)]
    out.append((95, "é漢😀 " + prose(900, 120), "fr", "s1", 10))
    return out


def plain_kept(rows):
    kept = []
    for r in rows:
        text = r[1] or ""
        words, chars, symbols, repeated, covered = plain_measures(text)
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
        capitals = sum("A" <= c <= "Z" for c in text)
        bad = (
            words < 20
            or 100 * covered > 30 * words
            or 10 * symbols > words
            or 2 * repeated > len(lines)
            or 2 * chars < 5 * words
            or chars > 14 * words
            or 100 * capitals > 40 * chars
        )
        if not bad:
            kept.append(r)
    return kept


def plain_chunks(data):
    h, last, ends = 0, 0, []

    def inside(i):
        return i >= len(data) or data[i] & 0xC0 != 0x80

    def close(c):
        nonlocal last
        while c - last > chunk_dedup.LONGEST:
            last += chunk_dedup.LONGEST
            while last < c and not inside(last):
                last += 1
            if last >= c:
                break
            ends.append(last)
        if not ends or ends[-1] != c:
            ends.append(c)
        last = c

    for i, b in enumerate(data):
        h = ((h << 1) + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        if i + 1 < len(data) and not h & int(chunk_dedup.MASK) and inside(i + 1) and i + 1 - last >= chunk_dedup.SHORTEST:
            close(i + 1)
    if data:
        close(len(data))
    return list(zip([0, *ends], ends))


def plain_cut(rows):
    """Runs of later chunks, grown byte by byte beside the first occurrences of their outermost chunks."""
    first = {}
    cut = {r[0]: (r[1].encode(), plain_chunks(r[1].encode())) for r in rows}
    for i in sorted(cut):
        for a, b in cut[i][1]:
            first.setdefault(cut[i][0][a:b], (i, a))
    out = []
    for r in rows:
        data, chunks = cut[r[0]]
        gone, run = set(), []
        for a, b in [*chunks, (None, None)]:
            if a is not None and first[data[a:b]] != (r[0], a):
                run.append((a, b))
                continue
            if run:
                lo, hi = run[0][0], run[-1][1]
                other, at = first[data[slice(*run[0])]]
                n = 0
                while n < min(chunk_dedup.REACH, lo, at) and data[lo - n - 1] == cut[other][0][at - n - 1]:
                    n += 1
                other, at = first[data[slice(*run[-1])]]
                at += run[-1][1] - run[-1][0]
                m = 0
                while m < min(chunk_dedup.REACH, len(data) - hi, len(cut[other][0]) - at) and data[hi + m] == cut[other][0][at + m]:
                    m += 1
                lo, hi = lo - n, hi + m
                while data[lo] & 0xC0 == 0x80:
                    lo += 1
                while hi < len(data) and data[hi] & 0xC0 == 0x80:
                    hi -= 1
                gone.update(range(lo, hi))
            run = []
        left, kept = 0, []
        while left < len(data):
            right = left
            while right < len(data) and (right in gone) == (left in gone):
                right += 1
            if left not in gone or right - left < chunk_dedup.MIN_RUN:
                kept.append(data[left:right])
            left = right
        text = b"".join(kept).decode()
        out.append((r[0], text, r[2], r[3], len(text)))
    return out


def plain_mix(rows, seed=17):
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1])
    shares = {s: n**0.7 for s, n in size.items() if n}
    out = []
    for r in rows:
        rate = round(shares[r[3]] / sum(shares.values()) * sum(size.values()) / size[r[3]], 9)
        parts, n = max(math.ceil(rate / 16), 1), 0
        for k in range(parts):
            u = (int(hashlib.md5(f"{seed}:{r[0]}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = below = math.exp(-rate / parts)
            m = 0
            while below < u:
                m += 1
                p *= rate / parts / m
                below += p
            n += m
        out += [r] * n
    return out


def test_pipeline(spark, rows, tmp_path):
    import sentencepiece

    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = plain_kept(rows)
    keepers = {k[0] for k in plain_components(good, 5, 80) if k[3]}
    mixed = plain_mix(plain_cut([r for r in good if r[0] in keepers]))
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_table.default_model())
    want = Counter()
    for r in mixed:
        ids = lib.encode(r[1], add_bos=True, add_eos=True)
        want[r[0], len(ids), tuple(ids), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert len(good) < len(rows) and len(keepers) < len(good)
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in got) == want


def test_stages_keep_the_columns(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == list(corpus_pipeline.COLUMNS)


def test_stages_on_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_rows_are_told_apart(spark):
    one, other, last = (prose(s, 80) for s in (1, 2, 3))
    rows = [
        (1, one, "en", "s", 1),
        (1, one, "en", "s", 1),
        (3, one + " tail", "en", "s", 1),
        (3, other, "en", "s", 1),
        (None, last, "en", "s", 1),
        (None, last, "de", "s", 1),
        (None, other, "en", "s", 1),
        (9, last + " tail", "en", "s", 1),
        (None, None, None, None, None),
    ]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(1, one), (None, other), (None, last), (None, None)])
