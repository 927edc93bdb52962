"""Training-data operators on hand-made tables, against plain versions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import (
    chunk_dedup,
    exact_topk,
    language_id,
    minhash,
    mixing,
    page_text,
    piece_table,
    quality_rules,
    suffix_dedup,
    toxicity,
)

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper larch maple oak pine rowan spruce".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, score string, n_words string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, passage = prose(1, 300), prose(2, 60)
    near = base.split()
    near[10] = "changed"
    texts = [
        base,
        base,
        " ".join(near),
        base.upper(),
        prose(3, 40) + " " + passage + " " + prose(4, 40),
        prose(5, 50) + "\n" + passage + "\n" + prose(6, 30),
        passage,
        "",
        None,
        " \n\t ",
        "one",
        "two words",
        "same line here\n" * 30,
        "a" * 5000,
        "é漢😀 ▁ x y " * 40,
        prose(7, 20000),
        "!!! ### $$$ " * 30,
        "0123456789" * 30 + passage,
    ]
    out = [(i, t, "en" if i % 2 else None, "s%d" % (i % 3), 0, "k", "s", "w") for i, t in enumerate(texts)]
    out.append((None, base, None, None, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None))
    out.append(out[4])  # a repeated row
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# quality rules


def plain_measures(text):
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_quality_measures(docs, rows):
    got = quality_rules.apply_policy(quality_rules.ledger(docs)).collect()
    want = Counter((r[0], *plain_measures(r[1])) for r in rows)
    names = quality_rules.MEASURES[:5]
    assert Counter((r["doc_id"], *[r[n] for n in names]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (r["failure_bits"] == 0)
        assert r["_k1"] in ("k", None)


def test_quality_filter_keeps_rows(docs):
    entries = quality_rules.apply_policy(quality_rules.ledger(docs))
    assert entries.filter("kept").count() == sum(r["kept"] for r in entries.select("kept").collect())


def test_ablations(docs):
    entries = quality_rules.ledger(docs).cache()
    bits = [r["failure_bits"] for r in entries.select("failure_bits").collect()]
    for r in quality_rules.ablations(entries).collect():
        policy = next(p for p in quality_rules.POLICIES if p.version == r["policy"])
        place = [x.name for x in quality_rules.RULES].index(r["rule"])
        assert r["n_rejected"] == sum(b >> place & 1 for b in bits)
        assert r["n_only_here"] == sum(b & policy.mask() == 1 << place for b in bits)
        assert r["n_rejected_by_policy"] == sum(b & policy.mask() > 0 for b in bits)


# near duplicates


def plain_components(rows, words, percent):
    def shingles(text):
        w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}

    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids) if sets[i] and ids else r[0]
        out.append((r[0], len(sets[i]), component, component == r[0]))
    return Counter(out)


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, rows, words):
    # A chain whose ends are far apart, and a family of close copies.
    rng = random.Random(8)
    more, text = [], prose(20, 120).split()
    for i in range(12):
        text = list(text)
        for _ in range(3):
            text[rng.randrange(len(text))] = "w%d" % rng.randrange(10**6)
        more.append((100 + i, " ".join(text), "", "", 0, "", "", ""))
    for i in range(40):
        copy = prose(21, 150).split()
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(len(copy))] = "v%d" % rng.randrange(10**6)
        more.append((200 + i, " ".join(copy), "", "", 0, "", "", ""))
    every = rows + more
    got = minhash.near_duplicates(spark.createDataFrame(every, SCHEMA), words=words).collect()
    assert Counter((r[0], r[1], r[2], r[3]) for r in got) == plain_components(every, words, 80)


def test_near_duplicates_of_nothing(none):
    assert minhash.near_duplicates(none).count() == 0


# suffixes


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(150):
        n, k = rng.randint(2, 60), rng.choice([1, 2, 3, 5])
        text = np.array([rng.randint(1, k) for _ in range(n)] + [0], np.int16)
        got = suffix_dedup.suffix_order(text, k + 1, 200, limit=rng.choice([64, 1 << 20])).tolist()
        want = sorted(range(n + 1), key=lambda i: text[i:].tolist())
        assert [i for i in got if i != n] == [i for i in want if i != n]


def plain_windows(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,shard,limit", [(200, 48, 1 << 22, 1 << 26), (60, 16, 1000, 4096)])
def test_repeated_strings(docs, rows, length, gram, shard, limit):
    got = suffix_dedup.remove_repeats(docs, length=length, gram=gram, shard_bytes=shard, limit=limit).collect()
    want = plain_windows([(r[1] or "").encode() for r in rows], length)
    assert Counter(tuple(r) for r in got) == Counter((r[0], *w) for r, w in zip(rows, want))


def test_repeated_strings_in_pieces(monkeypatch, spark):
    passage = prose(2, 80)
    texts = [prose(9, 900) + passage, prose(10, 700) + passage + prose(11, 200)]
    data = [t.encode() for t in texts]
    whole = np.frombuffer(b"".join(data), np.uint8)
    edges = np.cumsum([0] + [len(d) for d in data])
    keys = suffix_dedup.contexts(whole, edges)[2]
    apart = [suffix_dedup.contexts(np.frombuffer(d, np.uint8), np.array([0, len(d)]))[2] for d in data]
    assert sorted(keys) == sorted(np.concatenate(apart))


def test_hot_anchors_fit_a_shard(spark, monkeypatch):
    # One line in every document with other neighbours, one with the same text on one side, and copies.
    line, tail = prose(50, 12), prose(51, 60)
    texts = [f"{prose(1000 + i, 60)} {line} {prose(3000 + i, 60)}" for i in range(150)]
    texts += [f"{prose(5000 + i, 60)} {line} {tail}" for i in range(150)] + texts[:5]
    rows = [(i % 302, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def sort_shards(*_):
        def run(batches):
            for batch in batches:
                kept = batch.select(["key", "content", "body"])
                yield kept.rename_columns(["key", "content", "bits"])

        return run

    want = plain_windows([r[1].encode() for r in rows], 200)
    got = suffix_dedup.remove_repeats(docs, shard_bytes=4000).collect()
    assert Counter(tuple(r) for r in got) == Counter((r[0], *w) for r, w in zip(rows, want))
    # What reaches the sorting step, anchor by anchor.
    monkeypatch.setattr(suffix_dedup, "_sort_shards", sort_shards)
    made, store = [], suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, label: made.append((label, df)) or store(df, label))
    suffix_dedup.remove_repeats(docs, shard_bytes=4000)
    marks = [df for label, df in made if label == "marks"][0]
    assert marks.groupBy("key").agg(F.sum(F.length("bits")).alias("b")).agg(F.max("b")).first()[0] <= 4000


# chunks


def test_chunks_cover_texts():
    texts = [prose(3, 500), "", "a" * 3000, "é漢😀" * 300, "x"]
    data = [t.encode() for t in texts]
    edges = np.cumsum([0] + [len(d) for d in data])
    for d, lo, ends in zip(data, edges, chunk_dedup.cuts(np.frombuffer(b"".join(data), np.uint8), edges)):
        stops = [e - lo for e in ends]
        assert (stops[-1] if stops else 0) == len(d)
        parts = [d[a:b] for a, b in zip([0, *stops], stops)]
        assert b"".join(parts) == d
        assert all(len(p) <= chunk_dedup.LONGEST + 3 for p in parts)
        for p in parts:
            p.decode()


def test_cuts_find_their_places_again():
    passage = prose(30, 400).encode()
    ends = []
    for front in (b"", b"something else in front, "):
        d = np.frombuffer(front + passage, np.uint8)
        ends.append({e - len(front) for e in chunk_dedup.cuts(d, np.array([0, len(d)]))[0]})
    late = [{e for e in x if e > 600} for x in ends]
    assert late[0] == late[1]


def test_repeats_go_once(docs, rows):
    got = chunk_dedup.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["n_removed"] == 0  # upper case differs
    assert by_id[4]["n_removed"] == 0  # the smaller id keeps the passage
    for i in (5, 6, 17):
        assert by_id[i]["n_removed"] > 150
    assert by_id[7]["text"] == "" and by_id[8]["text"] is None
    texts = {r[0]: r[1] for r in rows}
    for i, r in by_id.items():
        if i is not None and texts[i] is not None:
            assert len(r["text"].encode()) == len(texts[i].encode()) - r["n_removed"]
    # Copies: the row with a null id sorts first and stays.
    assert by_id[0]["text"] == "" and by_id[1]["text"] == ""


def test_passages_of_fifty_words_go():
    # Passages of 51 words between other text: the share that is removed, counted by byte strings alone.
    lost = []
    for k in range(300):
        passage = prose(20000 + k, 51).encode()
        front = [prose(30000 + 2 * k + i, 20).encode() + b" " for i in (0, 1)]
        back = [b" " + prose(40000 + 2 * k + i, 20).encode() for i in (0, 1)]
        held = []
        for i in (0, 1):
            d = front[i] + passage + back[i]
            ends = chunk_dedup.cuts(np.frombuffer(d, np.uint8), np.array([0, len(d)]))[0]
            held.append([(a, b, d[a:b]) for a, b in zip([0, *ends], ends)])
        # One run for each repeated chunk, with what stands beside its first occurrence.
        d, seen, found = front[0] + passage + back[0], {}, []
        for a, b, x in held[0]:
            seen.setdefault(x, (a, b))
        for a, b, x in held[1]:
            if x in seen:
                i, j = seen[x]
                found.append((a, b, d[max(i - chunk_dedup.REACH, 0) : i], d[j : j + chunk_dedup.REACH]))
        gone = chunk_dedup.lengthened(front[1] + passage + back[1], found, chunk_dedup.MIN_RUN)
        lost.append(sum(b - a for a, b in gone) / len(passage))
    assert min(lost) > 0.5 and sum(lost) / len(lost) > 0.85


def test_empty_tables(none):
    assert chunk_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert mixing.replicate(none).count() == 0
    assert piece_table.encode(none).count() == 0
    assert language_id.identify(none).count() == 0
    assert quality_rules.apply_policy(quality_rules.ledger(none)).count() == 0


# mixing


def test_mixing_counts(docs, rows):
    got = mixing.replicate(docs, weights={"s0": 1.0, "s1": 3.0}, total=40000.0, seed=5).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1] or "")
    seen = Counter(r["doc_id"] for r in got)
    rate = {"s0": 0.25 * 40000 / size["s0"], "s1": 0.75 * 40000 / size["s1"]}
    for r in {r[0]: r for r in rows if r[0] is not None}.values():
        lam, n = rate.get(r[3], 0.0), 0
        if lam:
            parts = max(math.ceil(lam / 16), 1)
            for k in range(parts):
                digits = hashlib.md5(f"5:{r[0]}:{k}".encode()).hexdigest()[:13]
                u, p, m = (int(digits, 16) + 0.5) / 2**52, math.exp(-lam / parts), 0
                below = p
                while below < u and m < 80:
                    m += 1
                    p *= lam / parts / m
                    below += p
                n += m
        assert seen[r[0]] == n * sum(x == r for x in rows)


def test_mixing_mean(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "'abcd' AS text", "IF(id % 4 = 0, 'x', 'y') AS source")
    got = mixing.replicate(df, weights={"x": 1, "y": 1}).groupBy("source").count().collect()
    for r in got:
        assert abs(r["count"] - 40000 / 4) < 400
    one = [r["doc_id"] for r in mixing.replicate(df).collect()]
    assert one == [r["doc_id"] for r in mixing.replicate(df.repartition(7)).collect()]
    assert one != sorted(one)


# pieces


def test_pieces_are_the_library_s(docs, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_table.default_model())
    extra = ["<s> </s> <unk> <0x41>", "  ", " x", "▁", "x ", "\n\n", "\x00\x01", "word" * 3000, "�é́"]
    table = piece_table.ChunkTable(piece_table.default_model())
    for text, (ids, decoded) in zip(extra, piece_table.encode_batch(table, extra)):
        want = lib.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want and decoded == lib.decode(want)
    got = piece_table.encode(docs, ("n_tokens", "ids", "decoded", "ids_sha256")).collect()
    seen = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"], r["ids_sha256"]) for r in got)
    want = Counter()
    for r in rows:
        ids = lib.encode(r[1] or "", add_bos=True, add_eos=True)
        want[r[0], tuple(ids), lib.decode(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += 1
    assert seen == want


def test_small_piece_table_gives_the_same(monkeypatch):
    texts = [prose(i, 50) for i in range(30)]
    big = piece_table.encode_batch(piece_table.ChunkTable(piece_table.default_model()), texts)
    monkeypatch.setattr(piece_table, "TABLE", 10)
    table = piece_table.ChunkTable(piece_table.default_model())
    for text, (ids, decoded) in zip(texts, big):
        again = piece_table.encode_batch(table, [text])[0]
        assert again[0].tolist() == ids.tolist() and again[1] == decoded


# language and toxicity


def test_language(spark):
    rng = random.Random(2)
    alphabets = {"aa": "abcde ", "bb": "vwxyz ", "cc": "mnopq "}
    data = [(i, "".join(rng.choice(alphabets[k]) for _ in range(80)), k) for i, k in enumerate(list(alphabets) * 60)]
    data += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None), (None, "abcabc", "zz"), (903, "x" * 600000, None)]
    got = language_id.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(data)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == k for i, _, k in data[:180])
    assert [by_id[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert by_id[None]["held_out"] and by_id[None]["lang_pred"] == "aa"
    assert by_id[903]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_every_language_can_be_predicted(spark):
    # 70 languages, the last ones the rarest; in blocks of 16 the answers are the same as in one block.
    rng = random.Random(9)
    data = []
    for k in range(70):
        letters = [chr(0x4E00 + 10 * k + j) for j in range(10)]
        n = 9 if k < 64 else 6
        data += [(len(data) + i, "".join(rng.choice(letters) for _ in range(40)), f"l{k:02d}") for i in range(n)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    whole = {r["doc_id"]: r for r in language_id.identify(docs, block_langs=100).collect()}
    assert all(whole[i]["lang_pred"] == k for i, _, k in data)
    for r in language_id.identify(docs).collect() + language_id.identify(docs, block_langs=16).collect():
        assert r["lang_pred"] == whole[r["doc_id"]]["lang_pred"]
        assert r["score"] == pytest.approx(whole[r["doc_id"]]["score"], rel=1e-9)


def test_grams_of_pieces_are_those_of_the_text(monkeypatch):
    text = prose(4, 300)
    whole = np.bincount(np.concatenate(list(language_id.gram_buckets(text))), minlength=language_id.BUCKETS)
    monkeypatch.setattr(language_id, "_PIECE", 64)
    parts = np.bincount(np.concatenate(list(language_id.gram_buckets(text))), minlength=language_id.BUCKETS)
    assert (whole == parts).all()


def plain_bayes(rows):
    """Naive Bayes with dictionaries over hashed grams, one gram at a time."""
    word = (1 << 64) - 1

    def mixed(x):
        for _ in range(2):
            x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & word
        return x ^ (x >> 32)

    def grams(text):
        points = [ord(c) for c in text.lower()]
        for n in (1, 2, 3):
            for i in range(len(points) - n + 1):
                h = n
                for k in range(n):
                    h = (h * 0x9E3779B97F4A7C15 + points[i + k]) & word
                yield mixed(h) >> 48

    def has_letter(text):
        return bool(text) and any(c.isalpha() for c in text)

    counts, seen = {}, Counter()
    for i, text, lang in rows:
        if i is None or lang is None or zlib.crc32(str(i).encode()) % 3 == 1:
            continue
        seen[lang] += 1
        counts.setdefault(lang, Counter()).update(grams(text) if has_letter(text) else ())
    out = {}
    for i, text, _ in rows:
        if not has_letter(text) or not seen:
            out[i] = ("und", 0.0)
            continue
        scores = {}
        for lang in sorted(seen):
            total = sum(counts[lang].values()) + 0.1 * 65536
            scores[lang] = math.log(seen[lang] / sum(seen.values())) + sum(
                n * math.log((counts[lang][g] + 0.1) / total) for g, n in Counter(grams(text)).items()
            )
        best = max(scores, key=scores.get)
        out[i] = (best, 1 / sum(math.exp(x - scores[best]) for x in scores.values()))
    return out


@pytest.mark.parametrize("block", [64, 2])
def test_language_equals_plain_bayes(spark, monkeypatch, block):
    rng = random.Random(4)
    kinds = {"a": "aabcde", "b": "abbcdf", "c": "abccdg", "d": "abcdeé", "e": "xyzab "}
    rows = [
        (i, "".join(rng.choice(kinds[lang] + "ABC  12") for _ in range(rng.choice([0, 1, 3, 8, 30, 200]))), lang if i % 9 else None)
        for i, lang in enumerate(rng.choices("abcde", k=150))
    ]
    rows += [(1000, None, "a"), (1001, "123 !", "b"), (1002, "x" * 3000, "e")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), block_langs=block).collect()
    want = plain_bayes(rows)
    for r in got:
        assert r["lang_pred"] == want[r["doc_id"]][0] and r["score"] == pytest.approx(want[r["doc_id"]][1], rel=1e-3, abs=1e-6)


def plain_label_model(votes, gold, rounds):
    """The same estimate row by row and voter by voter, without correlations."""
    x = [[*v, g] for v, g in zip(votes, gold)]
    post = [0.05 + 0.9 * g for g in gold]
    for _ in range(rounds):
        n1 = sum(post)
        n0 = len(post) - n1
        prior = ((n1 + 1) / (len(post) + 2), (n0 + 1) / (len(post) + 2))
        on = [[(sum(w * r[j] for w, r in zip(ws, x)) + 0.5) / (n + 1) for j in range(len(x[0]))] for ws, n in (([1 - p for p in post], n0), (post, n1))]
        new = []
        for r in x:
            z = math.log(prior[0] / prior[1])
            for j, v in enumerate(r):
                z += math.log(on[1][j] / on[0][j]) if v else math.log((1 - on[1][j]) / (1 - on[0][j]))
            new.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        post = new
    return post


def test_label_model_equals_a_plain_one():
    rng = random.Random(3)
    truth = [int(rng.random() < 0.3) for _ in range(200)]
    votes = np.array([[int(rng.random() < (a if t else 1 - a)) for a in (0.9, 0.8, 0.7)] for t in truth])
    gold = np.array([t if rng.random() < 0.95 else 1 - t for t in truth])
    # Up to five rounds no correlation is looked for.
    got, _, share = toxicity.label_model(votes, gold, rounds=5)
    assert got == pytest.approx(plain_label_model(votes.tolist(), gold.tolist(), 5), rel=1e-9) and (share == 1).all()
    full, rate, share = toxicity.label_model(np.column_stack([votes, votes[:, 0]]), gold)
    assert share[0] == share[3] == 0.5 and share[1] == 1
    assert np.mean((full > 0.5) == np.array(truth)) > 0.9 and (rate[1] > rate[0]).all()


def test_regression_ends_where_the_gradient_is_zero():
    rng = np.random.default_rng(2)
    dense = rng.random((300, 6)) < 0.4
    target = 1 / (1 + np.exp(-(dense @ [2.0, -1.0, 0.5, 0, 0, 1] - 1)))
    rows, columns = np.nonzero(dense)
    w, b = toxicity.fit_linear(rows, columns, target, 6, penalty=0.01, rounds=3000)
    error = 1 / (1 + np.exp(-(dense @ w + b))) - target
    assert np.abs(dense.T @ error / 300 + 0.01 * w).max() < 1e-3 and abs(error.mean()) < 1e-3


def test_toxicity(spark):
    rng = random.Random(3)
    data, labels = [], []
    for i in range(400):
        words = [rng.choice(WORDS) for _ in range(60)]
        if i % 8 == 0:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["scoundrel", "rascal", "villain"])
        data.append((i, " ".join(words)))
        labels.append((i, int(i % 8 == 0)))
    data += [(1000, None), (1001, ""), (None, "villain"), (1002, "rascal " * 100000)]
    labels += [(1000, None), (None, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, truth).collect()}
    assert len(got) == len(data)
    assert sum(got[i]["predicted"] != int(i % 8 == 0) for i in range(400)) <= 2
    assert got[1000]["score"] == got[1001]["score"] < 0.5 and got[1002]["predicted"] == 1
    blank = toxicity.score_toxicity(docs, truth.filter("toxic = 0")).agg(F.max("score")).first()[0]
    assert blank < 1e-9


# pages


def cover(streams, n=page_text.MIN_TOKENS, pages=page_text.MIN_PAGES):
    """Covered tokens of all pages of one host, in one suffix array over whole pages."""
    sizes = np.array([len(s) for s in streams], np.int64)
    names = {}
    stream = np.array([names.setdefault(t, len(names)) for s in streams for t in s], np.int64)
    first = np.zeros(len(stream), bool)
    starts = np.cumsum(sizes) - sizes
    for s, at in zip(streams, starts.tolist()):
        seen = set()
        for i in range(len(s) - n + 1):
            first[at + i] = tuple(s[i : i + n]) not in seen
            seen.add(tuple(s[i : i + n]))
    found = page_text.repeated_windows(stream, starts, sizes, np.ones(len(sizes), np.int64), first, n, pages)
    covered = np.zeros(len(stream), bool)
    for i in np.flatnonzero(found):
        covered[i : i + n] = True
    return np.split(covered, np.cumsum(sizes)[:-1])


def main_texts(pages):
    parsed = [page_text.blocks(p or "") for p in pages]
    covers = cover([[t for text, _ in page for t in text.split(" ")] for page in parsed])
    return [page_text._kept(page, c) for page, c in zip(parsed, covers)]


def test_quotes_open_values_only_behind_an_equals_sign():
    page = "<article><p data-x=don't>one</p><p>two</p><p data-y=can't>three</p><a title='a>b' it's x=\"q>r\">four</a></article>"
    assert page_text.blocks(page) == [("one", "main"), ("two", "main"), ("three", "main"), ("four", "main")]
    start = time.time()
    assert page_text.blocks("<a " + "=x' " * 20000) and time.time() - start < 5


def test_doubtful_parts_of_articles_stay_unless_pages_repeat_them(spark):
    stock = prose(61, 14)
    html = [
        f"<article><p>{prose(i, 20)}</p><p class='legal'>{prose(50 + i, 10)} {stock}</p><div class=related-work>{prose(80 + i, 9)}</div>"
        f"<div class=comments>{prose(90 + i, 5)}</div></article>"
        for i in range(5)
    ]
    pages = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(html)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.extract_text(pages).collect()}
    for i in range(5):
        assert got[i] == "\n".join([prose(i, 20), prose(50 + i, 10), prose(80 + i, 9)])


def test_page_text():
    pages = [
        "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one<br>two <b>th</b>ree"
        "<p>four</article><footer>f</footer>",
        None,
        "",
        "<p>cut off &lt",
        "<div class='cookie-notice'>x</div><main><div>y</div><div class=\"comments\"><p>z</p></div></main>",
        "<article><header><h2>Head</h2></header><form>f</form><aside>s</aside><p>body</p></article><p>after</p>",
        '<script>var t="</p>";</script><style>p{}</style><p>shown<!-- hidden --></p>',
    ]
    got = [t for t, _, _ in main_texts(pages)]
    assert got == ["A & B\none two three\nfour", "", "", "cut off <", "y", "Head\nbody", "shown"]


def plain_cover(streams, n, pages):
    where = {}
    for k, s in enumerate(streams):
        for i in range(len(s) - n + 1):
            where.setdefault(tuple(s[i : i + n]), set()).add(k)
    out = []
    for s in streams:
        c = [False] * len(s)
        for i in range(len(s) - n + 1):
            if len(where[tuple(s[i : i + n])]) >= pages:
                c[i : i + n] = [True] * n
        out.append(c)
    return out


def test_covered_tokens():
    rng = random.Random(5)
    for _ in range(40):
        streams = [[rng.choice("abc") for _ in range(rng.randrange(30))] for _ in range(rng.randrange(1, 7))]
        for n in (1, 3, 5, 8):
            got = [c.tolist() for c in cover(streams, n, 3)]
            assert got == plain_cover(streams, n, 3)


def test_host_text_without_markup_goes(spark):
    stock = "this site is brought to you by the friends of all trees and shrubs"
    rows = [(i, f"http://h/{i}", f"<p>{prose(i, 30)}</p><p>{stock}</p>") for i in range(12)]
    rows += [(None, None, None), (5, "http://h/5", "<p>again</p>"), (50, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_row", F.lit(1))
    got = page_text.extract_text(pages, parts=2).collect()
    assert len(got) == len(rows)
    for r in got:
        assert stock not in r["text"] and r["n_chars"] == len(r["text"]) and r["_row"] == 1
    assert sum(prose(i, 30) in r["text"] for i in range(12) for r in got) == 12


def test_runs_are_counted_over_the_whole_host(spark, monkeypatch):
    # Text on three pages far apart of a large host, next to unique text in the same block.
    stock = prose(60, 12)
    html = [f"<p>{prose(100 + i, 9)}{' ' + stock if i % 250 == 7 else ''}</p>" for i in range(700)]
    html += ["<div>" + prose(70, 20) + "</div>", None, f"<article>{stock}</article>"]
    rows = [(i, "http://h/x", p) for i, p in enumerate(html)] + [(1, "http://other/", f"<p>{stock}</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = [(i, *m) for i, m in enumerate(main_texts(html))] + [(1, stock, 1, 0)]
    for parts in (2, 9):
        got = page_text.extract_text(pages, parts=parts).collect()
        assert Counter((r["page_id"], r["text"], r["n_blocks"], r["n_covered"]) for r in got) == Counter(want)
    assert sum(w[3] for w in want) == 4 * 12 and want[7][1] == prose(107, 9)
    # Anchors with many contexts are cut into windows; the answer is the same.
    monkeypatch.setattr(page_text, "MOST_CONTEXTS", 1)
    monkeypatch.setattr(page_text, "SHARD_TOKENS", 20)
    got = page_text.extract_text(pages, parts=3).collect()
    assert Counter((r["page_id"], r["text"], r["n_blocks"], r["n_covered"]) for r in got) == Counter(want)


# search


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(300, 6)), np.tile(rng.normal(size=(1, 6)), (60, 1))]).astype(np.float32)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(400, None), (401, []), (402, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (403, [float("nan")] * 6)]
    rows += [(404, [float("inf")] * 6), (None, [1.0] * 6), (410, [1.0, 2.0]), (420, [2.0, 3.0]), rows[7], rows[310]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = exact_topk.top_k(df, F.col("vec_id") % 10 == 0, k=5)
    answer = {}
    for r in got.collect():
        answer.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 360, 10):
        scores = whole @ whole[q]
        order = sorted((i for i in range(360) if i != q), key=lambda i: (-scores[i], i))[:5]
        assert sorted(answer[q]) == [(n + 1, i, int(scores[i])) for n, i in enumerate(order)]
    assert [a[1] for a in answer[410]] == [420] and [a[1] for a in answer[420]] == [410]
    assert not set(answer) & {400, 401, 402, 403, 404, None}


def test_top_k_of_large_components(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(exact_topk, "SHARD", 30)
    rows = []
    for i in range(120):
        large = [0.0, 0.0, 1e7, -1e7, 1e12, 3e13][rng.randrange(6)]
        rows.append((i, [large, rng.uniform(-2, 2), rng.uniform(-1e3, 1e3), float(rng.randrange(-3, 4))]))
    rows += [(200, [2.0**53, 0.25, 0.0, 0.0]), (201, [0.0, 1.0, 0.0, 0.0]), (202, [1e300, 0.0, 0.0, 0.0])]
    got = exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=5)
    low, high = -(2**63) + 1, 2**63 - 1
    whole = {i: [max(low - 1, min(high, math.floor(256 * x))) for x in v] for i, v in rows}
    answer = {}
    for r in got.collect():
        answer.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in [i for i in whole if i % 10 == 0]:
        scores = {i: max(low, min(high, sum(a * b for a, b in zip(whole[q], v)))) for i, v in whole.items() if i != q}
        order = sorted(scores, key=lambda i: (-scores[i], i))[:5]
        assert sorted(answer[q]) == [(n + 1, i, scores[i]) for n, i in enumerate(order)]


def test_top_k_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "SHARD", 40)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = exact_topk.top_k(df, F.col("vec_id") % 5 == 0, k=3).collect()
    whole = np.floor(256 * x).astype(np.int64)
    assert len(got) == 240
    for r in got:
        scores = whole @ whole[r["query_id"]]
        order = sorted((i for i in range(400) if i != r["query_id"]), key=lambda i: (-scores[i], i))
        assert order[r["rank"] - 1] == r["vec_id"] and scores[r["vec_id"]] == r["score"]


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_topk.top_k(df, F.col("vec_id") % 5 == 0).count() == 0


def test_texts_beyond_a_chunk(spark):
    text = prose(7, 260_000)
    assert len(text) > 1.4 * (1 << 20)
    cut = text[700_000:1_200_000]
    docs = spark.createDataFrame([(1, text), (2, "other words before " + cut), (3, text + " tail"), (4, "small")], "doc_id long, text string")
    pair = docs.filter("doc_id < 3")
    by_id = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(pair).collect()}
    assert by_id[1]["n_removed"] == by_id[2]["n_removed"] == len(cut) and by_id[1]["n_spans"] == 1
    by_id = {r["doc_id"]: r for r in chunk_dedup.remove_repeats(pair).collect()}
    assert by_id[1]["n_removed"] == 0 and len(cut) <= by_id[2]["n_removed"] <= len(cut) + 3
    groups = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert groups == {1: 1, 2: 2, 3: 1, 4: 4}
    pages = spark.createDataFrame([(1, "http://h/", f"<nav>m</nav><article><p>{text}</p></article>")], "page_id long, url string, html string")
    assert page_text.extract_text(pages).first()["text"] == " ".join(text.split())


def test_empty_tables_of_the_other_operators(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(none, labels).count() == 0 and minhash.near_duplicates(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert page_text.extract_text(pages).count() == 0
    assert exact_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_pieces_with_dotted_columns(spark):
    docs = spark.createDataFrame([(1, "two words", 3)], "doc_id long, text string, `a.b` int")
    assert piece_table.encode(docs, ("n_tokens",)).first()["a.b"] == 3
