"""Alignment of two tokenizers by the bytes that their tokens cover.

Tokenizer A is a byte-level BPE of the tokenizers library and gets the text behind one space; B is a
sentencepiece model, which adds that space itself. Coarse ends come from the libraries: character
offsets of A, turned into byte offsets, and the byte spans of B's pieces. (The installed sentencepiece
refuses the name "immutable_proto"; it gives the spans of that proto as ``return_type="offset_mapping"``.) A
token whose coarse span is not as long as its decoded bytes covers a part of a character or is a
byte-fallback piece: its end is then counted in decoded bytes from the last token that fits.

Byte offsets where tokens of both sides end cut a text into groups; a link is a pair of tokens that
end together. Both sides are independent across a single space between other characters, so each
distinct part between such spaces is aligned once while a worker holds it, and documents are put together by
position. A full table keeps the parts that came back most often. ``piece_table.check_model`` refuses a model for which this does not hold.

How many pairs can be counted is bounded by the vocabularies alone: of two tokens that end together
the shorter is a suffix of the longer, so there are no more pairs of ids than bytes in both
vocabularies (:func:`most_pairs`, under a million for the usual ones). That bound, not the corpus,
limits the table of counts that is collected and broadcast.

Defined cases: a null or empty text, and one whose tokens do not give back its bytes (B writes the
marker U+2581 as a space), have no tokens: zeros, empty arrays and an empty digest. Strings of special
tokens are plain text. Ids play no part, so null and repeated ones are kept as they are; further
columns are carried along, those named like an output are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from varloom.llm.common import map_rows, spans, stored, text_bytes
from varloom.llm.piece_table import MARK, check_model

#: Distinct parts, and bytes of them, that a Python worker keeps.
TABLE, TABLE_BYTES = 300_000, 32 << 20
#: Characters of new parts that are tokenized in one call.
CALL = 16_384
#: A single space between two characters that are not white space.
GAP = re.compile(r"(?<=\S) (?=\S)")
#: A single space next to other white space.
CROWDED = re.compile(r"\s | \s")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

OUTPUTS = {
    "n_a": "bigint",
    "n_b": "bigint",
    "n_groups": "bigint",
    "n_links": "bigint",
    "links": "array<int>",
    "groups_sha256": "string",
    "a_ids": "array<int>",
    "b_ids": "array<int>",
    "a_sizes": "array<int>",
    "b_sizes": "array<int>",
    "group_bytes": "array<int>",
}
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
LISTS = ("links", "a_ids", "b_ids", "a_sizes", "b_sizes", "group_bytes")
_TENS = 10 ** np.arange(1, 10)


def parts_of(text: str) -> list[str]:
    """Parts of a text between single spaces, each of which belongs to the part behind it."""
    if not text:
        return []
    if text[0] == " " or text[-1] == " " or CROWDED.search(text):
        return GAP.split(text)
    return text.split(" ")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: a printable byte is itself, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load_a(path: str):
    """Tokenizer A and the bytes of each of its ids."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_padding()
    tokenizer.no_truncation()
    alphabet = byte_alphabet()
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    entries = [b""] * (max(tokenizer.get_vocab().values()) + 1)
    for token, i in vocab.items():
        entries[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    return tokenizer, entries


def load_b(path: str):
    """Tokenizer B and the bytes of each of its ids."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    check_model(processor)
    entries = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        byte = _BYTE_PIECE.fullmatch(piece) if processor.is_byte(i) else None
        entries.append(bytes([int(byte[1], 16)]) if byte else piece.replace(MARK, " ").encode())
    return processor, entries


def most_pairs(path_a: str, path_b: str) -> int:
    """Bound on the pairs of ids that can end together: each is one suffix of one entry."""
    return sum(map(len, load_a(path_a)[1])) + sum(map(len, load_b(path_b)[1]))


class Ragged:
    """Rows of numbers of unequal length, appended and taken by row number."""

    def __init__(self, kind):
        self.flat, self.ends, self.used, self.n = np.empty(1 << 16, kind), np.zeros(1 << 14, np.int64), 0, 0

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = _room(self.flat, self.used + len(flat))
        self.ends = _room(self.ends, self.n + len(sizes) + 1)
        self.flat[self.used : self.used + len(flat)] = flat
        self.ends[self.n + 1 : self.n + len(sizes) + 1] = self.used + np.cumsum(sizes)
        self.used, self.n = self.used + len(flat), self.n + len(sizes)

    def keep(self, rows: np.ndarray) -> None:
        flat, sizes = self.take(rows), self.sizes(rows)
        self.used = self.n = 0
        self.flat, self.ends = self.flat[:0], np.zeros(1, np.int64)
        self.append(flat, sizes)

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.ends[rows + 1] - self.ends[rows]

    def take(self, rows: np.ndarray) -> np.ndarray:
        return self.flat[_places(self.ends[rows], self.sizes(rows))]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def refined_ends(coarse_from: np.ndarray, coarse_to: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens, counted in decoded bytes where a coarse span does not fit them."""
    fits = coarse_to - coarse_from == sizes
    if fits.all():
        return coarse_to
    counted = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(fits, np.arange(len(sizes)), -1))
    known, behind = np.where(last >= 0, coarse_to[last], 0), np.where(last >= 0, counted[last], 0)
    return np.where(fits, coarse_to, known + counted - behind)


class PairTable:
    """Alignments of the parts that a worker has seen, as far as the wanted columns need them."""

    def __init__(self, path_a: str, path_b: str, want: tuple[str, ...] = tuple(OUTPUTS)):
        self.a, a_bytes = load_a(path_a)
        self.b, b_bytes = load_b(path_b)
        self.n_b = len(b_bytes)
        if len(a_bytes) * self.n_b >= 1 << 31:
            raise ValueError("a pair of these vocabularies does not fit an int")
        self.a_marked, self.b_marked = _marked(len(a_bytes), ",", "|"), _marked(self.n_b, ",", ";")
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (a_bytes, b_bytes))
        self.a_text, self.b_text = (np.frombuffer(b"".join(x), np.uint8) for x in (a_bytes, b_bytes))
        self.a_at, self.b_at = (np.cumsum(x) - x for x in (self.a_sizes, self.b_sizes))
        self.want = want
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.digests: list[str] = []
        # For each part: whether it comes back, its bytes, how many calls of ``add`` met it, its numbers.
        self.good, self.bytes, self.met = np.zeros(0, bool), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.counts = {name: np.zeros(0, np.int32) for name in COUNTS if name in self.want}
        self.lists = {name: Ragged(np.int32) for name in LISTS if name in self.want}
        self.size = 0

    def trim(self) -> None:
        """Keep the parts that came back, the most frequent first, in half of the room; older meetings count less."""
        n = len(self.codes)
        order = np.argsort(-self.met[:n], kind="stable")
        fit = np.cumsum(self.bytes[order], dtype=np.int64) <= TABLE_BYTES // 2
        rows = order[: TABLE // 2][fit[: TABLE // 2]]
        rows = np.sort(rows[self.met[rows] > 1])
        names, kept = list(self.codes), rows.tolist()
        self.codes = {names[r]: i for i, r in enumerate(kept)}
        self.digests = [self.digests[r] for r in kept] if self.digests else []
        self.good, self.bytes, self.met = self.good[rows], self.bytes[rows], self.met[rows] // 2
        self.counts = {name: x[rows] for name, x in self.counts.items()}
        for held in self.lists.values():
            held.keep(rows)
        self.size = int(self.bytes.sum(dtype=np.int64))

    def add(self, cut: list[list[str]]) -> np.ndarray:
        """Align the parts of texts that the table does not hold yet; the places of all parts, in order."""
        if len(self.codes) > TABLE or self.size > TABLE_BYTES:
            self.trim()
        parts = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.codes.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(at < 0)
        unknown = [parts[i] for i in missing.tolist()]
        new = set(unknown)
        # Parts stand behind each other in one call; white space at either end of a text would meet the next one.
        edges = {p for parts in cut if parts for p in (parts[0], parts[-1]) if p[0].isspace() or p[-1].isspace()}
        alone = new & edges
        for part in alone:
            self._align([part])
        group, size = [], 0
        for part in new - alone:
            if size > CALL:
                self._align(group)
                group, size = [], 0
            group.append(part)
            size += len(part)
        self._align(group)
        at[missing] = np.fromiter(map(self.codes.__getitem__, unknown), np.int64, len(unknown))
        met = np.zeros(len(self.met), bool)
        met[at] = True
        self.met += met
        return at

    def _align(self, new: list[str]) -> None:
        if not new:
            return
        text = " ".join(new)
        raw = [b" " + p.encode() for p in new]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(list(map(len, raw)))
        self.size += len(data)

        made = self.a.encode(" " + text, add_special_tokens=False)
        a = np.array(made.ids, np.int64)
        places = np.fromiter(chain.from_iterable(made.offsets), np.int64, 2 * len(a))
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        a_end = refined_ends(chars[places[::2]], chars[places[1::2]], self.a_sizes[a])

        pieces = self.b.encode(text, return_type="offset_mapping", return_bytes=True)
        b = np.array(pieces["ids"], np.int64)
        places = np.fromiter(chain.from_iterable(pieces["offsets"]), np.int64, 2 * len(b))
        # The model's own space stands before the text, so spans are one byte later; the first piece starts at it.
        b_from = places[::2] + 1
        b_from[0] = 0
        b_end = refined_ends(b_from, places[1::2] + 1, self.b_sizes[b])

        same = self._bytes(self.a_text, self.a_at, self.a_sizes, a) == data.tobytes() == self._bytes(
            self.b_text, self.b_at, self.b_sizes, b
        )
        if not same and len(new) > 1:
            # One of the parts does not come back; the others still have their tokens.
            for part in new:
                self._align([part])
            return
        if not same:
            a = b = a_end = b_end = np.zeros(0, np.int64)
        shared = np.intersect1d(a_end, b_end, assume_unique=True)
        last_a, last_b = np.searchsorted(a_end, shared), np.searchsorted(b_end, shared)
        n_a, n_b, n_groups = (_by_part(x, ends) for x in (a_end, b_end, shared))

        first, n = len(self.codes), len(self.codes) + len(new)
        self.codes.update(zip(new, range(first, n)))
        self.good, self.bytes, self.met = (_room(x, n) for x in (self.good, self.bytes, self.met))
        self.good[first:n], self.bytes[first:n], self.met[first:n] = same, np.diff(ends, prepend=0), 0
        for name, x in zip(COUNTS, (n_a, n_b, n_groups, n_groups)):
            if name in self.counts:
                self.counts[name] = _room(self.counts[name], n)
                self.counts[name][first:n] = x
        lists = {
            "a_ids": lambda: (a, n_a),
            "b_ids": lambda: (b, n_b),
            "a_sizes": lambda: (np.diff(last_a, prepend=-1), n_groups),
            "b_sizes": lambda: (np.diff(last_b, prepend=-1), n_groups),
            "group_bytes": lambda: (np.diff(shared, prepend=0), n_groups),
            "links": lambda: (a[last_a] * self.n_b + b[last_b], n_groups),
        }
        for name, held in self.lists.items():
            held.append(*lists[name]())
        if "groups_sha256" in self.want:
            self.digests.extend(self._written(a, b, last_a, last_b, n_groups))

    def _written(self, a, b, last_a, last_b, n_groups) -> list[str]:
        """``a1,a2|b1;a3|b2;`` for each part: every group's A ids, then its B ids."""
        closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        closes_a[last_a] = closes_b[last_b] = 1
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        upto_a, upto_b = last_a + 1, np.append(0, last_b + 1)
        out, sizes = np.empty(len(a) + len(b), object), np.empty(len(a) + len(b), np.int64)
        for ids, marked, closes, place in (
            (a, self.a_marked, closes_a, np.arange(len(a)) + upto_b[group_a]),
            (b, self.b_marked, closes_b, np.arange(len(b)) + upto_a[group_b]),
        ):
            out[place] = marked[ids, closes]
            # Digits and the sign behind them.
            sizes[place] = 2 + np.searchsorted(_TENS, ids, "right")
        ends = np.append(0, last_a + last_b + 2)[np.append(0, np.cumsum(n_groups))]
        ends = np.append(0, np.cumsum(sizes))[ends].tolist()
        text = "".join(out.tolist())
        return [text[s:e] for s, e in zip(ends[:-1], ends[1:])]

    @staticmethod
    def _bytes(text, at, sizes, ids) -> bytes:
        return text[_places(at[ids], sizes[ids])].tobytes()


def _by_part(at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the sorted byte ends lie in each part."""
    return np.diff(np.searchsorted(at, ends, "right"), prepend=0)


def _marked(n: int, inside: str, last: str) -> np.ndarray:
    """Decimal ids with the sign that follows them: inside a list, and at its end."""
    out = np.empty((n, 2), object)
    out[:, 0], out[:, 1] = [f"{i}{inside}" for i in range(n)], [f"{i}{last}" for i in range(n)]
    return out


@lru_cache(1)
def _table(path_a: str, path_b: str, want: tuple[str, ...]) -> PairTable:
    """The table of this process: a worker that runs several tasks loads the models and meets common parts once."""
    return PairTable(path_a, path_b, want)


def _align(path_a: str, path_b: str, text_col: str, want: tuple[str, ...]):
    def run(batches):
        table = _table(path_a, path_b, want)
        for batch in batches:
            texts = pc.fill_null(batch.column(text_col), "")
            for at, stop in spans(text_bytes(texts)[1]):
                part = batch.slice(at, stop - at)
                cut = [parts_of(t) for t in texts.slice(at, stop - at).to_pylist()]
                codes, ends = table.add(cut), np.append(0, np.cumsum(list(map(len, cut))))
                bad = ~table.good[codes]
                if bad.any():
                    # A text with a part that does not come back has no tokens.
                    sizes = np.diff(ends)
                    none = np.diff(np.append(0, np.cumsum(bad))[ends]) > 0
                    codes = codes[~np.repeat(none, sizes)]
                    ends = np.append(0, np.cumsum(np.where(none, 0, sizes)))
                made = {name: _column(table, name, codes, ends) for name in want}
                kept = [c for c in part.schema.names if c not in made and c != text_col]
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), *made.values()], [*kept, *made])

    return run


def _column(table: PairTable, name: str, codes: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A column for the rows whose parts stand behind each other in ``codes``, up to ``ends``."""
    if name in table.counts:
        return pa.array(np.diff(np.append(0, np.cumsum(table.counts[name][codes], dtype=np.int64))[ends]))
    if name == "groups_sha256":
        written, at = list(map(table.digests.__getitem__, codes.tolist())), ends.tolist()
        texts = ["".join(written[s:e]) for s, e in zip(at[:-1], at[1:])]
        return pa.array([hashlib.sha256(t[:-1].encode()).hexdigest() if t else "" for t in texts], pa.string())
    held = table.lists[name]
    offsets = np.append(0, np.cumsum(held.sizes(codes)))[ends].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(held.take(codes)))


def align(
    docs: DataFrame,
    want: tuple[str, ...] = ("a_ids", "b_ids", "a_sizes", "b_sizes", "group_bytes"),
    text_col: str = "text",
    paths: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` without the text, with the wanted columns of ``OUTPUTS``.

    ``a_ids`` and ``b_ids`` are the tokens, ``a_sizes`` and ``b_sizes`` how many of them each group
    takes, ``group_bytes`` the bytes of each group, ``links`` the pairs that end together, each as
    ``a * size of vocabulary B + b``.
    """
    kept = [c for c in docs.columns if c not in want and c != text_col]
    run = _align(*(paths or default_paths()), "_text", want)
    return map_rows(docs, kept, {"_text": F.col(f"`{text_col}`")}, run, {w: OUTPUTS[w] for w in want})


def _score(table, n_b: int):
    def run(batches):
        # This worker may still hold the parts that it aligned.
        _table.cache_clear()
        codes, counts, best = table.value
        for batch in batches:
            links = batch.column("links")
            ends = links.offsets.to_numpy() - links.offsets[0].as_py()
            at = np.searchsorted(codes, links.flatten().to_numpy().astype(np.int64))
            sums = np.append(0, np.cumsum(counts[at]))[ends]
            hits = np.append(0, np.cumsum(best[at]))[ends]
            kept = [c for c in batch.schema.names if c != "links"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(np.diff(hits)), pa.array(np.diff(sums))],
                [*kept, "n_best", "count_sum"],
            )

    return run


def align_scored(docs: DataFrame, text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """Counts of tokens, groups and links for each row, with how its links stand in the corpus.

    A pair's count is the number of links that hold it in all rows. ``n_best`` counts the links whose
    pair has the highest count of its B id, ``count_sum`` adds the counts of all links. Alignments are
    written once; pairs are counted with partial sums before the exchange and come back as a table
    that :func:`most_pairs` bounds.
    """
    paths = paths or default_paths()
    n_b = len(load_b(paths[1])[1])
    new = ("n_a", "n_b", "n_groups", "n_links", "links", "groups_sha256")
    docs = docs.drop("n_best", "count_sum")
    aligned = stored(align(docs, new, text_col, paths), "aligned")
    pairs = aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).toArrow()
    codes, counts = (np.asarray(pairs.column(c), np.int64) for c in ("pair", "n"))
    if len(codes) > most_pairs(*paths):
        raise AssertionError("more pairs than suffixes")
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    highest = np.zeros(n_b, np.int64)
    np.maximum.at(highest, codes % n_b, counts)
    table = docs.sparkSession.sparkContext.broadcast((codes, counts, (counts == highest[codes % n_b]).astype(np.int64)))
    kept = [c for c in aligned.columns if c != "links"]
    return map_rows(aligned, kept, {"links": F.col("links")}, _score(table, n_b), {"n_best": "bigint", "count_sum": "bigint"})
