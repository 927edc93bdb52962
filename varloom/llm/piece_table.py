"""SentencePiece encoding and decoding by a table of distinct chunks.

With this vocabulary no piece has a letter before a white-space marker, so no merge crosses from a
word into the marker that follows. A text is therefore cut before every run of markers; each
distinct chunk of a batch is segmented and decoded once, and ids are joined back by position with
array takes. The table of chunks lives for one task and is emptied when it holds ``TABLE`` entries.

``check_model`` refuses a model for which this does not hold.

Defined cases: null text counts as empty; an empty text has only the begin and end ids and decodes
to the empty text. Ids of rows play no part, so null or repeated ones are kept as they are.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from varloom.llm.common import map_rows, spans, text_bytes

TABLE = 400_000
MARK = "▁"
#: Markers, then everything up to the next marker.
CHUNKS = re.compile(" *[^ ]+| +")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def check_model(processor) -> None:
    """Raise unless chunks are independent under this model."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(processor.serialized_model_proto())
    rules = proto.normalizer_spec
    crossing = [p.piece for p in proto.pieces if MARK in p.piece.lstrip(MARK)]
    special = [p.piece for p in proto.pieces if p.type in (4, 5)]
    if (
        rules.precompiled_charsmap
        or not rules.add_dummy_prefix
        or rules.remove_extra_whitespaces
        or not rules.escape_whitespaces
        or crossing
        or special
    ):
        raise ValueError("this model lets pieces depend on more than one chunk")


class ChunkTable:
    """Ids and decoded text of the chunks seen so far in a task."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(self.processor)
        self.begin, self.end = self.processor.bos_id(), self.processor.eos_id()
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.texts: list[str] = []
        self.used = 0
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.empty(1 << 14, np.int64)
        self.sizes = np.empty(1 << 14, np.int64)

    def add(self, chunks: set[str]) -> None:
        """Segment and decode chunks that the table does not hold yet."""
        if len(self.codes) > TABLE:
            self.clear()
        new = [c for c in chunks if c not in self.codes]
        if not new:
            return
        # A chunk starts with a marker, which the dummy prefix supplies; decoding drops it again.
        ids = self.processor.encode([c[1:] for c in new], num_threads=1)
        if " " in new:
            # Nothing follows the prefix here, and the library gives no ids for an empty text.
            ids[new.index(" ")] = [self.processor.piece_to_id(MARK)]
        first = len(self.codes)
        self.codes.update(zip(new, range(first, first + len(new))))
        self.texts.extend(" " + text for text in self.processor.decode(ids, num_threads=1))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
        self.flat = _room(self.flat, self.used + len(flat))
        self.starts, self.sizes = (_room(a, first + len(new)) for a in (self.starts, self.sizes))
        self.flat[self.used : self.used + len(flat)] = flat
        self.sizes[first : first + len(new)] = sizes
        self.starts[first : first + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)

    def take(self, codes: np.ndarray) -> np.ndarray:
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[codes] - (ends - sizes), sizes)
        return self.flat[at]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array, or a copy of at least twice its size that holds ``n`` values."""
    if n <= len(a):
        return a
    out = np.empty(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def marked(text: str) -> list[str]:
    """Chunks of a text behind its dummy prefix; each starts with a marker, shown as a space."""
    return CHUNKS.findall(" " + text.replace(MARK, " ")) if text else []


def encode_batch(table: ChunkTable, texts: list[str]) -> list[tuple[np.ndarray, str]]:
    """Ids with begin and end, and the decoded text, for each text."""
    cut = [marked(text) for text in texts]
    table.add(set().union(*cut))
    out = []
    for chunks in cut:
        codes = list(map(table.codes.__getitem__, chunks))
        ids = table.take(np.array(codes, np.int64))
        whole = np.concatenate([[table.begin], ids, [table.end]]).astype("<u4")
        out.append((whole, "".join(map(table.texts.__getitem__, codes))[1:]))
    return out


def _encode(path: str, text_col: str, want: tuple[str, ...]):
    def run(batches):
        table = ChunkTable(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(text_col), "")
            # Slices of about a megabyte keep ids and decoded texts of a batch from piling up.
            for at, end in spans(text_bytes(texts)[1]):
                part = batch.slice(at, end - at)
                made = encode_batch(table, texts.slice(at, end - at).to_pylist())
                columns = {
                    "n_tokens": pa.array([len(i) for i, _ in made], pa.int64()),
                    "ids_sha256": lambda: pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i, _ in made]),
                    "decoded_sha256": lambda: pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in made]),
                    "ids": lambda: pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())),
                    "decoded": lambda: pa.array([t for _, t in made], pa.string()),
                }
                new = {w: columns[w] if w == "n_tokens" else columns[w]() for w in want}
                kept = [c for c in batch.schema.names if c not in new and c != text_col]
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), *new.values()], [*kept, *new])

    return run


TYPES = {
    "n_tokens": "bigint",
    "ids_sha256": "string",
    "decoded_sha256": "string",
    "ids": "array<int>",
    "decoded": "string",
}


def encode(
    docs: DataFrame,
    want: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
    text_col: str = "text",
    model: str | None = None,
) -> DataFrame:
    """``docs`` without the text, with the wanted columns of ``TYPES``; same-named columns are replaced."""
    kept = [c for c in docs.columns if c not in want and c != text_col]
    run = _encode(model or default_model(), "_text", want)
    return map_rows(docs, kept, {"_text": F.col(f"`{text_col}`")}, run, {w: TYPES[w] for w in want})
