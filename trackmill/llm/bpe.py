"""Byte-level BPE encoding and decoding with the tokenizers library.

Every byte stands for one printable character (the byte table), so that the library's BPE model, which works on characters,
merges bytes. A text is split by the vocabulary's pattern; each piece that a worker has not met is encoded by the library, and
a bounded dictionary holds the ids of pieces that it has met, as prose repeats its words. Decoding looks the ids' characters up,
reverses the byte table and joins the bytes; a character that is split over tokens is whole again once the bytes are joined.

Null texts count as empty: no tokens. Ids that are none decode to U+FFFD. A text of any length is encoded in blocks that end just before white space, where no
match of the pattern can span. Repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts, small_batches

#: Pieces that a worker keeps; beyond it the dictionary starts anew.
KEPT_PIECES = 400_000
#: Characters that are split into pieces at once.
BLOCK_CHARS = 1 << 20
#: Rows of ids that are decoded at once.
DECODED_ROWS = 64

#: What an id that is none stands for: U+FFFD.
UNKNOWN = "\ufffd".encode()


def byte_table() -> list[str]:
    """The character of each byte: itself if printable in Latin-1, else the next unused one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte string of each id in a rank file (lines: base64, rank); ids must be dense and hold all single bytes."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for text, rank in pairs:
        tokens[int(rank)] = base64.b64decode(text)
    if not all(tokens) or len({x for x in tokens if len(x) == 1}) != 256:
        raise ValueError(f"{path}: ranks are not dense, or a byte is missing")
    return tokens


class Codec:
    """Encodes and decodes by a rank file's tokens and the pattern that splits text before the merges."""

    def __init__(self, tokens: list[bytes], pattern: str):
        from tokenizers import Tokenizer, models

        self.table = byte_table()
        self.back = {c: b for b, c in enumerate(self.table)}
        self.pattern = regex.compile(pattern)
        known = set(tokens)
        # any two neighbours whose join is a token may merge, so every split of a token is a merge of its rank
        merges = [(self._chars(t[:i]), self._chars(t[i:])) for t in tokens for i in range(1, len(t)) if t[:i] in known and t[i:] in known]
        self.model = Tokenizer(models.BPE(vocab={self._chars(t): i for i, t in enumerate(tokens)}, merges=merges, ignore_merges=True, cache_capacity=0))
        self.chars = [self.model.id_to_token(i) for i in range(len(tokens))]
        self.bytes = [bytes(map(self.back.__getitem__, c)) for c in self.chars]
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.met: dict[str, bytes] = {}

    def _chars(self, data: bytes) -> str:
        return "".join(map(self.table.__getitem__, data))

    def pieces(self, text: str) -> list[str]:
        if len(text) <= BLOCK_CHARS:
            return self.pattern.findall(text)
        out, start = [], 0
        edges = re.compile(r"(?<=\S)(?=\s)")
        while start < len(text):
            edge = edges.search(text, start + BLOCK_CHARS) if start + BLOCK_CHARS < len(text) else None
            end = edge.start() if edge else len(text)
            out += self.pattern.findall(text[start:end])
            start = end
        return out

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers."""
        pieces = self.pieces(text)
        new = list({p for p in pieces if p not in self.met})
        if new:
            if len(self.met) + len(new) > KEPT_PIECES:
                self.met.clear()
                new = list(set(pieces))
            found = self.model.encode_batch_fast([self._chars(p.encode()) for p in new], add_special_tokens=False)
            self.met.update((p, np.asarray(e.ids, dtype="<u4").tobytes()) for p, e in zip(new, found))
        return b"".join(map(self.met.__getitem__, pieces))

    def decode(self, ids: bytes | list) -> bytes:
        """The bytes of the ids; a null, negative or unknown one stands for U+FFFD."""
        if isinstance(ids, bytes):
            return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        n = len(self.bytes)
        return b"".join(self.bytes[i] if i is not None and 0 <= i < n else UNKNOWN for i in ids)

    def offsets(self, ids: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
        """For each id: the byte at which it starts, and the character that this byte belongs to."""
        lengths = self.lengths[np.frombuffer(ids, dtype="<u4")]
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return starts, (np.cumsum((data & 0xC0) != 0x80) - 1)[starts]


_codecs: dict[tuple, Codec] = {}


def codec(tokens: list[bytes], pattern: str) -> Codec:
    """One for each vocabulary and Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (hashlib.sha256(b"\0".join(tokens)).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(tokens, pattern)
    return _codecs[key]


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """key, ids array<int>; with offsets also byte_starts and char_starts array<int>, one entry for each id."""
    held = docs.sparkSession.sparkContext.broadcast(tokens)  # the vocabulary: a fixed file of under 2 MB

    def make():
        own = codec(held.value, pattern)

        def work(keys, texts):
            ids = [own.encode(t) for t in texts]
            columns = [[np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids]]
            if offsets:
                found = [own.offsets(x, t) for x, t in zip(ids, texts)]
                columns += [[f[k].astype(np.int32) for f in found] for k in (0, 1)]
            return [lists(c) for c in columns]

        return work

    return map_texts(docs, key, text, make, "ids array<int>" + ", byte_starts array<int>, char_starts array<int>" * offsets)


def lists(arrays: list[np.ndarray]):
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))


def decode(encoded: DataFrame, tokens: list[bytes], key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text: what the ids stand for. Bytes that are no UTF-8 (ids of a part of a text) become U+FFFD, as do ids that are null, negative or beyond the vocabulary; a null list gives null."""
    held = encoded.sparkSession.sparkContext.broadcast(tokens)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        own = codec(held.value, r"\s+")
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED_ROWS):
                some = batch.slice(at, DECODED_ROWS)
                out = [None if x is None else own.decode(x).decode("utf-8", "replace") for x in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return small_batches(encoded).select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip(docs: DataFrame, tokens: list[bytes], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, digests of the ids and of what they decode to, n_split (tokens that start within a character), n_bytes."""
    held = docs.sparkSession.sparkContext.broadcast(tokens)

    def make():
        own = codec(held.value, pattern)

        def work(keys, texts):
            rows = []
            for t in texts:
                ids = own.encode(t)
                data = own.decode(ids)
                starts, chars = own.offsets(ids, t)
                raw = np.frombuffer(data, dtype=np.uint8)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest(), int(np.count_nonzero((raw[starts] & 0xC0) == 0x80)) if len(starts) else 0, len(data)))
            return [list(c) for c in zip(*rows)]

        return work

    return map_texts(docs, key, text, make, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, n_bytes long")


def tokens_and_digests(docs: DataFrame, tokens: list[bytes], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>, n_tokens, ids_sha256, decoded_sha256."""
    held = docs.sparkSession.sparkContext.broadcast(tokens)

    def make():
        own = codec(held.value, pattern)

        def work(keys, texts):
            ids = [own.encode(t) for t in texts]
            return [lists([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids]), [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]]

        return work

    return map_texts(docs, key, text, make, "ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
