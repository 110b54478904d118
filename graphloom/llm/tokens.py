"""Encoding of the whole corpus with a public tokenizer.

A sentencepiece BPE model is serialised directly from the ranks of a byte-level BPE vocabulary: every token becomes a piece (its
bytes mapped to printable characters), scored by its negative rank, with identity normalisation. Texts are split into pre-tokens by
the vocabulary's pattern; each pre-token is byte-mapped and encoded by the model, which merges the best-scored pair first, exactly
as the ranks demand. Decoding maps the pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import pick

#: Pre-tokens whose ids are remembered per worker; beyond that the memory starts anew. Results don't depend on it.
MEMORY = 200_000


def byte_letters() -> dict[int, str]:
    """A printable character for each byte: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _int(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _blob(field: int, b: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(b)) + b


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model, in the protobuf wire format sentencepiece reads: pieces in order of id, then trainer and normalizer settings."""
    letters = byte_letters()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    normal, unknown = 1, 2
    out = bytearray()
    for rank, t in enumerate(tokens):
        piece = _blob(1, "".join(map(letters.__getitem__, t)).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _int(3, normal)
        out += _blob(1, piece)
    out += _blob(1, _blob(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int(3, unknown))
    bpe = 2
    trainer = _int(3, bpe) + _int(4, len(tokens) + 1) + _int(40, len(tokens)) + _int(41, -1) + _int(42, -1) + _int(43, -1)
    plain = _blob(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0)  # no dummy prefix, no removed or escaped white space
    return bytes(out + _blob(2, trainer) + _blob(3, plain))


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines "base64-token rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Text to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.split = regex.compile(pattern).findall
        self.letters = byte_letters()
        self.bytes = {v: k for k, v in self.letters.items()}
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; [] for null and empty ones. Names of special tokens are ordinary text."""
        if not text:
            return []
        out: list[int] = []
        known, parts = self.known, self.split(text)
        fresh = [p for p in dict.fromkeys(parts) if p not in known]
        if fresh:
            if len(known) + len(fresh) > MEMORY:
                known.clear()
                fresh = list(dict.fromkeys(parts))
            mapped = ["".join(map(self.letters.__getitem__, p.encode())) for p in fresh]
            known.update(zip(fresh, self.model.encode(mapped, num_threads=1)))
        for p in parts:
            out += known[p]
        return out

    def decode(self, ids: list[int]) -> str:
        pieces = "".join(map(self.model.id_to_piece, ids))
        return bytes(map(self.bytes.__getitem__, pieces)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(read_ranks(vocabulary), pattern)


def public_vocabulary(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """Path and pattern of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN


def encode_corpus(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): one row per document, no shuffle.

    Null and empty texts have the empty list, blank ones the ids of their blanks. Whole texts are encoded, however long. The
    vocabulary's path is read by each worker, so it must exist on every node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(vocabulary, pattern).encode
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                ids = pa.array([enc(x) for x in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    t = pick(docs, [id_col, text_col]).toDF("doc_id", "text")
    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and n_tokens (long; 0 for null and empty texts), one row per document, without moving the texts."""
    t = pick(docs, [*keep, text_col])
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(vocabulary, pattern).encode
        for b in batches:
            n = pa.array([len(enc(x)) for x in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    return t.mapInArrow(run, f"{types}, n_tokens long")


def round_trips(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, round_trip): how many ids each text has, and whether decoding them gives it back; one pass, no text moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            ids = [c.encode(x) for x in texts]
            back = [c.decode(i) == x for i, x in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, ids), pa.int32()), pa.array(back, pa.bool_())], names=["doc_id", "n_tokens", "round_trip"])

    t = pick(docs, [id_col, text_col]).toDF("doc_id", "text")
    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, n_tokens int, round_trip boolean")


def decode_corpus(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the inverse; the empty list gives the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = codec(vocabulary, pattern).decode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([dec(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    t = encoded.select("doc_id", F.col("ids"))
    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, text string")
