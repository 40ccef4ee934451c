"""Byte-level BPE by tree reduction (operator 6).

A text is halved until a piece is short. Pieces are encoded on their own; neighbours are joined by encoding again a window
around the seam that grows until both of its ends are places where the token split can't depend on the other side. Nodes
form a monoid under this join: any bracketing gives the encoding of the whole text. Decoding concatenates bytes up the tree.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import text as X

LEAF_CHARS = 4096
WINDOW_CHARS = 32
VOCABULARY = os.path.join(os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("tidemark", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _bytes(path: str) -> list[bytes]:
    enc = encoding(path)
    table = [b""] * enc.n_vocab
    for piece, i in enc._mergeable_ranks.items():
        table[i] = piece
    return table


def synced(text: str, at: int) -> bool:
    """Whether every text with these characters around ``at`` is split there: one space between two non-blanks begins a
    piece whatever stands further off, as no piece holds a space but as its first character."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


class Node:
    """The encoding of one stretch of text."""

    __slots__ = ("ids", "text")

    def __init__(self, text: str, ids: list[int]):
        self.text, self.ids = text, ids


def _tail(ids: list[int], n_bytes: int, table: list[bytes]) -> int:
    """How many tokens at the end hold exactly ``n_bytes`` bytes."""
    k = 0
    while n_bytes > 0:
        k += 1
        n_bytes -= len(table[ids[-k]])
    if n_bytes:
        raise ValueError("not a token boundary")
    return k


def _head(ids: list[int], n_bytes: int, table: list[bytes]) -> int:
    k = 0
    while n_bytes > 0:
        n_bytes -= len(table[ids[k]])
        k += 1
    if n_bytes:
        raise ValueError("not a token boundary")
    return k


def join(a: Node, b: Node, path: str = VOCABULARY) -> Node:
    """The node of ``a.text + b.text``."""
    if not a.text or not b.text:
        return b if not a.text else a
    enc, table = encoding(path), _bytes(path)
    span = WINDOW_CHARS
    while True:
        lo, hi = max(0, len(a.text) - span), min(len(b.text), span)
        left = next((i for i in range(lo, len(a.text) - 1) if synced(a.text, i)), 0 if lo == 0 else None)
        right = next((i for i in range(hi - 1, 0, -1) if synced(b.text, i)), len(b.text) if hi == len(b.text) else None)
        if left is not None and right is not None:
            break
        span *= 2
    window = a.text[left:] + b.text[:right]
    mid = enc.encode_ordinary(window)
    keep = len(a.ids) - _tail(a.ids, len(a.text[left:].encode()), table)
    drop = _head(b.ids, len(b.text[:right].encode()), table)
    return Node(a.text + b.text, a.ids[:keep] + mid + b.ids[drop:])


def encode_tree(text: str, path: str = VOCABULARY, leaf: int = LEAF_CHARS) -> Node:
    if len(text) <= leaf:
        return Node(text, encoding(path).encode_ordinary(text))
    half = len(text) // 2
    return join(encode_tree(text[:half], path, leaf), encode_tree(text[half:], path, leaf), path)


def encode(text: str, path: str = VOCABULARY, leaf: int = LEAF_CHARS) -> list[int]:
    """Token ids of the text; the same as encoding it in one go."""
    return encode_tree(text, path, leaf).ids


def decode_bytes(ids: list[int], path: str = VOCABULARY) -> bytes:
    """Bytes of the tokens: halves are decoded and concatenated."""
    if len(ids) > 1024:
        half = len(ids) // 2
        return decode_bytes(ids[:half], path) + decode_bytes(ids[half:], path)
    table = _bytes(path)
    return b"".join([table[i] for i in ids])


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    return decode_bytes(ids, path).decode()


SCHEMA = "doc_id bigint, n_tokens bigint, token_ids array<int>, round_trip boolean"


def encode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row a document: doc_id, n_tokens, token_ids, and whether decoding gives the text back byte for byte.

    Null text has null tokens, no count and a null round_trip; empty text has none. A null doc_id stays null; repeated rows give repeated rows. Columns
    other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding(path)
        for batch in batches:
            offsets, flat, counts, trips, missing = [0], [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                ids = encode(text, path) if text is not None else []
                flat.append(np.asarray(ids, np.int32))
                offsets.append(offsets[-1] + len(ids))
                counts.append(len(ids) if text is not None else None)
                trips.append(decode_bytes(ids, path) == text.encode() if text is not None else None)
                missing.append(text is None)
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(missing, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), lists, pa.array(trips, pa.bool_())], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(X.tidy(run), SCHEMA)


def decode_tokens(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids) to (doc_id, text); null tokens give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(x.as_py(), path) if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "token_ids").mapInArrow(X.tidy(run), "doc_id bigint, text string")
