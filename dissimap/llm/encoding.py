"""Token ids of whole texts by a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = os.environ.get("DISSIMAP_TOKENIZERS", "/opt/tokenizers")
#: The pieces into which byte_bpe_50k cuts a text before it merges bytes (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters at the end of a text whose pieces may change if more text follows, besides the last piece: a contraction.
OPEN_END = 3


@lru_cache(maxsize=4)
def encoder(name: str, folder: str):
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _piece():
    import regex

    return regex.compile(PATTERN)


class Encoded:
    """The ids of text[start:end], and `tail`: start, or a later piece boundary of that part, OPEN_END characters before its end or
    earlier, which whatever follows does not change."""

    __slots__ = ("start", "end", "parts", "tail")

    def __init__(self, start: int, end: int, parts: list[np.ndarray], tail: int):
        self.start, self.end, self.parts, self.tail = start, end, parts, tail


def _cut_last(parts: list[np.ndarray], n: int) -> list[np.ndarray]:
    parts = list(parts)
    while n:
        k = min(n, len(parts[-1]))
        parts[-1] = parts[-1][: len(parts[-1]) - k]
        n -= k
        if not len(parts[-1]):
            parts.pop()
    return parts


def _cut_first(parts: list[np.ndarray], n: int) -> list[np.ndarray]:
    parts = list(parts)
    while n:
        k = min(n, len(parts[0]))
        parts[0] = parts[0][k:]
        n -= k
        if not len(parts[0]):
            parts.pop(0)
    return parts


def join(text: str, left: Encoded, right: Encoded, encode) -> Encoded:
    """The encoding of two neighbouring parts. Pieces are matched from left to right and look at most one character beyond
    their end, so the left part's pieces up to `settled` stay, and from the first boundary where the pieces of the joined
    text meet the right part's, all of the right part's stay. Between them a window grows until they meet (at the right
    part's end, if nowhere before) and is encoded again, piece by piece: at its end a piece of blanks depends on what follows."""
    match = _piece().match
    settled = left.tail
    while settled < left.end and (e := match(text, settled, left.end).end()) <= left.end - OPEN_END:
        settled = e
    both, alone, tail = settled, right.start, settled
    window, gone = [], 0
    while both != alone:
        if both < alone:
            start, both = both, match(text, both, right.end).end()
            window += encode(text[start:both])
            if both <= right.end - OPEN_END:
                tail = both
        else:
            start, alone = alone, match(text, alone, right.end).end()
            gone += len(encode(text[start:alone]))
    meet = both
    parts = _cut_last(left.parts, len(encode(text[settled : left.end])))
    if window:
        parts.append(np.asarray(window, np.int32))
    parts += _cut_first(right.parts, gone)
    if meet <= right.tail <= right.end - OPEN_END:
        tail = right.tail
    return Encoded(left.start, right.end, parts, tail)


def encode_tree(text: str, encode, leaf: int = 1 << 15) -> np.ndarray:
    """The ids of text, as encode(text) gives them at once: halves are encoded one by one and their results joined."""
    if len(text) <= leaf:
        return np.asarray(encode(text), np.int32)
    match = _piece().match

    def part(a: int, b: int) -> Encoded:
        if b - a > leaf:
            m = (a + b) // 2
            return join(text, part(a, m), part(m, b), encode)
        tail = a
        while tail < b and (e := match(text, tail, b).end()) <= b - OPEN_END:
            tail = e
        return Encoded(a, b, [np.asarray(encode(text[a:b]), np.int32)], tail)

    parts = part(0, len(text)).parts
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def _ids(name: str, folder: str, leaf: int, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder).encode_ordinary
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                ids = [encode_tree(x, encode, leaf) if x else np.empty(0, np.int32) for x in part.column(1).to_pylist()]
                n = np.fromiter(map(len, ids), np.int32, len(ids))
                if counts:
                    out = pa.array(n.astype(np.int64))
                else:
                    ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)]).astype(np.int32)
                    out = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), out], ["k", "v"])

    return run


def encode_texts(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf: int = 1 << 15) -> DataFrame:
    """(key, ids array<int>): each row's text by the tokenizer, without special tokens; what looks like one is ordinary
    text. A null or empty text has an empty list. Rows stay rows, whatever their keys.

    No exchange: a row is encoded where it lies. A text of more than `leaf` characters goes through encode_tree().
    """
    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, text).mapInArrow(_ids(tokenizer, folder, leaf, False), f"k {kind}, v array<int>").toDF(key, "ids")


def count_tokens(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf: int = 1 << 15) -> DataFrame:
    """(key, n_tokens bigint), as encode_texts()."""
    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, text).mapInArrow(_ids(tokenizer, folder, leaf, True), f"k {kind}, v bigint").toDF(key, "n_tokens")
