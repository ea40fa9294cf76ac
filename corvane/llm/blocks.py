"""Vectorised words and shingles of Arrow text columns.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a word is identified by a 64-bit
hash of its UTF-8 bytes. Batches are walked in blocks of bounded bytes, so memory follows
the block (or the longest single text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, on a copy."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _byte_codes() -> np.ndarray:
    lower = np.arange(256)
    lower[65:91] += 32
    codes = mix((lower.astype(U64) + U64(1)) * U64(_ODD))
    codes[[9, 10, 11, 12, 13, 32]] = 0
    return codes


_CODES = _byte_codes()
_WORD_BYTE = _CODES != 0
_ROOT = 0xD1342543DE82EF95
_ROOT_INV = pow(_ROOT, -1, 1 << 64)
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    while len(_POWERS[0]) < n:
        k = len(_POWERS[0])
        for i, root in enumerate((_ROOT, _ROOT_INV)):
            _POWERS[i] = np.concatenate([_POWERS[i], _POWERS[i] * U64(pow(root, k, 1 << 64))])
    return _POWERS[0], _POWERS[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def spans(offsets: np.ndarray, budget: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most budget bytes; a longer single row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + budget, "right")) - 1)
        yield i, min(j, n)
        i = j


@dataclass
class Words:
    hash: np.ndarray  # uint64, one per word
    doc: np.ndarray  # row of the block
    counts: np.ndarray  # words per row
    first: np.ndarray  # index of each row's first word
    start: np.ndarray  # byte offsets in the block's bytes
    data: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray = _CODES) -> Words:
    """Words of the rows offsets[0:-1] .. offsets[1:]; bytes whose code is 0 separate them."""
    base = offsets[0]
    body, at = data[base : offsets[-1]], offsets - base
    n, docs = len(body), len(at) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), none, np.zeros(docs, np.int64), np.zeros(docs, np.int64), none, body)
    solid = (codes != 0)[body]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = at[:-1][at[:-1] < n]
    begins[heads] = solid[heads]
    start = np.flatnonzero(begins)
    up, down = _powers(n)
    if len(start):
        values = codes[body]
        values *= up[:n]
        h = np.add.reduceat(values, start)
        h *= down[start]
        h = mix(h)
    else:
        h = np.zeros(0, U64)
    edge = np.searchsorted(start, at)
    counts = np.diff(edge)
    return Words(h, np.repeat(np.arange(docs), counts), counts, edge[:-1], start, body)


def word_text(w: Words, index: int) -> str:
    """The lower-cased word at an index."""
    end = w.start[index + 1] if index + 1 < len(w.start) else len(w.data)
    raw = w.data[w.start[index] : end]
    stop = np.flatnonzero(~_WORD_BYTE[raw])
    raw = raw[: stop[0]] if len(stop) else raw
    low = raw.copy()
    low[(raw >= 65) & (raw <= 90)] += 32
    return low.tobytes().decode("utf-8", "replace")


def shingles(w: Words, size: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, rows, word positions) of all runs of `size` words.

    A row with fewer words gives its whole sequence as one shingle, or none.
    """
    total = len(w.hash)
    position = np.arange(total) - w.first[w.doc]
    # unrelated odd factors: with evenly spaced ones, "a b b a" and "b a a b" would get one hash
    keys = mix(np.arange(1, size + 1, dtype=U64) * U64(_ODD)) | U64(1)
    take = np.flatnonzero(position + size <= w.counts[w.doc]) if total else np.zeros(0, np.int64)
    h = np.full(len(take), U64(size))
    for j in range(size):
        h += w.hash[take + j] * keys[j]
    rows, pos = w.doc[take], position[take]
    if whole_if_short:
        short = np.flatnonzero((w.counts > 0) & (w.counts < size))
        if len(short):
            s = w.counts[short].astype(U64)
            for j in range(size - 1):
                has = w.counts[short] > j
                s[has] += w.hash[w.first[short[has]] + j] * keys[j]
            h, rows, pos = np.concatenate([h, s]), np.concatenate([rows, short]), np.concatenate([pos, np.zeros(len(short), np.int64)])
            order = np.argsort(rows, kind="stable")
            h, rows, pos = h[order], rows[order], pos[order]
    return mix(h), rows, pos


def distinct(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, end to end, and their number per row. rows ascend."""
    edge = np.searchsorted(rows, np.arange(n + 1))
    h = h.copy()
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[keep], np.bincount(rows[keep], minlength=n)
