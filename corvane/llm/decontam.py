"""Benchmark decontamination by SimHash windows.

For each benchmark item, windows of the item's number of words slide over every text, to every start
at which the window holds as many shingles of the item, in any order, as the similarity asked for
needs at least (all others are below it, so nothing is lost). A window's 64-bit SimHash is looked up
in a multi-index of the items of that size: a fingerprint is cut into blocks, and since a distance of
at most RADIUS leaves some block with at most RADIUS // BLOCKS differing bits, probing each block's
neighbourhood finds every item within the radius. Candidates are verified by exact weighted shingle
similarity (sum of minima over sum of maxima of shingle counts).

Benchmark items are the stated query set: they are processed in blocks of bounded bytes, each of
which every worker holds, against all texts. Nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import U64, mix, shingles, spans, text_buffers, words

BLOCKS = 5
RADIUS = 24
ITEM_BYTES = 8 << 20
#: Shingles of windows that are fingerprinted at once.
GROUP = 1 << 16
_WIDTHS = [13, 13, 13, 13, 12]


def simhash(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the shingle groups h[edge[i]:edge[i + 1]] (none empty).

    A shingle's occurrences in a group are numbered and count as different ones, so that the distance
    follows the weighted similarity.
    """
    group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    order = np.lexsort((h, group))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (group[order][1:] != group[order][:-1])
    place = np.arange(len(h))
    number = np.empty(len(h), np.int64)
    number[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    own = (h ^ U64(0x5851F42D4C957F2D)) + number.astype(U64) * U64(0x9E3779B97F4A7C15)
    bits = np.unpackbits(mix(own).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    total = np.add.reduceat(bits, edge[:-1], axis=0)
    return np.packbits(total > 0, axis=1).reshape(-1).view(U64)


class MultiIndex:
    """All stored fingerprints within RADIUS of a query."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        self.tables: list[dict[int, list[int]]] = []
        self.masks = []
        at = 0
        for width in _WIDTHS:
            table = defaultdict(list)
            for k, value in enumerate(((prints >> U64(at)) & U64((1 << width) - 1)).tolist()):
                table[value].append(k)
            near = [0]
            for flips in range(1, RADIUS // BLOCKS + 1):
                near += [sum(1 << b for b in c) for c in combinations(range(width), flips)]
            self.tables.append((at, width, np.array(sorted(table)), [table[v] for v in sorted(table)]))
            self.masks.append(np.array(near))
            at += width

    def within(self, query: int) -> list[tuple[int, int]]:
        """(stored index, distance), each once."""
        found: set[int] = set()
        for (at, width, values, members), masks in zip(self.tables, self.masks, strict=True):
            block = (query >> at) & ((1 << width) - 1)
            spot = np.searchsorted(values, probes := masks ^ block)
            hit = values[np.minimum(spot, len(values) - 1)] == probes
            for k in spot[hit].tolist():
                found.update(members[k])
        near = [(k, (query ^ int(self.prints[k])).bit_count()) for k in found]
        return sorted((k, d) for k, d in near if d <= RADIUS)


@dataclass
class Items:
    """Index of a block of benchmark items."""

    ids: list[int]
    sizes: np.ndarray  # words
    counts: list[Counter]
    keys: np.ndarray  # sorted shingle hashes, repeated
    item: np.ndarray
    near: dict[int, tuple[MultiIndex, list[int]]]  # by words of an item


def index_items(ids: list[int], texts: list[str | None], size: int = 5) -> Items:
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    w = words(data, offsets)
    h, row, _ = shingles(w, size, whole_if_short=False)
    edge = np.searchsorted(row, np.arange(len(ids) + 1))
    counts = [Counter(h[a:b].tolist()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    near = {}
    for n in sorted(set(w.counts[w.counts >= size].tolist())):
        own = np.flatnonzero(w.counts == n).tolist()
        prints = np.concatenate([simhash(h[edge[k] : edge[k + 1]], np.array([0, edge[k + 1] - edge[k]])) for k in own])
        near[n] = MultiIndex(prints), own
    order = np.argsort(h, kind="stable")
    return Items(ids, w.counts, counts, h[order], row[order], near)


def similarity(a: Counter, b: Counter) -> float:
    """Sum of minima over sum of maxima of two shingle counts."""
    low = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return low / (sum(a.values()) + sum(b.values()) - low) if a or b else 0.0


def _finder(x: Items, size: int, least: float) -> Callable:
    names = ["id", "item_id", "similarity", "hamming", "start_word", "n_words", "n_windows"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 20, bool)
        seen[(x.keys & U64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in spans(offsets):
                w = words(data, offsets[i : j + 1])
                h, row, _ = shingles(w, size, whole_if_short=False)
                hot = np.flatnonzero(seen[(h & U64((1 << 20) - 1)).astype(np.int64)])
                low, high = np.searchsorted(x.keys, h[hot]), np.searchsorted(x.keys, h[hot], "right")
                hot, low, high = hot[high > low], low[high > low], high[high > low]
                if not len(hot):
                    continue
                rows = _windows(x, w, h, row, hot, low, high, size, least)
                docs = batch.column(0).slice(i, j - i).to_pylist()
                if rows:
                    cols = list(zip(*((docs[k], x.ids[item], *rest) for (k, item), rest in sorted(rows.items())), strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names)

    return find


def _starts(x: Items, w, h, row, hot, low, high, size: int, least: float) -> np.ndarray:
    """Sorted (row, words of the item, index of a shingle): all windows with enough shingles of some item of that size.

    A similarity of least needs least / (1 + least) of the shingles of window and item together to be shared.
    """
    many = high - low
    entry = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    hit = np.unique(x.item[entry] * len(h) + np.repeat(hot, many))  # once for each item and place
    item, at = hit // len(h), hit % len(h)
    r = row[at]
    width = np.minimum(x.sizes[item], w.counts[r])
    held = width - size + 1
    need = np.maximum(np.ceil(least * (held + x.sizes[item] - size + 1) / (1 + least) - 1e-9), 1).astype(np.int64)
    # the need-th hit from each one on, of the same item in the same row
    last = np.arange(len(hit)) + need - 1
    ok = last < len(hit)
    last = np.where(ok, last, 0)
    ok &= (item[last] == item) & (r[last] == r)
    first = np.searchsorted(row, np.arange(len(w.counts)))[r]  # a row's first shingle
    start = np.maximum(at[last] - held + 1, first)
    stop = np.minimum(at, first + w.counts[r] - width)
    item, r, start, stop = item[ok], r[ok], start[ok], stop[ok]
    # starts and stops ascend within a row and item: what the one before covers is left to it
    again = (item[1:] == item[:-1]) & (r[1:] == r[:-1])
    start[1:] = np.where(again, np.maximum(start[1:], stop[:-1] + 1), start[1:])
    many = np.maximum(stop - start + 1, 0)
    at = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    return np.unique(np.stack([np.repeat(r, many), np.repeat(x.sizes[item], many), at], 1), axis=0)


def _windows(x: Items, w, h, row, hot, low, high, size: int, least: float) -> dict[tuple[int, int], tuple]:
    """Best verified window of each (row, item): similarity, distance, start, words, number of windows."""
    places = _starts(x, w, h, row, hot, low, high, size, least)
    first = np.searchsorted(row, np.arange(len(w.counts)))
    words_of = np.minimum(places[:, 1], w.counts[places[:, 0]])
    held = words_of - size + 1
    best: dict[tuple[int, int], tuple] = {}
    near: dict[tuple[int, int], list[tuple[int, int]]] = {}
    i, ends = 0, np.cumsum(held)
    while i < len(places):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + GROUP, "right")))
        edge = np.concatenate([[0], np.cumsum(held[i:j])])
        parts = h[np.repeat(places[i:j, 2] - edge[:-1], held[i:j]) + np.arange(edge[-1])]
        for k, mark in enumerate(simhash(parts, edge).tolist(), i):
            r, n, at = places[k].tolist()
            index, own = x.near[n]
            if (n, mark) not in near:
                near[n, mark] = index.within(mark)
            counts = Counter(parts[edge[k - i] : edge[k - i + 1]].tolist()) if near[n, mark] else None
            for item, distance in near[n, mark]:
                score = similarity(counts, x.counts[own[item]])
                if score >= least - 1e-12:
                    key, old = (r, own[item]), best.get((r, own[item]), (-1.0, 0, 0, 0, 0))
                    new = (score, distance, at - int(first[r]), int(words_of[k]), 0)
                    best[key] = (*(max(old, new, key=lambda v: (v[0], -v[2])))[:4], old[4] + 1)
        i = j
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle_words: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document and benchmark item with a window of similarity >= least.

    Columns: id_col, item_id, similarity, hamming, start_word, n_words (of the best window, the
    earliest of equals) and n_windows. Null and empty texts match nothing; nor do texts and items of
    fewer words than a shingle. Rows with a null id are reported with a null id; repeated rows
    repeat theirs. An empty benchmark gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, item_id long, similarity double, hamming int, start_word int, n_words int, n_windows int"
    parts: list[DataFrame] = []
    ids: list[int] = []
    texts: list[str | None] = []
    held = 0

    def flush() -> None:
        nonlocal ids, texts, held
        if ids:
            parts.append(rows.mapInArrow(_finder(index_items(ids, texts, shingle_words), shingle_words, least), schema))
        ids, texts, held = [], [], 0

    items = benchmark.select(F.col(item_col).cast("long"), F.col(item_text)).filter(F.col(item_col).isNotNull()).dropDuplicates()
    for item, text in items.toLocalIterator():
        ids.append(item)
        texts.append(text)
        held += len(text or "")
        if held >= ITEM_BYTES:
            flush()
    flush()
    if not parts:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    return reduce(DataFrame.union, parts).withColumnRenamed("id", id_col)
