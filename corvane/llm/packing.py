"""Best-two-fit packing of tokenised documents into fixed-size sequences.

Token ids come from a byte-level BPE vocabulary. The text is cut at the file's added tokens, which
have ids of their own, and between them into the vocabulary's pre-tokens with numpy over code
points; each worker encodes every pre-token it meets once and keeps its ids, so repeated words cost
a lookup.

Packing is global yet needs no global sort: pieces of one length are interchangeable, so the
driver packs the histogram of lengths (at most `capacity` numbers) by best-two-fit and gets a
list of bin patterns with repeat counts; pieces then find their place from their rank among the
pieces of their length, which two-level counting gives without gathering a length in one task.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import U64, _powers, mix, spans, text_buffers
from .scratch import materialize

CAPACITY = 1024
END_ID = 2
#: Pieces per counting bucket of one length, about.
BUCKET_ROWS = 200_000
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# fixed values: Unicode White_Space
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# fixed values: contractions that the pre-tokenizer splits off, without their apostrophe
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and hash code of each code point; built once per worker."""
    if not _TABLES:
        kinds = {"L": LETTER, "N": NUMBER}
        kind = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        kind[WHITE] = SPACE
        _TABLES.extend([kind, mix((np.arange(sys.maxunicode + 1, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))])
    return _TABLES[0], _TABLES[1]


def pretokens(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Start of each pre-token of the texts points[at[i]:at[i + 1]].

    The pattern is: contraction, or an optional blank with a run of letters, numbers or other
    marks, or white space without its last character if text follows, or white space.
    """
    kind = _tables()[0][points]
    n = len(points)
    head = np.zeros(n, bool)
    head[at[:-1][at[:-1] < n]] = True
    run = head.copy()
    run[1:] |= kind[1:] != kind[:-1]
    run[:1] = True
    start = run.copy()
    # text after white space: the last blank joins it, any other last character stands alone
    after = np.flatnonzero(run & (kind != SPACE) & ~head)
    after = after[kind[after - 1] == SPACE]
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & run[quote + 1] & ~head[quote + 1]]
    for tail in CONTRACTIONS:
        codes = [ord(x) for x in tail]
        q = quote[quote + len(codes) < n]
        for k, code in enumerate(codes, 1):
            q = q[(points[q + k] == code) & ~head[q + k]]
        start[q + 1] = False
        rest = q + 1 + len(codes)
        rest = rest[rest < n]
        rest = rest[(kind[rest] == LETTER) & ~head[rest]]
        start[rest] = True
    return np.flatnonzero(start)


class Encoder:
    """Pre-token ids by hash, kept in sorted arrays; forgets all when `limit` pre-tokens are held."""

    def __init__(self, vocabulary: str, limit: int = 1_500_000):
        import json

        import public_tokenizers
        import tiktoken

        # a byte's printable stand-in in the file: itself, or the next free character from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stands = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        with open(vocabulary, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        # strings that stand for one id wherever they occur in a text
        self.added = {t["content"].encode(): t["id"] for t in whole.get("added_tokens") or []}
        if any(t[flag] for t in whole.get("added_tokens") or [] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with a flag are not supported")
        # at one place the longest wins
        self.special = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        # ids follow the order of the merges, so they serve as ranks; whatever is no byte string is a special token
        ranks = {bytes(stands[c] for c in token): k for token, k in model["vocab"].items() if k < 256 + len(model["merges"])}
        self.bpe = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.keys, self.where, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        where, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int32)
        for k, piece in enumerate(pieces):
            ids = self.bpe.encode_ordinary(piece)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(ids)] = ids
            where[k], size[k] = self.used, len(ids)
            self.used += len(ids)
        spot = np.searchsorted(self.keys, keys)
        self.keys, self.where, self.size = np.insert(self.keys, spot, keys), np.insert(self.where, spot, where), np.insert(self.size, spot, size)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids per row)."""
        found = [(m.start(), m.end(), self.added[m.group()]) for m in self.special.finditer(data[offsets[0] : offsets[-1]])] if self.special else []
        row = np.searchsorted(offsets, [offsets[0] + a for a, _, _ in found], "right")
        # a match across two rows is none; such a match could hide a true one, so rows are searched one by one where there is any
        if any(offsets[0] + b > offsets[r] for (_, b, _), r in zip(found, row, strict=True)):
            found = [(a + m.start(), a + m.end(), self.added[m.group()]) for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True) for m in self.special.finditer(data[offsets[0] + a : offsets[0] + b])]
        if not found:
            return self._plain(data, offsets)
        # the added tokens and what lies between them as rows of their own
        cuts = np.array([[a, b] for a, b, _ in found]) + offsets[0]
        edges = np.sort(np.concatenate([offsets, cuts.ravel()]))  # a row's edge may be a cut as well
        ids, sizes = self._plain(data, edges)
        first = np.searchsorted(edges, cuts[:, 0], "right") - 1  # the piece that starts there and is not empty
        start = np.concatenate([[0], np.cumsum(sizes)])
        keep = np.ones(len(ids), bool)
        for k, (_, _, one) in zip(first.tolist(), found, strict=True):
            ids[start[k]] = one
            keep[start[k] + 1 : start[k + 1]] = False
            sizes[k] = 1
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids[keep], np.diff(total[np.searchsorted(edges, offsets)])

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode of rows without added tokens."""
        body, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        raw = body.tobytes()
        try:
            text = raw.decode()
            ahead = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
            at = ahead[at]
        except UnicodeDecodeError:
            rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            text, at = "".join(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        rows = len(at) - 1
        if not text:
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        start = pretokens(points, at)
        up, down = _powers(len(points))
        values = _tables()[1][points]
        values *= up[: len(points)]
        h = np.add.reduceat(values, start)
        h *= down[start]
        h = mix(h)
        unique, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > self.limit:
            self.forget()
        spot = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[spot] != unique) if len(self.keys) else np.arange(len(unique))
        if len(new):
            stop = np.append(start[1:], len(points))
            self.learn(unique[new], [text[start[k] : stop[k]] for k in first[new].tolist()])
            spot = np.searchsorted(self.keys, unique)
        size, where = self.size[spot][back].astype(np.int64), self.where[spot][back]
        before = np.cumsum(size) - size
        ids = self.ids[np.repeat(where - before, size) + np.arange(int(size.sum()))]
        edge = np.searchsorted(start, at)
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(total[edge])


_ENCODERS: dict[str, Encoder] = {}


def _pieces(vocabulary: str, capacity: int, end_id: int, keep_ids: bool) -> Callable:
    names = ["doc", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = Encoder(vocabulary)
        encoder = _ENCODERS[vocabulary]
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in spans(offsets):
                ids, sizes = encoder.encode(data, offsets[i : j + 1])
                edge = np.concatenate([[0], np.cumsum(sizes)])
                out: list[list] = [[] for _ in names]
                for k, doc in enumerate(batch.column(0).slice(i, j - i).to_pylist()):
                    own = np.append(ids[edge[k] : edge[k + 1]], np.uint32(end_id)).astype("<u4")
                    a, b = 0, len(own) % capacity or capacity
                    piece = 0
                    while a < len(own):
                        part = own[a:b]
                        for values, v in zip(out, (doc, piece, a, b - a, zlib.crc32(part), part.astype(np.int32)), strict=False):
                            values.append(v)
                        a, b, piece = b, b + capacity, piece + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out, kinds, strict=False)], names)

    return cut


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bin patterns ([(length, times in a bin)], number of such bins) of a histogram of lengths.

    A bin takes the largest length left, is filled greedily with the largest that fits, and then
    its smallest document gives way to the two unpacked documents that fit the expanded gap more
    tightly, if there are such. Equal bins that would follow are made at once.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, k in counts.items():
        left[size] = k
    plan = []
    while left.any():
        free = left.copy()
        lengths: list[int] = []
        gap = capacity
        while gap and (fit := np.flatnonzero(free[1 : gap + 1])).size:
            size = int(fit[-1]) + 1
            take = min(int(free[size]), gap // size)
            lengths += [size] * take
            free[size] -= take
            gap -= take * size
        if gap and len(lengths) > 1:
            small = lengths[-1]
            room = gap + small
            have = np.flatnonzero(free[1 : room + 1]) + 1
            best, two = small, None
            for a in have[::-1].tolist():
                if 2 * a < best:
                    break
                b = have[have <= min(room - a, a)]
                if len(b) and int(b[-1]) == a and free[a] < 2:
                    b = b[:-1]
                if len(b) and a + int(b[-1]) > best:
                    best, two = a + int(b[-1]), (a, int(b[-1]))
            if two:
                lengths[-1:] = two
        sizes, times = np.unique(lengths, return_counts=True)
        repeat = int((left[sizes] // times).min())
        left[sizes] -= times * repeat
        plan.append((list(zip(sizes[::-1].tolist(), times[::-1].tolist(), strict=True)), repeat))
    return plan


def _placer(plan: list[tuple[list[tuple[int, int]], int]]) -> Callable:
    """Adds sequence and offset to (length, rank): the pieces of a length fill its patterns in order."""
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    filled: dict[int, int] = {}
    for pattern, repeat in plan:
        offset = 0
        for size, times in pattern:
            ranges.setdefault(size, []).append((filled.get(size, 0), sequence, repeat, offset))
            filled[size] = filled.get(size, 0) + times * repeat
            offset += size * times
        sequence += repeat
    table = {size: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for size, rows in ranges.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            where, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length).tolist():
                own = np.flatnonzero(length == size)
                begin, first, repeat, base = table[size]
                k = np.searchsorted(begin, rank[own], "right") - 1
                step = rank[own] - begin[k]
                where[own], offset[own] = first[k] + step % repeat[k], base[k] + size * (step // repeat[k])
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(where), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return place


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).

    vocabulary: path, on every node, of a tokenizer JSON file with a byte-level BPE model whose ids
    follow its merges; its added tokens, where a text holds them, count as such. Every document ends with end_id.
    Documents over `capacity` are cut into pieces of that size, of which the first may be shorter.
    Null texts count as empty (one piece, the end id). Rows with a null id get pieces with a null id;
    repeated rows are packed one by one. No rows give no pieces. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    schema = "doc long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    pieces = materialize(rows.mapInArrow(_pieces(vocabulary, capacity, end_id, keep_ids), schema), "pieces")
    counts = {r.length: r.k for r in pieces.groupBy("length").agg(F.count("*").alias("k")).collect()}
    plan = best_two_fit(counts, capacity)
    # rank within a length: rank within (length, bucket) plus the pieces in earlier buckets
    buckets = max(8, sum(counts.values()) // BUCKET_ROWS)
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc", "piece"), F.lit(buckets)).cast("int"))
    before = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("k"))
    w = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "bucket", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("before"))
    inner = Window.partitionBy("length", "bucket").orderBy("doc", "piece")
    ranked = bucketed.withColumn("rn", F.row_number().over(inner)).join(before, ["length", "bucket"])
    ranked = ranked.select(*(c.split()[0] for c in schema.split(", ")), (F.col("before") + F.col("rn") - 1).alias("rank"))
    return ranked.mapInArrow(_placer(plan), f"{schema}, sequence_id long, offset long").withColumnRenamed("doc", id_col)
