"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a document labelled 1 over one labelled 0) from a bounded sample of labelled
documents; the score is linear in text features and learnt by logistic loss on feature
differences. The cut is the quantile of scores that separates the labels best on the sample;
scores are mapped to 0..1 so that the cut lies at `threshold`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import _WORD_BYTE, spans, text_buffers, words

SAMPLE = 20_000
PAIRS_EACH = 8


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, k) features of texts, from bytes and words alone."""
    w = words(data, offsets)
    n = len(w.counts)
    b = w.data
    row = np.repeat(np.arange(n), np.diff(offsets))
    per = lambda mask, of=row: np.bincount(of[mask], minlength=n).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    count = np.maximum(w.counts, 1).astype(float)
    upper, digit = (b >= 65) & (b <= 90), (b >= 48) & (b <= 57)
    lower = (b >= 97) & (b <= 122)
    wide = b >= 128
    mark = _WORD_BYTE[b] & ~upper & ~lower & ~digit & ~wide
    plain = mark & ((b == 46) | (b == 44) | (b == 39) | (b == 45))
    letters = np.maximum(per(upper) + per(lower), 1)
    length = np.add.reduceat(_WORD_BYTE[b].astype(np.int64), w.start) if len(w.start) else np.zeros(0, np.int64)
    last = b[w.start + length - 1] if len(w.start) else np.zeros(0, np.uint8)
    odd_end = mark_of(last)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    kinds = np.bincount(d[new], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    most = np.zeros(n)
    np.maximum.at(most, d[new], runs)
    lines = per(b == 10) + 1
    sum_len = np.bincount(w.doc, length, n)
    long_words = per(length > 18, w.doc)
    return np.stack(
        [
            np.log1p(w.counts), sum_len / count, per(upper) / letters, per(mark & ~plain) / size, per(plain) / size, per(digit) / size,
            per(odd_end, w.doc) / count, per(same, w.doc) / count, kinds / count, most / count, np.log(count / lines), long_words / count,
            per(b == 124) / size, per(wide) / size, np.bincount(w.doc, (length <= 3).astype(float), n) / count, lines / count,
        ],
        axis=1,
    )


def mark_of(last: np.ndarray) -> np.ndarray:
    """Whether a word's last byte is a sign other than a letter, digit, full stop or comma."""
    alnum = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 48) & (last <= 57) | (last >= 128)
    return ~alnum & (last != 46) & (last != 44)


@dataclass
class Ranker:
    knots: np.ndarray  # (features, knots)
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    threshold: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        parts = [x] + [np.maximum(x - self.knots[:, k], 0) for k in range(self.knots.shape[1])]
        return np.concatenate(parts, axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((self.expand(x) - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.cut) + shift, -40, 40)))


def fit_pairs(x: np.ndarray, y: np.ndarray, threshold: float, seed: int = 7, ridge: float = 1e-3, steps: int = 25) -> Ranker:
    """Bradley-Terry weights by Newton steps, then cut and slope. One label only: a constant score."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    knots = np.quantile(x, [0.02, 0.1, 0.3, 0.7, 0.9, 0.98], axis=0).T if len(x) else np.zeros((x.shape[1], 6))
    r = Ranker(knots, np.zeros(1), np.ones(1), np.zeros(1), 0.0, 1.0, threshold)
    z = r.expand(x)
    k = z.shape[1]
    r.mean, r.scale, r.weights = np.zeros(k), np.ones(k), np.zeros(k)
    if not len(good) or not len(bad):
        r.cut = -1.0 if len(good) or not len(bad) else 1.0
        return r
    r.mean, r.scale = z.mean(0), z.std(0) + 1e-9
    z = (z - r.mean) / r.scale
    rng = np.random.default_rng(seed)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    one = np.repeat(few, PAIRS_EACH)
    other = rng.choice(many, len(one))
    diff = (z[other] - z[one]) if few is bad else (z[one] - z[other])
    w = np.zeros(k)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = diff.T @ (1 - p) / len(diff) - ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(k)
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    r.weights = w
    s = z @ w
    order = np.argsort(s, kind="stable")
    # cut after i documents: right = zeros below + ones above
    right = np.concatenate([[0], np.cumsum(y[order] == 0)]) + (y == 1).sum() - np.concatenate([[0], np.cumsum(y[order] == 1)])
    share = np.flatnonzero(right == right.max())
    i = int(share[len(share) // 2])
    edge = np.concatenate([[s[order[0]] - 1], s[order], [s[order[-1]] + 1]])
    r.cut = float((edge[i] + edge[i + 1]) / 2)
    a = 1.0
    for _ in range(50):  # slope by maximum likelihood around the cut
        t = s - r.cut
        p = 1 / (1 + np.exp(-np.clip(a * t + np.log(threshold / (1 - threshold)), -30, 30)))
        g, hh = ((y - p) * t).sum(), (p * (1 - p) * t * t).sum() + 1e-9
        a = min(max(a + g / hh, 0.05), 50.0)
    r.slope = a
    return r


def _featured(frame: DataFrame) -> DataFrame:
    """(label, x) of (label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in spans(offsets):
                x = features(data, offsets[i : j + 1])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int32()), lists], ["label", "x"])

    return frame.mapInArrow(run, "label int, x array<double>")


def fit_ranker(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, sample: int = SAMPLE) -> Ranker:
    """Learn from at most `sample` labelled ids, those of the smallest hash; ids with both labels are left out."""
    picked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    picked = picked.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high")).filter("label = high").drop("high").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("label", "text")
    found = _featured(rows).toArrow().combine_chunks()
    y = found.column("label").to_numpy()
    x = found.column("x").combine_chunks().flatten().to_numpy() if len(y) else np.zeros(0)
    width = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    x = x.reshape(-1, width)
    order = np.lexsort((*x.T, y))
    return fit_pairs(x[order], y[order], threshold)


def score_quality(docs: DataFrame, model: Ranker, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the score column (0 to 1) added; replaces a column of that name. Null texts count as empty."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        data, offsets = text_buffers(column)
        parts = [model.score(features(data, offsets[i : j + 1])) for i, j in spans(offsets)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(out, score(F.col(text_col)))


def held_out(column: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has the remainder; a null id counts as an empty string."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus == remainder
