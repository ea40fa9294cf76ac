"""Toxicity by maximum-scoring segments.

Token scores are log-odds of the toxic against the other class with an informative Dirichlet
prior, shrunk by one standard error, minus a drift, so that ordinary text scores below zero.
A linear-time scan (Ruzzo and Tompa) finds all maximal scoring segments of a text. Segment
scores are judged by the extreme-value law of Karlin and Altschul, P(S >= x) = 1 - exp(-K n
exp(-lambda x)): lambda from the token scores of the other class, K from its texts' best
segments. Minus log of the expected number, summed over significant segments, is mapped to 0..1
by a logistic fit.

Words are runs of letters, digits and bytes over 127, A-Z lower-cased; a word that was too rare to
learn scores nothing but the drift. Every word that the labelled sample tells about has a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import _CODES, Words, spans, text_buffers, words
from .scratch import materialize

SAMPLE = 40_000
PRIOR = 200.0
FLOOR = 0.1
DRIFT = 0.35
_LETTERS = _CODES.copy()
_LETTERS[[b for b in range(128) if not chr(b).isalnum()]] = 0


def _first(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Index of one occurrence of each key in each row."""
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return order[new]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, y, c) of (label, text): texts with each word by label 0..3."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        label = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in spans(offsets, 2 << 20):
            w = words(data, offsets[i : j + 1], _LETTERS)
            y = label[i:j][w.doc]
            for side in range(4):
                pick = y == side
                # a word counts once per text, so that one text or its copies make no evidence by repetition
                own = w.hash[pick]
                u, c = np.unique(own[_first(own, w.doc[pick])], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.full(len(u), side, np.int32)), pa.array(c)], ["h", "y", "c"])


@dataclass
class ToxicModel:
    keys: np.ndarray  # sorted hashes
    scores: np.ndarray
    rate: float  # lambda
    scale: float  # K
    weights: np.ndarray  # logistic: bias, weight


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) of a row of numbers, in linear time."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    found: list[list] = []  # start, end, sum before, sum after, index of the nearest earlier one with a smaller sum before
    for k in np.flatnonzero(score > 0).tolist():
        new = [k, k + 1, total[k], total[k + 1]]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                found.append([*new, j])
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, float(r - left)) for a, b, left, r, _ in found]


def _token_scores(m: ToxicModel, w: Words) -> np.ndarray:
    out = np.full(len(w.hash), -DRIFT)
    if len(m.keys) and len(w.hash):
        k = w.hash.view(np.int64)
        spot = np.minimum(np.searchsorted(m.keys, k), len(m.keys) - 1)
        hit = m.keys[spot] == k
        out[hit] = m.scores[spot[hit]] - DRIFT
    return out


def _passages(m: ToxicModel, w: Words) -> Iterator[list[tuple[int, int, float, float]]]:
    """Per row: (start, end, score, minus log of the expected number) of its significant segments."""
    score = _token_scores(m, w)
    some = np.bincount(w.doc[score > 0], minlength=len(w.counts)) > 0
    for k in range(len(w.counts)):
        if not some[k]:
            yield []
            continue
        a, n = w.first[k], w.counts[k]
        base = np.log(m.scale * n)
        yield [(i, j, s, m.rate * s - base) for i, j, s in segments(score[a : a + n]) if m.rate * s > base]


def _rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive solution of sum share * exp(rate * score) = 1."""
    low, high = 0.0, 1.0
    f = lambda r: float((shares * np.exp(np.minimum(r * scores, 700))).sum()) - 1
    while f(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> ToxicModel:
    """Learn from at most `sample` labelled ids, those of the smallest hash; ids with both labels are left out.

    The dictionary, which every worker holds, has no more entries than those texts have words.
    """
    picked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    picked = picked.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high")).filter("label = high").drop("high").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    rows = rows.dropDuplicates(["text", "label"])
    # a quarter of the texts calibrates scores learnt from the others; the final scores are learnt from all
    aside = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    rows = rows.select((F.col("label") + F.when(aside, 2).otherwise(0)).cast("int").alias("label"), "text")
    of = lambda *sides: F.sum(F.when(F.col("y").isin(*sides), F.col("c")).otherwise(0))
    counts = rows.mapInArrow(_count, "h long, y int, c long").groupBy("h").agg(of(1, 3).alias("a"), of(0, 2).alias("b"), of(1).alias("a1"), of(0).alias("b1"))
    counts = materialize(counts.filter("a + b >= 4"), "toxic-counts")
    m = _dictionary(counts, "a", "b")
    trial = _dictionary(counts, "a1", "b1")
    if not len(m.keys) or not len(trial.keys):
        return m
    apart = rows.filter("label >= 2").select((F.col("label") - 2).alias("label"), "text")
    best = apart.mapInArrow(_scan(trial, "fit"), "label int, n int, best double").toPandas().sort_values(["label", "n", "best"])
    clean = best[best.label == 0]
    # under the law the mean of n * exp(-rate * best) over texts is 1 / K
    if len(clean):
        trial.scale = m.scale = float(1 / max((clean.n * np.exp(-trial.rate * clean.best)).mean(), 1e-9))
    total = apart.mapInArrow(_scan(trial, "sums"), "label int, n int, best double").toPandas().sort_values(["label", "best"])
    x, y = np.log1p(total.best.to_numpy(float)), total.label.to_numpy(float)
    z = np.stack([np.ones(len(x)), x], 1)
    w = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2)
        w += np.clip(np.linalg.solve(hess, z.T @ (y - p) - 0.1 * w), -3, 3)
    m.weights = w
    return m


def _dictionary(counts: DataFrame, a: str, b: str) -> ToxicModel:
    """Token scores and their lambda from the counts a (label 1) and b (label 0)."""
    n = counts.agg(F.coalesce(F.sum(a), F.lit(0)).alias("a"), F.coalesce(F.sum(b), F.lit(0)).alias("b")).first()
    if not n.a or not n.b:
        return ToxicModel(np.zeros(0, np.int64), np.zeros(0), 1.0, 1.0, np.array([1.0 if n.a else -1.0, 0.0]))
    # Dirichlet prior: FLOOR for each token and PRIOR dealt out by the tokens' shares in both classes
    prior = F.lit(FLOOR) + F.lit(PRIOR) * (F.col(a) + F.col(b)) / (n.a + n.b)
    up, down = F.col(a) + prior, F.col(b) + prior * (n.b / n.a)
    scored = counts.select("h", F.col(b).alias("b"), (F.log(up / n.a) - F.log(down / n.b)).alias("d"), F.sqrt(1 / up + 1 / down).alias("e"))
    scored = scored.withColumn("z", F.abs("d") / F.col("e"))
    kept = scored.filter("z > 1.5").select("h", "b", (F.signum("d") * (F.abs("d") - F.col("e"))).alias("s")).toPandas()
    order = np.argsort(kept.h.to_numpy(np.int64))
    keys, scores, seen = kept.h.to_numpy(np.int64)[order], kept.s.to_numpy(float)[order], kept.b.to_numpy(float)[order]
    share = seen / n.b
    share = np.append(share, max(1 - share.sum(), 0.0))
    return ToxicModel(keys, scores, _rate(np.append(scores - DRIFT, -DRIFT), share), 1.0, np.array([-1.0, 0.0]))


def _scan(m: ToxicModel, what: str) -> Callable:
    """fit: best segment score of (label, text); sums: summed significance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in spans(offsets):
                w = words(data, offsets[i : j + 1], _LETTERS)
                if what == "fit":
                    score = _token_scores(m, w)
                    some = np.bincount(w.doc[score > 0], minlength=j - i) > 0
                    value = [max((s for *_, s in segments(score[a : a + n])), default=0.0) if h else 0.0 for a, n, h in zip(w.first, w.counts, some, strict=True)]
                else:
                    value = [float(sum(e for *_, e in found)) for found in _passages(m, w)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(w.counts.astype(np.int32)), pa.array(value, pa.float64())], ["label", "n", "best"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with score (0 to 1), predicted and passages (start and end word, score, minus log E).

    Null and empty texts have no passages and get the score of a text without any.
    """
    kept = docs.select(F.struct(*keep).alias("kept"), F.col(text_col).alias("text"))
    schema = f"kept {kept.schema['kept'].dataType.simpleString()}, score double, predicted int, passages array<struct<start:int,end:int,score:double,significance:double>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("significance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in spans(offsets):
                found = list(_passages(model, words(data, offsets[i : j + 1], _LETTERS)))
                x = np.log1p([float(sum(e for *_, e in row)) for row in found])
                p = 1 / (1 + np.exp(-np.clip(model.weights[0] + model.weights[1] * x, -40, 40)))
                rows = [[dict(zip(("start", "end", "score", "significance"), s, strict=True)) for s in row] for row in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(rows, kind)], ["kept", "score", "predicted", "passages"])

    return kept.mapInArrow(run, schema).select("kept.*", "score", "predicted", "passages")
