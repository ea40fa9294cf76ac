"""Brown class-based bigram scoring.

P(text) = product over tokens of P(class | previous class) * P(token | class); a text ends with an
end token, whose class is also the context of the first word.

* Counts of all words of all training texts are gathered by a shuffle. The words counted most, as
  many as `head` allows (all words of a count or none), are clustered: the `core` most frequent of
  them by exchange on their bigram counts (a core x core matrix) until sweeps gain nothing more, every further
  one by one exchange step: it joins the class that raises the clustering's likelihood most, judged
  by its distributed counts of left and right classes.
* All other words, and words never seen, belong to a class that follows from their shape (length and
  last character); in it, words never seen are one event with the mass of the words seen once.
* Transitions are smoothed towards class frequencies.
* Scoring keeps the clustered words in each worker (26 bytes each); all other words are joined to
  the full count table, so nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import U64, Words, mix, spans, text_buffers, words
from .scratch import materialize

SHAPES = 16
#: Hash of the end token; outside the words' hash function.
END = np.int64(-0x61C8864680B583EB)
FLUSH = 1 << 20
PRIOR = 8.0
#: Exchange ends with a sweep that gains less than this share of the clustering's mutual information.
LEAST_GAIN = 1e-4


def _shapes(w: Words) -> np.ndarray:
    """Class 0..15 of each word by byte length (4 bands) and kind of last character (4 kinds)."""
    if not len(w.start):
        return np.zeros(0, np.int8)
    solid = ~np.isin(w.data, [9, 10, 11, 12, 13, 32])
    size = np.add.reduceat(solid.astype(np.int32), w.start)
    last = w.data[w.start + size - 1]
    kind = np.where(last >= 128, 1, np.where(((last | 32) >= 97) & ((last | 32) <= 122), 0, np.where((last == 46) | (last == 44), 2, 3)))
    return (np.digitize(size, [4, 7, 11]) * 4 + kind).astype(np.int8)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c, s) of the words of one column of texts, combined within the task."""
    keys, counts, shapes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
    texts = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts), pa.array(shapes.astype(np.int32))], ["h", "c", "s"])

    for batch in batches:
        texts += batch.num_rows
        data, offsets = text_buffers(batch.column(0))
        fresh = [(keys, counts, shapes)]
        for i, j in spans(offsets):
            w = words(data, offsets[i : j + 1])
            u, first, c = np.unique(w.hash, return_index=True, return_counts=True)
            fresh.append((u.view(np.int64), c, _shapes(w)[first]))
        every, counts, shapes = (np.concatenate(x) for x in zip(*fresh, strict=True))
        keys, first, back = np.unique(every, return_index=True, return_inverse=True)
        counts, shapes = np.bincount(back, counts, len(keys)).astype(np.int64), shapes[first]
        if len(keys) > FLUSH:
            yield out()
            keys, counts, shapes = keys[:0], counts[:0], shapes[:0]
    keys, counts, shapes = np.append(keys, END), np.append(counts, texts), np.append(shapes, np.int8(SHAPES))
    yield out()


def _find(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(h), -1, np.int64)
    spot = np.minimum(np.searchsorted(sorted_keys, h), len(sorted_keys) - 1)
    return np.where(sorted_keys[spot] == h, spot, -1)


def _classes(w: Words, head: np.ndarray, label: np.ndarray, used: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in head or -1, class) of each word; a word without a label has the class of its shape."""
    spot = _find(head, w.hash.view(np.int64))
    own = np.where(spot >= 0, label[spot], -1) if len(head) else spot
    return spot, np.where(own >= 0, own, used + _shapes(w).astype(np.int64))


def _framed(w: Words, symbols: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous, present, row) of every token, the end token of each row included."""
    n = len(w.counts)
    at = np.arange(len(symbols)) + w.doc
    present = np.full(len(symbols) + n, end, np.int64)
    present[at] = symbols
    row = np.repeat(np.arange(n), w.counts + 1)
    previous = np.empty_like(present)
    previous[1:] = present[:-1]
    previous[:1] = end
    return previous, present, row


def _bigrams(head: np.ndarray, label: np.ndarray, used: int) -> Callable:
    """(pair, c): counts of previous * size + present over the labels of head, the shapes and the end."""
    size = used + SHAPES + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in spans(offsets):
                w = words(data, offsets[i : j + 1])
                a, b, _ = _framed(w, _classes(w, head, label, used)[1], size - 1)
                table += np.bincount(a * size + b, minlength=size * size)
        pair = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(table[pair])], ["pair", "c"])

    return count


def _table(texts: DataFrame, head: np.ndarray, label: np.ndarray, used: int) -> np.ndarray:
    size = used + SHAPES + 1
    found = texts.mapInArrow(_bigrams(head, label, used), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    pairs = np.zeros(size * size, np.int64)
    pairs[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return pairs.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange_clusters(pairs: np.ndarray, core: int, classes: int) -> np.ndarray:
    """Class of each symbol: exchange clustering of the first `core` symbols of a square count table.

    Every further symbol keeps a class of its own. Each step moves one word to the class that raises
    sum n(g, h) log n(g, h) - sum n(g) log n(g) (left and right) most; sweeps end when no word moves
    or all moves of a sweep together raise that sum by less than LEAST_GAIN of it.
    """
    size = len(pairs)
    used = min(classes, max(core, 1))
    groups = used + size - core
    label = np.concatenate([np.arange(core) % used, used + np.arange(size - core)]).astype(np.int64)
    hot = np.zeros((size, groups))
    hot[np.arange(size), label] = 1
    pairs = pairs.astype(np.float64)
    table = hot.T @ pairs @ hot
    likelihood = lambda: float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum() + _xlogx(table.sum()))
    least = 1e-12 * (1 + float(_xlogx(pairs.sum())))  # rounding errors are no gain

    f, k, before = _xlogx, np.arange(used), -np.inf
    while core and (now := likelihood()) > before + LEAST_GAIN * abs(now):
        before = now
        right, left = pairs @ hot, (hot.T @ pairs).T
        for w in range(core):
            old = label[w]
            out, into, own = right[w], left[w], pairs[w, w]
            # without w: its row and column leave the class; a self-bigram counts once
            table[old] -= out
            table[:, old] -= into
            table[old, old] += own
            o, i = out.copy(), into.copy()
            o[old] -= own
            i[old] -= own
            gain = _gains(table, used, np.flatnonzero(o), o[o != 0], np.flatnonzero(i), i[i != 0])
            diagonal = table[k, k]
            gain -= f(diagonal + o[k]) - f(diagonal) + f(diagonal + i[k]) - f(diagonal)
            gain += f(diagonal + o[k] + i[k] + own) - f(diagonal)
            sums_r, sums_l = table[:used].sum(1), table[:, :used].sum(0)
            gain -= f(sums_r + out.sum()) - f(sums_r) + f(sums_l + into.sum()) - f(sums_l)
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + least:
                new = int(old)
            table[new] += o
            table[:, new] += i
            table[new, new] += own
            if new != old:
                label[w] = new
                hot[w, old], hot[w, new] = 0, 1
                column, line = pairs[:, w], pairs[w]
                right[:, old] -= column
                right[:, new] += column
                left[:, old] -= line
                left[:, new] += line
    return label


def _gains(table: np.ndarray, used: int, right: np.ndarray, o: np.ndarray, left: np.ndarray, i: np.ndarray) -> np.ndarray:
    """What each class gains in its pairs by a word with counts o to the classes `right` and i from the classes `left`."""
    rows, cols = table[:used, right], table[left, :used].T
    return (_xlogx(rows + o) - _xlogx(rows)).sum(1) + (_xlogx(cols + i) - _xlogx(cols)).sum(1)


def _contexts(head: np.ndarray, label: np.ndarray, used: int) -> Callable:
    """(w, side, g, c): how often class g follows (side 0) or precedes (side 1) each word of head without a label."""
    size = used + SHAPES + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            word, rest = np.divmod(codes, 2 * size)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (word, rest // size, rest % size)] + [pa.array(counts)], ["w", "side", "g", "c"])

        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            fresh = [(codes, counts)]
            for i, j in spans(offsets):
                w = words(data, offsets[i : j + 1])
                spot, own = _classes(w, head, label, used)
                a, b, _ = _framed(w, own, size - 1)
                at = np.arange(len(spot)) + w.doc  # the word's place among the tokens
                open_ = np.flatnonzero((spot >= 0) & (own >= used))
                key = spot[open_] * 2 * size
                fresh.append(np.unique(np.concatenate([key + b[at[open_] + 1], key + size + a[at[open_]]]), return_counts=True))
            every, many = (np.concatenate(x) for x in zip(*fresh, strict=True))
            codes, back = np.unique(every, return_inverse=True)
            counts = np.bincount(back, many, len(codes)).astype(np.int64)
            if len(codes) > FLUSH:
                yield out()
                codes, counts = codes[:0], counts[:0]
        yield out()

    return count


def _assigner(table: np.ndarray, used: int) -> Callable:
    """(w, class) of rows (w, side, g, c) sorted by w: the class with the largest exchange gain, the first of equals."""
    size = len(table)
    rows, cols = table.sum(1)[:used], table.sum(0)[:used]

    def judged(w: np.ndarray, side: np.ndarray, g: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        code, back = np.unique((w.astype(np.int64) * 2 + side) * size + g, return_inverse=True)
        c = np.bincount(back, c, len(code))
        w, rest = np.divmod(code, 2 * size)
        side, g = np.divmod(rest, size)
        new = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        best = np.zeros(len(new), np.int32)
        total = [np.add.reduceat(np.where(side == s, c, 0), new)[:, None] for s in (0, 1)]
        gain = -(_xlogx(rows + total[0]) - _xlogx(rows)) - (_xlogx(cols + total[1]) - _xlogx(cols))
        for a in range(0, len(code), 1 << 14):
            part = slice(a, a + (1 << 14))
            base = np.where(side[part, None] == 0, table[:used].T[g[part]], table[g[part], :used])
            np.add.at(gain, np.searchsorted(new, np.arange(len(code))[part], "right") - 1, _xlogx(base + c[part, None]) - _xlogx(base))
        best[:] = gain.argmax(1)
        return pa.RecordBatch.from_arrays([pa.array(w[new].astype(np.int32)), pa.array(best)], ["w", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols_ = [batch.column(k).to_numpy() for k in range(4)]
            held = cols_ if held is None else [np.concatenate(x) for x in zip(held, cols_, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last word may go on
            if cut:
                yield judged(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield judged(*held)

    return run


@dataclass
class ClassModel:
    tokens: int  # N
    types: int  # V
    head: np.ndarray  # sorted hashes of the clustered words
    head_counts: np.ndarray
    label: np.ndarray  # their classes
    emission: np.ndarray  # log10 P(word | class)
    used: int  # classes of clustered words; SHAPES shape classes and the end's follow
    transition: np.ndarray  # log10, classes x classes
    shape_tokens: np.ndarray  # training tokens of each shape class
    shape_unseen: np.ndarray  # probability of a word never seen, per shape class


def _cut(counts: DataFrame, head: int) -> int:
    """The smallest count from which on at most `head` words are left; words seen once are below it."""
    many = counts.filter(F.col("h") != int(END)).groupBy("c").agg(F.count("*").alias("n")).toPandas().sort_values("c", ascending=False)
    fit = many[(many.n.cumsum() <= head) & (many.c > 1)]
    return int(fit.c.min()) if len(fit) else int(many.c.max()) + 1 if len(many) else 1


def fit(texts: DataFrame, counts: DataFrame, core: int, classes: int, head: int) -> ClassModel:
    """texts: one column of training texts; counts: (h, c, s) of all their tokens."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    cut = _cut(counts, head)
    top = counts.filter((F.col("h") != int(END)) & (F.col("c") >= cut)).select("h", "c").toArrow()
    h, c = top.column(0).to_numpy(), top.column(1).to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    # the core, clustered by exchange
    first = np.sort(np.lexsort((h, -c))[:core])
    seeds = len(first)
    symbol = np.full(len(h), -1, np.int64)
    symbol[first] = np.arange(seeds)
    pairs = _table(texts, h, symbol, seeds)
    found = exchange_clusters(pairs, seeds, classes)
    used = min(classes, max(seeds, 1))
    hot = np.zeros((len(pairs), used + SHAPES + 1))
    hot[np.arange(len(pairs)), found] = 1
    table = hot.T @ pairs @ hot
    label = np.full(len(h), -1, np.int64)
    label[first] = found[:seeds]
    # every further word of the head, by one exchange step
    if len(h) > seeds:
        contexts = texts.mapInArrow(_contexts(h, label, used), "w int, side int, g int, c long")
        chosen = contexts.repartition("w").sortWithinPartitions("w").mapInArrow(_assigner(table, used), "w int, k int").toArrow()
        label[chosen.column(0).to_numpy()] = chosen.column(1).to_numpy()
        table = _table(texts, h, label, used).astype(float)
    groups = len(table)
    share = (table.sum(0) + 1) / (table.sum() + groups)
    transition = np.log10((table + PRIOR * share) / (table.sum(1, keepdims=True) + PRIOR))
    emission = np.log10(c / np.bincount(label, c, groups)[label]) if len(h) else np.zeros(0)
    # shape classes hold the words outside the head
    rest = counts.filter((F.col("c") < cut) & (F.col("h") != int(END))).groupBy("s").agg(F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("once")).toPandas()
    tokens, once = np.zeros(SHAPES), np.zeros(SHAPES)
    tokens[rest.s], once[rest.s] = rest.n, rest.once
    unseen = (once + 0.5) / (tokens + once + 1)
    return ClassModel(int(total.n), int(total.v), h, c, label, emission, used, transition, tokens, unseen)


def _scorer(m: ClassModel) -> Callable:
    end = m.used + SHAPES
    floor = np.log10(m.tokens + m.types + 1)
    base = np.log10(m.head_counts + 1.0) - floor

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(3))
            for i, j in spans(offsets):
                n = j - i
                w = words(data, offsets[i : j + 1])
                h = w.hash.view(np.int64)
                spot, own = _classes(w, m.head, m.label, m.used)
                hit = spot >= 0
                known = np.bincount(w.doc[hit], minlength=n)
                sums = [np.bincount(w.doc[hit], x[spot[hit]], n) for x in (base, m.emission)]
                a, b, row = _framed(w, own, end)
                moves = np.bincount(row, m.transition[a, b], n)
                # other words: one row per (text, word)
                tail = ~hit
                th, td, ts = h[tail], w.doc[tail], own[tail] - m.used
                order = np.lexsort((th, td))
                th, td, ts = th[order], td[order], ts[order]
                new = np.ones(len(th), bool)
                new[1:] = (th[1:] != th[:-1]) | (td[1:] != td[:-1])
                at = np.flatnonzero(new)
                many = np.diff(np.append(at, len(th)))
                uid = batch.column(0).slice(i, n).to_numpy(zero_copy_only=False)
                blank = len(at)
                nulls = pa.nulls
                summary = pa.RecordBatch.from_arrays(
                    [pa.array(uid), batch.column(1).slice(i, n).cast(pa.int64()), batch.column(2).slice(i, n), pa.array(mix(uid.astype(U64) ^ U64(0x5DEECE66D)).view(np.int64)), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(w.counts + 1), pa.array(known.astype(np.int64)), pa.array(sums[0].astype(float)), pa.array((sums[1] + moves).astype(float))],
                    NAMES,
                )
                yield summary
                if blank:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(uid[td[at]]), nulls(blank, pa.int64()), nulls(blank, pa.bool_()), pa.array(th[at]), pa.array(many.astype(np.int32)), pa.array(ts[at].astype(np.int32)), nulls(blank, pa.int64()), nulls(blank, pa.int64()), nulls(blank, pa.float64()), nulls(blank, pa.float64())],
                        NAMES,
                    )

    return score


NAMES = ["uid", "id", "held", "h", "n", "s", "n_tokens", "n_known", "base", "score"]


def class_ngram_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, core: int = 1024, classes: int = 64, head: int = 1 << 18) -> DataFrame:
    """Per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where held_out is not true; scores all rows, repeated ones one by one.
    Null texts count as empty and hold just the end token; a null id counts as an empty string.
    Without training rows every token is unknown and base_score is 0. Only id_col and text_col are
    read besides the columns of held_out. core: words clustered on the driver; head: words that may
    be clustered at all and that each worker holds.
    """
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    texts = rows.filter("not held").select("text")
    counts = texts.mapInArrow(_counter, "h long, c long, s int").groupBy("h").agg(F.sum("c").alias("c"), F.min("s").alias("s")).filter("c > 0")
    counts = materialize(counts, "token-counts")
    m = fit(texts, counts, core, classes, head)
    end_count = counts.filter(F.col("h") == int(END)).agg(F.coalesce(F.max("c"), F.lit(0)).alias("c")).first().c
    floor = float(np.log10(m.tokens + m.types + 1))
    parts = rows.mapInArrow(_scorer(m), "uid long, id long, held boolean, h long, n int, s int, n_tokens long, n_known long, base double, score double")
    joined = parts.join(counts.select("h", "c"), "h", "left").withColumn("c", F.when(F.col("n") > 0, F.coalesce("c", F.lit(0))))
    seen = [float(np.log10((1 - u) / max(t, 1))) for u, t in zip(m.shape_unseen, m.shape_tokens, strict=True)]
    unseen = [float(np.log10(u)) for u in m.shape_unseen]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("s") + 1)
    emitted = F.when(F.col("c") > 0, F.log10("c") + pick(seen)).otherwise(pick(unseen))
    out = joined.groupBy("uid").agg(
        F.max("id").alias(id_col),
        F.max("held").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.sum(F.coalesce("n_known", F.lit(0)) + F.when(F.col("c") > 0, F.col("n")).otherwise(0)) + F.lit(int(end_count > 0))).cast("long").alias("n_known"),
        (F.sum(F.coalesce("base", F.lit(0.0)) + F.when(F.col("n") > 0, F.col("n") * (F.log10(F.col("c") + 1) - floor)).otherwise(0.0)) + (float(np.log10(end_count + 1)) - floor)).alias("base_score"),
        F.sum(F.coalesce("score", F.lit(0.0)) + F.when(F.col("n") > 0, F.col("n") * emitted).otherwise(0.0)).alias("score"),
    )
    return out.select(id_col, "held_out", "n_tokens", "n_known", F.lit(m.tokens).cast("long").alias("train_tokens"), "base_score", "score")
