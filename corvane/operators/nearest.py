"""The exact k best rows of many queries, of the rows that one task sees.

Blocks of rows meet blocks of queries in a matrix product in single precision, which only rules out:
what it leaves within its error bound is scored in double, summed in the order of the elements.
A task holds one batch of rows and k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# sizes of work, none of which changes a result
CELLS = 1 << 22  # scores of a block
PENDING = 1 << 19  # candidates that wait to be merged
PAIRS = 1 << 15  # pairs scored in double at a time
SENT = 1 << 16  # rows of a batch that is sent on


def by_dimension(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each dimension; a null vector, or one with a null element, is none."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    if flat.null_count:
        parents = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
        lengths[parents[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    values = flat.to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == d)
        yield at, values.reshape(-1, d) if d and len(at) * d == len(values) else values[starts[at][:, None] + np.arange(d)]


def order_of(ids: pa.Array) -> np.ndarray:
    """Integers in the order of the ids, nulls first."""
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return ids.to_numpy(zero_copy_only=False)
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def same(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first of each different row, number of its kind for each row)."""
    if not matrix.shape[1]:
        return np.zeros(min(len(matrix), 1), np.int64), np.zeros(len(matrix), np.int64)
    raw = np.ascontiguousarray(matrix).view(np.dtype((np.void, matrix.dtype.itemsize * matrix.shape[1]))).ravel()
    _, first, kind = np.unique(raw, return_index=True, return_inverse=True)
    return first, kind.ravel()


def in_order(products: np.ndarray) -> np.ndarray:
    """Sums of rows, element by element."""
    return np.cumsum(products, axis=1)[:, -1] + 0.0 if products.shape[1] else np.zeros(len(products))


def places_within(sorted_groups: np.ndarray) -> np.ndarray:
    """0, 1, … within each run of equal values."""
    new = np.r_[True, sorted_groups[1:] != sorted_groups[:-1]] if len(sorted_groups) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    return np.arange(len(sorted_groups)) - np.repeat(starts, np.diff(np.r_[starts, len(sorted_groups)]))


class Group:
    """The queries of one dimension and their best rows so far. A key is -score or the distance: the least is best."""

    def __init__(self, at: np.ndarray, matrix: np.ndarray, k: int, cosine: bool, apart: bool) -> None:
        first, kind = (np.arange(len(matrix)), np.arange(len(matrix))) if apart else same(matrix)
        self.k, self.cosine, d = k, cosine, matrix.shape[1]
        self.q = matrix[first].astype(np.float64)
        order = np.argsort(kind, kind="stable")
        self.owners, self.owned = at[order], np.bincount(kind, minlength=len(first))
        self.owner_at = np.cumsum(self.owned) - self.owned
        self.squares = in_order(self.q * self.q)
        self.error = (d + 16) * 2.0**-22
        self.size = np.sqrt(self.squares)
        if cosine:
            self.left = (-self.q / self.size[:, None]).astype(np.float32)
        else:
            self.left = np.c_[-2 * self.q, np.ones(len(self.q)), self.size].astype(np.float32)
        self.least = np.full(len(self.q), np.inf)  # key of the k-th best row
        self.u, self.key, self.row = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def right(self, matrix: np.ndarray) -> np.ndarray:
        """The side of the rows in a product that is at most the key, or, of distances, its square less the query's, plus the bound of errors."""
        squares = (matrix * matrix).sum(axis=1)
        if self.cosine:
            return (matrix / np.sqrt(squares)[:, None]).astype(np.float32)
        return np.c_[matrix, squares * (1 - self.error), -2 * self.error * np.sqrt(squares)].astype(np.float32)

    def candidates(self, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) of all pairs that may be among the best; what is not a number stays."""
        right = self.right(matrix).T
        most = np.sqrt((matrix * matrix).sum(axis=1).max(initial=0))
        step = max(1, CELLS // max(1, len(matrix)))
        for low in range(0, len(self.q), step):
            part = slice(low, low + step)
            about = self.left[part] @ right
            if self.cosine:
                cut, spread = self.least[part] + self.error, self.error
            else:
                cut = self.least[part] ** 2 * (1 + self.error) - self.squares[part] * (1 - self.error)
                spread = self.error * (self.size[part] + most) ** 2
            fits = ~(about > cut.astype(np.float32)[:, None])
            if len(matrix) > self.k and np.count_nonzero(fits) > 4 * self.k * len(about):
                # k rows of this block have keys up to this one
                kth = np.partition(about, self.k - 1, axis=1)[:, self.k - 1] + 2 * spread
                fits = ~(about > np.fmin(cut, kth).astype(np.float32)[:, None])
            found = np.flatnonzero(fits)
            yield found // len(matrix) + low, found % len(matrix)

    def keys(self, u: np.ndarray, r: np.ndarray, matrix: np.ndarray, squares: np.ndarray) -> np.ndarray:
        out = np.empty(len(u))
        for low in range(0, len(u), PAIRS):
            part = slice(low, low + PAIRS)
            a, b = matrix[r[part]], self.q[u[part]]
            out[part] = -(in_order(a * b) / np.sqrt(squares[r[part]] * self.squares[u[part]])) if self.cosine else np.sqrt(in_order((a - b) * (a - b)))
        return out


class Nearest:
    """The k best rows of each query by cosine (or the least distance), ties by id; scores that are no numbers count as the largest."""

    def __init__(self, queries: pa.Table, k: int, cosine: bool, skip_self: bool = False) -> None:
        self.k, self.cosine, self.skip_self = k, cosine, skip_self
        queries = queries.combine_chunks()
        self.query_ids = pa.concat_arrays(queries["query_id"].chunks) if queries.num_rows else pa.array([], queries.schema.field("query_id").type)
        vectors = pa.concat_arrays(queries["_q"].chunks) if queries.num_rows else pa.array([], queries.schema.field("_q").type)
        with np.errstate(all="ignore"):
            self.groups = {m.shape[1]: Group(at, m, k, cosine, skip_self) for at, m in by_dimension(vectors)}
        self.pool: list[pa.Array] = []  # what is sent on of the rows that the state and the candidates refer to
        self.pooled = 0
        self.ids: list[pa.Array] = []
        self.waiting: list[tuple[Group, np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, rows: pa.Array, ids: pa.Array, vectors: pa.Array) -> None:
        with np.errstate(all="ignore"):
            for at, matrix in by_dimension(vectors):
                if group := self.groups.get(matrix.shape[1]):
                    self._add(group, at, matrix, rows, ids)

    def _add(self, group: Group, at: np.ndarray, matrix: np.ndarray, rows: pa.Array, ids: pa.Array) -> None:
        if not self.skip_self:  # of equal vectors the k least ids are enough
            first, kind = same(matrix)
            if len(first) < len(at):
                order = np.lexsort((order_of(ids.take(pa.array(at))), kind))
                kept = np.sort(order[places_within(kind[order]) < self.k])
                at, matrix = at[kept], matrix[kept]
        matrix = matrix.astype(np.float64)
        squares = in_order(matrix * matrix)
        own = ids.take(pa.array(at))
        for u, r in group.candidates(matrix):
            if self.skip_self and len(u):
                other = pc.not_equal(self.query_ids.take(pa.array(group.owners[group.owner_at[u]])), own.take(pa.array(r)))
                other = pc.fill_null(other, False).to_numpy(zero_copy_only=False)
                u, r = u[other], r[other]
            if not len(u):
                continue
            used, place = np.unique(r, return_inverse=True)
            self.pool.append(rows.take(pa.array(at[used])))
            self.ids.append(own.take(pa.array(used)))
            self.waiting.append((group, u, group.keys(u, r, matrix, squares), place.ravel() + self.pooled))
            self.pooled += len(used)
            self.n_waiting += len(u)
            if self.n_waiting >= PENDING:
                self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        pool, ids = pa.concat_arrays(self.pool), pa.concat_arrays(self.ids)
        order = order_of(ids)
        for group in {id(w[0]): w[0] for w in self.waiting}.values():
            new = [w[1:] for w in self.waiting if w[0] is group]
            u, key, row = (np.concatenate(x) for x in zip((group.u, group.key, group.row), *new, strict=True))
            odd = np.isnan(key)
            rank = np.where(odd, -np.inf if self.cosine else np.inf, key)
            by = np.lexsort((order[row], ~odd if self.cosine else odd, rank, u))
            by = by[places_within(u[by]) < self.k]
            group.u, group.key, group.row = u[by], key[by], row[by]
            last = by[places_within(u[by]) == self.k - 1]
            group.least[u[last]] = rank[last]
        held = np.unique(np.concatenate([g.row for g in self.groups.values()]))
        for g in self.groups.values():
            g.row = np.searchsorted(held, g.row)
        self.pool, self.ids, self.pooled = [pool.take(pa.array(held))], [ids.take(pa.array(held))], len(held)
        self.waiting, self.n_waiting = [], 0

    def best(self) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        """(rows, query ids, scores or distances); queries with equal vectors have the same rows."""
        self.merge()
        for g in self.groups.values():
            for low in range(0, len(g.u), SENT):
                u, key, row = (x[low : low + SENT] for x in (g.u, g.key, g.row))
                times = g.owned[u]
                entry = np.repeat(np.arange(len(u)), times)
                place = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
                for a in range(0, len(entry), SENT):
                    e, p = entry[a : a + SENT], place[a : a + SENT]
                    owner = g.owners[g.owner_at[u[e]] + p]
                    yield self.pool[0].take(pa.array(row[e])), self.query_ids.take(pa.array(owner)), pa.array(-key[e] if self.cosine else key[e])
