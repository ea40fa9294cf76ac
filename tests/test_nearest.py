"""The blocked search against a plain loop, on odd vectors."""

import math

import pytest

from corvane.operators import nearest, retrieval


def _plain(store, queries, k, cosine):
    """(query, id, score) by sums in order; a score that is no number is the largest, ties by id."""
    out = []
    for qid, q in queries:
        rows = []
        for vid, v in store:
            if v is None or q is None or len(v) != len(q) or None in v or None in q:
                continue
            if cosine:
                ab = aa = bb = 0.0
                for x, y in zip(v, q, strict=True):
                    ab, aa, bb = ab + x * y, aa + x * x, bb + y * y
                score = ab / math.sqrt(aa * bb) if aa * bb else math.nan
                rows.append((-math.inf if math.isnan(score) else -score, vid, score))
            else:
                d = 0.0
                for x, y in zip(v, q, strict=True):
                    d += (x - y) * (x - y)
                rows.append((math.sqrt(d), vid, math.sqrt(d)))
        out += [(qid, vid, "nan" if math.isnan(s) else s) for _, vid, s in sorted(rows)[:k]]
    return sorted(out, key=str)


def _vectors(n, seed):
    state = seed
    rows = []
    for i in range(n):
        v = []
        for _ in range(5):
            state = (state * 1103515245 + 12345) % 2**31
            v.append(float((state >> 12) % 7 - 3))  # small integers: many ties, copies and zeros
        rows.append((i, [0.0] * 5 if i % 40 == 7 else rows[i - 1][1] if i % 3 == 2 else None if i == 50 else v[:4] if i % 25 == 1 else v))
    return rows


@pytest.mark.parametrize("sizes", [(nearest.CELLS, nearest.PENDING), (60, 50)])
def test_search_equals_a_plain_loop(spark, monkeypatch, sizes):
    monkeypatch.setattr(nearest, "CELLS", sizes[0])
    monkeypatch.setattr(nearest, "PENDING", sizes[1])
    store = _vectors(200, 3)
    queries = store[::4]
    table = spark.createDataFrame(store, "vec_id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame(queries, "vec_id long, embedding array<float>")
    for cosine in (True, False):
        found = (retrieval.search(table, asked, 6) if cosine else retrieval.knn(table, asked, 6)).collect()
        name = "relevance_score" if cosine else "distance"
        got = sorted(((r.query_id, r.vec_id, "nan" if math.isnan(r[name]) else r[name]) for r in found), key=str)
        assert got == _plain(store, queries, 6, cosine)


def test_ties_go_by_text_ids_and_vectors_with_a_null_element_are_none(spark):
    store = [("b", [1.0, 0.0]), ("ä", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [1.0, None]), ("d", [2.0, 0.1])]
    table = spark.createDataFrame(store, "chunk_id string, embedding array<double>")
    asked = table.filter("chunk_id = 'a'")
    assert [r.chunk_id for r in retrieval.knn(table, asked, 9, id_col="chunk_id").orderBy("rank").collect()] == ["a", "b", "ä", "d"]
    assert [r.chunk_id for r in retrieval.search(table, asked, 2, id_col="chunk_id").orderBy("rank").collect()] == ["a", "b"]


def test_pairs_are_never_rows_of_a_join(spark):
    table = spark.createDataFrame(_vectors(60, 5), "vec_id long, embedding array<float>")
    for found in (retrieval.search(table, table, 3), retrieval.knn(table, table, 3)):
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_many_copies_of_a_vector_are_few_candidates():
    import numpy as np
    import pyarrow as pa

    n = 3000
    vectors = pa.array([[1.0, 2.0, 3.0]] * n, pa.list_(pa.float32()))
    ids = pa.array(np.arange(n)[::-1])
    best = nearest.Nearest(pa.table({"query_id": ids, "_q": vectors}), 4, True)
    best.add(pa.StructArray.from_arrays([ids], ["vec_id"]), ids, vectors)
    assert best.n_waiting == 4  # of 9,000,000 pairs
    found = list(best.best())
    assert sum(len(s) for s, _, _ in found) == 4 * n and {r["vec_id"] for s, _, _ in found for r in s.to_pylist()} == {0, 1, 2, 3}
