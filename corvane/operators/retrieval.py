"""Vector stores as tables: exact nearest neighbours, filtered relevance search, retrieval."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corvane.errors import RetrievalError, StoreError

from .nearest import Nearest

OVERFETCH = 5
#: Query sets up to this number of rows are sent to the tasks whole; larger ones are dealt into blocks.
MAX_QUERIES = 32_768
FEW_QUERIES, LEAST_TASKS = 256, 16
DIMENSION = 384
EMBEDDED = 1024  # texts that are taken apart at a time


def hash_embed(text: Column, dimension: int = DIMENSION) -> Column:
    """A deterministic embedding without a model: hashed words with signs, L2-normalised.

    A text without words, or whose words cancel each other out, counts as one blank, so no vector is zero.
    """

    @arrow_udf("array<float>")
    def embed(column: pa.Array) -> pa.Array:
        known: dict[str, int] = {}  # a word is hashed once per batch
        sums = np.zeros((len(column), dimension))
        for low in range(0, len(column), EMBEDDED):
            texts = [re.findall(r"\w+", (value or "").lower()) or [" "] for value in column.slice(low, EMBEDDED).to_pylist()]
            for word in {w for words in texts for w in words} - known.keys():
                known[word] = zlib.crc32(word.encode())
            h = np.array([known[w] for words in texts for w in words], np.int64)
            row = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
            sums[low : low + len(texts)] = np.bincount(row * dimension + h % dimension, np.where(h >> 31, 1.0, -1.0), len(texts) * dimension).reshape(-1, dimension)
        blank = zlib.crc32(b" ")
        sums[~sums.any(axis=1), blank % dimension] = 1.0 if blank >> 31 else -1.0
        out = (sums / np.linalg.norm(sums, axis=1, keepdims=True)).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * dimension), pa.array(out.ravel()))

    return embed(text)


def _nearest(store: DataFrame, queries: DataFrame, k: int, cosine: bool, id_col: str, vector: str, skip_self: bool = False) -> DataFrame:
    """Columns of store but its vectors, query_id, _score: each task's k best rows of every query, of rows with as many elements.

    Every block of queries is sent to all tasks and answered by a pass over the store. Rows of one
    query_id share a block. The store is dealt out evenly first if there are many queries, as the work is then
    in the pairs.
    """
    spark = store.sparkSession
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector).alias("_q"))
    n = asked.count()
    blocks = 1 if n <= MAX_QUERIES else -(-2 * n // MAX_QUERIES)  # half full on average, as a hash deals unevenly
    rows = store.select(F.struct(*[c for c in store.columns if c != vector]).alias("s"), F.col(id_col).alias("i"), F.col(vector).alias("v"))
    schema = f"s {rows.schema['s'].dataType.simpleString()}, query_id {asked.schema['query_id'].dataType.simpleString()}, _score double"
    if n > FEW_QUERIES:
        rows = rows.repartition(max(spark.sparkContext.defaultParallelism, LEAST_TASKS))

    def answer(part: DataFrame) -> DataFrame:
        held = spark.sparkContext.broadcast(_as_bytes(part.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Nearest(pa.ipc.open_stream(held.value).read_all(), k, cosine, skip_self)
            for batch in batches:
                best.add(*batch.columns)
            for found in best.best():
                yield pa.RecordBatch.from_arrays(list(found), ["s", "query_id", "_score"])

        return rows.mapInArrow(run, schema).select("s.*", "query_id", "_score")

    own = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [asked] if blocks == 1 else [asked.filter(own == b) for b in range(blocks)]
    return reduce(DataFrame.unionByName, map(answer, parts))


def _as_bytes(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


def knn(store: DataFrame, queries: DataFrame, k: int = 3, id_col: str = "vec_id", vector: str = "embedding", skip_self: bool = False) -> DataFrame:
    """(query_id, id_col, distance, rank): the k nearest rows of every query by L2, ties by id.

    Blocks of queries against all rows: each task keeps k rows per query, and only those are shuffled.
    """
    found = _nearest(store.select(id_col, vector), queries, k, False, id_col, vector, skip_self)
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    return found.select("query_id", id_col, F.col("_score").alias("distance")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def matches(filters: Mapping[str, Any] | None) -> Column:
    """Conjunction of equalities; a value of None matches anything."""
    tests = [F.coalesce(F.col(c) == v, F.lit(False)) for c, v in (filters or {}).items() if v is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def merge_filters(config: Mapping[str, Any], explicit: Mapping[str, Any] | None = None, language: str | None = None) -> dict[str, Any]:
    """Call language over explicit filters over configured ones."""
    return {**config, **(explicit or {}), **({"language": language} if language else {})}


def search(store: DataFrame, queries: DataFrame, k: int = 5, filters: Mapping[str, Any] | None = None, threshold: float | None = None, where: Callable[[], Column] | Column | None = None, prefilter: bool = False, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows of store with query_id, relevance_score and rank.

    Relevance is the cosine, computed in double; with a vector of zeros it is not a number, which
    counts as the largest. With filters, k * OVERFETCH candidates are ranked first and filtered after,
    so fewer than k may come back; prefilter=True filters the store first.
    """
    where = where() if callable(where) else where
    test = matches(filters) & (where if where is not None else F.lit(True))
    filtered = bool(filters) or where is not None or threshold is not None
    base = store.filter(test) if prefilter else store

    first = k * OVERFETCH if filtered and not prefilter else k
    scored = _nearest(base, queries, first, True, id_col, vector).withColumnRenamed("_score", "relevance_score")
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), id_col)
    top = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= first)
    if filtered:
        if threshold is not None:
            top = top.filter(F.col("relevance_score") >= threshold)
        top = top.filter(test).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top


def one_per_group(results: DataFrame, group: str, id_col: str = "vec_id") -> DataFrame:
    """Best-scored row of each (query, group)."""
    w = Window.partitionBy("query_id", group).orderBy(F.desc("relevance_score"), id_col)
    return results.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def same_group_first(results: DataFrame, own_group: Column, group: str, k: int, threshold: float = 0.3, id_col: str = "vec_id") -> DataFrame:
    """Up to k rows per query: those of the query's own group first, then the others; none twice."""
    tagged = results.filter(F.col("relevance_score") >= threshold).withColumn("pref", F.when(F.col(group) == own_group, 0).otherwise(1))
    once = Window.partitionBy("query_id", id_col).orderBy("pref")
    tagged = tagged.withColumn("_rn", F.row_number().over(once)).filter("_rn = 1").drop("_rn")
    w = Window.partitionBy("query_id").orderBy("pref", F.desc("relevance_score"), id_col)
    return tagged.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def merge_stores(a: DataFrame, b: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows of both; the vectors must have one dimension."""
    sizes = {r[0] for x in (a, b) for r in x.select(F.size(vector).alias("n")).distinct().limit(2).collect()}
    if len(sizes) > 1:
        raise StoreError(f"the stores have vectors of {sorted(sizes)} dimensions")
    return a.unionByName(b)


#: Embedders by name; a model of one's own is registered here once and then named.
EMBEDDERS: dict[str, Callable[..., Column]] = {"hash": hash_embed}


def embedder(name: str = "hash") -> Callable[..., Column]:
    """A registered embedder; an unknown name is an error that tells the known ones."""
    if name not in EMBEDDERS:
        raise StoreError(f"no embedder {name}; there are {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[name]


def build_store(chunks: DataFrame, text: str = "page_content", embed: Callable[[Column], Column] = hash_embed, vector: str = "embedding") -> DataFrame:
    """chunks with their vectors; rows without a text are left out."""
    return chunks.filter(F.col(text).isNotNull()).withColumn(vector, embed(F.col(text)))


def save_store(store: DataFrame, path: str, overwrite: bool = False, provenance: Mapping[str, str] | None = None) -> None:
    """Write a store as Parquet with a sidecar row; refuses an existing one unless told to overwrite."""
    spark = store.sparkSession
    mode = "overwrite" if overwrite else "errorifexists"
    store.write.mode(mode).parquet(f"{path}/rows")
    note = [(k, v) for k, v in (provenance or {}).items()]
    spark.createDataFrame(note, "key string, value string").coalesce(1).write.mode(mode).parquet(f"{path}/provenance")


def load_store(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """(rows, provenance) of a saved store."""
    from pyspark.errors import AnalysisException

    try:
        rows, notes = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/provenance")
    except AnalysisException as e:
        raise StoreError(f"no vector store at {path}") from e
    return rows, {r.key: r.value for r in notes.collect()}


def retrieve(spark: SparkSession, store: DataFrame, query: str, k: int = 5, filters: Mapping[str, Any] | None = None, threshold: float = 0.0, per_file: bool = False, embed: Callable[[Column], Column] = hash_embed, id_col: str = "chunk_id") -> DataFrame:
    """Ranked chunks for a text query; a blank query is an error. per_file keeps the best chunk of each file out of 3k."""
    if not query or not query.strip():
        raise RetrievalError("the query is blank")
    q = spark.createDataFrame([(query,)], "text string").select(F.lit("query").alias(id_col), embed(F.col("text")).alias("embedding"))
    found = search(store, q, 3 * k if per_file else k, filters, threshold, id_col=id_col)
    if per_file:
        found = one_per_group(found, "file_path", id_col)
        w = Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), id_col)
        found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return found
