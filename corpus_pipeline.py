"""From raw documents to packed sequences: five stages, each on all that the one before kept.

Every function takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.catalog import vocabulary_path
from corvane.llm.decontam import contaminated
from corvane.llm.neardup import row_groups
from corvane.llm.packing import pack_documents
from corvane.llm.pii import detect_pii, fit_trees, redact
from corvane.llm.quality import fit_ranker, held_out, score_quality
from corvane.llm.scratch import made, materialize, purge, row_keys, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose quality score is under THRESHOLD.

    Every row is judged for itself: null and empty texts get the score of an empty text, repeated
    rows and null ids make no difference, and columns beside COLUMNS are dropped. An empty table
    gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id"), 5, 0))
    model = fit_ranker(docs, labels, threshold=THRESHOLD)
    return score_quality(docs.select(*COLUMNS), model, out="_quality").filter(F.col("_quality") >= THRESHOLD).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group, one with its smallest id; five words, similarity 0.8.

    Rows are decided one by one: of repeated rows one stays, of an id with several texts every text
    stays that no kept row is near. Null and empty texts are near nothing and stay. Ids may be null.
    """
    rows, key = row_keys(docs.select(*COLUMNS), "doc_id")
    gone = row_groups(rows, key).filter("not kept").select(F.col("key").alias(key))
    return rows.join(gone, key, "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose text holds a passage of a benchmark item.

    Rows are decided one by one, also where ids repeat or are null. Null and empty texts and texts of
    fewer than five words hold none; an empty benchmark drops nothing.
    """
    rows, key = row_keys(docs.select(*COLUMNS), "doc_id")
    hits = contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    hits = materialize(hits.select(key).distinct(), "contaminated")
    return rows.join(hits, key, "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; n_chars follows the text.

    One row for each row. Null texts stay null, with a null n_chars; empty texts stay empty.
    """
    found = detect_pii(docs.select(*COLUMNS), fit_trees(spark), out="_pii")
    text = redact(F.col("text"), F.col("_pii_spans"))
    return found.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens.

    Null and empty texts give one piece with the end id alone; repeated rows are packed one by one.
    """
    return pack_documents(docs, vocabulary_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontaminate),
    ("pii", personal_data),
    ("packing", packing),
]

#: No stage's decision can be expressed in SQL alone: learnt scores, signatures and packing. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Once a stage is written, the tables that led to it are deleted."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            purge(spark, start, keep=(path,))
            docs = spark.read.parquet(path)
    return docs
