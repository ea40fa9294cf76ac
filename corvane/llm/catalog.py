"""Queries of the ten corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .classlm import class_ngram_scores
from .decontam import contaminated
from .license_scan import scan_licenses
from .media import media_table
from .neardup import near_duplicates
from .packing import pack_documents
from .pii import KINDS, detect_pii, fit_trees, span_digest
from .quality import fit_ranker, held_out, score_quality
from .toxicity import fit_toxicity, score_toxicity
from .urlfilter import HOST_RULES, PATTERN_RULES, judge_urls
from .urlfilter import oracle as url_oracle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    """Path of the byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_ngram_scores(_table(spark, sf_dir, "documents"), held_out=held_out(F.col("doc_id"), 7, 2))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), fit_trees(spark))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_base", lambda s: s["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    base = F.sha2(span_digest(F.col("pii_base")), 256)
    return found.select("doc_id", *map(count, KINDS[:4]), base.alias("base_sha256"), span_digest(F.col("pii_spans")).alias("spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, aside = _table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 0)
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels").filter(~aside))
    scored = score_toxicity(docs.select("doc_id", aside.alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), HOST_RULES + PATTERN_RULES)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, aside = _table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 0)
    model = fit_ranker(docs, _table(spark, sf_dir, "labels").filter(~aside), threshold=0.3)
    scored = score_quality(docs.select("doc_id", aside.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path())


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_table(_table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_class_ngrams, op2_pii, op3_toxicity, op4_decontamination, op5_url_filter, op6_license_scan, op7_quality, op8_packing, op9_media, op10_minhash_dedup, pipeline)
}
ORACLES: dict[str, str] = {"op5_url_filter": url_oracle(HOST_RULES + PATTERN_RULES)}
