"""The driver's tables seen as the engine's records, and the same in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# a path for every document, spread over the roles of paths
_FOLDERS = ["tests/unit/doc_{}.py", "docs/guide/doc_{}.md", "examples/doc_{}.java", "pkg/migrations/doc_{}.py", "src/api/doc_{}.py", "src/model/doc_{}.ts", "src/service/doc_{}.go"]
PATH_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{p.split('{}')[0]}' || CAST(doc_id AS VARCHAR) || '{p.split('{}')[1]}'" for i, p in enumerate(_FOLDERS)) + " END"
SRC = f"src AS (SELECT doc_id, source AS repo_id, {PATH_SQL} AS file_path, lang AS language, text AS content FROM documents)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source_file(doc_id, repo_id, file_path, language, content)."""
    path = F.lit(None).cast("string")
    for i, p in enumerate(_FOLDERS):
        head, tail = p.split("{}")
        path = F.when(F.col("doc_id") % 7 == i, F.concat(F.lit(head), F.col("doc_id").cast("string"), F.lit(tail))).otherwise(path)
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo_id"), path.alias("file_path"), F.col("lang").alias("language"), F.col("text").alias("content"))
