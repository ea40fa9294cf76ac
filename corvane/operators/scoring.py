"""Scores, language shares and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import severity, text

#: Namespace of the deterministic chunk ids (fixed value).
NAMESPACE = "12345678123456781234567812345678"


def category_scores(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, category, score, n, critical): 100 less the penalties, at least 0, in decimals."""
    lost = F.least(F.sum(severity.penalty(F.col("severity"))), F.lit(100))
    return findings.groupBy(*keys, "category").agg((100 - lost).alias("score"), F.count("*").alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))


def scorecard(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """One row per repository: weighted score to one decimal, grade, counts. A category without findings scores 100."""
    weights = F.array(*(F.struct(F.lit(k).alias("category"), F.lit(v).cast("decimal(4,2)").alias("weight")) for k, v in severity.WEIGHTS.items()))
    every = repos.select("repo_id", F.inline(weights))
    joined = every.join(category_scores(findings, ["repo_id"]), ["repo_id", "category"], "left")
    score = F.round(F.sum(F.col("weight") * F.coalesce("score", F.lit(100).cast("decimal(5,1)"))), 1)
    out = joined.groupBy("repo_id").agg(score.alias("s"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_findings"), F.coalesce(F.sum("critical"), F.lit(0)).cast("long").alias("critical_count"))
    return out.select("repo_id", F.col("s").cast("double").alias("overall_score"), severity.grade(F.col("s")).alias("grade"), "total_findings", "critical_count")


def flat_score(findings: DataFrame) -> DataFrame:
    """The flat form of the score: 100 less fixed points per finding, within 0..100."""
    points = F.lit(0)
    for name, p in severity.FLAT_PENALTY.items():
        points = F.when(F.col("severity") == name, p).otherwise(points)
    return findings.groupBy("repo_id").agg(F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.sum(points))).alias("flat_score"))


def share_by_files(files: DataFrame, ordinal: str) -> DataFrame:
    """Share of each language by files, to one decimal; the primary one has most files, ties by first seen."""
    counts = files.groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.min(ordinal).alias("seen"))
    w, ranked = Window.partitionBy("repo_id"), Window.partitionBy("repo_id").orderBy(F.desc("files"), "seen")
    return counts.select("repo_id", "language", "files", F.round(100.0 * F.col("files") / F.sum("files").over(w), 1).alias("share"), (F.row_number().over(ranked) == 1).alias("is_primary"))


def repository_metadata(files: DataFrame, ordinal: str) -> DataFrame:
    """One row per repository: primary language, share of each language by lines, files, lines.

    If the shares miss 100 by more than half a point, the last one takes the rest. Repositories have a line at least.
    """
    shares = share_by_lines(files, corrected=False)
    first = files.groupBy("repo_id", "language").agg(F.min(ordinal).alias("seen"))
    rows = shares.join(first, ["repo_id", "language"]).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct(F.col("seen"), "language", "share"))).alias("s"), F.max_by("language", F.struct("n_lines", "language")).alias("primary_language"), F.sum("n_lines").alias("n"))
    total = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x["share"])
    last = F.size("s") - 1
    rest = F.round(100 - (total - F.element_at("s", -1)["share"]), 1)
    mended = F.transform("s", lambda x, i: F.when((i == last) & (F.abs(total - 100) > 0.5), rest).otherwise(x["share"]))
    counts = files.groupBy("repo_id").agg(F.count_distinct("file_path").alias("total_files"))
    out = rows.select("repo_id", "primary_language", F.map_from_arrays(F.transform("s", lambda x: x["language"]), mended).alias("language_breakdown"), F.greatest("n", F.lit(1)).alias("total_lines"))
    return out.join(counts, "repo_id")


def share_by_lines(files: DataFrame, corrected: bool = True) -> DataFrame:
    """Share of each language by lines, to one decimal; corrected: the smallest takes what rounding left over."""
    counts = files.groupBy("repo_id", "language").agg(F.sum(text.line_count(F.col("content"))).cast("long").alias("n_lines"))
    w, ranked = Window.partitionBy("repo_id"), Window.partitionBy("repo_id").orderBy(F.desc("n_lines"), "language")
    parts = counts.withColumn("part", F.round(100.0 * F.col("n_lines") / F.sum("n_lines").over(w), 1)).withColumn("place", F.row_number().over(ranked)).withColumn("k", F.count("*").over(w))
    if not corrected:
        return parts.select("repo_id", "language", "n_lines", F.col("part").alias("share"))
    before = F.sum("part").over(ranked.rowsBetween(Window.unboundedPreceding, -1))
    return parts.select("repo_id", "language", "n_lines", F.when(F.col("place") < F.col("k"), F.col("part")).otherwise(F.round(100 - F.coalesce(before, F.lit(0.0)), 1)).alias("share"))


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    digit = F.substr(variant, nibble + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(digit, F.substring(h, 18, 3)), F.substring(h, 21, 12))
