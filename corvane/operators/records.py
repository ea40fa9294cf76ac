"""Record rules: validation, letters and issue lists, chunk resolution, summaries, JSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import severity
from corvane.functions.paths import LANGUAGES

# fixed values: upper bounds of the letters of cyclomatic complexity, and where an issue is named
LETTERS = [(5, "A"), (10, "B"), (15, "C"), (20, "D"), (25, "E")]
ISSUES = {"cyclomatic": 5, "cognitive": 7, "nesting": 3}
HTTP_WORDS = r"(?i)\b(?:requests?|session|client|http|resp|response|adapter|pool|conn|connection|urllib|httpx|aiohttp)\b[^\n]*?[.]get\s*\("


def cc_letter(cyclomatic: Column) -> Column:
    """A to F; null without a value."""
    out = F.lit("F")
    for most, letter in reversed(LETTERS):
        out = F.when(cyclomatic <= most, letter).otherwise(out)
    return F.when(cyclomatic.isNotNull(), out)


def issue_list(cyclomatic: Column, cognitive: Column, nesting: Column, loc: Column) -> Column:
    """The metrics worth naming, as CC=…, cognitive=…, nesting=…, LOC=…"""
    part = lambda label, value, test: F.when(test, F.concat(F.lit(f"{label}="), value.cast("string")))
    return F.concat_ws(
        "; ", part("CC", cyclomatic, cyclomatic >= ISSUES["cyclomatic"]), part("cognitive", cognitive, cognitive >= ISSUES["cognitive"]),
        part("nesting", nesting, nesting >= ISSUES["nesting"]), part("LOC", loc, severity.band(loc, "loc").isNotNull()),
    )


# fixed values: from which value on a metric gets which grade of advice
ADVICE = {"cyclomatic": [(20, "CRITICAL"), (15, "HIGH"), (10, "MEDIUM"), (5, "LOW")], "cognitive": [(30, "CRITICAL"), (20, "HIGH"), (15, "MEDIUM"), (7, "LOW")], "nesting": [(5, "HIGH"), (3, "MEDIUM")]}
HINTS = {"cyclomatic": "split it by its branches, or return early", "cognitive": "flatten its conditions and move loop bodies out", "nesting": "turn its conditions round and leave early"}


def advice(cyclomatic: Column, cognitive: Column, nesting: Column) -> Column:
    """What to do about a function, one sentence per metric that is worth it, the grade first."""
    values = {"cyclomatic": cyclomatic, "cognitive": cognitive, "nesting": nesting}

    def part(metric: str) -> Column:
        grade = F.lit(None).cast("string")
        for least, name in reversed(ADVICE[metric]):
            grade = F.when(values[metric] >= least, name).otherwise(grade)
        return F.when(grade.isNotNull(), F.concat(grade, F.lit(f": {metric} "), values[metric].cast("string"), F.lit(f", {HINTS[metric]}.")))

    return F.concat_ws(" ", *map(part, values))


def is_http_get(line: Column) -> Column:
    """Whether a client-like name stands before the line's first .get( call."""
    return line.rlike(HTTP_WORDS)


def violations(start: Column, end: Column, confidence: Column, title: Column) -> Column:
    """Names of the record rules that a finding breaks; empty if it is valid."""
    tests = {"start": start < 1, "span": end < start, "confidence": ~confidence.between(0, 1), "title": ~F.length(title).between(5, 200)}
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in tests.items())))


def split_valid(rows: DataFrame, broken: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their violations)."""
    marked = rows.withColumn("violations", broken)
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def resolve_chunks(results: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Results joined with their stored chunk; where there is none, the chunk is rebuilt from the result's own fields.

    A language that is not known becomes unknown, an end before its start becomes the start.
    """
    known = sorted({*LANGUAGES.values(), "unknown"})
    stored = chunks.select(key, F.struct("content", "language", "start_line", "end_line").alias("_c"))
    joined = results.join(stored, key, "left")
    start = F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1))
    rebuilt = F.struct(F.col("page_content").alias("content"), F.when(F.col("language").isin(known), F.col("language")).otherwise("unknown").alias("language"), start.alias("start_line"), F.greatest(F.coalesce("end_line", start), start).alias("end_line"))
    keep = [c for c in results.columns if c not in ("page_content", "language", "start_line", "end_line")]
    return joined.withColumn("_r", F.coalesce("_c", rebuilt)).select(*keep, F.col("_c").isNotNull().alias("stored"), "_r.*")


def listed(rows: DataFrame, keys: list[str], item: str, k: int = 5) -> DataFrame:
    """(keys, items): the first k items in order, and how many more there are."""
    w = Window.partitionBy(*keys)
    ranked = rows.select(*keys, item).distinct().withColumn("_rn", F.row_number().over(w.orderBy(item)))
    shown = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_rn") <= k, F.col(item)))).alias("_i"), F.count("*").alias("_n"))
    more = F.when(F.col("_n") > k, F.concat(F.lit(", +"), (F.col("_n") - k).cast("string"), F.lit(" more"))).otherwise("")
    return shown.select(*keys, F.concat(F.array_join("_i", ", "), more).alias("items"))


def needs_confirmation(level: Column) -> Column:
    """HIGH findings and worse would be sent for confirmation."""
    return severity.rank(level) <= 1


def summary(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """One row per repository and category with its weight and numbers of findings, zeros included."""
    every = repos.select("repo_id", F.explode(F.array(*map(F.lit, severity.WEIGHTS))).alias("category"))
    counts = findings.groupBy("repo_id", "category").pivot("severity", severity.SEVERITIES).agg(F.count(F.lit(1)))
    zero = [F.coalesce(F.col(s), F.lit(0)).alias(s.lower()) for s in severity.SEVERITIES]
    return every.join(counts, ["repo_id", "category"], "left").select("repo_id", "category", *zero)


def write_json(findings: DataFrame, path: str, overwrite: bool = False) -> None:
    """Findings as JSON lines; an existing folder is left alone unless told to overwrite it."""
    findings.write.mode("overwrite" if overwrite else "errorifexists").json(path)
