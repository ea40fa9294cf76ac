"""Queries of record rules, summaries and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import severity
from corvane.operators import records, retrieval, scoring

from . import catalog
from .adapters import SRC, table
from .catalog import FINDINGS, JOBS_SQL, query

_LETTER = "CASE " + " ".join(f"WHEN p_size <= {m} THEN '{x}'" for m, x in records.LETTERS) + " ELSE 'F' END"


@query(f"SELECT p_partkey, {_LETTER} AS letter FROM part")
def cc_letters(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", records.cc_letter(F.col("p_size")).alias("letter"))


@query("""SELECT p_partkey, concat_ws('; ', CASE WHEN p_size >= 5 THEN 'CC=' || p_size END, CASE WHEN p_size >= 7 THEN 'cognitive=' || p_size END, CASE WHEN p_size % 8 >= 3 THEN 'nesting=' || (p_size % 8) END,
CASE WHEN CAST(floor(p_retailprice / 10) AS INT) >= 60 THEN 'LOC=' || CAST(floor(p_retailprice / 10) AS INT) END) AS issues FROM part""")
def metric_issues(spark, sf_dir):
    size, loc = F.col("p_size"), F.floor(F.col("p_retailprice") / 10).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", records.issue_list(size, size, size % 8, loc).alias("issues"))


_BROKEN = "concat_ws(',', CASE WHEN s < 1 THEN 'start' END, CASE WHEN e < s THEN 'span' END, CASE WHEN NOT c BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN NOT length(t) BETWEEN 5 AND 200 THEN 'title' END)"


@query(f"""WITH r AS (SELECT CAST(l_quantity AS INT) - 3 AS s, CAST(l_quantity AS INT) + l_linenumber - 5 AS e, l_tax * 15 AS c, repeat('x', l_linenumber) AS t FROM lineitem) SELECT {_BROKEN} AS violations, count(*) AS n FROM r GROUP BY 1""")
def record_violations(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    broken = records.violations(q - 3, q + F.col("l_linenumber") - 5, F.col("l_tax") * 15, F.repeat(F.lit("x"), F.col("l_linenumber")))
    return table(spark, sf_dir, "lineitem").groupBy(F.array_join(broken, ",").alias("violations")).agg(F.count("*").alias("n"))


@query(f"""WITH {SRC}, r AS (SELECT vec_id AS chunk_id, 'page ' || vec_id AS page_content, CASE WHEN label < 5 THEN 'python' ELSE 'klingon' END AS language, label AS start_line, label - 2 AS end_line FROM embeddings),
c AS (SELECT doc_id AS chunk_id, left(content, 20) AS content, language, 1 AS start_line, 9 AS end_line FROM src WHERE doc_id % 2 = 0)
SELECT r.chunk_id, c.chunk_id IS NOT NULL AS stored, coalesce(c.content, r.page_content) AS content, CASE WHEN c.chunk_id IS NOT NULL THEN c.language WHEN r.language = 'python' THEN 'python' ELSE 'unknown' END AS language,
coalesce(c.start_line, greatest(r.start_line, 1)) AS start_line, coalesce(c.end_line, greatest(r.end_line, greatest(r.start_line, 1))) AS end_line FROM r LEFT JOIN c USING (chunk_id)""")
def resolve_chunks(spark, sf_dir):
    found = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("page "), F.col("vec_id").cast("string")).alias("page_content"), F.when(F.col("label") < 5, "python").otherwise("klingon").alias("language"), F.col("label").alias("start_line"), (F.col("label") - 2).alias("end_line"))
    chunks = catalog.source_files(spark, sf_dir).filter("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"), F.left("content", F.lit(20)).alias("content"), "language", F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    return records.resolve_chunks(found, chunks)


@query("""WITH r AS (SELECT o_custkey, o_orderstatus AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders))
SELECT o_custkey, string_agg(CASE WHEN rn <= 2 THEN item END, ', ' ORDER BY item) || CASE WHEN max(n) > 2 THEN ', +' || (max(n) - 2) || ' more' ELSE '' END AS items FROM r GROUP BY o_custkey""")
def listed_with_more(spark, sf_dir):
    return records.listed(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", 2)


@query(f"WITH {FINDINGS} SELECT category, severity IN ('CRITICAL', 'HIGH') AS needs_confirmation, count(*) AS n FROM findings GROUP BY ALL")
def escalations(spark, sf_dir):
    return catalog.line_findings(spark, sf_dir).groupBy("category", records.needs_confirmation(F.col("severity")).alias("needs_confirmation")).agg(F.count("*").alias("n"))


_COUNTS = ", ".join(f"count(*) FILTER (f.severity = '{s}') AS {s.lower()}" for s in severity.SEVERITIES)


@query(f"""WITH {FINDINGS}, cat AS (SELECT unnest([{', '.join("'" + c + "'" for c in severity.WEIGHTS)}]) AS category), repos AS (SELECT DISTINCT source AS repo_id FROM documents)
SELECT repos.repo_id, cat.category, {_COUNTS} FROM repos CROSS JOIN cat LEFT JOIN findings f ON f.repo_id = repos.repo_id AND f.category = cat.category GROUP BY 1, 2""")
def summary_table(spark, sf_dir):
    repos = table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id")).distinct()
    return records.summary(catalog.line_findings(spark, sf_dir), repos)


@query(f"""WITH {JOBS_SQL}, s AS (SELECT job_id, arg_max(status, event_id) AS status FROM j GROUP BY job_id) SELECT count(*) FILTER (status = 'RUNNING') AS active_jobs, count(*) AS jobs, (SELECT date_diff('second', min(ts), max(ts)) FROM events) AS uptime_seconds FROM s""")
def service_health(spark, sf_dir):
    from corvane.streaming import jobs

    events = table(spark, sf_dir, "events")
    second = lambda t: F.unix_seconds(t.cast("timestamp_ltz"))
    seconds = events.agg((second(F.max("ts")) - second(F.min("ts"))).alias("uptime_seconds"))
    state = jobs.lifecycle(jobs.from_events(events)).agg(F.count_if(F.col("status") == "RUNNING").alias("active_jobs"), F.count("*").alias("jobs"))
    return state.crossJoin(seconds)  # one row by one row


@query("SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """An extension: tumbling windows over event time."""
    rows = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp_ltz"), "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n")


@query("SELECT label, count(*) AS n, min(len(embedding)) AS dimension FROM embeddings GROUP BY label")
def provenance(spark, sf_dir):
    """The store's rows and dimension next to its label counts."""
    store = retrieval.merge_stores(*(table(spark, sf_dir, "embeddings").filter(f"label % 2 = {k}") for k in (0, 1)))
    return store.groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dimension"))


@query("SELECT p_partkey, " + "CASE WHEN p_size >= 20 THEN 'CRITICAL: cyclomatic ' || p_size || ', split it by its branches, or return early.' WHEN p_size >= 15 THEN 'HIGH: cyclomatic ' || p_size || ', split it by its branches, or return early.' WHEN p_size >= 10 THEN 'MEDIUM: cyclomatic ' || p_size || ', split it by its branches, or return early.' WHEN p_size >= 5 THEN 'LOW: cyclomatic ' || p_size || ', split it by its branches, or return early.' ELSE '' END AS advice FROM part")
def metric_advice(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", records.advice(F.col("p_size"), F.lit(0), F.lit(0)).alias("advice"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice / 5000 >= 75 THEN 'green' WHEN o_totalprice / 5000 >= 50 THEN 'orange' ELSE 'red' END AS colour, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS day FROM orders")
def score_colours(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", severity.score_colour(F.col("o_totalprice") / 5000).alias("colour"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("day"))


@query(f"""WITH {SRC}, c AS (SELECT repo_id, language, CAST(sum({catalog.LINE_COUNT_SQL}) AS BIGINT) AS n_lines FROM src GROUP BY 1, 2) SELECT repo_id, language, n_lines, round(100.0 * n_lines / sum(n_lines) OVER (PARTITION BY repo_id), 1) AS share FROM c""")
def language_share_plain(spark, sf_dir):
    return scoring.share_by_lines(catalog.source_files(spark, sf_dir), corrected=False)


@query(f"""WITH {SRC}, c AS (SELECT repo_id, language, CAST(sum({catalog.LINE_COUNT_SQL}) AS BIGINT) AS n FROM src GROUP BY 1, 2), r AS (SELECT repo_id, count(DISTINCT file_path) AS total_files FROM src GROUP BY 1)
SELECT repo_id, arg_max(language, {{'n': n, 'language': language}}) AS primary_language, CAST(count(*) AS INT) AS languages, CAST(sum(n) AS BIGINT) AS total_lines, any_value(total_files) AS total_files FROM c JOIN r USING (repo_id) GROUP BY repo_id""")
def repository_metadata(spark, sf_dir):
    found = scoring.repository_metadata(catalog.source_files(spark, sf_dir), "doc_id")
    return found.select("repo_id", "primary_language", F.size("language_breakdown").alias("languages"), F.col("total_lines").cast("long").alias("total_lines"), "total_files")
