"""All queries of the review engine with their DuckDB oracles. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import paths, severity, text
from corvane.operators import chunking, dedup, graph, retrieval, rules, scoring

from .adapters import SRC, source_files, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ------------------------------------------------------------------ SQL pieces
Q = "'"
_sql = lambda s: s.replace("'", "''")
BREAKS_SQL = r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
NORM = f"regexp_replace(content, '{BREAKS_SQL}', chr(10), 'g')"
CUT = f"CASE WHEN ends_with({NORM}, chr(10)) THEN left({NORM}, length({NORM}) - 1) ELSE {NORM} END"
LINES_SQL = f"CASE WHEN {NORM} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({CUT}, chr(10)) END"
LINES = f"{SRC}, lines AS (SELECT doc_id, repo_id, file_path, language, unnest({LINES_SQL}) AS line, unnest(range(1, len({LINES_SQL}) + 1)) AS line_no FROM src)"
STRIP_SQL = f"regexp_extract(line, '{_sql(text.UNCOMMENTED_RE2)}', 1)"
ENTROPY_SQL = "CASE WHEN value = '' THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: -(len(list_filter(string_split(value, ''), lambda d: d = c)) / length(value)) * log2(len(list_filter(string_split(value, ''), lambda d: d = c)) / length(value)))) END"
PLACEHOLDER_SQL = f"""(trim(value) = '' OR regexp_matches(trim(value), '{_sql(text.PLACEHOLDER)}') OR lower(trim(value)) IN ({', '.join(Q + w + Q for w in text.OBVIOUS)})
 OR regexp_matches(trim(value), '{text.SHOUTED}') OR ({ENTROPY_SQL}) < {text.LEAST_ENTROPY})"""
FIXTURE_SQL = f"""(lower(trim(value)) = '' OR lower(trim(value)) IN ({', '.join(Q + w + Q for w in text.FIXTURES)}) OR starts_with(lower(trim(value)), 'test ')
 OR ends_with(lower(trim(value)), ' test') OR (contains(lower(trim(value)), 'test') AND length(trim(value)) < 20))"""
ROLE_SQL = f"""CASE WHEN regexp_matches(file_path, '{paths.TEST_DIR}') OR regexp_matches(file_path, '{paths.TEST_FILE}') OR regexp_matches(file_path, '{paths.CONFTEST}') THEN 'test'
 WHEN regexp_matches(file_path, '{paths.DOC_DIR}') THEN 'docs' WHEN regexp_matches(file_path, '{paths.EXAMPLE_DIR}') THEN 'example' ELSE 'production' END"""
RANK_SQL = "CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(severity.SEVERITIES)) + " ELSE 5 END"
LAYER_SQL = lambda c: "CASE " + " ".join(f"WHEN contains(lower({c}), '{k}') THEN {i}" for i, k in enumerate(paths.LAYERS)) + " END"


def _hits_sql() -> str:
    parts = []
    for r in rules.RULES:
        unless = f" AND NOT regexp_matches(code, '(?i){_sql(r.unless)}')" if r.unless else ""
        parts.append(f"SELECT doc_id, repo_id, file_path, language, line_no, '{r.rule_id}' AS rule_id, {r.secret} AS secret, regexp_extract(code, '(?i){_sql(r.pattern)}', 0) AS m FROM code WHERE regexp_matches(code, '(?i){_sql(r.pattern)}'){unless}")
    return f"""{LINES}, code AS (SELECT *, {STRIP_SQL} AS code FROM lines WHERE NOT regexp_matches(line, '^\\s*#')),
allhits AS ({' UNION ALL '.join(parts)}),
ranked AS (SELECT *, CAST(floor((line_no - 1) / 80) AS INT) AS chunk_no, row_number() OVER (PARTITION BY doc_id, rule_id, floor((line_no - 1) / 80) ORDER BY line_no) AS rn FROM allhits),
firsts AS (SELECT *, regexp_extract(m, '["'']([^"'']*)["'']', 1) AS value FROM ranked WHERE rn = 1),
hits AS (SELECT doc_id, repo_id, file_path, language, rule_id, chunk_no, CAST(line_no AS INT) AS line_no, left(m, 120) AS match_text, value FROM firsts WHERE NOT secret OR NOT ({PLACEHOLDER_SQL} OR {FIXTURE_SQL}))"""


HITS = _hits_sql()
RULES_SQL = "rules(rule_id, category, kind, severity, confidence, title) AS (VALUES " + ", ".join(f"('{r.rule_id}', '{r.category}', '{r.kind}', '{r.severity}', {r.confidence}, '{r.title}')" for r in rules.RULES) + ")"
FINDINGS = f"{HITS}, {RULES_SQL}, findings AS (SELECT h.*, r.category, r.kind, r.severity, r.confidence, left('[' || r.rule_id || '] ' || r.title || ': ' || h.file_path, 200) AS title FROM hits h JOIN rules r USING (rule_id))"


def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all line rules over documents; prose has no language gate and all roles count."""
    return rules.scan_lines(source_files(spark, sf_dir), production_only=False, python_gate=False)


def line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.to_findings(line_hits(spark, sf_dir), rules.rule_table(spark))


# ------------------------------------------------------------------ rule scans, findings, scores
@query(f"WITH {HITS} SELECT doc_id, file_path, rule_id, chunk_no, line_no, match_text, value, round({ENTROPY_SQL}, 6) AS entropy FROM hits")
def secret_findings(spark, sf_dir):
    hits = line_hits(spark, sf_dir)
    return hits.select("doc_id", "file_path", "rule_id", "chunk_no", "line_no", "match_text", "value", F.round(text.entropy(F.col("value")), 6).alias("entropy"))


WEIGHT_SQL = "weights(category, weight) AS (VALUES " + ", ".join(f"('{k}', CAST({v} AS DECIMAL(4,2)))" for k, v in severity.WEIGHTS.items()) + ")"
PENALTY_SQL = "CASE severity " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DECIMAL(5,1))" for k, v in severity.PENALTY.items()) + " ELSE CAST(0.5 AS DECIMAL(5,1)) END"


@query(f"""WITH {FINDINGS}, {WEIGHT_SQL}, repos AS (SELECT DISTINCT source AS repo_id FROM documents),
sub AS (SELECT repo_id, category, greatest(0, 100 - least(sum({PENALTY_SQL}), 100)) AS score, count(*) AS n, sum(CASE WHEN severity = 'CRITICAL' THEN 1 ELSE 0 END) AS crit FROM findings GROUP BY repo_id, category),
total AS (SELECT repo_id, round(sum(weight * coalesce(score, 100)), 1) AS score, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_findings, CAST(coalesce(sum(crit), 0) AS BIGINT) AS critical_count FROM repos CROSS JOIN weights LEFT JOIN sub USING (repo_id, category) GROUP BY repo_id)
SELECT repo_id, CAST(score AS DOUBLE) AS overall_score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END AS grade, total_findings, critical_count FROM total""")
def severity_scorecard(spark, sf_dir):
    repos = table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id")).distinct()
    return scoring.scorecard(line_findings(spark, sf_dir), repos)


@query(f"""WITH {FINDINGS} SELECT coalesce(repo_id, '(all)') AS repo_id, coalesce(severity, '(all)') AS severity, count(*) AS n FROM findings GROUP BY ROLLUP (repo_id, severity)""")
def finding_counts(spark, sf_dir):
    found = line_findings(spark, sf_dir).select("repo_id", "severity")
    parts = found.rollup("repo_id", "severity").agg(F.count("*").alias("n"), F.grouping_id().alias("level")).filter("level < 3")
    parts = parts.select("repo_id", F.coalesce("severity", F.lit("(all)")).alias("severity"), "n")
    # the total of no findings is a row as well
    return parts.union(found.agg(F.count("*").alias("n")).select(F.lit("(all)").alias("repo_id"), F.lit("(all)").alias("severity"), "n"))


@query(f"""WITH {FINDINGS} SELECT regexp_extract(title, '^\\[([^\\]]+)\\]', 1) AS rule_id, repo_id, count(*) AS n, min(line_no) AS first_line FROM findings GROUP BY 1, 2""")
def findings_by_rule(spark, sf_dir):
    found = line_findings(spark, sf_dir).withColumn("rule_id", F.regexp_extract("title", r"^\[([^\]]+)\]", 1))
    return found.groupBy("rule_id", "repo_id").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


@query(f"""WITH {FINDINGS} SELECT l.quality, l.toxic, f.rule_id, count(*) AS n FROM findings f JOIN labels l ON l.doc_id = f.doc_id GROUP BY ALL""")
def findings_by_label(spark, sf_dir):
    return line_findings(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic", "rule_id").agg(F.count("*").alias("n"))


@query(f"WITH {FINDINGS} SELECT repo_id, CAST(greatest(0, least(100, 100 - sum(CASE severity WHEN 'CRITICAL' THEN 15 WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 1 ELSE 0 END))) AS BIGINT) AS flat_score FROM findings GROUP BY repo_id")
def flat_score(spark, sf_dir):
    return scoring.flat_score(line_findings(spark, sf_dir))


@query(f"""WITH {FINDINGS} SELECT severity, file_path, line_no, CAST(row_number() OVER (ORDER BY {RANK_SQL}, file_path, line_no, rule_id) AS INT) AS place FROM findings QUALIFY place <= 100""")
def top_findings(spark, sf_dir):
    """The first hundred findings in report order; the limit is the feature."""
    top = line_findings(spark, sf_dir).orderBy(severity.rank(F.col("severity")), "file_path", "line_no", "rule_id").limit(100)
    w = Window.orderBy(severity.rank(F.col("severity")), "file_path", "line_no", "rule_id")
    return top.withColumn("place", F.row_number().over(w)).select("severity", "file_path", "line_no", "place")


@query("""SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'CRITICAL' WHEN p_size >= 25 THEN 'HIGH' WHEN p_size >= 15 THEN 'MEDIUM' END AS cc_band,
CASE WHEN p_size >= 35 THEN 'CRITICAL' WHEN p_size >= 25 THEN 'HIGH' WHEN p_size >= 18 THEN 'MEDIUM' END AS cog_band,
CASE WHEN p_size >= 6 THEN 'HIGH' WHEN p_size >= 5 THEN 'MEDIUM' END AS nest_band, CASE WHEN p_retailprice / 10 >= 120 THEN 'CRITICAL' WHEN p_retailprice / 10 >= 80 THEN 'HIGH' WHEN p_retailprice / 10 >= 60 THEN 'MEDIUM' END AS loc_band FROM part""")
def threshold_bands(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return part.select("p_partkey", severity.band(size, "cyclomatic").alias("cc_band"), severity.band(size, "cognitive").alias("cog_band"), severity.band(size, "nesting").alias("nest_band"), severity.band(F.col("p_retailprice") / 10, "loc").alias("loc_band"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 40 THEN 0 WHEN l_quantity >= 25 THEN 1 WHEN l_quantity >= 15 THEN 2 END AS cc,
CASE WHEN l_quantity >= 35 THEN 0 WHEN l_quantity >= 25 THEN 1 WHEN l_quantity >= 18 THEN 2 END AS cog, CASE WHEN l_linenumber >= 6 THEN 1 WHEN l_linenumber >= 5 THEN 2 END AS nest,
CASE WHEN l_quantity * 3 >= 120 THEN 0 WHEN l_quantity * 3 >= 80 THEN 1 WHEN l_quantity * 3 >= 60 THEN 2 END AS loc FROM lineitem),
w AS (SELECT *, least(cc, cog, nest) AS structural FROM r)
SELECT CASE least(structural, CASE WHEN loc <= 1 OR structural IS NOT NULL THEN loc END) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' END AS worst, count(*) AS n FROM w GROUP BY 1""")
def worst_severity(spark, sf_dir):
    q = F.col("l_quantity")
    li = table(spark, sf_dir, "lineitem").withColumn("worst", severity.worst(q, q, F.col("l_linenumber"), q * 3))
    return li.groupBy("worst").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'MEDIUM' WHEN '2-HIGH' THEN 'LOW' WHEN '3-MEDIUM' THEN 'INFO' WHEN '4-NOT SPECIFIED' THEN 'INFO' WHEN '5-LOW' THEN 'INFO' ELSE o_orderpriority END AS lowered,
CASE WHEN o_totalprice / 500000 >= 0.80 THEN 'High' WHEN o_totalprice / 500000 >= 0.55 THEN 'Medium' ELSE 'Low' END AS confidence_level FROM orders""")
def downgraded(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for kv in {"1-URGENT": "CRITICAL", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM", "4-NOT SPECIFIED": "LOW", "5-LOW": "INFO"}.items() for x in kv])
    sev = F.coalesce(F.try_element_at(names, F.col("o_orderpriority")), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", severity.downgrade(sev).alias("lowered"), severity.confidence_band(F.col("o_totalprice") / 500000).alias("confidence_level"))


# ------------------------------------------------------------------ paths and languages
@query(f"WITH {SRC} SELECT doc_id, file_path, {ROLE_SQL} AS role FROM src")
def file_roles(spark, sf_dir):
    return source_files(spark, sf_dir).select("doc_id", "file_path", paths.file_role(F.col("file_path")).alias("role"))


@query(f"WITH {SRC} SELECT doc_id, file_path FROM src WHERE ({ROLE_SQL}) = 'production' AND NOT regexp_matches(file_path, '{paths.OTHER_DIR}')")
def production_files(spark, sf_dir):
    return source_files(spark, sf_dir).filter(paths.is_production(F.col("file_path"))).select("doc_id", "file_path")


SUFFIX_SQL = "lower(regexp_extract(regexp_extract(p, '[^/]*$'), '^.+[.]([^.]*)$', 1))"


@query(f"""WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages) SELECT page_id, {SUFFIX_SQL} AS suffix,
CASE {SUFFIX_SQL} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.LANGUAGES.items())} ELSE 'unknown' END AS language, {SUFFIX_SQL} IN ({', '.join(Q + k + Q for k in paths.LANGUAGES)}) AS allowed FROM u""")
def path_language(spark, sf_dir):
    p = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", paths.suffix(p).alias("suffix"), paths.language(p).alias("language"), paths.is_allowed(p).alias("allowed"))


_AS_REPO = "regexp_replace(regexp_replace(url, '^(https?)://[^/]+/', '\\1://github.com/org/'), '[?#].*$', '')"


@query(f"""WITH u AS (SELECT page_id, regexp_replace(trim({_AS_REPO}), '/+$', '') AS u FROM pages) SELECT page_id, regexp_matches(u, '{paths.REPOSITORY_URL}') AS valid, regexp_replace(regexp_extract(u, '([^/:]+)$', 1), '[.]git$', '') AS repo_name FROM u""")
def repo_name_from_url(spark, sf_dir):
    u = F.regexp_replace(F.regexp_replace("url", "^(https?)://[^/]+/", "$1://github.com/org/"), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", paths.is_repository_url(u).alias("valid"), paths.repository_name(u).alias("repo_name"))


@query("""WITH c AS (SELECT source AS repo_id, lang AS language, count(*) AS files, min(doc_id) AS seen FROM documents GROUP BY 1, 2)
SELECT repo_id, language, files, round(100.0 * files / sum(files) OVER (PARTITION BY repo_id), 1) AS share, row_number() OVER (PARTITION BY repo_id ORDER BY files DESC, seen) = 1 AS is_primary FROM c""")
def language_share_files(spark, sf_dir):
    return scoring.share_by_files(source_files(spark, sf_dir), "doc_id")


LINE_COUNT_SQL = "(length(content) - length(replace(content, chr(10), '')) + 1)"


@query(f"""WITH {SRC}, c AS (SELECT repo_id, language, CAST(sum({LINE_COUNT_SQL}) AS BIGINT) AS n_lines FROM src GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n_lines DESC, language) AS place, count(*) OVER (PARTITION BY repo_id) AS k, sum(n_lines) OVER (PARTITION BY repo_id) AS total FROM c),
s AS (SELECT *, round(100.0 * n_lines / total, 1) AS part FROM r)
SELECT repo_id, language, n_lines, CASE WHEN place < k THEN part ELSE round(100 - coalesce(sum(part) OVER (PARTITION BY repo_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 1) END AS share FROM s""")
def language_share_lines(spark, sf_dir):
    return scoring.share_by_lines(source_files(spark, sf_dir))


@query(f"WITH {SRC} SELECT repo_id, count(DISTINCT file_path) AS total_files, CAST(sum({LINE_COUNT_SQL}) AS BIGINT) AS total_lines FROM src GROUP BY repo_id")
def repo_totals(spark, sf_dir):
    return source_files(spark, sf_dir).groupBy("repo_id").agg(F.count_distinct("file_path").alias("total_files"), F.sum(text.line_count(F.col("content"))).cast("long").alias("total_lines"))


# ------------------------------------------------------------------ chunks and lines
WINDOWS = f"{LINES}, windows AS (SELECT doc_id, CAST(floor((line_no - 1) / 80) AS INT) AS chunk_no, CAST(min(line_no) AS INT) AS start_line, CAST(max(line_no) AS INT) AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS content FROM lines GROUP BY 1, 2)"


@query(f"WITH {WINDOWS} SELECT doc_id, chunk_no, start_line, end_line, md5(content) AS digest FROM windows WHERE regexp_matches(content, '[^\\s]')")
def line_windows(spark, sf_dir):
    files = source_files(spark, sf_dir).select("doc_id", "content")
    return chunking.line_windows(files).select("doc_id", "chunk_no", "start_line", "end_line", F.md5("content").alias("digest"))


@query("""SELECT conv_id, count(*) AS turns, md5(string_agg(replace(text, chr(10), ' '), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def rebuild_files(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    chunks = turns.select("conv_id", F.row_number().over(w).alias("start_line"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("content"))
    out = chunking.rebuild_files(chunks, ["conv_id"])
    return out.select("conv_id", F.size(F.split("content", "\n")).cast("long").alias("turns"), F.md5("content").alias("digest"))


@query(f"WITH {HITS}, {WINDOWS[len(LINES) + 2 :]} SELECT h.doc_id, h.rule_id, h.line_no, w.chunk_no, w.start_line, w.end_line FROM hits h JOIN windows w ON w.doc_id = h.doc_id AND h.line_no BETWEEN w.start_line AND w.end_line")
def covering_chunk(spark, sf_dir):
    hits = line_hits(spark, sf_dir).select("doc_id", "rule_id", "line_no", chunking.covering_chunk(F.col("line_no")).alias("chunk_no"))
    windows = chunking.line_windows(source_files(spark, sf_dir).select("doc_id", "content")).select("doc_id", "chunk_no", "start_line", "end_line")
    return hits.join(windows, ["doc_id", "chunk_no"]).select("doc_id", "rule_id", "line_no", "chunk_no", "start_line", "end_line")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) * 7 AS a, CAST(l_quantity AS INT) * 7 + CAST(l_tax * 1000 AS INT) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(unnest(range(CAST(floor((a - 1) / 80) AS BIGINT), CAST(floor((b - 1) / 80) AS BIGINT) + 1)) AS INT) AS chunk_no FROM s""")
def span_overlap(spark, sf_dir):
    a = F.col("l_quantity").cast("int") * 7
    b = a + F.round(F.col("l_tax") * 1000).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(chunking.chunks_of_span(a, b)).alias("chunk_no"))


RANGES_SQL = """r AS (SELECT l_orderkey AS file_id, CAST(l_quantity AS INT) AS s, CAST(l_quantity AS INT) + l_linenumber AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
merged AS (SELECT file_id, min(s) AS start_line, max(e) AS end_line FROM i GROUP BY file_id, island)"""


def _ranges(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), q.alias("start_line"), (q + F.col("l_linenumber")).alias("end_line"))
    return chunking.merge_ranges(rows, ["file_id"])


@query(f"WITH {RANGES_SQL} SELECT * FROM merged")
def merge_ranges(spark, sf_dir):
    return _ranges(spark, sf_dir)


@query(f"""WITH {RANGES_SQL}, f AS (SELECT DISTINCT file_id FROM merged), l AS (SELECT file_id, unnest(range(1, 61)) AS n FROM f),
u AS (SELECT l.file_id, n FROM l WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.file_id = l.file_id AND l.n BETWEEN m.start_line AND m.end_line))
SELECT f.file_id, CAST(count(n) AS INT) AS n_uncovered, CAST(coalesce(min(n), 1) AS INT) AS first_line, CAST(coalesce(max(n), 1) AS INT) AS last_line FROM f LEFT JOIN u USING (file_id) GROUP BY f.file_id""")
def uncovered_lines(spark, sf_dir):
    merged = _ranges(spark, sf_dir)
    totals = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id")).distinct().withColumn("n_lines", F.lit(60))
    return chunking.uncovered_lines(totals, merged, ["file_id"])


@query(f"SELECT DISTINCT p_brand AS value, round({ENTROPY_SQL.replace('value', 'p_brand')}, 6) AS entropy FROM part")
def entropy_by_value(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("value")).distinct().withColumn("entropy", F.round(text.entropy(F.col("value")), 6))


_SAMPLES = ["", "changeme", "s3cr3t", "REPLACE_ME", "aaaaaaaaaa", "my-token", "test", "my test", "hunter2", "8824c3a463b8b0d68516db48c461547d5799bf8b", "your-api-key", "<token>", "Password12", "contest", "Tr0ub4dor&3xyz!Q"]


@query(f"""WITH v(value) AS (SELECT unnest([{', '.join(Q + s + Q for s in _SAMPLES)}]) UNION SELECT DISTINCT p_name FROM part)
SELECT value, {PLACEHOLDER_SQL} AS placeholder, {FIXTURE_SQL} AS fixture FROM v""")
def placeholder_flags(spark, sf_dir):
    values = spark.createDataFrame([(s,) for s in _SAMPLES], "value string").union(table(spark, sf_dir, "part").select("p_name")).distinct()
    return values.select("value", text.is_placeholder(F.col("value")).alias("placeholder"), text.is_fixture_secret(F.col("value")).alias("fixture"))


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, length({STRIP_SQL}) AS kept, md5({STRIP_SQL}) AS digest FROM lines WHERE contains(line, '#')")
def strip_comments(spark, sf_dir):
    rows = source_files(spark, sf_dir).filter(F.contains("content", F.lit("#"))).select("doc_id", F.posexplode(text.split_lines(F.col("content"))).alias("i", "line")).filter(F.contains("line", F.lit("#")))
    cut = rows.select("doc_id", (F.col("i") + 1).alias("line_no"), text.strip_comment(F.col("line")).alias("cut"))
    return cut.select("doc_id", "line_no", F.length("cut").cast("long").alias("kept"), F.md5("cut").alias("digest"))


@query(f"""WITH {LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, md5(regexp_replace(regexp_replace(line, '"[^"]*"', '""', 'g'), '''[^'']*''', '''''', 'g')) AS digest FROM lines WHERE contains(line, '"') OR contains(line, '''')""")
def strip_strings(spark, sf_dir):
    quoted = lambda c: F.contains(c, F.lit('"')) | F.contains(c, F.lit("'"))
    rows = source_files(spark, sf_dir).filter(quoted("content")).select("doc_id", F.posexplode(text.split_lines(F.col("content"))).alias("i", "line")).filter(quoted("line"))
    return rows.select("doc_id", (F.col("i") + 1).alias("line_no"), F.md5(text.strip_strings(F.col("line"))).alias("digest"))


@query("""WITH i AS (SELECT doc_id, sha1(unhex('12345678123456781234567812345678') || encode('doc_' || CAST(doc_id AS VARCHAR) || ':1:0')) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id FROM i""")
def uuid5_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scoring.uuid5(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(":1:0"))).alias("chunk_id"))


# ------------------------------------------------------------------ deduplication and merges
@query("SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id AS k, CAST(floor(event_id / 10) AS INT) AS line FROM events),
kept(k, line) AS (SELECT k, min(line) FROM e GROUP BY k UNION ALL SELECT kept.k, (SELECT min(e.line) FROM e WHERE e.k = kept.k AND e.line > kept.line + 5) FROM kept WHERE kept.line IS NOT NULL)
SELECT k AS user_id, line FROM kept WHERE line IS NOT NULL""")
def proximity_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 10).cast("int").alias("line"))
    return dedup.proximity(rows, ["user_id"], "line")


@query(f"""WITH {HITS}, l AS (SELECT doc_id, 'label' AS origin FROM labels WHERE toxic = 1), r AS (SELECT doc_id, 'rule' AS origin FROM hits)
SELECT doc_id, origin FROM l UNION ALL SELECT doc_id, origin FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = r.doc_id)""")
def prefer_left_merge(spark, sf_dir):
    left = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit("label").alias("origin"))
    return dedup.prefer_left(left, line_hits(spark, sf_dir).select("doc_id", F.lit("rule").alias("origin")), ["doc_id"])


@query("""SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey""")
def last_wins(spark, sf_dir):
    return dedup.last_wins(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("n")), ["o_custkey"], "n").drop("n")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) <= 2""")
def first_of_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return dedup.first_of(rows, ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber", "l_partkey"], 2).drop("l_extendedprice")


# ------------------------------------------------------------------ retrieval: queries are the vectors with an id divisible by 50
DIST = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))"
DOT = lambda x, y: f"list_sum(list_transform(list_zip({x}.embedding, {y}.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
COS = f"{DOT('a', 'b')} / sqrt({DOT('a', 'a')} * {DOT('b', 'b')})"
PAIRS = f"q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0), scored AS (SELECT b.vec_id AS query_id, b.label AS query_label, a.vec_id, a.label, {COS} AS score FROM embeddings a, q b)"
TOP = lambda n: f"top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r0 FROM scored QUALIFY r0 <= {n})"


def _vectors(spark, sf_dir):
    store = table(spark, sf_dir, "embeddings")
    return store, store.filter("vec_id % 50 = 0")


@query(f"WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT b.vec_id AS query_id, a.vec_id, sqrt({DIST}) AS distance FROM embeddings a, q b) SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM d QUALIFY rank <= 3")
def knn_l2(spark, sf_dir):
    store, q = _vectors(spark, sf_dir)
    return retrieval.knn(store, q, 3).withColumn("distance", F.round("distance", 6))


def _rounded(df: DataFrame, rank: str = "rank") -> DataFrame:
    return df.select("query_id", "vec_id", F.round("relevance_score", 6).alias("score"), F.col(rank).alias("rank"))


@query(f"WITH {PAIRS}, {TOP(25)} SELECT query_id, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM top WHERE label = 3 QUALIFY rank <= 5")
def search_postfilter(spark, sf_dir):
    store, q = _vectors(spark, sf_dir)
    return _rounded(retrieval.search(store, q, 5, {"label": 3, "source": None}))


@query(f"WITH {PAIRS} SELECT query_id, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored WHERE label = 3 QUALIFY rank <= 5")
def search_prefilter(spark, sf_dir):
    store, q = _vectors(spark, sf_dir)
    return _rounded(retrieval.search(store, q, 5, {"label": 3}, prefilter=True))


@query(f"WITH {PAIRS}, {TOP(25)} SELECT query_id, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM top WHERE score >= 0.2 AND vec_id % 2 = 0 QUALIFY rank <= 5")
def search_threshold(spark, sf_dir):
    store, q = _vectors(spark, sf_dir)
    return _rounded(retrieval.search(store, q, 5, threshold=0.2, where=F.col("vec_id") % 2 == 0))


@query(f"WITH {PAIRS}, {TOP(15)} SELECT query_id, vec_id, round(score, 6) AS score, label FROM top QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) = 1")
def one_per_group(spark, sf_dir):
    store, q = _vectors(spark, sf_dir)
    return retrieval.one_per_group(retrieval.search(store, q, 15), "label").select("query_id", "vec_id", F.round("relevance_score", 6).alias("score"), "label")


@query(f"WITH {PAIRS}, {TOP(30)} SELECT query_id, vec_id, CAST(CASE WHEN label = query_label THEN 0 ELSE 1 END AS INT) AS pref, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN label = query_label THEN 0 ELSE 1 END, score DESC, vec_id) AS INT) AS place FROM top WHERE score >= 0.1 QUALIFY place <= 5")
def same_group_first(spark, sf_dir):
    store, q = _vectors(spark, sf_dir)
    own = q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    found = retrieval.search(store, q, 30).join(own, "query_id")
    return retrieval.same_group_first(found, F.col("own"), "label", 5, 0.1).select("query_id", "vec_id", "pref", "place")


@query("SELECT label % 2 AS half, count(*) AS n, CAST(min(len(embedding)) AS INT) AS dimension FROM (SELECT * FROM embeddings WHERE label < 5 UNION ALL SELECT * FROM embeddings WHERE label >= 5) GROUP BY 1")
def store_union(spark, sf_dir):
    store = table(spark, sf_dir, "embeddings")
    both = retrieval.merge_stores(store.filter("label < 5"), store.filter("label >= 5"))
    return both.groupBy((F.col("label") % 2).alias("half")).agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dimension"))


# ------------------------------------------------------------------ graph: suppliers as files, consecutive lines of an order as imports
FILE_SQL = lambda k: f"CASE {k} % 5 WHEN 0 THEN 'model/m' WHEN 1 THEN 'service/s' WHEN 2 THEN 'controller/c' WHEN 3 THEN 'api/a' ELSE 'util/u' END || CAST({k} AS VARCHAR) || '.py'"
EDGE_SQL = f"""li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem), e AS (SELECT DISTINCT 'r' || CAST(a.l_orderkey % 20 AS VARCHAR) AS repo_id, {FILE_SQL('a.l_suppkey')} AS src, {FILE_SQL('b.l_suppkey')} AS dst
FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey)"""
MODULE_SQL = f"m AS (SELECT DISTINCT 'r' || CAST(l_orderkey % 20 AS VARCHAR) AS repo_id, {FILE_SQL('l_suppkey')} AS file_path FROM lineitem)"


def _file_of(key):
    folders = F.element_at(F.array(*map(F.lit, ["model/m", "service/s", "controller/c", "api/a", "util/u"])), (key % 5 + 1).cast("int"))
    return F.concat(folders, key.cast("string"), F.lit(".py"))


def _modules(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("r"), (F.col("l_orderkey") % 20).cast("string")).alias("repo_id"), "l_suppkey").distinct()
    return rows.select("repo_id", _file_of(F.col("l_suppkey")).alias("file_path"), F.col("l_suppkey").alias("ordinal"))


def _edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("to"))
    repo = F.concat(F.lit("r"), (F.col("l_orderkey") % 20).cast("string"))
    imports = li.join(nxt, ["l_orderkey", "l_linenumber"]).select(repo.alias("repo_id"), _file_of(F.col("l_suppkey")).alias("file_path"), paths.stem(_file_of(F.col("to"))).alias("module"))
    return graph.import_edges(_modules(spark, sf_dir), imports.distinct())


@query(f"WITH {EDGE_SQL} SELECT * FROM e")
def import_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"WITH {EDGE_SQL} SELECT repo_id, src, count(DISTINCT dst) AS fan_out FROM e GROUP BY 1, 2 HAVING count(DISTINCT dst) >= 10")
def fan_out(spark, sf_dir):
    return graph.fan_out(_edges(spark, sf_dir))


@query(f"WITH {EDGE_SQL}, r AS (SELECT *, {LAYER_SQL('src')} AS src_rank, {LAYER_SQL('dst')} AS dst_rank FROM e) SELECT repo_id, src, dst, CAST(src_rank AS INT) AS src_rank, CAST(dst_rank AS INT) AS dst_rank FROM r WHERE dst_rank > src_rank + 1")
def layer_violations(spark, sf_dir):
    return graph.layer_violations(_edges(spark, sf_dir))


@query(f"""WITH {EDGE_SQL}, f AS (SELECT repo_id, src AS file_path, count(*) AS fan FROM e GROUP BY 1, 2), a AS (SELECT *, avg(fan) OVER () AS mean FROM f)
SELECT repo_id, file_path, round(least(fan * 20.0 / 2000, 1) * 22 + least(fan / 18.0, 1) * 18 + least(fan / greatest(mean * 2.5, 1), 1) * 18 + least((fan + 3) / 45.0, 1) * 22 + least((3 + greatest(floor(fan / 8), 1)) / 12.0, 1) * 20, 6) AS score FROM a""")
def god_score(spark, sf_dir):
    fan = _edges(spark, sf_dir).groupBy("repo_id", F.col("src").alias("file_path")).agg(F.count("*").alias("fan"))
    mean = fan.agg(F.avg("fan").alias("mean"))
    score = graph.god_score(F.col("fan") * 20, F.col("fan"), F.col("fan"), F.lit(3), F.col("fan"), F.col("mean"))
    return fan.join(F.broadcast(mean)).select("repo_id", "file_path", F.round(score, 6).alias("score"))  # one row of means


@query(f"""WITH {EDGE_SQL}, {MODULE_SQL}, c AS (SELECT repo_id, count(*) AS files, count({LAYER_SQL('file_path')}) AS layered FROM m GROUP BY 1), d AS (SELECT repo_id, count(*) AS edges FROM e GROUP BY 1)
SELECT repo_id, files, round(coalesce(edges, 0) / files, 6) AS mean_fan_out, round(layered / files, 6) AS layered_share, files >= 5 AND coalesce(edges, 0) / files >= 7 AND layered / files < 0.2 AS is_mud FROM c LEFT JOIN d USING (repo_id)""")
def mud_check(spark, sf_dir):
    return graph.mud(_modules(spark, sf_dir), _edges(spark, sf_dir)).withColumn("mean_fan_out", F.round("mean_fan_out", 6)).withColumn("layered_share", F.round("layered_share", 6))


# a sparse graph of nations within regions, so that cycles are small
NATION_SQL = "n AS (SELECT n_regionkey AS repo_id, n_nationkey AS k, n_name FROM nation), e AS (SELECT DISTINCT a.repo_id, a.n_name AS src, b.n_name AS dst FROM n a JOIN n b ON a.repo_id = b.repo_id AND a.k <> b.k AND (a.k * 7 + b.k * 3) % 5 < 2)"


@query(f"""WITH RECURSIVE {NATION_SQL}, reach(repo_id, a, b) AS (SELECT repo_id, src, dst FROM e UNION SELECT r.repo_id, r.a, e.dst FROM reach r JOIN e ON e.repo_id = r.repo_id AND e.src = r.b),
pair AS (SELECT x.repo_id, x.a, x.b FROM reach x JOIN reach y ON x.repo_id = y.repo_id AND x.a = y.b AND x.b = y.a), scc AS (SELECT repo_id, a, string_agg(DISTINCT b, ',' ORDER BY b) AS members FROM pair GROUP BY 1, 2)
SELECT DISTINCT repo_id, members FROM scc WHERE contains(members, ',')""")
def cycles(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("repo_id"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    a, b = n.alias("a"), n.alias("b")
    e = a.join(b, F.col("a.repo_id") == F.col("b.repo_id")).filter("a.k <> b.k and (a.k * 7 + b.k * 3) % 5 < 2").select("a.repo_id", F.col("a.name").alias("src"), F.col("b.name").alias("dst"))
    return graph.cycles(e).select("repo_id", F.array_join("members", ",").alias("members"))


# ------------------------------------------------------------------ jobs over events
STATUS_SQL = "CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END"
JOBS_SQL = f"j AS (SELECT user_id AS job_id, event_id, ts, {STATUS_SQL} AS status FROM events)"


@query(f"""WITH {JOBS_SQL} SELECT job_id, arg_max(status, event_id) AS status, min(ts) AS created_at, min(ts) FILTER (status = 'RUNNING') AS started_at, max(ts) FILTER (status IN ('COMPLETED', 'FAILED')) AS completed_at FROM j GROUP BY job_id""")
def job_lifecycle(spark, sf_dir):
    from corvane.streaming import jobs

    return jobs.lifecycle(jobs.from_events(table(spark, sf_dir, "events")))


@query(f"""WITH {JOBS_SQL}, s AS (SELECT job_id, arg_max(status, event_id) AS status FROM j GROUP BY job_id) SELECT status, count(*) AS n FROM s GROUP BY status""")
def jobs_by_status(spark, sf_dir):
    from corvane.streaming import jobs

    return jobs.by_status(jobs.lifecycle(jobs.from_events(table(spark, sf_dir, "events"))))


@query("""WITH p AS (SELECT user_id AS job_id, event_id, CAST(floor(value) % 101 AS INT) AS progress, lag(CAST(floor(value) % 101 AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT job_id, event_id, progress, CASE WHEN progress < 10 THEN 'ingest' WHEN progress < 40 THEN 'chunk' WHEN progress < 80 THEN 'analyse' WHEN progress < 100 THEN 'report' ELSE 'done' END AS stage FROM p WHERE before IS NULL OR before <> progress""")
def progress_changes(spark, sf_dir):
    from corvane.streaming import jobs

    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", (F.floor("value") % 101).cast("int").alias("progress"))
    return jobs.progress_changes(rows, "event_id")


# ------------------------------------------------------------------ queries without a SQL form
from . import code_queries, record_queries  # noqa: E402, F401
