"""The whole review of source files: findings, scores, report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import severity
from corvane.functions.paths import is_production
from corvane.functions.text import clip
from corvane.operators import chunking, dedup, graph, outline, pyast, records, rules, scoring
from corvane.sources.shared import materialize

FINDING = ["repo_id", "category", "rule_id", "kind", "severity", "title", "description", "suggested_fix", "cwe", "cvss", "file_path", "start_line", "end_line", "confidence", "confidence_level", "evidence"]
#: A detector that a caller adds: findings with the columns FINDING from (files, facts).
Detector = Callable[[DataFrame, DataFrame], DataFrame]
# fixed values: severities of the syntax rules and design heuristics
SYNTAX_RULES = {
    "BUG-001": ("NullDereference", "HIGH", "None is dereferenced"), "BUG-002": ("NullDereference", "MEDIUM", "result of get() is used unchecked"), "BUG-003": ("NullDereference", "HIGH", "optional parameter is used unchecked"),
    "BUG-010": ("DivisionByZero", "HIGH", "divisor may be zero"), "BUG-011": ("DivisionByZero", "MEDIUM", "modulus may be zero"), "BUG-020": ("InfiniteLoop", "HIGH", "loop has no way out"),
    "SEC-010": ("Injection", "CRITICAL", "SQL is built from input"), "SEC-030": ("PathTraversal", "HIGH", "path comes from input"), "SEC-040": ("SSRF", "HIGH", "url comes from input"),
    "SEC-050": ("Deserialization", "CRITICAL", "input is deserialised"), "SEC-070": ("Misconfiguration", "HIGH", "debug mode is on"),
    "SRP-001": ("SRP", "MEDIUM", "class has many methods"), "SRP-002": ("SRP", "LOW", "function is long"), "OCP-001": ("OCP", "HIGH", "function branches on types"), "OCP-002": ("OCP", "MEDIUM", "function branches on strings"),
    "ISP-001": ("ISP", "MEDIUM", "interface is wide"), "DIP-001": ("DIP", "HIGH", "constructor makes its own collaborator"),
}
FIXES = {
    "NullDereference": "Test for None before the use, or give a default.", "DivisionByZero": "Test the divisor before the division.", "InfiniteLoop": "Give the loop a condition or a way out.",
    "Injection": "Pass the values as parameters.", "PathTraversal": "Resolve the path and check that it lies under an allowed folder.", "SSRF": "Check the address against a list of allowed hosts.",
    "Deserialization": "Use a format that carries data alone, such as JSON, or a safe loader.", "Misconfiguration": "Take the switch from the environment, off by default.",
    "SRP": "Split it by responsibility.", "OCP": "Dispatch on types or a table instead of branches.", "ISP": "Split the interface into smaller ones.", "DIP": "Pass the collaborator in.",
    "CircularDependency": "Move what both need into a module of its own, or pass it in.", "TightCoupling": "Group the imports behind one interface.", "LayerViolation": "Go through the layer in between.",
    "GodClass": "Split the module by responsibility.", "BigBallOfMud": "Set up layers and let imports point one way.",
}
# fixed values: weakness numbers and scores of the syntax rules
WEAKNESS = {"SEC-010": ("CWE-89", 9.8), "SEC-030": ("CWE-22", 7.5), "SEC-040": ("CWE-918", 8.6), "SEC-050": ("CWE-502", 9.8), "SEC-070": ("CWE-94", 5.3)}
# fixed values: severity and confidence of the architecture findings
ARCHITECTURE = {
    "ARC-001": ("CircularDependency", "CRITICAL", 0.95, "import cycle"), "ARC-002": ("TightCoupling", "HIGH", 0.78, "imports many modules"), "ARC-003": ("LayerViolation", "HIGH", 0.70, "skips layers"),
    "ARC-004": ("GodClass", "HIGH", 0.78, "module does too much"), "ARC-005": ("BigBallOfMud", "CRITICAL", 0.75, "no layers"),
}


@dataclass(frozen=True)
class Config:
    """Parameters of a review."""

    max_chunk_lines: int = 80
    bug: bool = True
    security: bool = True
    solid: bool = True
    complexity: bool = True
    architecture: bool = True
    min_severity: str = "HIGH"  # of complexity findings

    def __post_init__(self) -> None:
        if not 20 <= self.max_chunk_lines <= 500:
            raise ValueError("max_chunk_lines is 20 to 500")


def syntax_table(spark: SparkSession) -> DataFrame:
    rows = [(k, *v, FIXES[v[0]], *WEAKNESS.get(k, (None, None))) for k, v in SYNTAX_RULES.items()]
    return spark.createDataFrame(rows, "rule_id string, kind string, severity string, label string, suggested_fix string, cwe string, cvss double")


def _shaped(rows: DataFrame, category) -> DataFrame:
    for name, kind in (("suggested_fix", "string"), ("cwe", "string"), ("cvss", "double")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumn("category", category).withColumn("title", clip(F.format_string("[%s] %s: %s", "rule_id", "label", "file_path"), 200))
    rows = rows.withColumn("description", F.format_string("%s in line %d: %s", "label", "start_line", "evidence"))
    return rows.withColumn("confidence_level", severity.confidence_band(F.col("confidence"))).select(*FINDING)


def code_findings(files: DataFrame, facts: DataFrame, config: Config) -> list[DataFrame]:
    """Syntax-rule, line-rule, SOLID and complexity findings of source files with their analysed facts."""
    spark = files.sparkSession
    table = F.broadcast(syntax_table(spark))
    out = []
    by_file = dedup.first_of(facts.filter("kind = 'rule'"), ["repo_id", "file_path", "rule_id"], ["seq"]).drop("kind").join(table, "rule_id").withColumn("evidence", F.col("name"))
    out.append(_shaped(by_file.withColumn("end_line", F.col("start_line")), F.when(F.col("rule_id").startswith("BUG"), "bug").otherwise("security")))
    hits = rules.scan_lines(files.select("repo_id", "file_path", "language", "content"), docstrings=pyast.docstring_mask(F.col("content")))
    lines = rules.to_findings(hits, rules.rule_table(spark)).withColumn("evidence", F.col("match_text"))
    out.append(lines.select(*FINDING))
    if config.solid:
        once = solid_hits(files, config.max_chunk_lines).drop("kind").join(table, "rule_id")
        once = once.withColumn("start_line", F.col("chunk_start")).withColumn("end_line", F.col("chunk_start") + config.max_chunk_lines - 1).withColumn("evidence", F.col("name"))
        out.append(_shaped(once, F.lit("solid")))
    if config.complexity:
        m = function_metrics(facts).withColumn("severity", severity.worst(*(F.col(c) for c in ("cyclomatic", "cognitive", "nesting", "lines_of_code"))))
        m = m.filter(severity.rank(F.col("severity")) <= severity.SEVERITIES.index(config.min_severity))
        m = m.withColumns({"rule_id": F.lit("CPX-001"), "kind": F.lit("Complexity"), "label": F.concat(F.lit("complex function "), F.col("name")), "confidence": F.lit(0.95), "suggested_fix": records.advice(F.col("cyclomatic"), F.col("cognitive"), F.col("nesting")), "evidence": F.to_json(F.struct("cyclomatic", "cognitive", "nesting", "lines_of_code"))})
        out.append(_shaped(m, F.lit("complexity")))
    return [x.filter(F.col("category").isin([c for c in severity.WEIGHTS if getattr(config, c)])) for x in out]


def solid_hits(files: DataFrame, max_chunk_lines: int = chunking.CHUNK_LINES) -> DataFrame:
    """Design hits of each line window for itself, each rule and name once in a window; a window that cannot be parsed alone has none."""
    chunks = chunking.line_windows(files.select("repo_id", "file_path", "language", "content"), max_chunk_lines)
    found = pyast.analyse_files(chunks.select("repo_id", F.col("start_line").alias("chunk_start"), "file_path", "language", "content"), ["repo_id", "chunk_start"], what=pyast.design)
    return dedup.first_of(found, ["repo_id", "file_path", "chunk_start", "rule_id", "name"], ["seq"])


def function_metrics(facts: DataFrame) -> DataFrame:
    """Metric rows with their values as columns."""
    values = F.from_json("detail", "lines_of_code int, cyclomatic int, cognitive int, nesting int")
    return facts.filter("kind = 'metric'").withColumn("v", values).select("repo_id", "file_path", "name", "start_line", "end_line", "v.*")


def import_rows(facts: DataFrame) -> DataFrame:
    """(repo_id, file_path, seq, module): what files import, as the stems that files are known by."""
    return facts.filter("kind = 'import' and name <> ''").select("repo_id", "file_path", "seq", F.get_json_object("detail", "$.stem").alias("module"))


def module_summary(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo_id, file_path, n_lines, n_imports, imports, classes, functions, ordinal) of production files; imports in order, each once."""
    counts = facts.filter("kind = 'entity'").withColumn("v", F.from_json("detail", "classes int, functions int")).select("repo_id", "file_path", "v.*")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("seq", "module"))), lambda x: x["module"])
    imports = import_rows(facts).groupBy("repo_id", "file_path").agg(F.array_distinct(in_order).alias("imports"))
    base = files.filter(is_production(F.col("file_path"))).select("repo_id", "file_path", F.size(F.split("content", "\n")).alias("n_lines"))
    joined = base.join(counts, ["repo_id", "file_path"], "left").join(imports, ["repo_id", "file_path"], "left").na.fill(0, ["classes", "functions"])
    listed = F.coalesce("imports", F.array().cast("array<string>"))
    return joined.select("repo_id", "file_path", "n_lines", F.size(listed).alias("n_imports"), listed.alias("imports"), "classes", "functions", F.col("file_path").alias("ordinal"))


def python_modules(files: DataFrame) -> DataFrame:
    """module_summary of the Python files, without facts: a row per file from one pass, nothing is joined."""
    counted = files.withColumn("n_lines", F.size(F.split("content", "\n")))
    values = F.from_json("detail", "classes int, functions int, imports array<string>")
    found = pyast.analyse_files(counted, ["repo_id", "n_lines"], what=pyast.summary).withColumn("v", values)
    return found.select("repo_id", "file_path", "n_lines", F.size("v.imports").alias("n_imports"), "v.imports", "v.classes", "v.functions", F.col("file_path").alias("ordinal"))


def _smell(rows: DataFrame, rule_id: str, path, evidence) -> DataFrame:
    kind, level, confidence, label = ARCHITECTURE[rule_id]
    fixed = {"rule_id": rule_id, "kind": kind, "severity": level, "confidence": confidence, "label": label, "suggested_fix": FIXES[kind]}
    return rows.select("repo_id", path.alias("file_path"), evidence.cast("string").alias("evidence"), *(F.lit(v).alias(k) for k, v in fixed.items()))


def cycle_text(members, shown: int = 6):
    """The first members of a cycle, and how many more there are."""
    more = F.size(members) - shown
    return F.concat(F.array_join(F.slice(members, 1, shown), ", "), F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def architecture_findings(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Cycles, tight coupling, layer violations, god modules and mud."""
    modules = module_summary(files, facts)
    edges = materialize(graph.import_edges(modules, import_rows(facts)), "import-edges")
    fan = edges.groupBy("repo_id", F.col("src").alias("file_path")).agg(F.count("*").alias("fan"))
    mean = modules.groupBy("repo_id").agg(F.avg("n_imports").alias("mean"))
    scored = modules.join(fan, ["repo_id", "file_path"], "left").na.fill(0, ["fan"]).join(mean, "repo_id")
    scored = scored.withColumn("score", graph.god_score(*(F.col(c) for c in ("n_lines", "fan", "n_imports", "classes", "functions", "mean"))))
    god = scored.filter((F.col("score") >= graph.GOD_SCORE) & ~graph.is_entry_point(F.col("file_path"), F.col("n_lines"), F.col("functions")))
    parts = [
        _smell(graph.cycles(edges), "ARC-001", F.col("members")[0], cycle_text(F.col("members"))),
        _smell(graph.fan_out(edges), "ARC-002", F.col("src"), F.col("fan_out")),
        _smell(graph.layer_violations(edges), "ARC-003", F.col("src"), F.col("dst")),
        _smell(god, "ARC-004", F.col("file_path"), F.round("score", 1)),
        _smell(graph.mud(modules, edges).filter("is_mud"), "ARC-005", F.lit("(repository)"), F.col("mean_fan_out")),
    ]
    every = reduce(DataFrame.unionByName, parts)
    return _shaped(every.withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(1)), F.lit("architecture"))


def review(files: DataFrame, config: Config = Config(), detectors: Sequence[Detector] = ()) -> DataFrame:
    """All findings of files(repo_id, file_path, language, content), each place and rule once, in report order.

    Files are parsed once, into a table in the shared folder. Further detectors may be given.
    """
    facts = materialize(pyast.analyse_files(files, ["repo_id"], languages=["python", *outline.OUTLINES]), "facts")
    parts = code_findings(files, facts, config)
    if config.architecture:
        parts.append(architecture_findings(files, facts))
    parts += [detect(files, facts).select(*FINDING) for detect in detectors]
    every = reduce(DataFrame.unionByName, parts)
    once = dedup.first_of(every, ["repo_id", "category", "rule_id", "file_path", "start_line", "evidence"], ["title"])
    return once.orderBy("repo_id", severity.rank(F.col("severity")), "file_path", "start_line", "rule_id")


# fixed values: security categories a reply may name
CATEGORIES = [
    "HardcodedSecret", "Injection", "PathTraversal", "SSRF", "Deserialization", "InsecureUpload", "WeakCryptography", "Misconfiguration",
]


def resolve_category(raw):
    """The category a reply means: its name, or the first whose name holds it or that it holds, any case; otherwise Misconfiguration."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    out = F.lit("Misconfiguration")
    for name in reversed(CATEGORIES):
        out = F.when((low != "") & (F.contains(F.lit(name.lower()), low) | F.contains(low, F.lit(name.lower()))), name).otherwise(out)
    return out


def confirmations(rows: DataFrame, column: str = "reply") -> DataFrame:
    """Findings out of model replies: a JSON object or array of objects; what is missing gets defaults, broken replies give none."""
    one = "rule_id string, severity string, title string, line int, confidence double, category string"
    listed = F.from_json(F.when(F.trim(column).startswith("{"), F.concat(F.lit("["), F.trim(column), F.lit("]"))).otherwise(F.col(column)), f"array<struct<{one.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double')}>>")
    found = rows.select(*[c for c in rows.columns if c != column], F.explode(listed).alias("f")).select(*[c for c in rows.columns if c != column], "f.*")
    found = found.filter(F.col("title").isNotNull()).withColumn("category", resolve_category(F.col("category"))).withColumn("severity", F.when(severity.rank(F.upper("severity")) < 5, F.upper("severity")).otherwise("MEDIUM"))
    return found.withColumn("confidence", F.least(F.greatest(F.coalesce("confidence", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))).withColumn("line", F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)))


# fixed values: categories in report order
SECTIONS = ["security", "bug", "architecture", "solid", "complexity"]


def executive_summary(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo_id, place, line): score, findings and weight by category, what is urgent, and advice by the score."""
    count = lambda test: F.count_if(test).alias
    of = lambda c: F.col("category") == c
    counts = findings.groupBy("repo_id").agg(
        *(count(of(c))(f"n_{c}") for c in severity.WEIGHTS), count(of("security") & (F.col("severity") == "CRITICAL"))("urgent"),
        count(of("bug") & F.col("severity").isin("CRITICAL", "HIGH"))("bugs"), count(F.col("kind") == "CircularDependency")("cycles"),
    )
    card = scoring.scorecard(findings, repos).join(counts, "repo_id", "left").na.fill(0)
    score = F.col("overall_score")
    lines = [
        F.concat(F.lit("# Review of "), F.col("repo_id")),
        F.format_string("Score: %.1f (%s)", "overall_score", "grade"),
        F.format_string("Findings: %d, critical: %d", "total_findings", "critical_count"),
        *(F.format_string(f"| {c} | %d | {round(float(w) * 100)}%% |", f"n_{c}") for c, w in severity.WEIGHTS.items()),
        F.when(F.col("urgent") > 0, F.format_string("%d critical security findings need a fix before the next deployment.", "urgent")),
        F.when(F.col("bugs") > 0, F.format_string("%d severe bugs are likely to fail at run time.", "bugs")),
        F.when(F.col("cycles") > 0, F.format_string("%d import cycles stand in the way of testing modules alone.", "cycles")),
        F.when(score >= 80, "In good shape.").when(score >= 60, "Needs attention.").otherwise("Needs work first."),
    ]
    listed = F.array(*(F.when(line.isNotNull(), F.struct(F.lit(f"0-{k:02d}").alias("place"), line.alias("line"))) for k, line in enumerate(lines)))
    return card.select("repo_id", F.inline(F.array_compact(listed)))


def digest(findings: DataFrame, shown: int = 3) -> DataFrame:
    """(repo_id, category, place, line): how many findings a category has, the first few, and how many more."""
    w = Window.partitionBy("repo_id", "category")
    order = w.orderBy(severity.rank(F.col("severity")), "file_path", "start_line", "rule_id")
    ranked = findings.select("repo_id", "category", F.row_number().over(order).alias("place"), F.format_string("[%s] %s", "severity", "title").alias("line"))
    head = findings.groupBy("repo_id", "category").agg(F.count("*").alias("n"))
    more = head.filter(F.col("n") > shown).select("repo_id", "category", F.lit(shown + 1).alias("place"), F.format_string("and %d more", F.col("n") - shown).alias("line"))
    head = head.select("repo_id", "category", F.lit(0).alias("place"), F.format_string("%s (%d findings)", "category", "n").alias("line"))
    return head.union(ranked.filter(F.col("place") <= shown)).union(more)


def report_lines(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo_id, place, line): a Markdown report per repository; sorted by repo_id and place, its lines make the text.

    A place is a text that sorts as the report goes, so no repository's findings are gathered or ranked.
    """
    section = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("category"))
    head = findings.groupBy("repo_id", "category").agg(F.count("*").alias("n")).select("repo_id", F.format_string("%d-", section).alias("place"), F.format_string("## %s (%d)", "category", "n").alias("line"))
    place = F.format_string("%d-%d-%s-%08d-%s", section, severity.rank(F.col("severity")), "file_path", "start_line", "rule_id")
    line = F.format_string("- **%s** %s (%s:%d)", "severity", "title", "file_path", "start_line")
    return executive_summary(findings, repos).union(head).union(findings.select("repo_id", place.alias("place"), line.alias("line")))


def write_report(lines: DataFrame, path: str) -> None:
    """The reports as text, one folder per repository (repo=…), the lines in order; an existing folder is an error."""
    named = lines.withColumn("repo", safe_name(F.col("repo_id")))
    named.repartition("repo").sortWithinPartitions("repo", "repo_id", "place").select("repo", F.col("line").alias("value")).write.partitionBy("repo").text(path)


def safe_name(name) -> str:
    """File-name form of a repository name."""
    return F.left(F.regexp_replace(name, r"[^a-zA-Z0-9_\-]", "_"), F.lit(40))


def to_html(markdown: str) -> str:
    """Escaped text in a pre block; no converter is assumed."""
    import html

    return f"<html><body><pre>{html.escape(markdown)}</pre></body></html>"
