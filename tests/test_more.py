"""Sources, summaries, reports and helpers that no table query covers."""

import base64
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.errors import SourceError, StoreError
from corvane.operators import chunking, graph, records, retrieval, rules, scoring
from corvane.plans import review, snippets
from corvane.sources import files as sources
from corvane.sources import shared
from corvane.streaming import jobs


@pytest.fixture(scope="module")
def mini(spark):
    return snippets.files(spark)


@pytest.fixture(scope="module")
def found(mini):
    return review.review(mini).cache()


def test_exactly_one_source(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.py").write_bytes(b"x\0")
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("r/b.js", "1")
        z.writestr("r/a.py", "2")
    text = base64.b64encode(blob.getvalue()).decode()
    assert [r.file_path for r in sources.load_repository(spark, str(tmp_path)).collect()] == ["a.py"]
    assert [r.file_path for r in sources.load_repository(spark, zip_b64=text).collect()] == ["a.py", "b.js"]
    for given in ({}, {"path": str(tmp_path), "zip_b64": text}, {"zip_b64": "broken"}):
        with pytest.raises(SourceError):
            sources.load_repository(spark, **given)


def test_docstrings_hide_lines(spark):
    body = 'def f():\n    """\n    password = "Tr0ub4dor&3xyz"\n    """\n    api_key = "k8Jq2mZx91LpQw7v"\n'
    files = spark.createDataFrame([("r", "src/a.py", "python", body)], "repo_id string, file_path string, language string, content string")
    assert [(r.rule_id, r.start_line) for r in review.review(files).filter("rule_id in ('SEC-001', 'SEC-003')").orderBy("rule_id").collect()] == [("SEC-001", 5), ("SEC-003", 5)]


def test_architecture_levels_and_fields(found):
    rows = {(r.rule_id, r.severity, r.confidence) for r in found.filter("category = 'architecture'").collect()}
    assert {("ARC-001", "CRITICAL", 0.95), ("ARC-002", "HIGH", 0.78)} <= rows
    for r in found.collect():
        assert r.suggested_fix and r.description and (r.cwe is not None) == (r.category == "security") == (r.cvss is not None), r


def test_further_detectors(spark, mini):
    def todo(files, facts):
        first = files.limit(1).select("repo_id", "file_path")
        fixed = {"category": "bug", "rule_id": "X-1", "kind": "Todo", "severity": "LOW", "title": "todo", "description": "d", "suggested_fix": "f", "confidence_level": "Low", "evidence": "e"}
        return first.select("*", *(F.lit(v).alias(k) for k, v in fixed.items()), F.lit(None).cast("string").alias("cwe"), F.lit(None).cast("double").alias("cvss"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(0.1).alias("confidence"))

    assert review.review(mini, review.Config(solid=False, architecture=False), [todo]).filter("rule_id = 'X-1'").count() == 1


def test_imports_of_other_languages_reach_the_graph(spark):
    rows = [("r", "a/main.c", "c", '#include "util.h"\n'), ("r", "a/util.c", "c", "int x;\n"), ("r", "a/app.ts", "typescript", 'import { x } from "lib/y";\n'), ("r", "a/lib.ts", "typescript", "export const x = 1\n")]
    files = spark.createDataFrame(rows, "repo_id string, file_path string, language string, content string")
    from corvane.operators import outline, pyast

    facts = pyast.analyse_files(files, ["repo_id"], languages=["python", *outline.OUTLINES])
    edges = graph.import_edges(review.module_summary(files, facts), review.import_rows(facts))
    assert {(r.src, r.dst) for r in edges.collect()} == {("a/main.c", "a/util.c"), ("a/app.ts", "a/lib.ts")}
    lines = [r.line for r in graph.repository_summary(review.module_summary(files, facts), edges).orderBy("place").collect()]
    assert lines == ["Files analysed: 4", "a/app.ts: 1 imports, 0 classes, 0 functions; depends on a/lib.ts", "a/main.c: 1 imports, 0 classes, 0 functions; depends on a/util.c", "a/lib.ts: 0 imports, 0 classes, 0 functions", "a/util.c: 0 imports, 0 classes, 0 functions"]


def test_report_and_digest(spark, found, tmp_path):
    lines = review.report_lines(found, spark.createDataFrame([("mini",), ("bare",)], "repo_id string"))
    of = lambda repo: [r.line for r in lines.filter(F.col("repo_id") == repo).orderBy("place").collect()]
    assert of("bare") == ["# Review of bare", "Score: 100.0 (A)", "Findings: 0, critical: 0", "| bug | 0 | 30% |", "| solid | 0 | 25% |", "| architecture | 0 | 20% |", "| security | 0 | 15% |", "| complexity | 0 | 10% |", "In good shape."]
    report = of("mini")
    assert "1 import cycles stand in the way of testing modules alone." in report and [x for x in report if x.startswith("## ")][0].startswith("## security") and sum(x.startswith("- **") for x in report) == found.count()
    review.write_report(lines, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["repo=bare", "repo=mini"]
    written = spark.read.text(str(tmp_path / "out" / "repo=mini")).collect()
    assert [r.value for r in written] == report
    digest = [r.line for r in review.digest(found).filter("category = 'bug'").orderBy("place").collect()]
    assert digest[0].startswith("bug (") and len(digest) == 5 and digest[4].startswith("and ")


def test_categories_and_colours(spark):
    row = spark.range(1).select(*(review.resolve_category(F.lit(x)).alias(f"c{k}") for k, x in enumerate(["Injection", "sql injection", "ssrf", "", None, "odd"])), scoring.severity.score_colour(F.lit(80)).alias("a"), scoring.severity.score_colour(F.lit(80), "card").alias("b")).first()
    assert list(row) == ["Injection", "Injection", "SSRF", "Misconfiguration", "Misconfiguration", "Misconfiguration", "green", "blue"]


def test_lines_entry_points_and_windows(spark):
    lines = F.array(*map(F.lit, "abcd"))
    got = spark.range(1).select(chunking.extract_lines(lines, F.lit(2), F.lit(9)).alias("a"), chunking.extract_lines(lines, F.lit(3), F.lit(2)).alias("b"), graph.is_entry_point(F.lit("src/main.py"), F.lit(500), F.lit(20)).alias("c"), graph.is_entry_point(F.lit("a/b/c/d/main.py"), F.lit(500), F.lit(20)).alias("d"), graph.is_entry_point(F.lit("core.py"), F.lit(250), F.lit(8)).alias("e"), graph.is_entry_point(F.lit("other.py"), F.lit(500), F.lit(20)).alias("f"))
    assert list(got.first()) == ["b\nc\nd", "", True, False, True, False]
    events = spark.createDataFrame([(f"2024-01-01 00:0{k}:00", "a") for k in (0, 4, 6)], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type")
    assert sorted(r.n for r in jobs.windowed_counts(events).collect()) == [1, 2]


def test_json_is_not_overwritten(spark, found, tmp_path):
    path = str(tmp_path / "f")
    records.write_json(found, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        records.write_json(found, path)
    records.write_json(found.limit(1), path, overwrite=True)
    assert spark.read.json(path).count() == 1


def test_embedders():
    assert retrieval.embedder() is retrieval.hash_embed
    with pytest.raises(StoreError):
        retrieval.embedder("unknown")


def test_hash_embeddings(spark):
    rows = spark.createDataFrame([("a b a",), ("",), (None,), ("Ünï_1 B",)], "t string").select(retrieval.hash_embed(F.col("t"), 16).alias("v")).collect()
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-5 and len(r.v) == 16 for r in rows) and rows[1].v == rows[2].v


def test_texts_whose_words_cancel_do_not_break_a_search(spark):
    # w0 and w88 share a place of 64 with other signs
    rows = spark.createDataFrame([("a", "w0 w88"), ("b", "w0 other"), ("c", "")], "chunk_id string, page_content string")
    embed = lambda c: retrieval.hash_embed(c, 64)
    store = retrieval.build_store(rows, embed=embed)
    by_id = {r.chunk_id: r.embedding for r in store.collect()}
    assert by_id["a"] == by_id["c"] and sum(map(abs, by_id["a"])) == 1.0
    assert [r.chunk_id for r in retrieval.retrieve(spark, store, "w0", 1, embed=embed).collect()] == ["b"]


def test_shared_tables_are_purged(spark):
    start = shared.made()
    a, b = (shared.materialize(spark.range(3), "t") for _ in "ab")
    keep = shared._PATHS[-1]
    shared.purge(spark, start, keep=(keep,))
    assert b.count() == 3 and shared.made() == start + 1
    with pytest.raises(Exception, match="not exist|FileNotFound|FILE_NOT_EXIST"):
        a.count()
    shared.purge(spark, start)


HITS = {
    "SEC-001": ['my_db_password = "abcd"', "apikey='12345'", 'secret_key="zzzz"'], "SEC-011": ['Item.objects.raw("x %s" % y)', "extra(where=f'{x}')"], "SEC-020": ["subprocess.check_call(cmd, shell = True)"], "SEC-021": ["os.execvp(a + b)", "os.system('a %s' % b)"],
    "SEC-022": ["eval( request.x )", "exec(getattr(a, b))"], "SEC-031": ["f.save(upload.name)"], "SEC-060": ["hashlib.md5(x)", "SHA1 (x)"], "SEC-061": ["AES('c2VjcmV0a2V5')"], "BUG-030": ["f = open(name)"], "BUG-031": ["my_conn = mysql.connector.connect("], "BUG-032": ["s = socket.socket()"],
}
MISSES = {"SEC-001": ['secretkey_x = "abcd"', 'password = "abc"'], "SEC-020": ["subprocess.run(f(x), shell=True)"], "SEC-022": ["evaluate(request)", "eval(x)"], "SEC-031": ["f.save(upload.name, extension)"], "BUG-030": ["with open(name) as f:", "f = open()"], "BUG-032": ["s = socket.socket() # with"], "SEC-061": ["AES('short')"]}


def test_line_rule_patterns(spark):
    cases = [(r, t, want) for table, want in ((HITS, True), (MISSES, False)) for r, ts in table.items() for t in ts]
    frame = spark.createDataFrame(cases, "rule string, line string, want boolean")
    for r in frame.collect():
        rule = rules.BY_ID[r.rule]
        test = F.col("line").rlike(f"(?i){rule.pattern}") & (~F.col("line").rlike(f"(?i){rule.unless}") if rule.unless else F.lit(True))
        assert frame.filter((F.col("line") == r.line) & test).isEmpty() != r.want, (r.rule, r.line)
