"""Column functions and operators against plain Python models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.errors import JobError, RetrievalError, SourceError, StoreError
from corvane.functions import paths, severity, text
from corvane.operators import chunking, dedup, graph, retrieval, rules, scoring
from corvane.streaming import jobs


def column(spark, values, f, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.select("i", f(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_split_lines_like_python(spark):
    rng = random.Random(1)
    values = ["", "\n", "a", "a\n", "a\r\nb\r", "\n\n", "a\u2028b\x0bc\x0cd\x1ce\x85f"] + ["".join(rng.choice("ab\n\r \x0b") for _ in range(rng.randrange(12))) for _ in range(200)]
    assert column(spark, values, text.split_lines) == [v.splitlines() for v in values]


def strip_model(line):
    out, quote, i = "", None, 0
    while i < len(line):
        c = line[i]
        if quote:
            if c == "\\" and i + 1 < len(line):
                i += 2
                continue
            if c == quote:
                quote = None
        elif c in "\"'":
            quote = c
        elif c == "#":
            return line[:i]
        i += 1
    return line


def test_strip_comment_like_a_scanner(spark):
    rng = random.Random(2)
    values = ["", "# x", "a # b", "'#' # y", "it's # hidden", '"\\"#" # z', "x" * 5000 + "#"] + ["".join(rng.choice("ab#\"'\\ ") for _ in range(rng.randrange(14))) for _ in range(500)]
    assert column(spark, values, text.strip_comment) == [strip_model(v) for v in values]


def test_entropy_placeholders_fixtures(spark):
    assert column(spark, ["", "abca", "aaaa"], text.entropy) == pytest.approx([0, 1.5, 0])
    values = ["", " ", "changeme", "hunter2!Zq8", "REPLACE_ME", "my-token", "8824c3a463b8b0d6", "your-api-key", "PASSWORD1", "aaaaaaaaaa"]
    assert column(spark, values, text.is_placeholder) == [True, True, True, False, True, True, False, True, True, True]
    assert column(spark, ["", "Test", "contest entry value long", "a test", "dev", "prod"], text.is_fixture_secret) == [True, True, False, True, True, False]
    assert column(spark, ['a = "x y"', "a = 'q'", "none"], text.quoted_value) == ["x y", "q", ""]


def test_paths(spark):
    roles = {"tests/a.py": "test", "src/test_a.py": "test", "pkg/a_test.py": "test", "x/latest.py": "test", "docs/a.md": "docs", "examples/a.py": "example", "src/app.py": "production", "a\\unit_tests\\b.py": "test", "src/conftest.py": "test", "__tests__/a.js": "test", "src/contest.md": "production"}
    assert column(spark, list(roles), paths.file_role) == list(roles.values())
    assert column(spark, ["src/a.py", "app/static/x.py", "bench/a.py", "migrations/a.py"], paths.is_production) == [True, False, False, False]
    assert column(spark, ["a.PY", "b.tsx", "c", ".py", "d.h", "e.mjs", "x.tar.gz"], paths.language) == ["python", "typescript", "unknown", "unknown", "c", "javascript", "unknown"]
    assert column(spark, ["src/a.py", "node_modules/x.js", ".hidden/a.py", "a/.env", "venv/b/c.py"], paths.is_excluded) == [False, True, True, False, True]
    urls = ["https://github.com/acme/tool.git/", "git@gitlab.com:acme/tool", "https://example.com/a/b", "https://github.com/acme"]
    assert column(spark, urls, paths.is_repository_url) == [True, True, False, False]
    assert column(spark, urls[:2], paths.repository_name) == ["tool", "tool"]
    assert column(spark, ["x/model/a.py", "api/service.py", "plain.py"], paths.layer_rank) == [0, 6, None]


def test_severity(spark):
    assert column(spark, ["CRITICAL", "INFO", "?", None], severity.rank) == [0, 4, 5, 5]
    assert column(spark, ["CRITICAL", "LOW", "?"], severity.downgrade) == ["MEDIUM", "INFO", "?"]
    rows = spark.createDataFrame([(40, 0, 0, 5), (1, 0, 6, 5), (16, 0, 0, 65), (1, 0, 0, 65), (None, 0, 0, 85), (1, 1, 0, 5)], "cc int, cog int, nest int, loc int")
    assert [r[0] for r in rows.select(severity.worst(F.col("cc"), F.col("cog"), F.col("nest"), F.col("loc"))).collect()] == ["CRITICAL", "HIGH", "MEDIUM", None, "HIGH", None]


def test_scorecard(spark):
    found = spark.createDataFrame([("a", "bug", "CRITICAL")] * 7 + [("a", "security", "INFO"), ("b", "solid", "HIGH")], "repo_id string, category string, severity string")
    repos = spark.createDataFrame([("a",), ("b",), ("c",)], "repo_id string")
    got = {r.repo_id: (r.overall_score, r.grade, r.total_findings, r.critical_count) for r in scoring.scorecard(found, repos).collect()}
    assert got == {"a": (69.9, "C", 8, 7), "b": (97.5, "A", 1, 0), "c": (100.0, "A", 0, 0)}


def test_line_windows_and_rebuild(spark):
    files = {"a": "\n".join(f"line {i}" for i in range(200)), "b": "\n" * 80 + "x\n", "c": "  \n", "d": "one"}
    frame = spark.createDataFrame(list(files.items()), "file_path string, content string")
    chunks = chunking.line_windows(frame)
    got = sorted((r.file_path, r.start_line, r.end_line) for r in chunks.collect())
    assert got == [("a", 1, 80), ("a", 81, 160), ("a", 161, 200), ("b", 81, 81), ("d", 1, 1)]
    back = {r.file_path: r.content for r in chunking.rebuild_files(chunks, ["file_path"]).collect()}
    assert back == {"a": files["a"], "b": "x", "d": "one"}
    gap = spark.createDataFrame([("f", 1, "a"), ("f", 4, "d")], "file_path string, start_line int, content string")
    assert chunking.rebuild_files(gap, ["file_path"]).first().content == "a\n\n\nd"


def test_ranges(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 3, 8), ("a", 10, 15), ("a", 9, 9), ("b", 4, 4)], "f string, start_line int, end_line int")
    merged = chunking.merge_ranges(rows, ["f"])
    assert sorted((r.f, r.start_line, r.end_line) for r in merged.collect()) == [("a", 1, 15), ("b", 4, 4)]
    totals = spark.createDataFrame([("a", 15), ("b", 6), ("c", 2)], "f string, n_lines int")
    got = {r.f: (r.n_uncovered, r.first_line, r.last_line) for r in chunking.uncovered_lines(totals, merged, ["f"]).collect()}
    assert got == {"a": (0, 1, 1), "b": (5, 1, 6), "c": (2, 1, 2)}


def test_uncovered_lines_without_ranges_inside(spark):
    totals = spark.createDataFrame([("none", 7), ("beyond", 3), ("empty", 0), ("part", 5)], "f string, n_lines int")
    merged = spark.createDataFrame([("beyond", 4, 9), ("part", 2, 9)], "f string, start_line int, end_line int")
    got = {r.f: (r.n_uncovered, r.first_line, r.last_line) for r in chunking.uncovered_lines(totals, merged, ["f"]).collect()}
    assert got == {"none": (7, 1, 7), "beyond": (3, 1, 3), "empty": (0, 1, 1), "part": (1, 1, 1)}


def test_proximity_and_order(spark):
    rows = spark.createDataFrame([("k", x) for x in (30, 1, 4, 6, 7, 12, 13)], "k string, line int")
    assert sorted(r.line for r in dedup.proximity(rows, ["k"], "line").collect()) == [1, 7, 13, 30]
    frame = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, "z")], "k string, seq int, v string")
    assert sorted(r.v for r in dedup.first_of(frame, ["k"], ["seq"]).collect()) == ["x", "z"]
    assert sorted(r.v for r in dedup.last_wins(frame, ["k"], "seq").collect()) == ["y", "z"]


def test_line_rules(spark):
    body = "\n".join(["f = open(p)", "with open(p) as g: pass", 'token = "8824c3a463b8b0d68516db48c461547d5799bf8b"', 'password = "changeme"', 'password = "hQ8!kd92mXz"', "x = 1  # token = 'aaaa'", "s = socket.socket(a)", "file.save(request.files) # allowlist", "upload.save(data)", 'raw("select %s" % x)'])
    files = spark.createDataFrame([("src/a.py", "python", body), ("tests/a.py", "python", body), ("src/b.go", "go", body)], "file_path string, language string, content string")
    got = sorted((r.file_path, r.rule_id, r.line_no) for r in rules.scan_lines(files).collect())
    # the first password is a stand-in and ends its rule for the window
    assert got == [("src/a.py", "BUG-030", 1), ("src/a.py", "BUG-032", 7), ("src/a.py", "SEC-003", 3), ("src/a.py", "SEC-011", 10), ("src/a.py", "SEC-031", 8), ("src/b.go", "BUG-030", 1), ("src/b.go", "BUG-032", 7)]


def test_components(spark):
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randrange(2, 12)
        edges = {(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < 0.2}
        reach = {a: {a} for a in range(n)}
        for _ in range(n):
            for a, b in edges:
                reach[a] |= reach[b]
        want = sorted({tuple(sorted(str(b) for b in range(n) if b in reach[a] and a in reach[b])) for a in range(n)})
        nodes = {}
        for a, b in edges:
            nodes.setdefault(str(a), []).append(str(b))
        assert graph.strong_components(nodes) == [list(x) for x in want if len(x) > 1]


def test_retrieval(spark, tmp_path):
    store = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)], i % 2, f"f{i // 2}") for i in range(10)], "vec_id long, embedding array<float>, label int, file_path string")
    q = store.filter("vec_id = 4")
    assert [r.vec_id for r in retrieval.knn(store, q, 3).orderBy("rank").collect()] == [4, 3, 5]
    assert retrieval.knn(store, q, 99).count() == 10
    found = retrieval.search(store, q, 2, {"label": 1, "file_path": None}, prefilter=True)
    assert {r.label for r in found.collect()} == {1} and found.count() == 2
    once = retrieval.one_per_group(retrieval.search(store, q, 10), "file_path")
    assert once.count() == 5
    with pytest.raises(StoreError):
        retrieval.merge_stores(store, spark.createDataFrame([(1, [1.0], 1, "f")], store.schema))
    retrieval.save_store(store, str(tmp_path / "s"), provenance={"model": "hash"})
    back, notes = retrieval.load_store(spark, str(tmp_path / "s"))
    assert back.count() == 10 and notes == {"model": "hash"}
    with pytest.raises(Exception, match="exists"):
        retrieval.save_store(store, str(tmp_path / "s"))
    with pytest.raises(StoreError):
        retrieval.load_store(spark, str(tmp_path / "none"))
    chunks = spark.createDataFrame([("a", "the quick fox", "x.py"), ("b", "lazy dog", "y.py"), ("c", "quick quick dog", "x.py")], "chunk_id string, page_content string, file_path string")
    built = retrieval.build_store(chunks)
    assert [r.chunk_id for r in retrieval.retrieve(spark, built, "lazy dog", 1).collect()] == ["b"]
    assert retrieval.retrieve(spark, built, "quick", 5, per_file=True, threshold=-1.0).count() == 2
    with pytest.raises(RetrievalError):
        retrieval.retrieve(spark, built, "  ")
    assert retrieval.merge_filters({"a": 1, "language": "x"}, {"a": 2}, "py") == {"a": 2, "language": "py"}


def test_retrieval_answers_every_query_beyond_one_block(spark, monkeypatch):
    store = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)], i % 2) for i in range(30)], "vec_id long, embedding array<float>, label int")
    calls = [
        lambda: retrieval.knn(store, store, 2),
        lambda: retrieval.knn(store, store, 2, skip_self=True),
        lambda: retrieval.search(store, store, 3),
        lambda: retrieval.search(store, store, 3, {"label": 1}, prefilter=True),
        lambda: retrieval.search(store, store, 3, threshold=0.2),
        lambda: retrieval.one_per_group(retrieval.search(store, store, 5), "label"),
    ]
    whole = [sorted(call().collect()) for call in calls]
    assert len(whole[0]) == 60 and len(whole[2]) == 90
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 8)
    assert [sorted(call().collect()) for call in calls] == whole


def test_jobs(spark, tmp_path):
    store = jobs.JobStore()
    store.create("j", at=1)
    with pytest.raises(JobError):
        store.create("j")
    with pytest.raises(JobError):
        store.update("k")
    store.update("j", "RUNNING", 10, at=2)
    assert store.update("j", "RUNNING", 20, at=3)["started_at"] == 2
    assert store.update("j", "COMPLETED", 100, at=9)["completed_at"] == 9 and store.count_by_status() == {"COMPLETED": 1}
    store.delete("j")
    store.delete("j")
    assert store.get("j") is None


def test_lifecycle_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(3):  # three micro-batches, ids dealt out of order
        events.filter(F.col("event_id") % 3 == 2 - k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.lifecycle_stream(jobs.from_events(stream)).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in jobs.lifecycle(jobs.from_events(events)).select("job_id", "status", "created_at", "started_at", "completed_at").collect()}
    seen = {tuple(r) for r in spark.table("states").select("job_id", "status", "created_at", "started_at", "completed_at").collect()}
    assert want <= seen


def test_uuid5(spark):
    import uuid

    names = ["a:1:0", "src/é.py:3:12", ""]
    assert column(spark, names, scoring.uuid5) == [str(uuid.uuid5(uuid.UUID(scoring.NAMESPACE), n)) for n in names]


def test_directory_and_zip(spark, tmp_path):
    from corvane.sources import files

    for path, body in {"src/a.py": b"x = 1\ny = 2\n", "node_modules/b.js": b"1", "src/c.txt": b"1", "src/bin.py": b"\0", "src/bad.py": b"\xff\n", "z.ts": b"let a"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(body)
    got = {r.file_path: (r.language, r.line_count, r.content) for r in files.directory(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": ("python", 3, "x = 1\ny = 2\n"), "src/bad.py": ("python", 2, "\ufffd\n"), "z.ts": ("typescript", 1, "let a")}
    (tmp_path / "none").mkdir()
    with pytest.raises(SourceError):
        files.directory(spark, str(tmp_path / "none"))
    rooted = spark.createDataFrame([("r", "top/a.py"), ("r", "top/b/c.py"), ("q", "a/x.py"), ("q", "b/x.py")], "repo_id string, file_path string")
    assert sorted(r.file_path for r in files.strip_common_root(rooted).collect()) == ["a.py", "a/x.py", "b/c.py", "b/x.py"]


def test_regexes_are_safe_on_long_lines(spark):
    line = "a" * 100_000 + "#" + "'" * 3
    assert column(spark, [line], text.strip_comment) == ["a" * 100_000]
    assert re.search("possess|\\+\\+", text.UNCOMMENTED)


def test_records(spark, tmp_path):
    from corvane.operators import records
    from corvane.plans.review import safe_name, to_html

    assert column(spark, [1, 10, 11, 26, None], records.cc_letter, "int") == ["A", "B", "C", "F", None]
    assert column(spark, ["r = requests.get(u)", "d.get(k)", "client().x.get('/a')", "no call"], records.is_http_get) == [True, False, True, False]
    rows = spark.createDataFrame([(1, 2, 0.5, "a title"), (3, 2, 0.5, "a title"), (1, 2, 1.5, "abc")], "s int, e int, c double, t string")
    good, bad = records.split_valid(rows, records.violations(F.col("s"), F.col("e"), F.col("c"), F.col("t")))
    assert good.count() == 1 and sorted(tuple(r.violations) for r in bad.collect()) == [("confidence", "title"), ("span",)]
    records.write_json(good, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    assert column(spark, ["a b/c" + "x" * 60], safe_name) == [("a_b_c" + "x" * 60)[:40]]
    assert "&lt;x&gt;" in to_html("<x>")
