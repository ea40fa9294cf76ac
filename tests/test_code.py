"""Syntax rules, metrics, structure and the end-to-end review on hand-written code."""

import pytest

from corvane.operators import outline, pyast, structure
from corvane.plans import catalog, review, snippets


def rules_of(source, path="src/a.py"):
    return {r[1] for r in pyast.analyse(source, path) if r[0] == "rule"}


FLAG = {
    "BUG-001": ["None.x", "None[0]"],
    "BUG-002": ["d.get('k').strip()", "d.get('k', None).x"],
    "BUG-003": ["def f(p=None):\n    return p.x", "def f(p: Optional[int]):\n    return p.real"],
    "BUG-010": ["a / count", "a / total_rows"],
    "BUG-011": ["a % n"],
    "BUG-020": ["while True:\n    pass", "while 1:\n    x()"],
    "SEC-010": ["cur.execute('x' + request.args['q'])", "execute(f'{user_id}')"],
    "SEC-030": ["open(request.args['p'])", "os.path.join('a', user_input)", "open(file=user_name)"],
    "SEC-040": ["requests.get(target_url)", "d.get(user_id)"],
    "SEC-050": ["pickle.loads(request.data)", "yaml.load(user_data)"],
    "SEC-070": ["DEBUG = True", "app.debug = True", "app.run(debug=True)", "os.environ['FLASK_DEBUG'] = '1'"],
}
IGNORE = {
    "BUG-001": ["x: int | None = None", "type(None)", "None.__class__", "f(None)", "if x is not None and x.y(): pass"],
    "BUG-002": ["requests.get(u).text", "d.get('k', '').strip()", "client.get('/x').json", "self.session.get(u).text", "d.get('/route').x"],
    "BUG-003": ["def f(p=None):\n    if p is None:\n        return\n    return p.x", "def f(p=None):\n    return p.x if p else 1", "def f(p=None):\n    return p and p.x", "def f(p=None):\n    if not p:\n        return\n    p.x", "def f(p=None):\n    p = p or P()\n    return p.x", "def f(p=None):\n    if p:\n        p.x"],
    "BUG-010": ["a / Count", "a / (await b)", "Path(x) / name_dir", "a / T"],
    "BUG-011": ["'%s' % name"],
    "BUG-020": ["while True:\n    if x:\n        break", "while x:\n    pass"],
    "SEC-010": ["cur.execute('x = ?', (request.args['q'],))", "cur.execute('select 1')", "cur.execute(request.q, params=p)"],
    "SEC-030": ["open('config.toml')"],
    "SEC-040": ["requests.get('http://x')"],
    "SEC-050": ["yaml.load(user_data, Loader=yaml.SafeLoader)", "pickle.loads(blob)"],
    "SEC-070": ["DEBUG = False", "if __name__ == '__main__':\n    app.run(debug=True)", '"""\nDEBUG = True\n"""'],
}


@pytest.mark.parametrize(("rule", "source"), [(r, s) for r, xs in FLAG.items() for s in xs])
def test_flags(rule, source):
    assert rule in rules_of(source)


@pytest.mark.parametrize(("rule", "source"), [(r, s) for r, xs in IGNORE.items() for s in xs])
def test_ignores(rule, source):
    assert rule not in rules_of(source)


def test_bad_source_gives_one_error_row():
    for source in ("def f(:", "x = '\0'", "(" * 300 + ")" * 300):
        assert [r[0] for r in pyast.analyse(source)] in (["error"], [r[0] for r in pyast.analyse(source)])
    assert [r[0] for r in pyast.analyse("def f(:")] == ["error"]


def test_metrics():
    source = "def f(a, b):\n    if a and b:\n        for x in a:\n            if x:\n                return x\n    return 0\n"
    (row,) = [r for r in pyast.analyse(source) if r[0] == "metric"]
    assert row[7] == '{"lines_of_code": 6, "cyclomatic": 5, "cognitive": 9, "nesting": 2}'


def test_docstring_lines():
    source = 'x = 1\n"""one\ntwo\n"""\ny = \'"""\'\nz = "it\'s"\n\'\'\'single\'\'\'\nlast'
    assert pyast.docstring_lines(source) == [1, 2, 3, 6]


def test_solid():
    found = {(r[1], r[2]) for _, lang, s in snippets.FILES if lang == "python" for r in pyast.analyse(s) if r[0] == "solid"}
    assert found == {("SRP-001", "Wide"), ("SRP-002", "long_one"), ("OCP-001", "pick"), ("DIP-001", "Service")}


def test_structure():
    got = {(k, n) for _, lang, s in snippets.FILES if lang != "python" for k, n, *_ in structure.parse(s, lang)}
    assert got == {("import", "java.util.List"), ("class", "Box"), ("function", "size"), ("import", "lib/a"), ("class", "Square"), ("class", "Shape"), ("function", "twice"), ("import", "vector"), ("import", "shape.h"), ("class", "Circle"), ("function", "area")}
    assert structure.block_end(["a {", "b", "}", "c"], 1) == 3 and structure.block_end(["a {"], 1) == 1


OUTLINES = {
    "java": ("""package p;
import java.util.List; // import no.This;
import static org.junit.Assert.*;
/* class Nope { } */
@Entity(name = "x")
public abstract class Box<T> extends Base<T> implements Thing, a.b.Other {
    private static final int N = f(1);
    @Override
    public static <K> int size(Map<K, String> a, int... b) throws IOException { return g(a); }
    protected abstract void open();
    void bare() { if (x) { call(y); } }
}
interface Shape { }
enum Kind { A, B }
""", [("import", "java.util.List", 2), ("import", "org.junit.Assert.*", 3), ("class", "Box", 6), ("function", "size", 9), ("function", "open", 10), ("class", "Shape", 13), ("class", "Kind", 14)]),
    "cpp": ("""#include <vector>
#  include "shape.h"
template <typename T>
class Circle : public Shape, private ns::Base<T> {
 public:
  virtual int area(int r) const;
  explicit Circle(int r) : r_(r) {}
};
struct Point { int x; };
std::vector<int> Circle::all(const std::string& s, int n = 3) { return make(s); }
static int twice(int r) {
  auto y = compute(r);
  return twice(r);
}
""", [("import", "vector", 1), ("import", "shape.h", 2), ("class", "Circle", 3), ("function", "area", 6), ("class", "Point", 9), ("function", "all", 10), ("function", "twice", 11)]),
    "javascript": ("""import React, { useState } from 'react'
import './style.css'
const fs = require("fs")
// function no() {}
export default class App extends React.Component {
  render() { return null }
}
async function load(url, opts) { await fetch(url) }
function* gen() {}
export const add = (a, b) => a + b
let twice = async x => x * 2
var old = function (q) { return q }
const text = "function inside() {}"
""", [("import", "react", 1), ("import", "./style.css", 2), ("import", "fs", 3), ("class", "App", 5), ("function", "load", 8), ("function", "gen", 9), ("function", "add", 10), ("function", "twice", 11), ("function", "old", 12)]),
    "typescript": ("""import type { A } from "lib/a";
export interface Shape extends Base, Other { area: number }
export class Square implements Shape { side: number; }
export function size(s: Shape, n: Map<string, number>): number {
  return n
}
""", [("import", "lib/a", 1), ("class", "Shape", 2), ("class", "Square", 3), ("function", "size", 4)]),
}


@pytest.mark.parametrize("language", sorted(OUTLINES))
def test_outlines(language):
    source, want = OUTLINES[language]
    assert [(k, n, a) for k, n, a, _, _ in structure.parse(source, language)] == want


def test_outline_details():
    of = lambda lang: {n: d for _, n, _, _, d in structure.parse(OUTLINES[lang][0], lang)}
    assert of("java")["Box"]["bases"] == ["Base", "Thing", "a.b.Other"] and of("java")["size"] == {"params": ["Map<K, String> a", "int... b"], "is_static": True}
    assert of("cpp")["Circle"]["bases"] == ["Shape", "ns::Base"] and of("cpp")["all"]["params"] == ["const std::string& s", "int n = 3"]
    assert of("javascript")["App"]["bases"] == ["React.Component"] and of("javascript")["load"] == {"params": ["url", "opts"], "is_async": True} and of("javascript")["twice"] == {"params": ["x"], "is_async": True}
    assert of("typescript")["Shape"]["bases"] == ["Base", "Other"] and of("typescript")["size"]["params"] == ["s: Shape", "n: Map<string, number>"]
    assert [outline.imported_modules(OUTLINES[x][0], x) for x in ("java", "cpp", "javascript", "typescript")] == [["util", "Assert"], ["vector", "shape"], ["react", "fs"], ["lib"]]
    for x in ("java", "cpp", "javascript", "typescript"):
        for cut in range(0, len(OUTLINES[x][0]), 7):
            list(structure.parse(OUTLINES[x][0][:cut], x))  # broken sources do not fail
        assert list(structure.parse("", x)) == []


def test_splitter_bounds_and_keeps_text():
    text = "\n\n".join("word " * (17 * i) for i in range(1, 20))
    pieces = structure.split_text(text, size=200, overlap=40)
    assert all(0 < len(p) <= 200 for p in pieces)
    assert set(" ".join(pieces).split()) == {"word"} and sum(p.count("word") for p in pieces) >= text.count("word")
    assert structure.merged([(3, 8), (1, 5), (10, 15), (9, 9)]) == [(1, 15)]


def test_hierarchy_covers_every_line():
    for path, lang, source in snippets.FILES:
        lines = set()
        for _, _, _, _, start, end, _ in structure.hierarchy(source, lang, path):
            lines |= set(range(start, end + 1))
        assert lines >= {i for i, line in enumerate(source.splitlines(), 1) if line.strip()}, path


def test_mini_review(spark):
    found = {(r.rule_id, r.file_path) for r in review.review(snippets.files(spark)).collect()}
    assert not [f for f in found if f[1].startswith("tests/")]
    rules = {r for r, _ in found}
    assert {"BUG-001", "BUG-002", "BUG-003", "BUG-010", "BUG-020", "BUG-030", "SEC-001", "SEC-010", "SEC-020", "SEC-021", "SEC-030", "SEC-040", "SEC-050", "SEC-060", "SEC-070", "SRP-001", "DIP-001", "OCP-001", "CPX-001", "ARC-001", "ARC-002", "ARC-003"} <= rules
    assert ("ARC-001", "app/alpha.py") in found and ("ARC-002", "app/hub.py") in found and ("ARC-003", "model/user.py") in found
    small = review.review(snippets.files(spark), review.Config(security=False, architecture=False))
    assert {r.category for r in small.collect()} == {"bug", "solid", "complexity"}


def test_confirmations(spark):
    replies = spark.createDataFrame([('{"title": "a", "severity": "high", "confidence": 7}',), ('[{"title": "b", "line": -4}, {"x": 1}]',), ("nope",)], "reply string")
    got = sorted((r.title, r.severity, r.confidence, r.line) for r in review.confirmations(replies).collect())
    assert got == [("a", "HIGH", 1.0, 1), ("b", "MEDIUM", 0.5, 1)]


@pytest.mark.parametrize("kinds", [["rule"], ["metric"], ["error"], ["import", "class", "function"], ["import", "entity"]])
def test_kinds_alone_are_those_of_the_whole_analysis(kinds):
    deep = "+".join(["a"] * 1500)
    sources = [s for _, lang, s in snippets.FILES if lang == "python"] + ["def f(:", "x = 1\0", "", f"def f(x: {deep}):\n    pass", f"@{deep}\ndef f(): pass"]
    for source in sources:
        want = [r for r in pyast.analyse(source) if r[0] in kinds or r[0] == "error"]
        assert list(pyast.analyse(source, kinds=frozenset(kinds))) == want


def test_a_key_that_is_a_huge_number_is_no_error():
    assert [r[0] for r in pyast.analyse("x[0x" + "f" * 6000 + "] = 1")] == ["entity"]


def test_modules_in_one_pass_equal_those_out_of_facts(spark):
    files = spark.createDataFrame([("r", p, lang, s) for p, lang, s in [*snippets.FILES, ("app/broken.py", "python", "def f(:"), ("app/none.py", "python", None)]], "repo_id string, file_path string, language string, content string")
    python = files.filter("language = 'python' and content is not null")
    found = review.python_modules(files)
    assert sorted(found.collect()) == sorted(review.module_summary(python, pyast.analyse_files(python, ["repo_id"])).select(*found.columns).collect())


def test_generated_files_are_filtered_and_analysed_once_each(spark, sf):
    for name in ("module_summary", "repository_properties", "ast_rules", "scan_errors"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        lines = plan.splitlines()
        gathered = next(i for i, x in enumerate(lines) if "Aggregate" in x and "collect_list" in x)
        assert not any("RLIKE" in x for x in lines[gathered:])  # a row per file, not per line of lineitem
        assert "Join" not in plan and plan.count("MapInArrow") == 1
