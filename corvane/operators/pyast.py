"""Python syntax analysers as one table function over files.

`analyse` walks a file's tree once and emits rows tagged by kind: rule, solid, metric, import,
entity, class, function, docstring, error. A file that cannot be parsed gives one error row.
"""

from __future__ import annotations

import ast
import gc
import json
import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.paths import is_production

from .outline import imported_modules
from .pyrules import FIELDS, Function, Hit, Scan, children, dotted, optional, walk

# fixed values: constructors that are no collaborators, and limits of the design rules
BUILTIN_CALLS = ["Exception", "ValueError", "TypeError", "KeyError", "RuntimeError", "NotImplementedError", "AttributeError", "IndexError"]
SOLID_LIMITS = {"methods": 10, "lines": 60, "isinstance": 3, "strings": 4, "abstract": 8}

Branch = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.ExceptHandler)
COLUMNS = "kind string, rule_id string, name string, start_line int, end_line int, confidence double, seq int, detail string"


class Module:
    """A parsed file."""

    def __init__(self, source: str, path: str = "") -> None:
        self.source, self.path = source, path
        self.tree = ast.parse(source)
        self.nodes = walk(self.tree)  # breadth first: the order in which hits count

    def rule_hits(self) -> list[Hit]:
        return Scan(self.tree, self.path).hits()

    # -------------------------------------------------------------- SOLID, metrics, structure
    def solid(self) -> Iterator[tuple[str, ast.AST, dict]]:
        for n in self.nodes:
            if isinstance(n, ast.ClassDef):
                methods = [m for m in n.body if isinstance(m, Function)]
                if len(methods) >= SOLID_LIMITS["methods"]:
                    yield "SRP-001", n, {"count": len(methods)}
                abstract = sum(1 for m in methods for d in m.decorator_list if dotted(d).split(".")[-1] == "abstractmethod")
                if abstract >= SOLID_LIMITS["abstract"]:
                    yield "ISP-001", n, {"count": abstract}
                assigned = (c for m in methods if m.name == "__init__" for s in ast.walk(m) if isinstance(s, ast.Assign) for c in ast.walk(s) if isinstance(c, ast.Call))
                for c in assigned:
                    made = c.func.id if isinstance(c.func, ast.Name) else c.func.attr if isinstance(c.func, ast.Attribute) else ""
                    if made[:1].isupper() and made not in BUILTIN_CALLS:
                        yield "DIP-001", n, {"dependency": made}
            elif isinstance(n, Function):
                if (lines := n.end_lineno - n.lineno + 1) >= SOLID_LIMITS["lines"]:
                    yield "SRP-002", n, {"lines": lines}
                inner = walk(n)
                checks = sum(isinstance(c, ast.Call) and dotted(c.func).split(".")[-1] == "isinstance" for c in inner)
                if checks >= SOLID_LIMITS["isinstance"]:
                    yield "OCP-001", n, {"count": checks}
                strings = sum(isinstance(v, ast.Constant) and isinstance(v.value, str) for c in inner if isinstance(c, ast.If) and isinstance(c.test, ast.Compare) for v in c.test.comparators)
                if strings >= SOLID_LIMITS["strings"]:
                    yield "OCP-002", n, {"count": strings}

    def metrics(self) -> Iterator[tuple[ast.AST, dict]]:
        for n in self.nodes:
            if isinstance(n, Function):
                yield n, {"lines_of_code": n.end_lineno - n.lineno + 1, **measures(n)}

    def imports(self) -> Iterator[tuple[str, dict]]:
        for n in self.nodes:
            if isinstance(n, ast.Import):
                yield from ((a.name, {"alias": a.asname, "symbols": [], "stem": a.name.split(".")[0]}) for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                yield n.module or "", {"alias": None, "symbols": [a.name for a in n.names], "stem": (n.module or "").split(".")[0]}


_DECIDES = {ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert}
_BRANCHES, _JUMPS = set(Branch), {ast.Break, ast.Continue, ast.Return}


def measures(fn: ast.AST) -> dict[str, int]:
    """cyclomatic, cognitive and nesting of a function, in one walk without recursion.

    cyclomatic: 1 + decision points: branches, loops, handlers, conditions, comprehensions with their
    ifs, asserts, match cases. cognitive: blocks count 1 plus their depth; jumps count 1; a chain of n
    conditions counts n - 1. nesting: deepest control block, less one.
    """
    cyclomatic, cognitive, deepest = 1, 0, 0
    work = [(fn, 0)]
    while work:
        n, depth = work.pop()
        kind = type(n)
        if kind in _DECIDES:
            cyclomatic += 1
        if kind in _BRANCHES:
            depth += 1
            cognitive += depth
            deepest = max(deepest, depth)
        elif kind in _JUMPS:
            cognitive += 1
        elif kind is ast.BoolOp:
            cyclomatic += len(n.values) - 1
            cognitive += len(n.values) - 1
        elif kind is ast.comprehension:
            cyclomatic += 1 + len(n.ifs)
        elif kind is ast.match_case and not (isinstance(n.pattern, ast.MatchAs) and n.pattern.pattern is None and n.guard is None):
            cyclomatic += 1
        if FIELDS[kind]:
            work += [(c, depth) for c in children(n)]
    return {"cyclomatic": cyclomatic, "cognitive": cognitive, "nesting": max(0, deepest - 1)}


def docstring_lines(content: str) -> list[int]:
    """0-based numbers of the lines in triple-quoted strings, first and last line included."""
    if '"""' not in content and "'''" not in content:
        return []
    # a token is an escape, a triple quote, or a one-line string; what lies between is skipped
    token = re.compile(r'\\.|"""|\'\'\'|"(?:\\.|[^"\\])*(?:"|$|\\$)|\'(?:\\.|[^\'\\])*(?:\'|$|\\$)')
    closing = {q: re.compile(r"\\.|" + q) for q in ('"""', "'''")}
    found: list[int] = []
    inside = ""
    for number, line in enumerate(content.splitlines()):
        marked, at = bool(inside), 0
        while m := (closing[inside] if inside else token).search(line, at):
            at = m.end()
            if inside:
                inside = "" if m.group() == inside else inside
            elif m.group() in closing:
                inside, marked = m.group(), True
        if marked:
            found.append(number)
    return found


def _function(n: ast.AST) -> dict:
    return {"params": [a.arg for a in n.args.args], "is_async": isinstance(n, ast.AsyncFunctionDef), "decorators": [ast.unparse(d) for d in n.decorator_list], "docstring": (ast.get_docstring(n, clean=False) or "")[:500] or None}


def analyse(source: str, path: str = "", language: str = "python", kinds: frozenset[str] | None = None) -> Iterator[tuple]:
    """Rows of COLUMNS for one file, of `kinds` alone if told so; of other languages than Python, its imports.

    A file whose analysis fails gives its error row whatever the kinds.
    """
    if language != "python":
        for k, stem in enumerate(imported_modules(source, language) if kinds is None or "import" in kinds else ()):
            yield "import", None, stem, 1, 1, None, k, json.dumps({"alias": None, "symbols": [], "stem": stem})
        return
    try:
        module = Module(source, path)
        rows = list(_rows(module, kinds))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        yield "error", None, type(e).__name__, 1, 1, None, 0, str(e)[:200]
        return
    yield from rows


def summary(source: str, path: str = "", language: str = "python") -> Iterator[tuple]:
    """One row: a file's classes, functions, and the stems of its imports in order, each once; a file that cannot be parsed has none."""
    classes = functions = 0
    stems: dict[str, None] = {}
    for kind, _, name, _, _, _, _, detail in analyse(source, path, language, frozenset(["import", "entity"])):
        if kind == "import" and name:
            stems[json.loads(detail)["stem"]] = None
        elif kind == "entity":
            classes, functions = json.loads(detail).values()
    yield "summary", None, None, 1, 1, None, 0, json.dumps({"classes": classes, "functions": functions, "imports": list(stems)})


def design(source: str, path: str = "", language: str = "python") -> Iterator[tuple]:
    """The rows of the design rules alone; a source that cannot be parsed has none."""
    try:
        module = Module(source, path)
        yield from _solid_rows(module)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return


def _solid_rows(m: Module) -> Iterator[tuple]:
    for k, (rule, n, detail) in enumerate(m.solid()):
        yield "solid", rule, n.name, n.lineno, n.end_lineno, 0.75, k, json.dumps(detail)


def _rule_rows(m: Module) -> Iterator[tuple]:
    if not (hits := m.rule_hits()):
        return
    masked = set(docstring_lines(m.source))
    lines = m.source.splitlines()
    seq = 0
    for rule, n, confidence in hits:
        if n.lineno - 1 not in masked:
            yield "rule", rule, lines[n.lineno - 1].strip()[:120], n.lineno, n.end_lineno, confidence, seq, None
            seq += 1


def _metric_rows(m: Module) -> Iterator[tuple]:
    for k, (n, values) in enumerate(m.metrics()):
        yield "metric", None, n.name, n.lineno, n.end_lineno, None, k, json.dumps(values)


def _import_rows(m: Module) -> Iterator[tuple]:
    for k, (name, detail) in enumerate(m.imports()):
        yield "import", None, name, 1, 1, None, k, json.dumps(detail)


def _outline_rows(m: Module) -> Iterator[tuple]:
    for k, n in enumerate(m.tree.body):
        if isinstance(n, ast.ClassDef):
            methods = [{"name": f.name, "start_line": f.lineno, "end_line": f.end_lineno, **_function(f)} for f in n.body if isinstance(f, Function)]
            detail = {"bases": [ast.unparse(b) for b in n.bases], "methods": methods, "docstring": (ast.get_docstring(n, clean=False) or "")[:500] or None}
            yield "class", None, n.name, n.lineno, n.end_lineno, None, k, json.dumps(detail)
        elif isinstance(n, Function):
            yield "function", None, n.name, n.lineno, n.end_lineno, None, k, json.dumps(_function(n))


def _entity_rows(m: Module) -> Iterator[tuple]:
    classes, functions = sum(isinstance(n, ast.ClassDef) for n in m.nodes), sum(isinstance(n, Function) for n in m.nodes)
    yield "entity", None, "counts", 1, 1, None, 0, json.dumps({"classes": classes, "functions": functions})


#: What makes rows of which kinds, in the order of the rows.
PARTS: list[tuple[frozenset[str], Callable[[Module], Iterator[tuple]]]] = [
    (frozenset(["rule"]), _rule_rows), (frozenset(["solid"]), _solid_rows), (frozenset(["metric"]), _metric_rows),
    (frozenset(["import"]), _import_rows), (frozenset(["class", "function"]), _outline_rows), (frozenset(["entity"]), _entity_rows),
]


def _rows(m: Module, kinds: frozenset[str] | None = None) -> Iterator[tuple]:
    for made, part in PARTS:
        if kinds is None or made & kinds:
            yield from (row for row in part(m) if kinds is None or row[0] in kinds)
        elif part is _outline_rows:
            list(part(m))  # as it may fail: the error counts
        elif part is _rule_rows:
            for n in m.nodes:
                if isinstance(n, Function):
                    optional(n)  # likewise


#: Rows that are sent on at a time.
SENT = 8192


def in_batches(batches: Iterator[pa.RecordBatch], produce: Callable[..., Iterator[tuple]], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows that produce gives for the columns after the first, with the first column's value.

    Trees hold no cycles, so the collector of cycles runs once for the rows sent on together, not during the work.
    """
    was = gc.isenabled()
    gc.disable()
    try:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            columns = [batch.column(k).to_pylist() for k in range(1, batch.num_columns)]
            for i, values in enumerate(zip(*columns, strict=True)):
                before = len(rows)
                rows.extend(produce(*values))
                at += [i] * (len(rows) - before)
                if rows and (len(rows) >= SENT or i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)
                    at, rows = [], []
                    gc.collect()
    finally:
        if was:
            gc.enable()


def analyse_files(files: DataFrame, keys: list[str], production_only: bool = True, what: Callable[..., Iterator[tuple]] = analyse, languages: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Rows that `what` gives for the files(keys…, file_path, language, content) in `languages` (Python alone unless told otherwise); of `kinds` alone, and errors, if told so.

    The filters stand before the Python function, as nothing is pushed through it.
    """
    if kinds:
        what = partial(what, kinds=frozenset(kinds))
    if production_only:
        files = files.filter(is_production(F.col("file_path")))
    files = files.filter(F.col("language").isin(languages or ["python"]) & F.col("content").isNotNull()).select(F.struct(*keys, "file_path").alias("k"), "file_path", "language", "content")
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(batches, lambda path, language, content: what(content, path, language), types, ["k", *names])

    schema = f"k {files.schema['k'].dataType.simpleString()}, {COLUMNS}"
    return files.mapInArrow(run, schema).select("k.*", *names)


def docstring_mask(content: Column) -> Column:
    """0-based numbers of the lines in triple-quoted strings; a text without triple quotes needs no Python."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<int>")
    def mask(column: pa.Array) -> pa.Array:
        return pa.array([docstring_lines(x) if x and ('"""' in x or "'''" in x) else [] for x in column.to_pylist()], pa.list_(pa.int32()))

    return mask(content)
