"""Rules over Python syntax trees: one walk that carries what is known at each place.

The walk goes breadth first without recursion. A place knows whether it is part of an annotation,
whether it runs only as a script, and which names cannot be None there; branches and conditions add
to that. What mentions untrusted input is marked from the leaves upwards when first asked for. A table tells
which checks a kind of node gets; each hit is ranked by rule, then by its place in the walk.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache

# fixed values: names that the heuristics know
TAINTED = ["request", "req", "user_input", "user_data", "form", "args", "files"]
SUPPLIED = ["url", "uri", "path", "host"]
WERKZEUG = ["args", "form", "files", "values", "data", "json"]
HTTP_ROOTS = ["requests", "httpx", "aiohttp", "urllib", "urllib3", "http", "https", "session", "client", "adapter", "pool", "conn", "connection", "response", "resp"]
HTTP_METHODS = ["get", "post", "put", "patch", "delete", "head", "options", "request"]
PATH_NAMES = [
    "path", "filepath", "file_path", "dir", "directory", "root", "base", "cwd", "fname", "filename", "folder", "p", "src", "dst", "dest",
    "target", "source", "prefix", "suffix", "parent", "child", "base_dir", "base_path", "work_dir", "repo_path", "data_dir",
]
NUMBER_NAMES = [
    "count", "total", "n", "num", "number", "size", "length", "len", "sum", "avg", "denominator", "divisor", "factor", "ratio", "rate", "pct", "percent",
    "width", "height", "cols", "rows", "value", "val", "x", "y", "z", "i", "j", "k",
]
NEVER_DIVISORS = ["await", "async", "lambda", "True", "False", "None", "self", "cls", "type", "object", "Any", "Union", "Optional"]
# fixed values: keywords of calls that bind SQL parameters, name a path, an address or serialised data
BINDING, PATH_KEYS, URL_KEYS, DATA_KEYS = ["params", "parameters", "vars", "args"], ["file", "path", "filename", "filepath", "name", "dest", "src"], ["url", "uri", "endpoint", "href"], ["data", "buf", "buffer", "s", "bytes"]
# fixed values: confidence of a hit
CONFIDENCE = {"BUG-002": 0.86, "BUG-003": 0.78, "BUG-010": 0.85, "BUG-011": 0.85, "BUG-020": 0.82, "SEC-010": 0.84, "SEC-030": 0.80, "SEC-040": 0.82, "SEC-050": 0.82}
ON_ATTRIBUTE, ON_SUBSCRIPT = 0.92, 0.90  # BUG-001
DEBUG_NAME, DEBUG_ATTRIBUTE, DEBUG_RUN, DEBUG_ENVIRONMENT = 0.88, 0.85, 0.83, 0.86  # SEC-070
#: Rules in the order in which their hits count.
ORDER = ["BUG-001", "BUG-002", "BUG-003", "BUG-010", "BUG-020", "SEC-010", "SEC-030", "SEC-040", "SEC-050", "SEC-070"]
PROLOGUE = 8  # statements of a function in which a parameter may be settled

Function = (ast.FunctionDef, ast.AsyncFunctionDef)
Hit = tuple[str, ast.AST, float]
_HTTP = re.compile(rf"(?:{'|'.join(HTTP_ROOTS)})(?:[.].*)?|.*test_client.*|.*[.](?:client|app)|.*session|.*[.]session.*|app|bp|blueprint")
_NO_NUMBER = re.compile(rf"(?i:{'|'.join(PATH_NAMES)}|.*path.*|.*dir.*)|{'|'.join(NEVER_DIVISORS)}|[A-Z][a-zA-Z0-9]*|[^a-z]")
_NUMBER = re.compile(rf"(?i:{'|'.join(NUMBER_NAMES)})")


# fields that hold no node: names and numbers; contexts and operators, which say nothing that their parents do not
_BARE = {"ctx", "op", "ops", "id", "attr", "arg", "name", "module", "level", "kind", "type_comment", "conversion", "is_async", "simple", "rest", "kwd_attrs", "lineno", "tag", "str"}
#: Fields of each kind of node that can hold nodes.
FIELDS = {kind: tuple(f for f in kind._fields if f not in _BARE) for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST)}
FIELDS |= dict.fromkeys([ast.Constant, ast.Name, ast.alias, ast.Global, ast.Nonlocal, ast.MatchSingleton, ast.TypeIgnore], ())
_GAPS = {"keys", "kw_defaults"}  # lists in which a place may be empty


def children(node: ast.AST) -> list[ast.AST]:
    """The nodes below a node in the order of the fields, without contexts and operators."""
    found: list[ast.AST] = []
    for name in FIELDS[type(node)]:
        value = getattr(node, name)
        if type(value) is list:
            found += [x for x in value if x is not None] if name in _GAPS else value
        elif value is not None:
            found.append(value)
    return found


def walk(node: ast.AST) -> list[ast.AST]:
    """A node and all nodes below it, breadth first, as children() gives them."""
    found = [node]
    for x in found:
        if FIELDS[type(x)]:
            found += children(x)
    return found


def dotted(node: ast.AST) -> str:
    """a.b.c of names and attributes; parts that are neither are left out."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def is_none(node: ast.AST | None) -> bool:
    return isinstance(node, ast.Constant) and node.value is None


def is_true(node: ast.AST) -> bool:
    return isinstance(node, ast.Constant) and node.value is True


# ---------------------------------------------------------------- conditions
def compared(test: ast.AST, op: type) -> frozenset[str]:
    """Names that a comparison sets against None by the operator, on either side."""
    if not isinstance(test, ast.Compare):
        return frozenset()
    sides = [(test.left, right) for kind, right in zip(test.ops, test.comparators, strict=True) if isinstance(kind, op)]
    return frozenset(name.id for pair in sides for name, none in (pair, pair[::-1]) if isinstance(name, ast.Name) and is_none(none))


def denied(test: ast.AST) -> frozenset[str]:
    """The name in `not name`."""
    inner = test.operand if isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not) else None
    return frozenset([inner.id]) if isinstance(inner, ast.Name) else frozenset()


def asked(test: ast.AST) -> frozenset[str]:
    """Names that a condition asks for; of a conjunction its first part counts."""
    while isinstance(test, ast.BoolOp) and isinstance(test.op, ast.And):
        test = test.values[0]
    named = frozenset([test.id]) if isinstance(test, ast.Name) else frozenset()
    return named | denied(test) | compared(test, ast.IsNot)


def script_only(test: ast.AST) -> bool:
    """Whether a condition is `__name__ == "__main__"`, in either order."""
    if not isinstance(test, ast.Compare) or [type(o) for o in test.ops] != [ast.Eq]:
        return False
    sides = test.left, test.comparators[0]
    return any(isinstance(a, ast.Name) and a.id == "__name__" and isinstance(b, ast.Constant) and b.value == "__main__" for a, b in (sides, sides[::-1]))


def leaves(body: list[ast.stmt]) -> bool:
    return any(isinstance(n, (ast.Break, ast.Return, ast.Raise)) for s in body for n in walk(s))


def settled(fn: ast.AST) -> frozenset[str]:
    """Names that a function's first statements turn away when None, or replace."""
    found: frozenset[str] = frozenset()
    for s in fn.body[:PROLOGUE]:
        if isinstance(s, ast.If) and leaves(s.body):
            found |= compared(s.test, ast.Is) | denied(s.test)
        elif isinstance(s, ast.Assign) and isinstance(s.value, ast.BoolOp) and isinstance(s.value.op, ast.Or):
            first = s.value.values[0]
            found |= {t.id for t in s.targets if isinstance(t, ast.Name) and isinstance(first, ast.Name) and first.id == t.id}
    return found


def optional(fn: ast.AST) -> list[str]:
    """Parameters that may be None by their annotation or default, in order."""
    a = fn.args
    places = [*a.posonlyargs, *a.args]
    given = [*[None] * (len(places) - len(a.defaults)), *a.defaults, *a.kw_defaults]
    speaks = lambda x: x.annotation is not None and re.search("optional|none", ast.unparse(x.annotation).lower())
    return [x.arg for x, default in zip([*places, *a.kwonlyargs], given, strict=True) if is_none(default) or speaks(x)]


# ---------------------------------------------------------------- the walk
@dataclass(frozen=True)
class Place:
    annotation: bool = False
    script: bool = False
    sure: frozenset[str] = frozenset()  # names that cannot be None here
    watched: frozenset[tuple[int, int, str]] = frozenset()  # (function, parameter's place, name) of optional parameters around


def _inner(node: ast.AST, place: Place) -> Iterator[tuple[ast.AST, Place]]:
    """The children of a node with their places, in the order of the fields."""
    sure: dict[int, frozenset[str]] = {}
    if isinstance(node, (ast.If, ast.IfExp)):
        body = node.body if isinstance(node, ast.If) else [node.body]
        sure |= dict.fromkeys(map(id, body), asked(node.test))
        if isinstance(node, ast.If):
            sure |= dict.fromkeys(map(id, node.orelse), denied(node.test))
            if not place.script and script_only(node.test):
                place = replace(place, script=True)
    elif isinstance(node, ast.BoolOp) and isinstance(node.op, ast.And):
        sure |= dict.fromkeys(map(id, node.values[1:]), asked(node.values[0]))
    typed = {id(getattr(node, name, None)) for name in ("annotation", "returns")}
    if isinstance(node, getattr(ast, "TypeAlias", ())):
        typed.add(id(node.value))
    for child in children(node):
        now = place
        if names := sure.get(id(child)):
            now = replace(now, sure=now.sure | names)
        yield child, replace(now, annotation=True) if id(child) in typed else now


#: Nodes whose children have places of their own.
_APART = {ast.If, ast.IfExp, ast.BoolOp, ast.arg, ast.AnnAssign, ast.FunctionDef, ast.AsyncFunctionDef, getattr(ast, "TypeAlias", ast.If)}


@lru_cache(maxsize=1 << 16)
def _suspicious(name: str) -> bool:
    low = name.lower()
    return low in TAINTED or low.startswith("user_") or low.endswith(("_url", "_uri")) or ("supplied" in low and any(x in low for x in SUPPLIED))


_SOURCES = {ast.Name, ast.Call, ast.Attribute, ast.Subscript}


def _source(n: ast.AST) -> bool:
    """Whether a node itself names request data or user input, or suggests them."""
    if isinstance(n, ast.Name):
        return _suspicious(n.id)
    if isinstance(n, ast.Call):
        return dotted(n.func) in ("input", "raw_input")
    if isinstance(n, ast.Attribute):
        low = dotted(n).lower()
        return low.startswith(("request.", "flask.request.")) or (low.startswith("werkzeug.") and any(x in low for x in WERKZEUG))
    if isinstance(n, ast.Subscript):
        low = dotted(n.value).lower()
        return low in ("sys.argv", "os.environ") or low.startswith("request.")
    return False


class Scan:
    """All hits of a module: (rule, node, confidence) in the order in which they count."""

    def __init__(self, tree: ast.AST, path: str = "") -> None:
        self.debug_allowed = re.split(r"[/\\]", path)[-1] in ("__main__.py", "conftest.py")
        self.ranked: list[tuple[tuple[int, int, int], Hit]] = []
        self.nodes = nodes = [tree]
        places = [Place()]
        for here, node in enumerate(nodes):
            place, kind = places[here], type(node)
            if kind in Function and (names := optional(node)):
                done = settled(node)
                place = replace(place, watched=place.watched | {(here, k, name) for k, name in enumerate(names) if name not in done})
            if kind in _APART and (kind is not ast.arg or node.annotation):
                for child, now in _inner(node, place):
                    nodes.append(child)
                    places.append(now)
            elif FIELDS[kind]:
                below = children(node)
                nodes += below
                places += [place] * len(below)
        used: set[tuple[int, int, str]] = set()
        for here, node in enumerate(nodes):
            if type(node) not in CHECKS:
                continue
            place = places[here]
            for check in CHECKS[type(node)]:
                for rule, confidence in check(self, node, place) or ():
                    self.ranked.append(((ORDER.index(rule if rule in ORDER else "BUG-010"), here, 0), (rule, node, confidence)))
            # the first unguarded use of each optional parameter
            if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id not in place.sure:
                for watch in place.watched - used:
                    if watch[2] == node.value.id:
                        used.add(watch)
                        self.ranked.append(((ORDER.index("BUG-003"), watch[0], watch[1]), ("BUG-003", node, CONFIDENCE["BUG-003"])))

    @cached_property
    def tainted(self) -> set[int]:
        """Nodes that mention untrusted input, marked from the leaves upwards."""
        above = [-1, *(here for here, node in enumerate(self.nodes) for _ in children(node))]  # the nodes are in this order
        found: set[int] = set()
        for here in range(len(self.nodes) - 1, -1, -1):
            node = self.nodes[here]
            if id(node) in found or (type(node) in _SOURCES and _source(node)):
                found.add(id(node))
                if above[here] >= 0:
                    found.add(id(self.nodes[above[here]]))
        return found

    def hits(self) -> list[Hit]:
        return [hit for _, hit in sorted(self.ranked, key=lambda x: x[0])]

    # ------------------------------------------------------------ checks: (rule, confidence) of a node
    def none_access(self, n: ast.AST, place: Place):
        if is_none(n.value) and not place.annotation and getattr(n, "attr", "") != "__class__":
            yield "BUG-001", ON_ATTRIBUTE if isinstance(n, ast.Attribute) else ON_SUBSCRIPT

    def lookup_chain(self, n: ast.Attribute, place: Place):
        call = n.value
        if not (isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and call.func.attr == "get"):
            return
        defaults = [*call.args[1:2], *(k.value for k in call.keywords if k.arg == "default")]
        key = call.args[0] if call.args else None
        route = isinstance(key, ast.Constant) and isinstance(key.value, str) and key.value.startswith("/")
        if all(map(is_none, defaults)) and not route and not _HTTP.fullmatch(dotted(call.func.value).lower()):
            yield "BUG-002", CONFIDENCE["BUG-002"]

    def division(self, n: ast.BinOp, place: Place):
        rule = {ast.Div: "BUG-010", ast.Mod: "BUG-011"}.get(type(n.op))
        formats = isinstance(n.left, ast.Constant) and isinstance(n.left.value, str) and rule == "BUG-011"
        if rule and isinstance(n.right, ast.Name) and not place.annotation and not formats and suggests_number(n.right.id):
            yield rule, CONFIDENCE[rule]

    def endless_loop(self, n: ast.While, place: Place):
        if isinstance(n.test, ast.Constant) and n.test.value in (True, 1) and not leaves(n.body):
            yield "BUG-020", CONFIDENCE["BUG-020"]

    def call(self, n: ast.Call, place: Place):
        """The rules on calls, each by the function's name and the arguments that must not come from input."""
        name = dotted(n.func)
        last = name.split(".")[-1]
        keys = lambda wanted: [k.value for k in n.keywords if k.arg in wanted]
        first = n.args[:1]
        suspects: dict[str, list[ast.AST]] = {}
        if last == "execute" and not keys(BINDING) and not any(isinstance(x, (ast.Tuple, ast.List, ast.Dict)) for x in n.args[1:2]):
            suspects["SEC-010"] = first
        if name in ("open", "io.open", "Path", "pathlib.Path") or name.endswith("path.join"):
            suspects["SEC-030"] = n.args + keys(PATH_KEYS)
        # any dotted call counts; a bare name needs to speak of a request
        if last in HTTP_METHODS and ("." in name or "request" in name.lower()):
            suspects["SEC-040"] = (keys(URL_KEYS) or first)[:1]
        safe = name == "yaml.load" and any(isinstance(x, ast.Attribute) and x.attr == "SafeLoader" for x in keys(["Loader"]))
        if name in ("pickle.load", "pickle.loads", "yaml.load") and not safe:
            suspects["SEC-050"] = first or keys(DATA_KEYS)[:1]
        yield from ((rule, CONFIDENCE[rule]) for rule, nodes in suspects.items() if any(id(x) in self.tainted for x in nodes))
        if last == "run" and not (self.debug_allowed or place.script):
            yield from (("SEC-070", DEBUG_RUN) for value in keys(["debug"]) if is_true(value))

    def debug_switch(self, n: ast.Assign, place: Place):
        for t in [] if self.debug_allowed or place.script else n.targets:
            if isinstance(t, ast.Subscript) and isinstance(t.slice, ast.Constant) and isinstance(t.slice.value, str) and t.slice.value.upper() == "FLASK_DEBUG":
                yield "SEC-070", DEBUG_ENVIRONMENT
            elif is_true(n.value) and dotted(t).split(".")[-1] in ("debug", "DEBUG"):
                if isinstance(t, ast.Name) and t.id == "DEBUG":
                    yield "SEC-070", DEBUG_NAME
                elif isinstance(t, ast.Attribute) and t.attr == "debug":
                    yield "SEC-070", DEBUG_ATTRIBUTE


CHECKS: dict[type, list[Callable]] = {
    ast.Attribute: [Scan.none_access, Scan.lookup_chain],
    ast.Subscript: [Scan.none_access],
    ast.BinOp: [Scan.division],
    ast.While: [Scan.endless_loop],
    ast.Call: [Scan.call],
    ast.Assign: [Scan.debug_switch],
}


def suggests_number(name: str) -> bool:
    """Whether a divisor's name suggests a number that may be zero."""
    if _NO_NUMBER.fullmatch(name):
        return False
    return bool(_NUMBER.fullmatch(name)) or (len(name) > 1 and name.islower() and "file" not in name)
