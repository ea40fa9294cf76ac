"""Outlines of brace languages from their tokens: imports, classes and functions.

A source is cut into tokens (comments dropped, strings whole, C directives as one token) and these
into heads: what stands between two of `;`, `{` and `}` outside brackets, or, in scripts, what
starts a line. A head's words tell what it declares.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

# fixed values: words before a declaration, of inheritance, and words that no function is named by or declared with
JAVA_MODIFIERS = ["public", "private", "protected", "abstract", "final", "static", "synchronized", "native", "default", "override"]
CPP_MODIFIERS = ["virtual", "static", "inline", "explicit", "constexpr"]
SCRIPT_MODIFIERS = ["export", "default", "async", "abstract", "declare"]
INHERITANCE = ["extends", "implements", "public", "private", "protected", "virtual"]
KEYWORDS = ["if", "else", "for", "while", "do", "switch", "case", "return", "catch", "new", "delete", "sizeof", "throw"]
OPEN, CLOSE = "([", ")]"

_PARTS = r"""(?P<skip>//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/)?)|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|%s(?P<word>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<mark>=>|::|->|[^\s])"""
SCRIPT, C_LIKE = re.compile(_PARTS % "", re.DOTALL), re.compile(_PARTS % r"(?P<directive>(?m:^)[ \t]*\#[^\n]*)|", re.DOTALL)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int
    first: bool  # on its line


def tokens(source: str, pattern: re.Pattern) -> list[Token]:
    out: list[Token] = []
    line, at, last = 1, 0, 0
    for m in pattern.finditer(source):
        if m.lastgroup == "skip":
            continue
        line += source.count("\n", at, m.start())
        at = m.start()
        out.append(Token(m.lastgroup, m.group().strip(), m.start(), m.end(), line, line != last))
        last = line + m.group().count("\n")
    return out


def heads(found: list[Token]) -> Iterator[tuple[list[Token], str]]:
    """(tokens, what ends them) between the marks ; { } outside brackets; directives are heads of their own."""
    head: list[Token] = []
    depth = 0
    for t in found:
        if t.kind == "directive":
            yield [t], ""
        elif t.text == "}" or (t.text in (";", "{") and not depth):
            if head:
                yield head, t.text
            head, depth = [], 0
        else:
            depth += (t.text in OPEN) - (t.text in CLOSE)
            head.append(t)
    if head:
        yield head, ""


def closing(head: list[Token], k: int, pairs: tuple[str, str] = (OPEN, CLOSE)) -> int:
    """Index of the mark that closes the bracket at k, or the last index."""
    depth = 0
    for i in range(k, len(head)):
        depth += (head[i].text in pairs[0]) - (head[i].text in pairs[1])
        if not depth:
            return i
    return len(head) - 1


def named(head: list[Token]) -> list[str]:
    """Dotted or qualified names in a head; type arguments and inheritance words are left out."""
    out: list[str] = []
    k, joins = 0, False
    while k < len(head):
        t = head[k]
        if t.text == "<":
            k = closing(head, k, ("<", ">"))
        elif t.text in (".", "::"):
            joins = bool(out)
            if joins:
                out[-1] += t.text
        elif t.kind == "word":
            if joins:
                out[-1] += t.text
            elif t.text not in INHERITANCE:
                out.append(t.text)
            joins = False
        k += 1
    return out


def parameters(source: str, head: list[Token], k: int) -> list[str]:
    """Texts between the commas of the bracket at k."""
    end = closing(head, k)
    cuts, depth = [head[k].end], 0
    for t in head[k + 1 : end]:
        depth += (t.text in "([{<") - (t.text in ")]}>")
        if t.text == "," and not depth:
            cuts += [t.start, t.end]
    cuts.append(head[end].start if head[end].text in CLOSE else head[end].end)
    return [p for a, b in zip(cuts[::2], cuts[1::2], strict=True) if (p := " ".join(source[a:b].split()))]


def _declared(head: list[Token], modifiers: list[str]) -> tuple[list[Token], list[str]]:
    """(head after annotations, template parts and modifiers, the modifiers)."""
    k, found = 0, []
    while k < len(head):
        if head[k].text == "@" and k + 1 < len(head):
            k += 2
            while k < len(head) and head[k].text == ".":
                k += 2
            if k < len(head) and head[k].text == "(":
                k = closing(head, k) + 1
        elif head[k].text == "template" and k + 1 < len(head) and head[k + 1].text == "<":
            k = closing(head, k + 1, ("<", ">")) + 1
        elif head[k].text in modifiers:
            found.append(head[k].text)
            k += 1
        elif found and head[k].text == ":" and head[k - 1].text in ("public", "private", "protected"):
            k += 1
        else:
            break
    return head[k:], found


Item = tuple[str, str, int, dict]


def java(source: str) -> Iterator[Item]:
    for whole, end in heads(tokens(source, SCRIPT)):
        head, modifiers = _declared(whole, JAVA_MODIFIERS)
        if not head:
            continue
        texts = [t.text for t in head]
        line = next(t.line for t in whole if t.text in (*modifiers, texts[0]))
        if texts[0] == "import":
            yield "import", "".join(x for x in texts[1:] if x != "static"), line, {}
        elif texts[0] in ("class", "interface", "enum") and len(head) > 1:
            yield "class", texts[1], line, {"bases": named(head[2:])}
        elif modifiers and end in ("{", ";") and "(" in texts and "=" not in texts[: texts.index("(")]:
            k = texts.index("(")
            if k and head[k - 1].kind == "word" and texts[k - 1] not in KEYWORDS:
                yield "function", texts[k - 1], line, {"params": parameters(source, head, k), "is_static": "static" in modifiers}


def cpp(source: str) -> Iterator[Item]:
    for whole, end in heads(tokens(source, C_LIKE)):
        if whole[0].kind == "directive":
            if m := re.fullmatch(r"""#\s*include\s*[<"]([^<>"]+)[>"].*""", whole[0].text):
                yield "import", m[1], whole[0].line, {}
            continue
        head, modifiers = _declared(whole, CPP_MODIFIERS + ["public", "private", "protected"])
        texts = [t.text for t in head]
        if texts[:1] in (["class"], ["struct"]):
            if end == "{" and len(head) > 1 and head[1].kind == "word" and texts[2:3] in ([], [":"], ["final"]):
                yield "class", texts[1], whole[0].line, {"bases": named(head[3:])}
            continue
        if "(" not in texts or end not in ("{", ";") or texts[0] in KEYWORDS:
            continue
        k = texts.index("(")
        before = texts[: k - 1]
        while len(before) > 1 and before[-1] == "::":  # the class of a member
            before = before[:-2]
        plain = not any(x in ("=", ".", "->") for x in before)
        if k and head[k - 1].kind == "word" and texts[k - 1] not in KEYWORDS and before and plain:
            yield "function", texts[k - 1], head[0].line, {"params": parameters(source, head, k), "is_static": "static" in modifiers}


def script(source: str, typed: bool = False) -> Iterator[Item]:
    """JavaScript, and TypeScript with its interfaces."""
    found = tokens(source, SCRIPT)
    for k, t in enumerate(found):
        if not (t.first or k == 0 or found[k - 1].text in (";", "{", "}")):
            continue
        end = next((i for i in range(k + 1, len(found)) if found[i].text == ";" or (found[i].first and found[i].text not in "{}),")), len(found))
        head, modifiers = _declared(found[k:end], SCRIPT_MODIFIERS)
        # a bracket may go on over lines
        if head and any(x.text == "(" for x in head):
            opened = next(i for i, x in enumerate(found[k:]) if x.text == "(") + k
            head, modifiers = _declared(found[k : max(end, closing(found, opened) + 2)], SCRIPT_MODIFIERS)
        texts = [x.text for x in head]
        flags = {"is_async": "async" in modifiers}
        if texts[:1] == ["import"]:
            strings = [x.text[1:-1] for x in head if x.kind == "string"]
            if strings and (texts[1:2] == [head[1].text] and head[1].kind == "string" or "from" in texts):
                yield "import", strings[0], t.line, {}
        elif texts[:1] == ["class"] and len(head) > 1:
            yield "class", texts[1], t.line, {"bases": named(head[texts.index("extends") + 1 : texts.index("{") if "{" in texts else None])[:1] if "extends" in texts else []}
        elif typed and texts[:1] == ["interface"] and len(head) > 1:
            yield "class", texts[1], t.line, {"bases": named(head[texts.index("extends") + 1 : texts.index("{") if "{" in texts else None]) if "extends" in texts else []}
        elif texts[:1] == ["function"]:
            at = 2 if texts[1:2] == ["*"] else 1
            if texts[at + 1 : at + 2] == ["("]:
                yield "function", texts[at], t.line, {"params": parameters(source, head, at + 1), **flags}
        elif texts[:1] in (["const"], ["let"], ["var"]) and "=" in texts and texts.index("=") + 1 < len(texts):
            value = texts.index("=") + 1
            if "require" in texts[value:]:
                given = [x.text[1:-1] for x in head[value:] if x.kind == "string"]
                if given:
                    yield "import", given[0], t.line, {}
                continue
            flags["is_async"] = texts[value] == "async"
            value += flags["is_async"]
            opened = texts.index("(", value) if "(" in texts[value:] else -1
            if texts[value : value + 1] == ["function"] and opened > 0:
                yield "function", texts[1], t.line, {"params": parameters(source, head, opened), **flags}
            elif opened == value and texts[closing(head, opened) + 1 : closing(head, opened) + 2] == ["=>"]:
                yield "function", texts[1], t.line, {"params": parameters(source, head, opened), **flags}
            elif texts[value + 1 : value + 2] == ["=>"]:
                yield "function", texts[1], t.line, {"params": [texts[value]], **flags}


OUTLINES = {"java": java, "cpp": cpp, "c": cpp, "javascript": script, "typescript": lambda source: script(source, typed=True)}


def imported_modules(source: str, language: str) -> list[str]:
    """What a file imports, as the stems that files are known by; in order, each once."""
    names = [name for kind, name, *_ in OUTLINES[language](source) if kind == "import"] if language in OUTLINES else []
    if language == "java":  # the package of the class
        names = [n.split(".")[-2] for n in names if "." in n]
    elif language in ("javascript", "typescript"):  # packages; relative paths name none
        names = [n.split("/")[0] for n in names if not n.startswith(".")]
    else:
        names = [n.split("/")[-1].replace(".h", "") for n in names]
    return list(dict.fromkeys(names))
