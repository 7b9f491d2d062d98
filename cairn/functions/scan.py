"""Small scanners for what no regular expression finds: matching brackets, top-level parts, path expressions.

Pure functions of one text, called inside Arrow batches. Strings and comments
are skipped; a bracket without a partner ends at the end of the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

PAIRS = {"(": ")", "[": "]", "{": "}"}
#: A string, a comment, or a single character.
TOKEN = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/|.", re.DOTALL)


_SKIPPED = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/"
#: A string, a comment or a bracket; ways that all begin with a literal let the search pass over everything else.
_BRACKETS = r"\(|\)|\[|\]|\{|\}"
_BRACKET = re.compile(rf"{_SKIPPED}|{_BRACKETS}", re.DOTALL)
_DEPTH = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}


def tokens(text: str, start: int = 0) -> Iterator[tuple[int, str]]:
    for m in TOKEN.finditer(text, start):
        if not m[0].startswith(("//", "/*")):
            yield m.start(), m[0]


def close_of(text: str, start: int) -> int:
    """The place behind the bracket that closes the one at ``start``."""
    depth = 0
    if text[start : start + 1] in PAIRS:
        for m in _BRACKET.finditer(text, start):
            if step := _DEPTH.get(m[0]):
                depth += step
                if depth == 0:
                    return m.end()
        return len(text)
    for at, t in tokens(text, start):
        depth += (t in "([{") - (t in ")]}")
        if depth == 0:
            return at + len(t)
    return len(text)


@lru_cache(maxsize=64)
def parts_at(separator: str, angles: bool) -> re.Pattern:
    """A string, a comment, a bracket or the separator."""
    return re.compile(rf"{_SKIPPED}|{_BRACKETS}{'|<|>' if angles else ''}|{re.escape(separator)}", re.DOTALL)


def split_top(text: str, separator: str = ",", angles: bool = False) -> list[str]:
    """Parts between separators outside all brackets, trimmed; ``angles`` counts < and > as brackets."""
    parts, depth, last = [], 0, 0
    for m in parts_at(separator, angles).finditer(text):
        t = m[0]
        if t == separator:
            if depth == 0:
                parts.append(text[last : m.start()].strip())
                last = m.end()
        elif len(t) == 1:
            depth += (t in "([{<") - (t in ")]}>")
    parts.append(text[last:].strip())
    return [p for p in parts if p]


def close_tag(text: str, start: int, name: str) -> int:
    """The place behind the closing tag of the element at ``start``, or behind its own tag where none follows."""
    close = text.find(f"</{name}>", start)
    return close + len(name) + 3 if close >= 0 else text.find(">", start) + 1 or len(text)


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


JAVA_METHOD = re.compile(r"(?:(?:public|protected|private|static|final|default)\s+)+(?:<[^>{}]*>\s*)?[\w<>\[\], ?.]+?\s+(\w+)\s*\(")
NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "new"}


def java_methods(text: str) -> list[tuple[str, int, int]]:
    """(name, start, end) of each method with a body, from its first modifier to its closing brace."""
    out = []
    for m in JAVA_METHOD.finditer(text):
        after = close_of(text, m.end() - 1)
        body = re.compile(r"\s*(?:throws\s+[\w., ]+)?\s*\{").match(text, after)
        if body and m[1] not in NOT_METHODS:
            out.append((m[1], m.start(), close_of(text, body.end() - 1)))
    return out


_HEAD = r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|const|let|class|interface|record|enum)\s+"
_HEADS = re.compile(rf"{_HEAD}(?=(\w+))")


@lru_cache(maxsize=1)
def _heads(text: str) -> dict[str, tuple[int, int]]:
    """Where the first declaration of each name begins and its name ends; those of the last text are kept."""
    heads: dict[str, tuple[int, int]] = {}
    for m in _HEADS.finditer(text):
        heads.setdefault(m[1], (m.start(), m.end(1)))
    return heads


@lru_cache(maxsize=1)
def _methods(text: str) -> dict[str, tuple[int, int]]:
    """The first Java method of each name; those of the last text are kept."""
    methods: dict[str, tuple[int, int]] = {}
    for n, a, b in java_methods(text):
        methods.setdefault(n, (a, b))
    return methods


def declaration(text: str, name: str) -> tuple[int, int] | None:
    """The span of the function, constant, class or method called ``name``, by its braces or up to its semicolon."""
    if re.fullmatch(r"\w+", name):
        head = _heads(text).get(name)
    else:
        found = re.search(rf"{_HEAD}{re.escape(name)}\b", text)
        head = found.span() if found else None
    if head:
        start, begin = head
        if text.startswith("(", begin):  # a function's parameters
            begin = close_of(text, begin)
        upto = 0
        for at, t in tokens(text, begin):
            if at < upto:
                continue
            if t == "(":
                upto = close_of(text, at)
            elif t == "{":
                return start, close_of(text, at)
            elif t == ";" or (t == "\n" and not text[begin:at].rstrip().endswith(("=", "=>", ","))):
                return start, at + 1
        return start, len(text)
    return _methods(text).get(name)


def resolve_path(expression: str, value_of: Callable[[str], str | None], seen: frozenset[str] = frozenset()) -> str | None:
    """The path that an expression gives, its unknown parts as {name}; null if nothing of it is known.

    Literals, templates, sums, ``a ?? b`` (the first that is known), ``c ? a : b``
    (one path if both give it, else their common beginning) and names, which
    ``value_of`` turns into expressions; a name inside itself is unknown.
    """
    e = expression.strip().rstrip(";").strip()
    while e.startswith("(") and close_of(e, 0) == len(e):
        e = e[1:-1].strip()
    choice = split_top(e, "?") if "??" not in e else [e]
    if len(choice) == 2 and len(ways := split_top(choice[1], ":")) == 2:
        a, b = (resolve_path(x, value_of, seen) for x in ways)
        if a is None or b is None or a == b:
            return a if b is None else b
        upto = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[:upto].rstrip("/") + "/{choice}"
    if len(options := split_top(e, "??")) > 1:
        return next((r for r in (resolve_path(o, value_of, seen) for o in options) if r is not None), None)
    if len(terms := split_top(e, "+")) > 1:
        parts = [(t, resolve_path(t, value_of, seen)) for t in terms]
        if all(r is None for _, r in parts):
            return None
        return "".join(r if r is not None else "{" + last_name(t) + "}" for t, r in parts)
    if len(e) > 1 and e[0] in "'\"" and e[-1] == e[0]:
        return e[1:-1]
    if len(e) > 1 and e[0] == e[-1] == "`":
        return re.sub(r"\$\{([^{}]*)\}", lambda m: r if (r := resolve_path(m[1], value_of, seen)) is not None else "{" + last_name(m[1]) + "}", e[1:-1])
    if re.fullmatch(r"[A-Za-z_$][\w$.]*", e) and e not in seen and (value := value_of(e)) is not None:
        return resolve_path(value, value_of, seen | {e})
    return None


def last_name(expression: str) -> str:
    names = re.findall(r"[A-Za-z_$][\w$]*", expression)
    return names[-1] if names else "param"
