"""Java declarations read from a token stream: types with their nesting, members, annotations, parameters.

A small recursive descent over one file's tokens, called inside Arrow batches.
Bodies of methods and initialisers are skipped by their brackets. A file whose
brackets don't match is read as far as it goes and reported as such.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate, batched

_TOKEN = re.compile(r'"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*.*?\*/|[A-Za-z_$][\w$]*|\d[\w.]*|->|::|\S', re.DOTALL)
_PARTED = re.compile(f"({_TOKEN.pattern})", re.DOTALL)
_COMMENT = ("//", "/*")
_NAME = re.compile(r"[A-Za-z_$]")
_OPEN, _CLOSE = {"(": ")", "{": "}", "[": "]"}, set(")}]")
_BRACKETS = {*_OPEN, *_CLOSE}
#: Words that may stand before a declaration, and those that open a type.
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "default", "sealed", "synchronized", "native", "transient", "volatile", "strictfp"}
TYPES = {"class", "interface", "enum", "record"}
#: Up to how many characters a text is parted into tokens at once.
SMALL = 1 << 17


@dataclass(slots=True)
class Annotation:
    """``values``: by argument name ('' for the unnamed one), the literals and names that it is given."""

    name: str
    values: dict[str, list[str]]


@dataclass(slots=True)
class Parameter:
    name: str
    type: str
    annotations: list[Annotation]


@dataclass(slots=True)
class Declaration:
    """A type, method or field; ``owner`` is the type around it (outer.inner), ``start`` and ``stop`` are offsets, annotations and body included."""

    kind: str
    owner: str
    name: str
    type: str
    annotations: list[Annotation]
    start: int
    stop: int
    parameters: list[Parameter] = field(default_factory=list)
    body: tuple[int, int] | None = None
    modifiers: frozenset[str] = frozenset()


class Source:
    """The tokens of one file, its declarations, and whether all brackets match."""

    def __init__(self, text: str):
        self.text = text
        # a file may be large: places as machine numbers, equal tokens as one text
        self.at, self.tokens = array("i"), []
        once: dict[str, str] = {}
        if len(text) <= SMALL:
            parts = _PARTED.split(text)  # what stands between the tokens, and these
            self.tokens, self.at = parts[1::2], array("i", [*accumulate(map(len, parts))][:-1:2])
            comments = {t for t in {*self.tokens} if t.startswith(_COMMENT)}
            if comments:
                kept = [k for k, t in enumerate(self.tokens) if t not in comments]
                self.tokens, self.at = [self.tokens[k] for k in kept], array("i", [self.at[k] for k in kept])
        else:
            for some in batched(_TOKEN.finditer(text), 10_000):
                kept = [m for m in some if not m[0].startswith(_COMMENT)]
                words = [m[0] for m in kept]
                self.at.extend([m.start() for m in kept])
                self.tokens.extend(map(once.setdefault, words, words))
        del once
        self.partner, open_ = array("i", [-1]) * len(self.tokens), []
        self.sound = True
        for k, t in ((k, t) for k, t in enumerate(self.tokens) if t in _BRACKETS):
            if t in _OPEN:
                open_.append(k)
            elif open_ and _OPEN[self.tokens[open_[-1]]] == t:
                self.partner[open_.pop()] = k
            else:
                self.sound = False
        self.sound &= not open_
        self.lines = array("i", [0])
        self.lines.extend(m.end() for m in re.finditer("\n", text))

    @cached_property
    def declarations(self) -> list[Declaration]:
        return list(self.read())

    def read(self) -> Iterator[Declaration]:
        """The declarations one at a time, for files whose declarations are many; a type comes before its members."""
        yield from self._members(0, len(self.tokens), "")

    def place(self, offset: int) -> tuple[int, int]:
        """Line and column of an offset, from 1."""
        line = bisect_right(self.lines, offset)
        return line, offset - self.lines[line - 1] + 1

    def _close(self, k: int, end: int) -> int:
        """The token behind the bracket that closes the one at ``k``; the end where it has no partner."""
        other = self.partner[k] if k < len(self.partner) else -1
        return min((other if other >= 0 else end - 1) + 1, end)

    def _angle(self, k: int, end: int) -> int:
        depth = 0
        while k < end:
            depth += (self.tokens[k] == "<") - (self.tokens[k] == ">")
            k += 1
            if not depth:
                break
        return k

    def _join(self, a: int, b: int) -> str:
        return self.text[self.at[a] : self.at[b - 1] + len(self.tokens[b - 1])] if b > a else ""

    def _annotation(self, k: int, end: int) -> tuple[Annotation, int]:
        name = k + 1
        while name + 2 < end and self.tokens[name + 1] == ".":
            name += 2
        k = name + 1
        values: dict[str, list[str]] = {}
        if k < end and self.tokens[k] == "(":
            close = self._close(k, end)
            for a, b in self._parts(k + 1, close - 1):
                key, a = (self.tokens[a], a + 2) if b > a + 1 and self.tokens[a + 1] == "=" else ("", a)
                values.setdefault(key, []).extend(self._values(a, b))
            k = close
        return Annotation(self.tokens[name] if name < end else "", values), k

    def _values(self, a: int, b: int) -> list[str]:
        """The literals and names of an annotation's value; those of a nested annotation belong to it."""
        if b > a and self.tokens[a] in ("{", "("):
            return [v for c, d in self._parts(a + 1, self._close(a, b) - 1) for v in self._values(c, d)]
        if b > a and self.tokens[a] == "@":
            return []
        if any(t[0] == '"' for t in self.tokens[a:b]):  # literals, also joined by +
            return ["".join(t.strip('"') for t in self.tokens[a:b] if t[0] == '"')]
        return [self._join(a, b)] if b > a else []

    def _parts(self, k: int, end: int) -> list[tuple[int, int]]:
        """Token ranges between commas outside brackets and angles."""
        parts, first = [], k
        while k < end:
            if self.tokens[k] in _OPEN:
                k = self._close(k, end)
            elif self.tokens[k] == "<":
                k = self._angle(k, end)
            else:
                if self.tokens[k] == ",":
                    parts.append((first, k))
                    first = k + 1
                k += 1
        return [(a, b) for a, b in [*parts, (first, end)] if b > a]

    def _modifiers(self, k: int, end: int) -> tuple[list[Annotation], int]:
        """The annotations before a declaration, and where it begins; the words before it are left in ``words``."""
        out = []
        self.words: set[str] = set()
        while k < end:
            if self.tokens[k] == "@" and k + 1 < end and self.tokens[k + 1] != "interface":
                one, k = self._annotation(k, end)
                out.append(one)
            elif self.tokens[k] in MODIFIERS or (self.tokens[k] == "non" and self._join(k, min(k + 3, end)) == "non-sealed"):
                self.words.add(self.tokens[k])
                k += 3 if self.tokens[k] == "non" else 1
            else:
                break
        return out, k

    def _parameters(self, k: int, end: int) -> list[Parameter]:
        out = []
        for a, b in self._parts(k, end):
            annotations, a = self._modifiers(a, b)
            names = [x for x in range(a, b) if _NAME.match(self.tokens[x])]
            if names and names[-1] > a:
                out.append(Parameter(self.tokens[names[-1]], self._join(a, names[-1]), annotations))
        return out

    def _members(self, k: int, end: int, owner: str) -> Iterator[Declaration]:
        while k < end:
            first = k
            annotations, k = self._modifiers(k, end)
            if k >= end:
                return
            if self.tokens[k] == "{":
                k = self._close(k, end)
            elif self.tokens[k] in TYPES and k + 1 < end and _NAME.match(self.tokens[k + 1]) or self.tokens[k] == "@" and k + 1 < end:
                k = yield from self._type(first, k + (self.tokens[k] == "@"), end, owner, annotations)
            else:
                k, found = self._member(first, k, end, owner, annotations)
                if found:
                    yield found

    def _type(self, first: int, k: int, end: int, owner: str, annotations: list[Annotation]) -> Generator[Declaration, None, int]:
        kind, name = self.tokens[k], self.tokens[k + 1] if k + 1 < end else ""
        inside = f"{owner}.{name}" if owner else name
        parameters: list[Parameter] = []
        k += 2
        while k < end and self.tokens[k] != "{":
            if self.tokens[k] == "<":
                k = self._angle(k, end)
            elif self.tokens[k] == "(":
                parameters = self._parameters(k + 1, self._close(k, end) - 1)
                k = self._close(k, end)
            elif self.tokens[k] == ";":
                return k + 1
            else:
                k += 1
        if k >= end:
            return end
        close = self._close(k, end)
        yield Declaration(kind, owner, name, "", annotations, self.at[first], self._end(close), parameters, (self.at[k], self._end(close)))
        k += 1
        inner = close - 1 if self.tokens[close - 1] == "}" else close
        if kind == "enum":
            while k < inner and self.tokens[k] != ";":
                k = self._close(k, inner) if self.tokens[k] in _OPEN else k + 1
        yield from self._members(k, inner, inside)
        return close

    def _end(self, k: int) -> int:
        return self.at[k - 1] + len(self.tokens[k - 1])

    def _member(self, first: int, k: int, end: int, owner: str, annotations: list[Annotation]) -> tuple[int, Declaration | None]:
        """The token behind a method or a field, and this; anything else is passed over up to its end."""
        start, name, words = k, None, frozenset(self.words)
        while not owner and k < end:  # package, imports, and whatever isn't a type
            if self.tokens[k] in (";", "}"):
                return k + 1, None
            k = self._close(k, end) if self.tokens[k] in _OPEN else k + 1
        if k >= end:
            return end, None
        if self.tokens[k] == "<":
            start = k = self._angle(k, end)
        while k < end:
            t = self.tokens[k]
            if t == "<":
                k = self._angle(k, end)
            elif t == "(" and name is not None:
                parameters = self._parameters(k + 1, self._close(k, end) - 1)
                k = self._close(k, end)
                while k < end and self.tokens[k] not in ("{", ";"):
                    k += 1
                body = None
                if k < end and self.tokens[k] == "{":
                    opened, k = k, self._close(k, end)
                    body = self.at[opened], self._end(k)
                else:
                    k = min(k + 1, end)
                return k, Declaration("method", owner, self.tokens[name], self._join(start, name), annotations, self.at[first], self._end(k), parameters, body, words)
            elif t in ("=", ";", ","):
                while k < end and self.tokens[k] != ";":
                    k = self._close(k, end) if self.tokens[k] in _OPEN else k + 1
                k = min(k + 1, end)
                if name is None or name <= start:
                    return k, None
                return k, Declaration("field", owner, self.tokens[name], self._join(start, name), annotations, self.at[first], self._end(k))
            elif t in _OPEN:
                k = self._close(k, end)
                if t == "{":
                    return k, None
            elif t in _CLOSE:
                return k + 1, None
            else:
                name = k if _NAME.match(t) else name
                k += 1
        return end, None


def innermost(spans: list[tuple[int, int, str]]) -> Callable[[int], str | None]:
    """Tells the name of the innermost of ``spans`` (start, stop, name) around a place; they stand apart or in one another."""
    places, names, around = array("i"), [], []

    def left(upto: int | None) -> None:
        while around and (upto is None or around[-1][0] <= upto):
            places.append(around.pop()[0])
            names.append(around[-1][1] if around else None)

    for a, b, name in sorted(spans, key=lambda s: (s[0], -s[1])):
        left(a)
        places.append(a)
        names.append(name)
        around.append((b, name))
    left(None)
    return lambda at: names[k - 1] if (k := bisect_right(places, at)) else None
