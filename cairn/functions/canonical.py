"""Artifacts without what changes from run to run: JSON values of any depth, lines of records, Markdown.

Operational metadata (times and digests of inputs) go only where metadata
stand: in a record that looks like metadata, under a key called so, and in
lines and fenced blocks of Markdown that say so. Evidence stays as it is.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Volatile keys by letters and digits, the keys of which a metadata record has one of each, the titles of volatile lines, what replaces them.
VOLATILE_KEYS = {"generatedat", "updatedat", "startedat", "completedat"}
VERSION_KEYS, TIME_KEYS = {"pipelineversion", "sourceartifacts"}, {"generatedat"}
VOLATILE_LINES = "Olusturulma zamani|Generated|Generated at|Updated|Updated at|Started|Started at|Completed|Completed at|Input hash"
OMITTED = "[VOLATILE_METADATA_OMITTED]"

_LINE = re.compile(rf"(\s*(?:[-*]\s*)?(?:{VOLATILE_LINES.replace(' ', chr(92) + 's+')})\s*:\s*).*", re.IGNORECASE)
_TITLE = re.compile(r"##\s+(?:artifact\s+)?metadata\s*", re.IGNORECASE)


def _plain(key: str) -> str:
    return re.sub("[^a-z0-9]", "", key.lower())


def _volatile(key: str) -> bool:
    return _plain(key) in VOLATILE_KEYS or _plain(key).endswith("inputhash")


def is_metadata(value: object) -> bool:
    """A record that tells a pipeline's version or sources, and a time or an input's digest."""
    keys = {_plain(k) for k in value} if isinstance(value, dict) else set()
    return bool(keys & VERSION_KEYS) and (bool(keys & TIME_KEYS) or any(k.endswith("inputhash") for k in keys))


def canonical_value(value: object, metadata: bool) -> object:
    """The value without volatile keys of metadata records; ``metadata`` says whether it stands where they do. Depth is bounded by memory only."""
    root: list = [None]
    todo = [(root, 0, value, metadata)]
    while todo:
        place, at, x, inside = todo.pop()
        if isinstance(x, list):
            made: list | dict = [None] * len(x)
            todo += [(made, k, item, inside) for k, item in enumerate(x)]
        elif isinstance(x, dict):
            drop = inside or is_metadata(x)
            kept = {k: v for k, v in x.items() if not (drop and _volatile(k))}
            # keys that are array indexes come first, in their order
            indexes = sorted((k for k in kept if re.fullmatch(r"0|[1-9]\d{0,9}", k) and int(k) < 2**32 - 1), key=int)
            made = dict.fromkeys([*indexes, *(k for k in kept if k not in set(indexes))])
            todo += [(made, k, kept[k], _plain(k).endswith("metadata")) for k in made]
        else:
            made = x
        place[at] = made
    return root[0]


def _number(x: float) -> str:
    if x != x or abs(x) == float("inf"):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return f"{Decimal(repr(x)):.0f}" if abs(x) >= 2**53 else str(int(x))
    return re.sub(r"e([+-])0+(?=\d)", r"e\1", repr(x))


def _written(value: object, indent: int | None = None) -> str:
    """JSON of a canonical value; numbers as doubles are written, two spaces a level with ``indent``."""
    out, todo = [], [(value, 0)]
    line = lambda depth: "" if indent is None else "\n" + " " * (indent * depth)
    while todo:
        x, depth = todo.pop()
        if isinstance(x, str) and depth < 0:
            out.append(x)
        elif isinstance(x, (dict, list)) and x:
            items = list(x.items()) if isinstance(x, dict) else [(None, v) for v in x]
            rest: list = []
            for k, (key, v) in enumerate(items):
                head = ("," if k else "") + line(depth + 1) + ("" if key is None else json.dumps(key, ensure_ascii=False) + (":" if indent is None else ": "))
                rest += [(head, -1), (v, depth + 1)]
            rest.append((line(depth) + ("}" if isinstance(x, dict) else "]"), -1))
            out.append("{" if isinstance(x, dict) else "[")
            todo += reversed(rest)
        elif isinstance(x, (int, float)) and not isinstance(x, bool):
            out.append(_number(float(x)))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def _parsed(text: str) -> tuple[object, bool]:
    try:
        return json.loads(text, parse_int=float, parse_constant=lambda c: json.loads("")), True
    except (ValueError, RecursionError):
        return None, False


def canonical_lines(text: str) -> str:
    """Markdown whose volatile lines outside fences have no value."""
    out, fenced = [], False
    for line in text.replace("\r\n", "\n").split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced and (found := _LINE.fullmatch(line)):
            line = found[1] + OMITTED
        out.append(line)
    return "\n".join(out)


def _markdown(text: str) -> str:
    lines, k = canonical_lines(text).split("\n"), 0
    while k < len(lines):
        if _TITLE.fullmatch(lines[k]):
            opening = next((j for j in range(k + 1, len(lines)) if lines[j].rstrip().lower() == "```json"), None)
            closing = next((j for j in range(opening + 2, len(lines)) if lines[j].rstrip() == "```"), None) if opening else None
            if closing:
                value, sound = _parsed("\n".join(lines[opening + 1 : closing]))
                if sound:
                    lines[opening + 1 : closing] = [_written(canonical_value(value, True), 2)]
                    closing = opening + 2
                k = closing
        k += 1
    return "\n".join(lines)


def canonical(text: str | None, kind: str, source: str = "") -> str | None:
    """The artifact's canonical text; null for null, and for a json artifact that doesn't parse."""
    if text is None:
        return None
    if kind == "json":
        value, sound = _parsed(text)
        flow = re.split(r"[\\/]", source or "")[-1].lower() == "page-flow.json"
        return _written(canonical_value(value, flow or is_metadata(value)), 2) + "\n" if sound else None
    if kind == "jsonl":
        out = []
        for line in filter(None, (x.strip() for x in re.split(r"\r?\n", text))):
            value, sound = _parsed(line)
            out.append(_written(canonical_value(value, is_metadata(value))) if sound else canonical_lines(line))
        return "\n".join(out)
    return _markdown(text)


def canonical_artifact(text: Column | str, kind: Column | str, source: Column | str) -> Column:
    """:func:`canonical` of a column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, kinds: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series([canonical(t, k, s) for t, k, s in zip(texts, kinds, sources, strict=True)], dtype=object)

    return run(text, kind, source)
