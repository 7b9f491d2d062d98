"""Calls, interactions and declarations of one file, with their offsets; called inside Arrow batches."""

from __future__ import annotations

import re

from cairn.functions.scan import PAIRS, close_of, parts_at, split_top

#: HTTP methods, what wrappers of a request are called, and the keys that hold a path.
VERBS = {"get", "post", "put", "patch", "delete"}
WRAPPERS = {"sendrequest", "callapi", "fetchjson"}
PATH_KEYS = ("url", "path", "endpoint", "uri")
_CHAIN = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*(?:\s*\??\.\s*[A-Za-z_$][\w$]*)*)")
_MAY_CALL = re.compile(r"(?i)fetch|axios|request|execute|json|api$")
_STRING = re.compile(r"\s*(['\"`])(.*)\1\s*", re.DOTALL)


def arguments(text: str, at: int) -> tuple[str, int] | None:
    """(inside, end) of the parentheses that follow ``at``, behind white space and type arguments; None where none follow."""
    k = re.compile(r"\s*").match(text, at).end()
    if text.startswith("<", k):
        depth = 0
        while k < len(text):
            depth += (text[k] == "<") - (text[k] == ">" and text[k - 1] != "=")
            k += 1
            if not depth:
                break
            if text[k - 1] in ";{}" and depth < 2 and text[k - 1] == ";":
                return None
        k = re.compile(r"\s*").match(text, k).end()
    if not text.startswith("(", k):
        return None
    end = close_of(text, k)
    return (text[k + 1 : end - 1], end) if text[end - 1] == ")" and end > k + 1 else None


def literal(expression: str | None) -> str | None:
    found = _STRING.fullmatch(expression or "")
    return found[2] if found else None


def value_of(config: str | None, keys: tuple[str, ...]) -> str | None:
    """The expression under the first of the object's properties that is one of ``keys``."""
    config = (config or "").strip()
    if not config.startswith("{"):
        return None
    for part in split_top(config[1 : close_of(config, 0) - 1]):
        name, colon, value = part.partition(":")
        if colon and name.strip().strip("'\"`") in keys:
            return value.strip()
    return None


def verb_of(config: str | None) -> str | None:
    """The HTTP method of an options object: a literal, or the last part of a name such as Method.POST."""
    given = value_of(config, ("method",))
    name = literal(given) or (given or "").rpartition(".")[2].strip() if given else ""
    return name.upper() if name.lower() in VERBS else None


def described(name: str, args: list[str]) -> tuple[str, str, str] | None:
    """(method, path expression, confidence) of a call that is no member of a client, by the function's name and the form of its arguments."""
    lower = name.lower()
    first, second = (args + [None, None])[:2]
    if first is None:
        return None
    as_object = first.strip().startswith("{")
    if lower == "fetch":
        return verb_of(second) or "GET", first, "high"
    if lower == "axios" and as_object:
        path = value_of(first, PATH_KEYS)
        return (verb_of(first) or "GET", path, "high") if path else None
    for verb in VERBS:
        if lower.removeprefix(verb) in ("json", "api", "request") and lower.startswith(verb):
            return verb.upper(), first, "medium"
    if not (lower.endswith(("request", "execute")) or lower in WRAPPERS):
        return None
    if as_object:
        path = value_of(first, PATH_KEYS)
        return (verb_of(first) or "GET", path, "medium") if path else None
    if (literal(first) or "").lower() in VERBS and second:
        return literal(first).upper(), second, "medium"
    return verb_of(second) or "GET", first, "medium"


def options_of(inside: str) -> list[str]:
    """Names that a call passes on: options, serialised bodies, headers."""
    out = re.findall(r"\b(?:params|query|data|body|headers)\s*:\s*([A-Za-z_$][\w$]*)", inside)
    out += re.findall(r"\bstringify\s*\(\s*([A-Za-z_$][\w$]*)", inside)
    return out + [f"header:{h}" for h in re.findall(r"['\"`]([A-Za-z]\w*-[\w-]+)['\"`]\s*:", inside)]


def script_calls(text: str) -> list[tuple]:
    """(at, receiver, http_method, expression, options, confidence) of calls that may be HTTP calls; the receiver is null for plain functions."""
    out = []
    for m in _CHAIN.finditer(text):
        parts = [p for p in re.split(r"\s*\??\.\s*", m[1]) if p] if "." in m[1] else [m[1]]
        member = len(parts) > 1 and parts[-1] in VERBS
        if not member and not _MAY_CALL.search(parts[-1]):
            continue
        found = arguments(text, m.end())
        if found is None:
            continue
        args = split_top(found[0])
        if member:
            if args:
                out.append((m.start(), ".".join(parts[:-1]), parts[-1].upper(), args[0], options_of(found[0]), "high"))
        elif one := described(parts[-1], args):
            out.append((m.start(), None, *one[:2], options_of(found[0]), one[2]))
    return out


def script_functions(text: str) -> list[tuple[int, str]]:
    """(at, name) of function declarations, named arrow functions and methods; ``at`` is where their head ends."""
    out = [(m.end(), m[1]) for m in re.finditer(r"\bfunction\s*\*?\s+([A-Za-z_$][\w$]*)\s*\(", text)]
    name_before = re.compile(r"(?:(?<=[,{;\n])|\A|\b(?:const|let)\s)\s*([A-Za-z_$][\w$]*)\s*(?P<sign>:[^=;:{}]+=|=|:)\s*(?:async\s*)?\Z")
    for m in re.finditer(r"(?:\(([^()]*)\)(?:\s*:\s*[\w<>\[\], |.]+)?|([A-Za-z_$][\w$]*))\s*=>", text):
        head = text[max(0, m.start() - 200) : m.start()]
        found = name_before.search(head)
        if found and (found["sign"] != "=" or re.search(r"\b(?:const|let)\s*\Z", head[: found.start(1)])):
            out.append((m.end(), found[1]))
    for m in re.finditer(r"(?:(?<=[,{;\n])|\A)[ \t]*(?:async\s+)?([A-Za-z_$][\w$]*)\s*\([^()]*\)\s*(?::\s*[\w<>\[\], |.]+)?\{", text):
        if m[1] not in ("if", "for", "while", "switch", "catch", "function"):
            out.append((m.end(), m[1]))
    return sorted(out)


_FUNCTION_LIKE = re.compile(r"(?:(?:React\.)?(?:memo|forwardRef)\s*(?:<[^;=]*?>)?\(\s*)?(?:async\s*)?(?:function\b|(?:<[^;=]+>\s*)?(?:\([^;=]*?\)(?:\s*:\s*[\w.<>\[\]]+)?|[A-Za-z_$][\w$]*)\s*=>)")


def script_components(text: str) -> list[tuple]:
    """(at, component, export, children, imports, props type) of a script's components.

    Components are functions with a capital and constants that hold one, also
    inside memo and forwardRef. A default export without a name has none here:
    its file gives it. Children, imports and the props type are the file's.
    """
    names = {m[1]: m.start() for m in reversed(list(re.finditer(r"\bfunction\s+([A-Z]\w*)\s*(?:<[^(]*>)?\(", text)))}
    for m in re.finditer(r"\bconst\s+([A-Z]\w*)\s*(?::[^=;]+)?=\s*", text):
        if _FUNCTION_LIKE.match(text, m.end()):
            names.setdefault(m[1], m.start())
    unnamed = re.search(r"\bexport\s+default\s+(?!function\b)", text)
    unnamed = unnamed if unnamed and _FUNCTION_LIKE.match(text, unnamed.end()) else None
    given = set(re.findall(r"\bexport\s+default\s+(?:(?:async\s+)?function\s+)?([A-Z]\w*)\b", text))
    named = set(re.findall(r"\bexport\s+(?:async\s+)?(?:function|const)\s+([A-Z]\w*)", text))
    named |= {n for inside in re.findall(r"\bexport\s*\{([^}]*)\}", text) for n in re.findall(r"\w+", inside)}
    children = list(dict.fromkeys(re.findall(r"<([A-Z]\w*)\b", text)))
    imports = list(dict.fromkeys(re.findall(r"\bimport\s[^\"']+\sfrom\s+[\"']([^\"']+)", text)))
    props = re.search(r"\b(?:type|interface)\s+([A-Z]\w*(?:Props|Properties))\b", text)
    rows = [(at, n, "default" if n in given or unnamed else "named" if n in named else "unknown") for n, at in names.items()]
    if unnamed:
        rows.append((unnamed.start(), None, "default"))
    return [(at, n, export, [c for c in children if c != n], imports, props and props[1]) for at, n, export in sorted(rows, key=lambda r: r[0])]


_HANDLER = re.compile(r"\bon(Click|Submit|Change)=\{")
#: What is looked at inside a tag: its end, a handler, a bracket or a quote.
_IN_TAG = re.compile(r">|\bon(?:Click|Submit|Change)=\{|[{\"']")


def interactions(text: str) -> list[tuple]:
    """(at, element, event, handler, label): elements with a handler, closed within 120 characters of label, and submitted forms.

    An element's own text is not searched again. Of several handlers the last
    counts that stands before any other > in the tag.
    """
    out, upto = [], 0
    for m in re.finditer(r"<([A-Za-z][\w.]*)\b", text):
        k, handlers, plain = m.end(), [], True
        while s := _IN_TAG.search(text, k):
            k = s.start()
            if text[k] == ">":
                break
            if h := _HANDLER.match(text, k):
                end = close_of(text, h.end() - 1)
                if plain and text[end - 1] == "}":
                    handlers.append((f"on{h[1]}", text[h.end() : end - 1].strip()))
                plain, k = plain and ">" not in text[k:end], end
            else:
                end = close_of(text, k) if text[k] == "{" else text.find(text[k], k + 1) + 1 or len(text)
                plain, k = plain and ">" not in text[k:end], end
        else:
            k = len(text)
        handlers = [h for h in handlers if h[1]]
        if m[1] == "form" and (submit := next((h for e, h in handlers if e == "onSubmit"), None)):
            out.append((m.start(), "form", "onSubmit", submit, "form submit"))
        if m.start() < upto or not handlers or k >= len(text):
            continue
        close = text.find(f"</{m[1]}>", k + 1, k + 1 + 120 + len(m[1]) + 3)
        if close >= 0:
            label = re.sub(r"\{[^}]+\}", " ", re.sub(r"<[^>]+>", " ", text[k + 1 : close]))
            out.append((m.start(), m[1], *handlers[-1], " ".join(label.split()) or "Not visible"))
            upto = close + len(m[1]) + 3
    return out


# Java ------------------------------------------------------------------------------------------

_QUOTED, _IDENTIFIER = re.compile(r"[\"']([^\"']+)[\"']"), re.compile(r"[A-Za-z_]\w*")
_HOST, _VARIABLE = re.compile(r"(?i)\Ahttps?://[^/]*"), re.compile(r"\A\$\{[^}]+\}(?=/)")
_STEP = re.compile(r"\.(path|replacePath|pathSegment)\s*(?=\()")
_LINK, _MORE = re.compile(r"\s*\.?\s*([A-Za-z_$][\w$]*)\s*"), re.compile(r"\s*\.")
_CLIENTS = re.compile(r"\b(?:RestClient|WebClient)\s+([A-Za-z_]\w*)")
_FLUENT = re.compile(r"\b(?:this\s*\.\s*)?([A-Za-z_]\w*)\s*(?=\.\s*(?i:get|post|put|patch|delete|method)\s*\()")
_HTTP_METHOD = re.compile(r"\bHttpMethod\.([A-Z]+)")
_HEADER_SET, _BEARER = re.compile(r"\.\s*(?:set|add|setIfAbsent)\s*\(\s*[\"']([^\"']+)"), re.compile(r"\.\s*setBearerAuth\s*\(")
_ASSIGNED = re.compile(r"\b([A-Za-z_]\w*)\s*=(?!=)\s*")
_ENDS = parts_at(";", False)
_TEMPLATE = re.compile(r"\b\w*(?i:restTemplate)\s*\.\s*(getForObject|getForEntity|postForObject|postForEntity|put|delete|patchForObject|exchange)\s*(?=\()")


def java_path(expression: str) -> str | None:
    """The path in an expression's literals: the first that begins with a slash, else the first, without scheme and host."""
    first = (split_top(expression, angles=True) or [expression])[0]
    parts = _QUOTED.findall(first)
    return bare_path(next((p for p in parts if p.startswith("/")), parts[0])) if parts else None


def bare_path(path: str) -> str:
    path = _HOST.sub("", path.strip()) or "/"
    path = _VARIABLE.sub("", path)
    return path if path.startswith("/") else f"/{path}"


def built_path(expression: str) -> str | None:
    """The path that a builder's steps give: path() and pathSegment() append, replacePath() begins anew."""
    out = ""
    for m in _STEP.finditer(expression):
        inside = expression[m.end() + 1 : close_of(expression, m.end()) - 1]
        step = "/".join(_QUOTED.findall(inside)) if m[1] == "pathSegment" else java_path(inside) or ""
        if step:
            out = re.sub("/+", "/", f"/{'' if m[1] == 'replacePath' else out}/{step}")
    return (out.rstrip("/") or "/") if out else None


def chain_calls(text: str, start: int) -> list[tuple[str, str]]:
    """(name, arguments) of the calls of a fluent chain from ``start``, up to where the expression ends."""
    out, k = [], start
    while m := _LINK.match(text, k):
        k = m.end()
        if text.startswith("(", k):
            end = close_of(text, k)
            out.append((m[1], text[k + 1 : end - 1]))
            k = end
        if not _MORE.match(text, k):
            break
    return out


def fluent_calls(text: str) -> list[tuple]:
    """(at, http_method, path, variable, headers, body) of chains on REST and web clients; ``variable`` names the path where it is no literal."""
    receivers = {"restclient", "webclient"} | {n.lower() for n in _CLIENTS.findall(text)}
    out = []
    for m in _FLUENT.finditer(text):
        if m[1].lower() not in receivers:
            continue
        steps = chain_calls(text, m.end())
        verb = steps[0][0].upper()
        if verb == "METHOD":
            named = _HTTP_METHOD.search(steps[0][1])
            verb = named[1] if named else None
        uri = next((a for n, a in steps if n == "uri"), None)
        if verb is None or uri is None:
            continue
        path = built_path(uri) or java_path(uri)
        name = (split_top(uri, angles=True) or [""])[0]
        variable = name if path is None and _IDENTIFIER.fullmatch(name) else None
        if path or variable:
            before = steps[: next((k for k, (n, _) in enumerate(steps) if n in ("retrieve", "exchange")), len(steps))]
            out.append((m.start(), verb, path, variable, headers_of(before), body_of(before)))
    return out


def headers_of(steps: list[tuple[str, str]]) -> list[str]:
    out = []
    for name, inside in steps:
        if name == "header":
            out += _QUOTED.findall(inside)[:1]
        elif name == "headers":
            nested = _HEADER_SET.findall(inside)
            bearer = ["Authorization"] if _BEARER.search(inside) else []
            out += [*nested, *bearer, *([] if nested else _QUOTED.findall(inside)[:1])]
    out += [header for step, header in (("contentType", "Content-Type"), ("accept", "Accept")) if any(n == step for n, _ in steps)]
    return list(dict.fromkeys(out))


def body_of(steps: list[tuple[str, str]]) -> str | None:
    given = next((a for n, a in steps if n == "body"), next((a for n, a in steps if n == "bodyValue"), None))
    return " ".join((split_top(given, angles=True) or [given])[0].split())[:300] or None if given is not None else None


def assigned_paths(text: str) -> list[tuple[int, str, str]]:
    """(at, name, path) of assignments whose value gives a path; ``at`` is where they end."""
    out = []
    for m in _ASSIGNED.finditer(text):
        depth = 0
        for found in _ENDS.finditer(text, m.end()):
            t, at = found[0], found.start()
            depth += (t in PAIRS) - (t in PAIRS.values())
            if depth < 0 or (t == ";" and not depth):
                value = text[m.end() : at]
                if t == ";" and (path := built_path(value) or java_path(value)):
                    out.append((at, m[1], path))
                break
    return out


def template_calls(text: str) -> list[tuple]:
    """(at, operation, http_method, path) of RestTemplate calls."""
    out = []
    for m in _TEMPLATE.finditer(text):
        inside = text[m.end() + 1 : close_of(text, m.end()) - 1]
        if path := java_path(inside):
            named = _HTTP_METHOD.search(inside)
            verb = (named[1] if named else "REQUEST") if m[1] == "exchange" else re.match("get|post|put|delete|patch", m[1])[0].upper()
            out.append((m.start(), m[1], verb, path))
    return out
