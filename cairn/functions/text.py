"""Column expressions for paths, names, masking, excerpts and identities.

Everything here is a ``Column -> Column`` function of built-in expressions, so
it stays inside whole-stage code generation. A null input gives the result of
an empty string where a function normalises, and null where it measures.
"""

from __future__ import annotations

from functools import reduce

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Column | str


def _col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _replace(x: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, x)


# Paths and methods -----------------------------------------------------------


def http_path(value: Text) -> Column:
    """A path without query, fragment, host, doubled or closing slashes, its variables written {param}."""
    path = F.regexp_replace(F.trim(F.coalesce(_col(value), F.lit(""))), r"(?s)[?#].*\z", "")
    absolute = path.rlike(r"(?i)\Ahttps?://")
    # a URL parser escapes braces, so a template in an absolute URL is no variable
    escaped = _replace(path, (r"(?i)\Ahttps?://[^/]*", ""), (r"\{", "%7B"), (r"\}", "%7D"))
    path = F.concat(F.lit("/"), F.when(absolute, escaped).otherwise(path))
    return F.coalesce(
        F.nullif(
            _replace(path, ("/+", "/"), (r"/\z", ""), (r":\w+", "{param}"), (r"\$\{[^}]+\}", "{param}"), (r"\{[^}]+\}", "{param}")),
            F.lit(""),
        ),
        F.lit("/"),
    )


def without_api_prefix(path: Text) -> Column:
    """A normalised path without a leading /api segment that more follows."""
    return F.regexp_replace(_col(path), r"(?i)\A/api(?=/)", "")


def http_method(value: Text) -> Column:
    return F.upper(F.coalesce(F.nullif(_col(value), F.lit("")), F.lit("GET")))


def join_paths(base: Text, path: Text) -> Column:
    joined = F.concat_ws("/", F.coalesce(_col(base), F.lit("")), F.coalesce(_col(path), F.lit("")))
    return F.coalesce(F.nullif(_replace(F.concat(F.lit("/"), joined), ("/+", "/"), (r"/\z", "")), F.lit("")), F.lit("/"))


def endpoint_key(method: Text, path: Text) -> Column:
    return F.concat_ws(" ", http_method(method), http_path(path))


def endpoint_parts(key: Text) -> Column:
    """METHOD /path as a struct of both, normalised."""
    k = _col(key)
    method = F.regexp_extract(k, r"\A\s*([A-Za-z]+)\s+", 1)
    path = F.regexp_replace(k, r"\A\s*[A-Za-z]+\s+", "")
    return F.struct(http_method(method).alias("method"), http_path(path).alias("path"))


def path_suffixes(path: Text) -> Column:
    """All suffixes of a normalised path that begin at a slash; the root's only one is itself."""
    p = _col(path)
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)))
    return F.when(p == "/", F.array(F.lit("/"))).otherwise(
        F.transform(starts, lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, k, F.size(parts)), "/")))
    )


def url_parts(url: Text) -> Column:
    """host, project and repository of https, ssh and scp-like repository addresses."""
    u = _replace(F.trim(_col(url)), (r"(?i)\A[a-z+]+://", ""), (r"\A[^@/]*@", ""), (r"\A([^/:]+):(?!\d)", "$1/"), (r"[?#].*\z", ""))
    u = _replace(u, (r"/+\z", ""), (r"(?i)\.git\z", ""))
    segments = F.filter(F.split(u, "/"), lambda x: x != "")
    return F.struct(
        F.lower(F.get(segments, F.lit(0))).alias("host"),
        F.when(F.size(segments) > 2, F.get(segments, F.size(segments) - 2)).alias("project"),
        F.when(F.size(segments) > 1, F.get(segments, F.size(segments) - 1)).alias("repository"),
    )


def url_identity(url: Text) -> Column:
    """One lower-case spelling for all addresses of a repository."""
    u = F.lower(F.trim(_col(url)))
    u = F.when(~u.contains("://") & u.rlike(r"\A[^/@]+@[^/:]+:"), F.concat(F.lit("ssh://"), F.regexp_replace(u, r"\A([^:]+):", "$1/"))).otherwise(u)
    return _replace(u, (r"[?#].*\z", ""), (r"://[^@/]*@", "://"), (r"/+\z", ""), (r"\.git\z", ""))


def url_without_credentials(url: Text) -> Column:
    return _replace(F.trim(_col(url)), (r"://[^@/]*@", "://"), (r"[?#].*\z", ""))


def has_credentials(url: Text) -> Column:
    """A password, or a user of another scheme than ssh, stands in the address."""
    u = F.trim(_col(url))
    return u.rlike(r"(?i)\A[a-z+]+://[^/@:]*:[^/@]*@") | (u.rlike(r"(?i)\A[a-z+]+://[^/@]+@") & ~u.rlike(r"(?i)\A(git\+)?ssh://"))


def url_for_storage(url: Text) -> Column:
    """The address without password, query and fragment; an ssh address keeps its user, which is no secret."""
    bare = _replace(F.trim(_col(url)), (r"[?#].*\z", ""), (r"(://[^@/:]*):[^@/]*@", "$1@"))
    return F.when(bare.rlike(r"(?i)\A(git\+)?ssh://"), bare).otherwise(_replace(bare, (r"://[^@/]*@", "://")))


def without_url_credentials_or_error(url: Text) -> Column:
    """The address, or an error where it carries credentials."""
    return F.when(has_credentials(url), F.raise_error(F.lit("the repository's address carries credentials"))).otherwise(_col(url))


def source_layout(path: Text) -> Column:
    """Module, source set and root of a path with a src/(main|test)/(java|resources) triple; nulls without one."""
    p = F.regexp_replace(_col(path), r"\\", "/")
    pattern = r"(?i)\A(?:(.*?)/)?(src/(main|test)/(?:java|resources))(?:/|\z)"
    part = lambda k: F.nullif(F.regexp_extract(p, pattern, k), F.lit(""))
    return F.struct(
        F.when(p.rlike(pattern), F.regexp_extract(p, pattern, 1)).alias("module_path"),
        F.lower(part(3)).alias("source_set"),
        part(2).alias("source_root"),
    )


# Names: look-alike normalisers, each for its own use --------------------------


def alnum_name(x: Text) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_col(x), F.lit(""))), "[^a-z0-9]", "")


def last_segment(x: Text) -> Column:
    return F.regexp_extract(_col(x), r"([^.$]*)\z", 1)


def without_generics(x: Text) -> Column:
    return F.regexp_replace(_col(x), "<.*>", "")


def stem_name(x: Text) -> Column:
    """A type name without its role words."""
    return alnum_name(F.regexp_replace(_col(x), "(?i)(controller|service|repository|client|impl|entity|dto)", ""))


def file_stem(x: Text) -> Column:
    return F.regexp_replace(F.regexp_extract(_col(x), r"([^/\\]*)\z", 1), r"\.[A-Za-z0-9]+\z", "")


def action_name(x: Text) -> Column:
    return F.regexp_replace(_col(x), "(?i)(releases?|requests?|api|client|fetch|call)+\\z", "")


def similar(a: Text, b: Text) -> Column:
    """One stem contains the other, neither being empty."""
    p, q = stem_name(a), stem_name(b)
    return (p != "") & (q != "") & (p.contains(q) | q.contains(p))


def _without_marks() -> tuple[str, str]:
    """For ``translate``: letters that decompose into one letter and marks, with that letter, and last the marks themselves, which go."""
    pairs, marks = [("ı", "i")], []
    for c in map(chr, range(0x80, 0x2100)):
        rest = [d for d in unicodedata.normalize("NFD", c.lower()) if not unicodedata.combining(d)]
        if unicodedata.combining(c):
            marks.append(c)
        elif len(rest) == 1 and rest[0] != c and c == c.lower():
            pairs.append((c, rest[0]))
    return "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


_MARKED, _BARE = _without_marks()


def ascii_fold(x: Text) -> Column:
    """Lower case, letters decomposed and without their marks; the dotless i is an i."""
    return F.translate(F.lower(F.coalesce(_col(x), F.lit(""))), _MARKED, _BARE)


def heading_name(x: Text) -> Column:
    """A heading for comparison: folded, without its number, letters and digits only."""
    return _replace(ascii_fold(x), (r"\A\s*\d+[.)]\s*", ""), ("[^a-z0-9]", ""))


def safe_name(x: Text) -> Column:
    slug = _replace(F.lower(_col(x)), ("[^a-z0-9._-]+", "-"), (r"\A-+|-+\z", ""))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("item"))


def safe_segment(x: Text) -> Column:
    return F.concat_ws("-", F.substring(safe_name(x), 1, 80), F.substring(F.sha2(_col(x), 256), 1, 10))


def label_text(x: Text) -> Column:
    """Text without tags and braced values, in single spaces."""
    return F.trim(_replace(_col(x), ("<[^>]+>", " "), (r"\{[^}]+\}", " "), (r"\s+", " ")))


# Secrets ----------------------------------------------------------------------

MASK = "[MASKED_SECRET]"
#: A text without any of these has no secret, so most texts are passed on unread by the rules.
SUSPECT = r"(?i)password|token|secret|api[_-]?key|authorization|PRIVATE KEY"
#: What counts as a secret and what is put in its place, in order.
MASK_RULES = [
    (r"""(?i)("(?:password|token|secret|api[_-]?key|client[_-]?secret|access[_-]?token|refresh[_-]?token|id[_-]?token|authorization)"\s*:\s*)"(?:\\.|[^"\\\r\n])*\"""", '$1"[MASKED_SECRET]"'),
    (r"""(?i)('(?:password|token|secret|api[_-]?key|client[_-]?secret|access[_-]?token|refresh[_-]?token|id[_-]?token|authorization)'\s*:\s*)'(?:\\.|[^'\\\r\n])*'""", "$1'[MASKED_SECRET]'"),
    (r"""(?i)(["'](?:password|token|secret|api[_-]?key|client[_-]?secret|access[_-]?token|refresh[_-]?token|id[_-]?token|authorization)["']\s*:\s*)(?!["'])[^,\s}\]]+""", '$1"[MASKED_SECRET]"'),
    (r"""(?i)((?:password|token|secret|api[_-]?key|client[_-]?secret|authorization)\s*[:=]\s*)"(?:\\.|[^"\\\r\n])*\"""", '$1"[MASKED_SECRET]"'),
    (r"""(?i)((?:password|token|secret|api[_-]?key|client[_-]?secret|authorization)\s*[:=]\s*)'(?:\\.|[^'\\\r\n])*'""", "$1'[MASKED_SECRET]'"),
    (r"""(?i)((?:password|token|secret|api[_-]?key|client[_-]?secret)\s*[:=]\s*)(?!["'])[^"'\s]+""", "$1[MASKED_SECRET]"),
    (r"(?i)(authorization:\s*)(?:bearer\s+)?[A-Za-z0-9._~+/=-]+", "$1[MASKED_SECRET]"),
    (r"(?s)-----BEGIN [^-]+PRIVATE KEY-----.*?-----END [^-]+PRIVATE KEY-----", "[MASKED_SECRET]"),
]
#: The older rules, which drop quotes around a value.
OLDER_MASK_RULES = [
    (r"""(?i)(password|token|secret|api[_-]?key|client[_-]?secret)\s*[:=]\s*["']?[^"'\s]+""", "$1=[MASKED_SECRET]"),
    (r"(?i)(authorization:\s*)(?:bearer\s+)?[A-Za-z0-9._~+/=-]+", "$1[MASKED_SECRET]"),
    (r"(?s)-----BEGIN [^-]+PRIVATE KEY-----.*?-----END [^-]+PRIVATE KEY-----", "[MASKED_SECRET]"),
]


def mask_secrets(x: Text) -> Column:
    c = _col(x)
    return F.when(c.rlike(SUSPECT), _replace(c, *MASK_RULES)).otherwise(c)


def mask_count(x: Text) -> Column:
    """How many replacements :func:`mask_secrets` makes: each rule counts on what the ones before left."""
    text, total = _col(x), F.lit(0)
    for pattern, by in MASK_RULES:
        total = total + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, by)
    return F.when(_col(x).rlike(SUSPECT), total).otherwise(0).cast("bigint")


def mask_sensitive_key(key: Text) -> Column:
    k = _col(key)
    sensitive = k.rlike("(?i)(password|passwd|secret|token|api[_-]?key|credential|private)")
    return F.when(sensitive, F.concat(k, F.lit(f"={MASK}"))).otherwise(k)


# Excerpts and identities --------------------------------------------------------


def head(x: Text, most: int, marker: str = "\n...[truncated]") -> Column:
    """The first ``most`` characters; the marker comes on top."""
    c = _col(x)
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(marker))).otherwise(c)


def head_within(x: Text, most: int, marker: str = "\n...[truncated]") -> Column:
    """At most ``most`` characters, marker included."""
    c = _col(x)
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(max(0, most - len(marker)))), F.lit(marker))).otherwise(c)


def head_and_tail(x: Text, most: int, share: float = 0.75, marker: str = "\n...[omitted]...\n") -> Column:
    """Beginning and end of a long text, ``share`` of the room for the beginning (rounded up)."""
    c, room = _col(x), max(0, most - len(marker))
    first = -(-int(room * share * 100) // 100)
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(first)), F.lit(marker), F.right(c, F.lit(room - first)))).otherwise(c)


def head_and_tail_even(x: Text, most: int, marker: str = "\n...[omitted]...\n") -> Column:
    """Beginning and end of a long text in equal parts; an odd character goes to the end."""
    c, room = _col(x), max(0, most - len(marker))
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(room // 2)), F.lit(marker), F.right(c, F.lit(room - room // 2)))).otherwise(c)


def tail(x: Text, most: int, marker: str = "[earlier text omitted]\n") -> Column:
    c = _col(x)
    return F.when(F.length(c) > most, F.concat(F.lit(marker), F.right(c, F.lit(most)))).otherwise(c)


def short_hash(*parts: Text, size: int = 16, sep: str = ":") -> Column:
    return F.substring(F.sha2(F.concat_ws(sep, *[_col(p).cast("string") for p in parts]), 256), 1, size)


def token_estimate(chars: Text) -> Column:
    return F.ceil(_col(chars) / 4).cast("bigint")


def token_estimate_safe(chars: Text) -> Column:
    return (F.ceil(_col(chars) / 3) + 512).cast("bigint")


def line_at(text: Text, offset: Text) -> Column:
    """1-based line of a 0-based offset."""
    return F.regexp_count(F.left(_col(text), _col(offset)), F.lit("\n")) + 1


def source_references(text: Text) -> Column:
    found = F.regexp_extract_all(_col(text), F.lit(r"(src/[A-Za-z0-9_./-]+\.(?:java|tsx?|jsx?|ya?ml|properties))"), F.lit(1))
    return F.array_distinct(found)
