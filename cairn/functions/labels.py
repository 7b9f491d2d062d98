"""Column expressions for labels, page contexts, model texts, JSON values and budgets.

Like :mod:`cairn.functions.text`: built-in expressions only. A null input gives
null, except where a function says what stands for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import OLDER_MASK_RULES, Text, _col, _replace

WHITE = " \t\n\r\f\v"

# Pages and handlers ---------------------------------------------------------------


def page_name(file: Text) -> Column:
    """The last path segment without a script extension; null for an empty path."""
    return F.nullif(F.regexp_replace(F.regexp_extract(_col(file), r"([^/]*)\z", 1), r"(?i)\.[jt]sx?\z", ""), F.lit(""))


def page_context(page: Text, call: Text, function: Text) -> Column:
    """(page, flow_type): the page's name, or what the call says where no page is known."""
    named = page_name(page)
    said = F.lower(F.concat_ws(" ", _col(call), F.coalesce(_col(function), F.lit(""))))
    background = named.isNull() & said.rlike("refresh|session|token")
    return F.struct(
        F.coalesce(named, F.when(background, "SessionBackground"), F.lit("UnknownPage")).alias("page"),
        F.when(background, "session-background").when(F.lower(named) == "layout", "layout").otherwise("page").alias("flow_type"),
    )


def needs_interaction(call: Text) -> Column:
    """Calls other than GET and HEAD are made by somebody."""
    return ~_col(call).rlike(r"(?i)\A\s*(?:GET|HEAD)\b")


def likely_http_path(path: Text) -> Column:
    """A path from the root, or an address of the web; the root alone is none."""
    p = _col(path)
    scheme = F.lower(F.substring_index(p, "://", 1))
    return (p.startswith("/") & ~p.isin("/", "//")) | (p.contains("://") & scheme.isin("http", "https"))


#: What the last part of an HTTP client's name ends with, and the extensions of source files.
RECEIVERS = ["axios", "api", "client", "http", "request", "gateway", "service"]
SOURCES = ["java", "kt", "ts", "tsx", "js", "jsx", "properties", "yml", "yaml", "xml", "json"]
#: Parts of configuration keys that name another system.
INTEGRATIONS = ["url", "uri", "host", "kafka", "rabbit", "mq", "client", "integration", "external"]


def _any(words: list[str], test) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), test)


def likely_http_receiver(receiver: Text, classification: Text, path: Text) -> Column:
    """The receiver's last part ends like a client, or the file is one, or the path leads into an API."""
    last = F.lower(F.element_at(F.split(F.translate(_col(receiver), " \t\r\n", ""), "[.]"), -1))
    path_ = F.lower(_col(path))
    inside = path_.startswith("api/") | path_.startswith("/api/")
    return (_col(classification) == "api-client") | _any(RECEIVERS, lambda w: F.endswith(last, w)) | inside


def looks_like_source(file: Text) -> Column:
    parts = F.split(F.lower(_col(file)), "[.]")
    return (F.size(parts) > 1) & F.element_at(parts, -1).isin(*SOURCES)


def integration_signal(key: Text) -> Column:
    """A configuration key that names another system."""
    return _any(INTEGRATIONS, lambda w: F.contains(F.lower(_col(key)), w))


def handler_name(x: Text) -> Column:
    """A handler expression without its arrow head, call and braces."""
    return F.trim(_replace(_col(x), (r"\A.*?=>\s*", ""), (r"\(.*\)\z", ""), (r"[{}]", "")))


def flow_method(x: Text) -> Column:
    """The method that a flow's text ends in: 'via Type.method', else the last segment behind the last arrow."""
    via = F.regexp_extract(_col(x), r"(?i)\bvia\s+[\w$.]+\.(\w+)", 1)
    last = F.regexp_extract(F.regexp_extract(_col(x), r"(?s)((?:(?!->).)*)\z", 1), r"([^.]*)\z", 1)
    return F.when(via != "", via).otherwise(F.trim(F.regexp_replace(last, r"(?s)\(.*", "")))


def relative_source(x: Text) -> Column:
    """A mentioned path from its first src folder on, with forward slashes; null for nothing and for addresses."""
    bare = F.rtrim(F.ltrim(F.btrim(_col(x), F.lit(WHITE)), F.lit("\"'`(")), F.lit("\"'`),.:;"))
    parts = F.split(F.translate(bare, "\\", "/"), "/")
    at = F.array_position(F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.lower), "src")
    found = F.array_join(F.when(at > 1, F.slice(parts, at.cast("int"), F.size(parts))).otherwise(parts), "/")
    address = F.substring_index(bare, "://", 1).rlike(r"\A[A-Za-z]+\z") & bare.contains("://")
    return F.when((bare != "") & ~address, F.ltrim(found, F.lit("/")))


#: Types that name no data type of the application.
PLAIN_TYPES = "void boolean byte short int long float double char string integer bigdecimal uuid localdate localdatetime pageable principal authentication".split()
CONTAINERS = "responseentity list set map optional page mono flux collection".split()


def type_names(signature: Text) -> Column:
    """The distinct application types in a type expression, lower-cased, in order."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(_col(signature), F.lit(r"\b([A-Z]\w*)"), F.lit(1)), F.lower))
    drop = F.array(*[F.lit(t) for t in PLAIN_TYPES + CONTAINERS])
    return F.filter(found, lambda t: ~F.array_contains(drop, t))


# Labels and model texts --------------------------------------------------------------


def plain_label(x: Text, most: int = 220) -> Column:
    """One line without control characters and diagram directives."""
    line = F.btrim(F.regexp_replace(_col(x), r"[\p{Cntrl}\s]+", " "))
    return F.left(F.replace(F.replace(line, F.lit("%%{"), F.lit("% {")), F.lit("%% {"), F.lit("% {")), F.lit(most))


def diagram_label(x: Text) -> Column:
    return F.translate(F.regexp_replace(plain_label(x), "&", "and"), "\"`<>[{]}", "''''(())")


def sequence_label(x: Text) -> Column:
    return _replace(diagram_label(x), (":", " -"), (";", ","))


def xml_text(x: Text) -> Column:
    return _replace(_col(x), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def without_closing_tag(x: Text, tag: str) -> Column:
    """Text that can't close the tag it is put into."""
    return F.regexp_replace(_col(x), f"(?i)</(?=\\Q{tag}\\E)", r"<\\/")


def model_text(x: Text) -> Column:
    """A model's answer without its thoughts and the fence around it.

    Thoughts are what the answer begins with in think tags. A fence is a first
    line of three backticks, alone or with json, markdown or md, and a last
    line of three backticks.
    """
    begun = F.ltrim(_col(x), F.lit(WHITE))
    close = F.locate("</think>", F.lower(begun))
    thought = F.lower(begun).startswith("<think>") & (close > 0)
    said = F.btrim(F.when(thought, F.substring(begun, close + len("</think>"), F.length(begun))).otherwise(begun), F.lit(WHITE))
    lines = F.split(said, "\n")
    first, last = F.lower(F.rtrim(F.element_at(lines, 1), F.lit(WHITE))), F.element_at(lines, -1)
    fenced = (F.size(lines) > 2) & first.isin("```", "```json", "```markdown", "```md") & (last == "```")
    inside = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(fenced, F.btrim(inside, F.lit(WHITE))).otherwise(said)


def legacy_mask(x: Text) -> Column:
    """The older mask of three rules; quotes around a value go."""
    return _replace(_col(x), *OLDER_MASK_RULES)


def masks_in(x: Text) -> Column:
    """How many masked values a text holds."""
    return F.regexp_count(_col(x), F.lit(r"\[MASKED_SECRET\]")).cast("bigint")


# JSON ------------------------------------------------------------------------------------


def lenient_json(x: Text) -> Column:
    """A variant from the whole text, or else from its outermost braces; null if neither parses."""
    outermost = F.regexp_extract(_col(x), r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(F.trim(_col(x))), F.try_parse_json(outermost))


#: Keys that change from run to run and mean nothing.
VOLATILE = ["generatedAt", "createdAt", "updatedAt", "durationMs", "runId"]


def canonical_json(x: Text) -> Column:
    """An object's JSON with keys in order and without volatile ones; null if it is no object.

    Volatile are the fixed keys and all that end in InputHash or OutputHash, at
    the top level, where metadata stand.
    """
    parsed = F.from_json(_col(x), "map<string,variant>")
    kept = F.filter(F.map_entries(parsed), lambda e: ~e["key"].isin(*VOLATILE) & ~e["key"].rlike("(?:Input|Output)Hash\\z"))
    ordered = F.array_sort(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value"))))
    one = F.transform(ordered, lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(":"), e["value"]))
    fields = F.transform(one, lambda s: F.regexp_replace(s, r'\A\[("(?:[^"\\]|\\.)*")\]:', "$1:"))
    return F.when(parsed.isNotNull(), F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")))


def text_metadata(markdown: Text, name: str, schema: str) -> Column:
    """The JSON object in a document's <!-- name {...} --> comment, as a struct; null without one."""
    return F.from_json(F.nullif(F.regexp_extract(_col(markdown), f"<!--\\s*\\Q{name}\\E\\s+(\\{{[^\\r\\n]*\\}})\\s*-->", 1), F.lit("")), schema)


def as_record(value: Text) -> Column:
    """A variant that is an object, else null."""
    return F.when(F.schema_of_variant(_col(value)).startswith("OBJECT"), _col(value))


def as_strings(value: Text) -> Column:
    """A variant as an array of strings: an array's items, a single value alone, nothing for null; empty ones go."""
    v = _col(value)
    many = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<string>"))
    one = F.array(F.try_variant_get(v, "$", "string"))
    return F.filter(F.coalesce(many, one), lambda s: s.isNotNull() & (s != ""))


def identity_hash(**parts: Column) -> Column:
    """SHA-256 of the parts' JSON with keys in order; a null part is left out."""
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(parts.items())])), 256)


# Budgets -----------------------------------------------------------------------------------

#: Tokens held back, and the bounds in characters.
RESERVED, MOST_INPUT, MOST_CHUNK, CHUNK_OVERHEAD = 2048, 240_000, 180_000, 12_000
SOURCE_WINDOW, LEAST_SOURCE, WINDOWS = 60_000, 30_000, 12


def model_budget(window: Text, most_output: Text, configured: Text) -> Column:
    """(input, chunk, source) characters for a context window in tokens; null where the window is too small."""
    given = F.least(F.lit(MOST_INPUT), (_col(window) - _col(most_output) - RESERVED) * 3).cast("bigint")
    chunk = F.least(F.lit(MOST_CHUNK), given - CHUNK_OVERHEAD).cast("bigint")
    one = F.greatest(F.lit(1000), F.least(F.lit(SOURCE_WINDOW), chunk - 1000))
    source = F.least(_col(configured), F.greatest(F.lit(LEAST_SOURCE), one * WINDOWS)).cast("bigint")
    return F.when(given > 8000, F.struct(given.alias("input"), chunk.alias("chunk"), source.alias("source")))


def section_output_tokens(n_sections: Text, most: Text) -> Column:
    return F.least(_col(most), 512 + 900 * _col(n_sections)).cast("bigint")


def section_weight(heading: Text) -> Column:
    """How much room a section deserves; the first keyword decides."""
    h = F.lower(_col(heading))
    #: fixed values: weights and keywords, in order
    rules = [(6, "bff|feign|outbound|client"), (6, r"backend|\bbe\b|repository|entity|dto|validation"), (5, "flow|esles|match|trace|api"), (4, r"react|\bui\b|route|component|interaction|form|state")]
    chain = F.lit(2)
    for weight, words in reversed(rules):
        chain = F.when(h.rlike(words), weight).otherwise(chain)
    return chain.cast("bigint")
