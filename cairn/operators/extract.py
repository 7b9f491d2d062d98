"""Records from source files: classes, endpoints, calls, routes, fields, keys.

Each extractor is a projection over a file table (path, content): patterns
find the records, ``posexplode`` makes rows, and expressions read the parts.
Where brackets must match (record headers, method bodies, path expressions,
snippets), a small scanner runs on Arrow batches, one file at a time.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import batched
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from cairn.functions import calls, java, scan
from cairn.functions.labels import likely_http_path, likely_http_receiver
from cairn.functions.text import join_paths, mask_sensitive_key
from cairn.plans.durable import materialize, spread
from cairn.plans.running import as_of

if TYPE_CHECKING:
    import pandas as pd

#: Arguments in parentheses, which may hold strings and one more level of parentheses.
_ARGS = r'\(((?:[^()"]|"[^"]*"|\((?:[^()"]|"[^"]*")*\))*)\)'
CLASS = r"\b(?:class|interface|enum|record)\s+([A-Z]\w*)"


#: Annotations that constrain a field.
CONSTRAINTS = "NotNull|NotBlank|NotEmpty|Null|Size|Min|Max|DecimalMin|DecimalMax|Digits|Positive|PositiveOrZero|Negative|NegativeOrZero|Past|PastOrPresent|Future|FutureOrPresent|Pattern|Email|AssertTrue|AssertFalse|Valid"


#: How many rows a scan of files hands over at once.
ROWS = 2000


def _found(files: DataFrame, pattern: str, *keep: str) -> DataFrame:
    """One row per match: (path, keep..., ord, hit)."""
    return files.select("path", *keep, F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("ord", "hit"))


def _part(pattern: str, k: int = 1, of: str = "hit") -> Column:
    return F.nullif(F.regexp_extract(of, pattern, k), F.lit(""))


def scanned(files: DataFrame, keep: list[str], made: str, fn: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """(keep..., made...): the rows that ``fn`` makes of each file's content, in Arrow batches of at most ``ROWS`` rows."""
    out = StructType([files.schema[c] for c in keep] + list(StructType.fromDDL(made)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for batch in batches:
            rows = ((*key, *row) for *key, text in batch[[*keep, "content"]].itertuples(index=False, name=None) for row in fn(text or ""))
            for some in batched(rows, ROWS):
                yield pd.DataFrame(some, columns=out.names)

    return files.select(*keep, "content").mapInPandas(run, out)


#: Fixed values, rules in order: kind, annotations, what the type's name ends with, folder.
JAVA_KINDS = [
    ("test", "SpringBootTest|WebMvcTest|DataJpaTest|Test", "Test|Tests", "/src/test/"),
    ("controller", "RestController|Controller", "Controller", "/controller/"),
    ("service", "Service", "Service", "/service/"),
    ("repository", "Repository", "Repository", "/repository/"),
    ("entity", "Entity", "Entity", "/entity/"),
    ("config", "Configuration", "Config|Configuration", "/config/"),
    ("dto", "", "Dto|DTO|Request|Response", "/dto/"),
    ("mapper", "", "Mapper", "/mapper/"),
    ("client", "", "Client", "/client/"),
    ("exception", "", "Exception", "/exception/"),
    ("model", "", "Model", "/model/"),
    ("util", "", "Util|Utils", "/util/"),
]


def java_class(path: Column, content: Column) -> Column:
    """The kind of a Java file by its annotations, the name of its first type and its folder; the first rule that holds decides.

    Besides, what extends a repository is one, and what mentions FeignClient is a client.
    """
    folder, name = F.lower(path), F.regexp_extract(content, r"\b(?:class|interface|enum)\s+(\w+)", 1)
    chain = F.lit("unknown")
    for kind, annotations, endings, place in reversed(JAVA_KINDS):
        rule = folder.contains(place) | name.rlike(f"(?:{endings})\\z")
        if annotations:
            rule = rule | content.rlike(rf"@(?:{annotations})\b")
        if kind == "repository":
            rule = rule | content.rlike(r"\bextends\s+\w*Repository\b")
        if kind == "client":
            rule = rule | content.contains("FeignClient")
        chain = F.when(rule, kind).otherwise(chain)
    return chain


def script_class(path: Column, content: Column | None = None) -> Column:
    """The kind of a user-interface file, by path and content; pages come before clients.

    Hooks are told by their folder alone, as names are compared in lower case.
    """
    p = F.lower(path)
    name = F.regexp_extract(p, r"([^/]*)\z", 1)
    text = F.lit("") if content is None else F.coalesce(content, F.lit(""))
    among = lambda *folders: F.exists(F.array(*[F.lit(f"/{f}/") for f in folders]), lambda f: F.contains(p, f))
    has = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w))
    says = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
    tagged = text.rlike("<[A-Z]")
    typed = text.rlike(r"\b(?:type|interface)\s+[A-Z]\w") & ~text.rlike(r"<[A-Z]\w")
    return (
        F.when((name == "package.json") | name.rlike(r"(?:vite|webpack|next)\.config"), "config")
        .when(p.rlike(r"\.(?:test|spec)\.[tj]sx?\z") | p.contains("__tests__"), "test")
        .when(among("pages", "views") | path.rlike(r"Page\.[tj]sx?\z"), "page")
        .when(among("api") | p.contains("api-client") | has("axios", "fetch(", "createapi", "basequery"), "api-client")
        .when(among("routes") | text.rlike(r"<Route\s|\bconst\s+routes\s*=") | says("createBrowserRouter", "useRoutes"), "route")
        .when(among("hooks"), "hook")
        .when(among("store", "stores") | has("createslice", "configurestore", "zustand", "createstore"), "store")
        .when(among("types", "models") | typed, "model/type")
        .when(among("utils", "helpers", "lib"), "util")
        .when(tagged | text.rlike(r"\bReact\b|from\s+[\"']react[\"']"), "component")
        .otherwise("unknown")
    )


def file_index(files: DataFrame) -> DataFrame:
    """What an index keeps of scanned files (path, content, ...): everything but the content, with kind and size in bytes."""
    p, c = F.col("path"), F.coalesce("content", F.lit(""))
    kind = F.when(p.endswith(".java"), java_class(p, c)).when(p.rlike(r"\.[tj]sx?\z"), script_class(p, c))
    return files.withColumn("classification", kind).withColumn("size", F.octet_length(c).cast("bigint")).drop("content")


def stereotype(annotations: Column) -> Column:
    """The kind that a class's annotations give; the first that it has, null without one."""
    kinds = [("RestController|Controller", "controller"), ("Service", "service"), ("Repository", "repository"), ("Entity", "entity"), ("Configuration", "config"), ("FeignClient", "client"), ("ControllerAdvice|RestControllerAdvice", "exception"), ("Component", "component")]
    chain = F.lit(None).cast("string")
    for names, kind in reversed(kinds):
        chain = F.when(F.arrays_overlap(annotations, F.array(*[F.lit(n) for n in names.split("|")])), kind).otherwise(chain)
    return chain


def components(files: DataFrame) -> DataFrame:
    """At most one per Java file: class, package, annotations in order, base paths, supertypes, dependencies.

    A class that no file rule knows has the kind of its annotations.
    """
    before = F.regexp_extract("content", r"(?s)\A(.*?)\b(?:class|interface|enum|record)\s+[A-Z]", 1)
    annotations = F.array_distinct(F.regexp_extract_all(before, F.lit(r"@([A-Z]\w*)"), F.lit(1)))
    mapped = F.regexp_extract_all(F.regexp_extract(before, r"@RequestMapping\(([^)]*)\)", 1), F.lit(r'"([^"]*)"'), F.lit(1))
    bases = F.when(F.size(mapped) > 0, mapped).otherwise(F.array(F.lit("")))
    header = F.regexp_extract("content", r"\b(?:class|interface)\s+[A-Z]\w*([^{]*)\{", 1)
    name = F.nullif(F.regexp_extract("content", CLASS, 1), F.lit(""))
    injected = F.regexp_extract_all("content", F.lit(r"private\s+final\s+([A-Z]\w*)(?:<[^;]*>)?\s+\w+\s*;"), F.lit(1))
    wired = F.regexp_extract_all("content", F.lit(r"@Autowired\s+(?:private\s+)?([A-Z]\w*)"), F.lit(1))
    supers = F.filter(F.transform(F.split(F.regexp_extract(header, r"\bimplements\s+(.*)", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    return files.where("path like '%.java'").select(
        "path",
        name.alias("class_name"),
        F.regexp_extract("content", r"(?m)^\s*package\s+([\w.]+)\s*;", 1).alias("package_name"),
        F.coalesce(F.nullif(java_class(F.col("path"), F.col("content")), F.lit("unknown")), stereotype(annotations), F.lit("unknown")).alias("type"),
        annotations.alias("annotations"),
        F.nullif(F.get(bases, F.lit(0)), F.lit("")).alias("base_path"),
        bases.alias("base_paths"),
        injected.alias("constructor_dependencies"),
        wired.alias("field_dependencies"),
        supers.alias("implemented"),
        F.nullif(F.regexp_extract(header, r"\bextends\s+([A-Z]\w*(?:<[^,>]*)?)", 1), F.lit("")).alias("extended"),
    ).where("class_name is not null")


#: A mapping annotation, other annotations, modifiers, and the signature behind them.
ENDPOINT = rf"@(Get|Post|Put|Delete|Patch|Request)Mapping(?:{_ARGS})?\s*(?:@\w+(?:{_ARGS})?\s*)*(?:(?:public|protected|private|final)\s+)*(?!class\b|interface\b)([\w<>\[\], ?.]+?)\s+(\w+)\s*{_ARGS}\s*(?:throws [\w., ]+)?[{{;]"


def _mappings(files: DataFrame) -> DataFrame:
    """One row per mapping annotation of a controller with a method behind it; ``paths`` and ``methods`` hold all that it names."""
    base = components(files).where("type = 'controller'").select(F.col("path").alias("file"), "class_name", "base_path", "base_paths")
    hits = _found(files.where("path like '%.java'"), ENDPOINT)
    verb, inside = _part(ENDPOINT), F.coalesce(_part(ENDPOINT, 2), F.lit(""))
    unnamed = F.regexp_replace(inside, r'\b(?:produces|consumes|params|headers|name)\s*=\s*(?:\{[^}]*\}|"[^"]*"|[\w.]+)', "")
    own = F.regexp_extract_all(unnamed, F.lit(r'"([^"]*)"'), F.lit(1))
    named = F.array_distinct(F.regexp_extract_all(inside, F.lit(r"RequestMethod\.(\w+)"), F.lit(1)))
    methods = F.when(verb != "Request", F.array(F.upper(verb))).when(F.size(named) > 0, named).otherwise(F.array(F.lit("REQUEST")))
    rows = hits.select(F.col("path").alias("file"), "ord", methods.alias("methods"), F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(""))).alias("paths"), _part(ENDPOINT, 5).alias("handler"), F.trim(_part(ENDPOINT, 4)).alias("response_type"), F.coalesce(_part(ENDPOINT, 6), F.lit("")).alias("signature"))
    return rows.join(base, "file")


def endpoints(files: DataFrame) -> DataFrame:
    """One per mapping annotation of a controller: the first method and the first path that it names, handler, response type, parameters."""
    return _mappings(files).select("file", "ord", "class_name", F.get("methods", F.lit(0)).alias("http_method"), join_paths("base_path", F.get("paths", F.lit(0))).alias("path"), "handler", "response_type", "signature")


def all_endpoints(files: DataFrame) -> DataFrame:
    """Every base path with every path and method that a mapping names."""
    rows = _mappings(files).withColumn("base", F.explode("base_paths")).withColumn("own", F.explode("paths")).withColumn("http_method", F.explode("methods"))
    return rows.select("file", "class_name", "http_method", join_paths("base", "own").alias("path"), "handler").distinct()


def endpoint_divergence(files: DataFrame) -> DataFrame:
    """(kind, n): endpoint keys that both extractions find, only the one of first paths, only the one of all paths."""
    key = lambda df: df.select("file", "http_method", "path").distinct()
    first, every = key(endpoints(files)), key(all_endpoints(files))
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(first.intersect(every), "both").unionByName(count(first.subtract(every), "first-only")).unionByName(count(every.subtract(first), "all-only"))


def parameters(found: DataFrame) -> DataFrame:
    """Each endpoint's parameters: source by annotation, else by type (request) or unknown; name, type, required, default."""
    commas = r',(?=(?:[^"]*"[^"]*")*[^"]*\z)(?![^<]*>)(?![^(]*\))'
    pieces = F.filter(F.transform(F.split("signature", commas), lambda x: F.trim(x)), lambda x: x != "")
    hit = found.select("file", "handler", F.posexplode(pieces).alias("ord", "hit"))
    tail = r"([\w.]+(?:<.*>)?(?:\[\])?)\s+(\w+)\z"
    options = F.regexp_extract("hit", rf"@(?:PathVariable|RequestParam|RequestHeader|RequestBody){_ARGS}", 1)
    name = F.coalesce(F.nullif(F.regexp_extract(options, r'(?:\A\s*|\b(?:value|name)\s*=\s*)"([^"]*)"', 1), F.lit("")), _part(tail, 2))
    default = F.nullif(F.regexp_extract(options, r'defaultValue\s*=\s*"([^"]*)"', 1), F.lit(""))
    has = lambda a: F.col("hit").contains(f"@{a}")
    source = (
        F.when(has("PathVariable"), "path").when(has("RequestParam"), "query").when(has("RequestHeader"), "header").when(has("RequestBody"), "body")
        .when(_part(tail).rlike("(?:Servlet|Web)Request|HttpSession|Principal|Authentication"), "request").otherwise("unknown")
    )
    return hit.select("file", "handler", "ord", source.alias("source"), name.alias("name"), _part(tail).alias("type"), (~options.rlike(r"required\s*=\s*false") & default.isNull()).alias("required"), default.alias("default"))


def entities(files: DataFrame) -> DataFrame:
    """Classes with @Entity: table (an argument of @Table itself, none of a nested annotation), id field, fields, relations."""
    e = files.where(F.col("content").rlike(r"@Entity\b"))
    hidden = r"(?:private|protected)"
    relation = rf"@(?:OneToMany|ManyToOne|OneToOne|ManyToMany)\b[^;]{{0,160}}?{hidden}\s+([\w<>, ]+?)\s+(\w+)\s*[;=]"
    own = F.regexp_replace(F.regexp_extract("content", r'@Table\(((?:[^()"]|"[^"]*"|\((?:[^()]|\([^()]*\))*\))*)\)', 1), r"@\w+\((?:[^()]|\([^()]*\))*\)", "")
    return e.select(
        "path",
        F.regexp_extract("content", CLASS, 1).alias("entity"),
        F.nullif(F.regexp_extract(own, r'\bname\s*=\s*"([^"]*)"', 1), F.lit("")).alias("table_name"),
        F.nullif(F.regexp_extract("content", rf"@Id\b[^;]{{0,120}}?{hidden}\s+[\w<>]+\s+(\w+)", 1), F.lit("")).alias("id_field"),
        F.regexp_extract_all("content", F.lit(rf"{hidden}\s+(?!static)[\w<>, ]+?\s+(\w+)\s*[;=]"), F.lit(1)).alias("fields"),
        F.regexp_extract_all("content", F.lit(relation), F.lit(2)).alias("relations"),
        F.transform(F.regexp_extract_all("content", F.lit(relation), F.lit(1)), lambda t: F.regexp_extract(t, r"(\w+)>?\z", 1)).alias("targets"),
    )


def imports(files: DataFrame) -> DataFrame:
    """(from, to, path): a class and the last segment of each of its imports."""
    hits = _found(files.where("path like '%.java'").withColumn("from", F.regexp_extract("content", CLASS, 1)), r"(?m)^\s*import\s+(?:static\s+)?[\w.]+\s*;", "from")
    return hits.select("from", F.regexp_extract("hit", r"(\w+)\s*;", 1).alias("to"), "path").where("to <> '' and `from` <> ''")


def config_keys(files: DataFrame) -> DataFrame:
    """(path, key) of properties and YAML files, sensitive ones marked."""
    hits = _found(files.where(F.col("path").rlike(r"\.(properties|ya?ml)\z")), r"(?m)^\s*[\w.-]+\s*[:=]")
    return hits.select("path", mask_sensitive_key(F.regexp_extract("hit", r"([\w.-]+)", 1)).alias("key")).distinct()


def tests(files: DataFrame) -> DataFrame:
    frameworks = F.filter(F.array(*[F.when(F.col("content").contains(f), f.strip(".")) for f in ("junit", "mockito", "SpringBootTest", "WebMvcTest", "DataJpaTest")]), lambda x: x.isNotNull())
    methods = F.regexp_extract_all("content", F.lit(r"@Test\b[^;{]*?\bvoid\s+(\w+)\s*\("), F.lit(1))
    return files.where(java_class(F.col("path"), F.col("content")) == "test").select("path", F.regexp_extract("content", CLASS, 1).alias("class_name"), frameworks.alias("frameworks"), methods.alias("test_methods"))


#: Receivers whose calls are no dependencies.
IGNORED_RECEIVERS = {"this", "super", "log", "logger", "System", "Objects", "Collections", "Stream"}
ACCESS = {"public", "protected", "private"}
_BLANK = scan.re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|//[^\n]*|/\*.*?\*/", scan.re.DOTALL)


def _method_calls(text: str) -> list[tuple]:
    """(class, method, at, receiver, its type, target) of the calls in method bodies, by braces; strings and comments hold none."""
    first = scan.re.search(CLASS, text)
    if not first:
        return []
    found = java.Source(text).declarations
    code = _BLANK.sub(lambda m: " " * len(m[0]), text)
    raw = lambda t: t.split("<")[0].strip()
    constructed = {d.owner: {p.name: raw(p.type) for p in d.parameters} for d in found if d.kind == "method" and not d.type and d.name == d.owner.rpartition(".")[2]}
    fields: dict[str, dict[str, str]] = {}
    for d in found:
        if d.kind == "field" and d.type[:1].isupper():
            fields.setdefault(d.owner, {})[d.name] = raw(d.type)
    out = []
    for d in found:
        if d.kind != "method" or not d.body or not d.type or not d.modifiers & ACCESS:
            continue
        types = {}
        owner = d.owner
        while True:  # a nested type sees what the types around it have
            types = fields.get(owner, {}) | constructed.get(owner, {}) | types
            if not owner:
                break
            owner = owner.rpartition(".")[0]
        for m in scan.re.finditer(r"\b([A-Za-z_]\w*)\s*\.\s*([A-Za-z_]\w*)\s*\(", code[d.body[0] : d.body[1]]):
            if m[1] not in IGNORED_RECEIVERS:
                kind = types.get(m[1]) or (m[1] if m[1][0].isupper() else None)
                out.append((first[1], d.name, d.body[0] + m.start(), m[1], kind, m[2], "high" if kind else "medium"))
    return out


def method_calls(files: DataFrame) -> DataFrame:
    """(path, class_name, method, ord, receiver, receiver_type, target, confidence): calls on a receiver, by the method whose braces hold them.

    Methods of nested types count, those without an access modifier don't.
    ``ord`` is the call's offset. Types come from fields of any visibility, then
    the constructor's parameters; a receiver with a capital is its own type.
    """
    made = "class_name string, method string, ord int, receiver string, receiver_type string, target string, confidence string"
    return scanned(files.where("path like '%.java'"), ["path"], made, _method_calls)


def repository_methods(files: DataFrame) -> DataFrame:
    """@Query methods (high) and derived ones (medium), with the entity of the generic supertype."""
    entity = F.nullif(F.regexp_extract("content", r"extends\s+\w*Repository<\s*(\w+)", 1), F.lit(""))
    repos = files.where(java_class(F.col("path"), F.col("content")) == "repository").withColumn("entity", entity).withColumn("repository", F.regexp_extract("content", CLASS, 1))
    query = _found(repos, r'@Query\([^"]*"([^"]*)"[^)]*\)\s*[\w<>, ]+\s+(\w+)\s*\(', "entity", "repository")
    asked = query.select("path", "repository", "entity", F.regexp_extract("hit", r"(\w+)\s*\(\z", 1).alias("method"), F.regexp_extract("hit", r'"([^"]*)"', 1).alias("query"), F.lit("high").alias("confidence"))
    derived = _found(repos, r"\b(?:find|exists|count|delete)\w*By\w+\s*\(", "entity", "repository")
    derived = derived.select("path", "repository", "entity", F.regexp_extract("hit", r"(\w+)", 1).alias("method"), F.lit(None).cast("string").alias("query"), F.lit("medium").alias("confidence"))
    return asked.unionByName(derived.join(asked.select("path", "method"), ["path", "method"], "left_anti"))


def validations(files: DataFrame) -> DataFrame:
    """(path, class_name, field, annotation): each constraint of each field or parameter, also where several stand in a row."""
    named = files.withColumn("class_name", F.regexp_extract("content", CLASS, 1))
    pattern = rf"@({CONSTRAINTS})\b(?:{_ARGS})?(?=\s*(?:@\w+(?:{_ARGS})?\s*)*(?:(?:private|protected|public|final)\s+)*[\w.]+(?:<[^;(){{}}]*>)?(?:\[\])?\s+(\w+))"
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all("content", F.lit(pattern), F.lit(4)).alias("f"))
    hits = named.select("path", "class_name", F.explode(both).alias("h"))
    return hits.select("path", "class_name", F.col("h.f").alias("field"), F.col("h.a").alias("annotation"))


def exceptions(files: DataFrame) -> DataFrame:
    """Advices, exception classes, handlers and throws."""
    named = files.withColumn("class_name", F.regexp_extract("content", CLASS, 1))
    row = lambda df, kind, detail: df.select("path", "class_name", F.lit(kind).alias("type"), detail.alias("detail"))
    out = row(named.where(F.col("content").rlike("@(Rest)?ControllerAdvice")), "advice", F.col("class_name"))
    out = out.unionByName(row(named.where(F.col("content").rlike(r"class\s+\w*Exception\s+extends")), "exception", F.col("class_name")))
    out = out.unionByName(row(_found(named, r"@ExceptionHandler\(([^)]*)\)", "class_name"), "handler", F.regexp_extract("hit", r"(\w+)\.class", 1)))
    return out.unionByName(row(_found(named, r"throw\s+new\s+\w+", "class_name"), "throw", F.regexp_extract("hit", r"(\w+)\z", 1)))


def _members(text: str) -> list[tuple]:
    """(class, ord, field, type, validations) of a data type's fields and record components."""
    out = []
    annotation = scan.re.compile(r"@(\w+)\s*(\()?")
    found = scan.re.search(r"\b(class|record)\s+([A-Z]\w*)", text)
    if not found:
        return out
    kind, name = found.groups()
    opened = text.find("(" if kind == "record" else "{", found.end())
    if opened < 0:
        return out
    body = text[opened + 1 : scan.close_of(text, opened) - 1]
    parts = scan.split_top(body, ",", angles=True) if kind == "record" else [p for p in scan.split_top(body, ";") if not p.rstrip().endswith("}")]
    for part in parts:
        part, validations = part.split("}")[-1] if kind == "class" else part, []
        while m := annotation.search(part):
            end = scan.close_of(part, m.end() - 1) if m[2] else m.end()
            if scan.re.fullmatch(CONSTRAINTS, m[1]):
                validations.append(m[1])
            part = part[: m.start()] + part[end:]
        declared = scan.re.fullmatch(r"(?:(?:private|protected|public|final)\s+)*([\w.]+(?:<.*>)?(?:\[\])?)\s+(\w+)(?:\s*=.*)?", part.strip(), scan.re.DOTALL)
        if declared and "static" not in part:
            out.append((name, len(out), declared[2], declared[1], validations))
    return out


def dtos(files: DataFrame) -> DataFrame:
    """(path, class_name, ord, field, type, validations) of data types, told by folder or name: fields of classes, components of records."""
    name = F.regexp_extract("path", r"([^/]*)\.java\z", 1)
    chosen = files.where("path like '%.java'").where(F.lower("path").rlike("/(dtos?|requests?|responses?|payloads?|models?)/") | name.rlike("(Dto|DTO|Request|Response|Command|Query|Payload)\\z"))
    return scanned(chosen, ["path"], "class_name string, ord int, field string, type string, validations array<string>", _members)


def method_ranges(files: DataFrame) -> DataFrame:
    """(path, method, start, stop, start_line): each method with a body, by matching braces."""
    rows = lambda text: [(n, a, b, scan.line_of(text, a)) for n, a, b in scan.java_methods(text)]
    return scanned(files.where("path like '%.java'"), ["path"], "method string, start int, stop int, start_line int", rows)


def _feign_calls(source: java.Source) -> list[tuple]:
    """(at, method, http_method, path) of the mapped methods of a declarative client."""
    out = []
    for d in source.declarations if "@FeignClient" in source.text else []:
        for a in d.annotations if d.kind == "method" else []:
            if a.name.removesuffix("Mapping").upper() in ("GET", "POST", "PUT", "PATCH", "DELETE") and a.name.endswith("Mapping"):
                paths = a.values.get("") or a.values.get("value") or a.values.get("path") or ["/"]
                out.append((d.start, d.name, a.name.removesuffix("Mapping").upper(), paths[0]))
    return out


def _outbound_calls(text: str) -> Iterator[tuple]:
    """The outbound calls of one file, which is read once for all their forms."""
    chains, templates = calls.fluent_calls(text), calls.template_calls(text)
    if not (chains or templates or "@FeignClient" in text):
        return
    source = java.Source(text)
    client = (scan.re.search(r"\b(?:class|interface)\s+(\w+)", text) or [None, "UnknownClient"])[1]
    inside = java.innermost([(*d.body, d.name) for d in source.declarations if d.kind == "method" and d.body])
    line = lambda at: source.place(at)[0]
    assigned: dict[str, list[tuple[int, str]]] = {}
    if any(path is None for _, _, path, *_ in chains):
        for at, name, path in sorted(calls.assigned_paths(text)):
            assigned.setdefault(name, []).append((at, path))
    for at, verb, path, name, headers, body in chains:
        if path is None:
            before = assigned.get(name, [])
            k = bisect_right(before, at, key=lambda p: p[0])
            path = before[k - 1][1] if k else None
        if path is not None:
            yield client, at, line(at), inside(at), verb, path, headers, body, "high"
    for at, name, verb, path in _feign_calls(source):
        yield client, at, line(at), name, verb, path, None, None, "high"
    for at, _, verb, path in templates:
        yield client, at, line(at), inside(at), verb, path, None, None, "low" if "{param}" in path else "medium"


def outbound_calls(files: DataFrame) -> DataFrame:
    """Declarative clients, fluent chains and RestTemplate calls: (path, client, ord, line, method, http_method, target_path, headers, body, confidence).

    A chain's path is a literal in uri(), what a builder's steps give, or the
    last path that its variable was assigned before the call in the file.
    Headers and body are those set before the exchange. ``method`` is the one
    around the call; ``ord`` its offset.
    """
    made = "client string, ord int, line int, method string, http_method string, target_path string, headers array<string>, body string, confidence string"
    return scanned(files.where("path like '%.java'"), ["path"], made, _outbound_calls)


def routes(files: DataFrame) -> DataFrame:
    """<Route path element> (high) and route objects (medium); the component is the innermost one named."""
    scripts = files.where(F.col("path").rlike(r"\.[jt]sx?\z"))
    element = r'<Route\b[^>]*?path="([^"]*)"[^>]*?element=\{(.*?)\}\s*/?>'
    jsx = _found(scripts, element).select("path", _part(element).alias("route"), F.element_at(F.regexp_extract_all("hit", F.lit(r"<([A-Z]\w*)"), F.lit(1)), -1).alias("component"), F.lit("high").alias("confidence"))
    objects = r"path:\s*['\"]([^'\"]*)['\"]\s*,\s*(?:element|component):\s*<?([A-Z]\w*)"
    return jsx.unionByName(_found(scripts, objects).select("path", _part(objects).alias("route"), _part(objects, 2).alias("component"), F.lit("medium").alias("confidence")))


_SCRIPT = r"\.[jt]sx?\z"
def constants(files: DataFrame) -> DataFrame:
    """(path, name, value): string constants of a script and, as object.member, those in objects; values are expressions."""
    scripts = files.where(F.col("path").rlike(_SCRIPT))
    plain = r"\bconst\s+([A-Za-z_$][\w$]*)\s*(?::\s*\w+\s*)?=\s*((?:[\w.$]+\s*(?:\?\?|\+)\s*)*(?:['\"][^'\"]*['\"]|`[^`]*`)(?:\s*\+\s*(?:['\"][^'\"]*['\"]|[\w.$]+))*)"
    own = _found(scripts, plain).select("path", _part(plain).alias("name"), F.trim(_part(plain, 2)).alias("value"))
    table = r"\bconst\s+([A-Za-z_$][\w$]*)\s*(?::\s*[\w<>, ]+\s*)?=\s*\{([^{}]*)\}"
    member = r"([A-Za-z_$][\w$]*)\s*:\s*(['\"][^'\"]*['\"]|`[^`]*`)"
    objects = _found(scripts, table).select("path", _part(table).alias("object"), F.explode(F.regexp_extract_all(_part(table, 2), F.lit(member), F.lit(0))).alias("hit"))
    return own.unionByName(objects.select("path", F.concat_ws(".", "object", _part(member)).alias("name"), _part(member, 2).alias("value")))


def import_aliases(files: DataFrame) -> DataFrame:
    """(path, alias, name) of imported names; the alias is the name where none is given."""
    scripts = files.where(F.col("path").rlike(_SCRIPT))
    names = _found(scripts, r"\bimport\s+(?:\w+\s*,\s*)?\{[^}]*\}").select("path", F.explode(F.split(F.regexp_extract("hit", r"\{([^}]*)\}", 1), ",")).alias("hit"))
    name, alias = _part(r"\A\s*([\w$]+)"), _part(r"\bas\s+([\w$]+)")
    return names.select("path", F.coalesce(alias, name).alias("alias"), name.alias("name")).where("name is not null")


def shared_constants(files: DataFrame) -> DataFrame:
    """(name, value) of constants that have one value in all files."""
    from cairn.operators.match import unique_value

    return unique_value(constants(files), "name", "value")


def known_values(files: DataFrame) -> DataFrame:
    """(path, name, value): what each file's names mean: its own constants, then imported ones that have one value everywhere."""
    from cairn.operators.match import unique_value

    every = materialize(constants(files), "constants")  # the patterns go over the files once
    own = every.groupBy("path", "name").agg(F.min("value").alias("value"), F.lit(0).alias("rank"))
    shared = unique_value(every, "name", "value").withColumn("head", F.regexp_extract("name", r"\A([^.]*)", 1))
    imported = import_aliases(files).withColumnRenamed("name", "head").join(shared, "head")
    imported = imported.select("path", F.concat("alias", F.regexp_extract("name", r"\A[^.]*(.*)", 1)).alias("name"), "value", F.lit(1).alias("rank"))
    # what an imported constant refers to is read in its own file's terms, by shared names
    behind = shared.select(F.col("name"), "value", F.lit(2).alias("rank"))
    first = materialize(own.unionByName(imported), "known")
    named = first.withColumn("refers", F.explode_outer(F.regexp_extract_all("value", F.lit(r"([A-Za-z_$][\w.$]*)"), F.lit(1))))
    further = named.join(behind.select(F.col("name").alias("refers"), F.col("value").alias("v2")), "refers").select("path", F.col("refers").alias("name"), F.col("v2").alias("value"), F.lit(2).alias("rank"))
    return first.unionByName(further).groupBy("path", "name").agg(F.min_by("value", F.struct("rank", "value")).alias("value"))


def _placed_calls(text: str) -> Iterator[tuple]:
    """(at, function, receiver, http_method, expression, options, confidence, target, open): calls with the last function whose head ends before them.

    ``target`` is the path without a known name, ``open`` whether names were asked for.
    """
    found = calls.script_calls(text)
    heads = calls.script_functions(text) if found else []
    asked: list[str] = []
    for at, receiver, verb, expression, *rest in found:
        k = bisect_right(heads, at, key=lambda h: h[0])
        asked.clear()
        target = scan.resolve_path(expression, asked.append)
        yield (at, heads[k - 1][1] if k else None, receiver, verb, expression, *rest, target, bool(asked))


def _with_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (path, expression, target, ...) with the targets that their file's names (path, name, value) give; each file's calls and names meet once."""
    kept = [c for c in rows.columns if c != "target"]
    of_file = rows.groupBy("path").agg(F.collect_list(F.struct(*kept)).alias("rows"))
    names = known.groupBy("path").agg(F.collect_list("name").alias("names"), F.collect_list("value").alias("values"))
    joined = of_file.join(names, "path", "left").select("rows", F.col("rows")["expression"].alias("expressions"), "names", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for expressions, keys, given in zip(*[batch.column(c).to_pylist() for c in ("expressions", "names", "values")], strict=True):
                values = dict(zip(keys or [], given or [], strict=True))
                made.append([scan.resolve_path(e, values.get) for e in expressions])
            yield pa.RecordBatch.from_arrays([batch.column("rows"), pa.array(made, pa.list_(pa.string()))], names=["rows", "targets"])

    found = joined.mapInArrow(run, StructType([joined.schema["rows"]]).add("targets", ArrayType(StringType())))
    return found.select(F.inline(F.arrays_zip("rows", "targets"))).select("rows.*", F.col("targets").alias("target")).select(*rows.columns)


def api_calls(files: DataFrame) -> DataFrame:
    """(path, ord, function, http_method, target, expression, parameters, confidence): HTTP calls with what is known of their path.

    ``ord`` is the call's offset. ``function`` is the last one whose head ends
    before the call; ``parameters`` are at most 20 names in the path and in all
    of the call: options, bodies, headers. Only calls whose path has names meet
    the constants of their file.
    """
    scripts = files.where(F.col("path").rlike(_SCRIPT))
    kinds = scripts.withColumn("classification", script_class(F.col("path"), F.col("content")))
    made = "ord int, function string, receiver string, http_method string, expression string, options array<string>, confidence string, target string, open boolean"
    found = materialize(scanned(kinds, ["path", "classification"], made, _placed_calls), "calls")
    rows = found.where("not open").unionByName(_with_known(found.where("open"), known_values(scripts)))
    placed = rows.where(likely_http_path("target") & (F.col("receiver").isNull() | likely_http_receiver("receiver", "classification", "target")))
    names = F.filter(F.regexp_extract_all("target", F.lit(r"\{([^}]+)\}"), F.lit(1)), lambda x: x != "param")
    parameters_ = F.slice(F.array_distinct(F.concat(names, "options")), 1, 20)
    return placed.select("path", "ord", "function", "http_method", "target", "expression", parameters_.alias("parameters"), "confidence")


def api_consumers(files: DataFrame, functions: DataFrame, owners: DataFrame, components_of: DataFrame, most: int = 20) -> DataFrame:
    """(function, consumers): who calls each function (function), at most ``most``, in name order.

    Files of pages, components, hooks and stores are cut into the names that
    they call, which meet the functions by an equi-join. A file's consumers are
    its components (path, component), each as the page that alone owns it
    (``owners``: node, owner), or the file where it has none.
    """
    kinds = script_class(F.col("path"), F.col("content"))
    named = files.where(kinds.isin("page", "component", "hook", "store")).select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_$][\w$]*)\s*\("), F.lit(1)))).alias("function"))
    calls = named.join(functions.select("function").distinct(), "function")
    who = calls.join(components_of.select("path", "component"), "path", "left").join(owners.select(F.col("node").alias("component"), "owner"), "component", "left")
    return who.groupBy("function").agg(F.slice(F.array_sort(F.collect_set(F.coalesce("owner", "component", "path"))), 1, most).alias("consumers"))


def ui_components(files: DataFrame, found_routes: DataFrame) -> DataFrame:
    """(path, ord, component, classification, route, export, children, imports, props_type, confidence) of pages', components' and routes' files.

    A component is a page if it is routed, or the main one of a page's file:
    called like the file, ending in Page, or alone there.
    """
    kinds = files.where(F.col("path").rlike(_SCRIPT)).withColumn("kind", script_class(F.col("path"), F.col("content"))).where(F.col("kind").isin("page", "component", "route"))
    made = "ord int, component string, export string, children array<string>, imports array<string>, props_type string"
    base = F.regexp_extract("path", r"([^/]*)\.[tj]sx?\z", 1)
    rows = scanned(kinds, ["path", "kind"], made, calls.script_components).withColumn("base", base)
    named = rows.withColumn("component", F.coalesce("component", F.when(F.col("base").rlike(r"\A[A-Z]\w*\z"), F.col("base")))).where("component is not null")
    # a file's components come together once, so that no scan is made twice
    named = spread(named.withColumn("children", F.array_remove("children", F.col("component"))), "path").dropDuplicates(["path", "component"])
    alone = F.count(F.lit(1)).over(Window.partitionBy("path")) == 1
    last = found_routes.groupBy("component").agg(F.max("route").alias("route"))
    joined = named.withColumn("alone", alone).join(last, "component", "left")
    main = (F.col("kind") == "page") & ((F.col("component") == F.col("base")) | F.col("component").endswith("Page") | F.col("alone"))
    kind, level = F.when(main | F.col("route").isNotNull(), "page").otherwise("component"), F.when(F.col("route").isNotNull(), "high").otherwise("medium")
    return joined.select("path", "ord", "component", kind.alias("classification"), "route", "export", "children", "imports", "props_type", level.alias("confidence"))


def interactions(files: DataFrame, found_components: DataFrame | None = None) -> DataFrame:
    """(path, ord, element, event, handler, label): elements with a handler and submitted forms.

    With components (path, ord, component, classification) their owner is told
    too (``component``; ``page`` if that is one): the file's page, else its
    first component; records of files without any go.
    """
    rows = scanned(files, ["path"], "ord int, element string, event string, handler string, label string", calls.interactions)
    if found_components is None:
        return rows
    first = F.struct(F.when(F.col("classification") == "page", 0).otherwise(1).alias("rank"), "ord", "component")
    owners = found_components.groupBy("path").agg(F.min(first).alias("o"))
    owner = F.col("o.component")
    return rows.join(owners, "path").select(*rows.columns, owner.alias("component"), F.when(F.col("o.rank") == 0, owner).alias("page"))


def state_hooks(files: DataFrame) -> DataFrame:
    """(path, ord, state, setter, initial): useState as it is; a reducer's initial object as one state.field row a field."""
    pattern = r"const\s+\[\s*(\w+)\s*,\s*(\w+)\s*\]\s*=\s*(?:React\.)?use(State|Reducer)(?:<[^>]*>)?\(([^()]*)\)"
    hooks = _found(files, pattern, "content").select("path", "ord", "content", _part(pattern).alias("state"), _part(pattern, 2).alias("setter"), _part(pattern, 3).alias("kind"), F.trim(_part(pattern, 4)).alias("given"))
    plain = hooks.where("kind = 'State'").select("path", "ord", "state", "setter", F.col("given").alias("initial"))
    second = F.trim(F.regexp_extract("given", r"\A[^,]*,\s*(.*)\z", 1))
    named = F.expr(r"regexp_extract(content, concat('const\\s+', second, '\\s*(?::[^=]*)?=\\s*(\\{[^{}]*\\})'), 1)")
    reducers = hooks.where("kind = 'Reducer'").withColumn("second", second).withColumn("object", F.when(F.col("second").startswith("{"), F.col("second")).when(F.col("second").rlike(r"\A\w+\z"), named))
    field = r"(\w+)\s*:\s*([^,{}]+)"
    fields = reducers.select("path", "ord", "state", "setter", F.explode(F.regexp_extract_all("object", F.lit(field), F.lit(0))).alias("hit"))
    return plain.unionByName(fields.select("path", "ord", F.concat_ws(".", "state", _part(field)).alias("state"), "setter", F.trim(_part(field, 2)).alias("initial")))


def form_fields(files: DataFrame, found_components: DataFrame | None = None, owners: DataFrame | None = None) -> DataFrame:
    """Fields by name attribute, registration, controlled value, label or id: (path, ord, field, source[, page]).

    With components (path, component, classification) and unique owners (node,
    owner) the page is the one in the file, else the only page that reaches a
    component of the file, else null.
    """
    tag = r"<(?:input|select|textarea|Field|Controller|TextField)\b[^>]*>"
    rules = [("name", r'\bname="([^"]*)"'), ("register", r"""\bregister\(\s*['"]([^'"]*)"""), ("controlled", r"\b(?:value|checked)=\{([\w.]+)"), ("aria-label", r'\baria-label="([^"]*)"'), ("id", r'\bid="([^"]*)"(?=[^>]*\bonChange=)')]
    found = _found(files, tag)
    source = F.coalesce(*[F.when(_part(p).isNotNull(), F.lit(kind)) for kind, p in rules])
    fields = found.select("path", "ord", F.coalesce(*[_part(p) for _, p in rules]).alias("field"), source.alias("source")).where("field is not null")
    return fields if found_components is None else with_page(fields, found_components, owners)


def with_page(rows: DataFrame, found_components: DataFrame, owners: DataFrame) -> DataFrame:
    """``rows`` of files (path) with ``page``: a page component of the file, else the only page that reaches one of its components."""
    direct = found_components.where("classification = 'page'").groupBy("path").agg(F.min("component").alias("__direct"))
    reached = found_components.join(owners.select(F.col("node").alias("component"), "owner"), "component").groupBy("path").agg(F.min("owner").alias("__owner"), F.max("owner").alias("__last"))
    joined = rows.join(direct, "path", "left").join(reached, "path", "left")
    page = F.coalesce("__direct", F.when(F.col("__owner") == F.col("__last"), F.col("__owner")))
    return joined.withColumn("page", page).drop("__direct", "__owner", "__last")


def snippets(files: DataFrame, wanted: DataFrame, most: int = 5000, before: int = 0, after: int = 0) -> DataFrame:
    """(wanted..., code, confidence, uncertainty) for ``wanted`` (path, group, symbol, ...).

    A symbol's declaration by matching braces is exact (high); else a window
    around its first mention, ``before`` and ``after`` characters, is taken if
    one is asked for (medium); else the row says what is missing. Long code is cut, with a mark.
    """
    joined = wanted.join(files.select("path", "content"), "path", "left")
    out = StructType([*wanted.schema.fields]).add("code", "string").add("confidence", "string").add("uncertainty", "string")
    keep = wanted.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for batch in batches:
            made = []
            for symbol, text in zip(batch["symbol"], batch["content"], strict=True):
                span = scan.declaration(text, symbol) if text else None
                at = text.find(symbol) if text else -1
                level, why = "high", None
                if span is None and at >= 0 and before + after:
                    span, level = (max(0, at - before), min(len(text), at + after)), "medium"
                if span is None:
                    made.append((None, "low", f"{symbol} is not visible" if text else "the file is missing"))
                    continue
                code = text[span[0] : span[1]]
                made.append((code if len(code) <= most else code[:most] + "\n[SNIPPET_TRUNCATED]", level, why))
            yield pd.concat([batch[keep].reset_index(drop=True), pd.DataFrame(made, columns=["code", "confidence", "uncertainty"])], axis=1)

    return joined.select(*keep, "content").mapInPandas(run, out)
