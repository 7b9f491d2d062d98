"""Endpoints by the syntax of Java files: nested classes, all paths and methods, validation and security, ranges."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.java import SMALL, Annotation, Declaration, Parameter, Source
from cairn.operators import extract
from cairn.operators.extract import scanned

#: Annotations of mappings, of validation, of security, and of a parameter's source.
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE"}
VALIDATION = set(
    "Valid Validated NotNull NotBlank NotEmpty Size Min Max Positive PositiveOrZero Negative NegativeOrZero Email Pattern Past PastOrPresent Future FutureOrPresent AssertTrue AssertFalse".split()
)
SECURITY = {"PreAuthorize", "PostAuthorize", "Secured", "RolesAllowed"}
SOURCES = {"PathVariable": "path", "RequestParam": "query", "RequestHeader": "header", "RequestBody": "body"}

ENDPOINT = (
    "class_name string, handler string, http_method string, endpoint string, response_type string, "
    "parameters array<struct<source:string,name:string,type:string,required:boolean,default:string,validations:array<string>>>, "
    "annotations array<string>, validations array<string>, security array<string>, start_line int, start_column int, end_line int, end_column int, confidence string"
)


def _paths(annotation: Annotation | None) -> list[str]:
    values = annotation.values if annotation else {}
    return list(dict.fromkeys(values.get("path") or values.get("value") or values.get("") or [""]))


def _methods(annotation: Annotation) -> list[str]:
    if annotation.name in MAPPINGS:
        return [MAPPINGS[annotation.name]]
    named = [v.rpartition("RequestMethod.")[2] for v in annotation.values.get("method", []) if "RequestMethod." in v]
    return list(dict.fromkeys(named)) or ["REQUEST"]


def _parameter(p: Parameter) -> tuple:
    given = next((a for a in p.annotations if a.name in SOURCES), Annotation("", {}))
    first = lambda key: (given.values.get(key) or [None])[0]
    required = first("required")
    return SOURCES.get(given.name, "request"), first("name") or first("value") or first("") or p.name, p.type, None if required is None else required != "false", first("defaultValue"), [a.name for a in p.annotations if a.name in VALIDATION]


def _endpoints(text: str) -> Iterator[tuple]:
    if "Mapping" not in text:
        return
    source = Source(text)
    # those of a large file are read twice rather than held
    declarations = source.read if len(text) > SMALL else lambda: source.declarations
    controllers: dict[str, Declaration] = {}
    for d in declarations():
        if d.kind == "class" and {"RestController", "Controller"} & {a.name for a in d.annotations}:
            controllers[f"{d.owner}.{d.name}" if d.owner else d.name] = d
    for d in declarations():
        owner = controllers.get(d.owner)
        mapped = [a for a in d.annotations if a.name in MAPPINGS or a.name == "RequestMapping"] if owner and d.kind == "method" else []
        if not mapped:
            continue
        around, own = [a.name for a in owner.annotations], [a.name for a in d.annotations]
        parameters = [_parameter(p) for p in d.parameters]
        checks = [n for n in around + own if n in VALIDATION] + [n for p in parameters for n in p[5]]
        guards = [n for n in around + own if n in SECURITY]
        bases = _paths(next((a for a in owner.annotations if a.name == "RequestMapping"), None))
        place = (*source.place(d.start), *source.place(d.stop))
        for a in mapped:
            joined = dict.fromkeys("/" + "/".join(x for x in f"{b}/{p}".split("/") if x) for b in bases for p in _paths(a))
            for verb in _methods(a):
                for path in joined:
                    yield d.owner, d.name, verb, path, d.type, parameters, own, list(dict.fromkeys(checks)), list(dict.fromkeys(guards)), *place, "high" if source.sound else "medium"


def endpoints(files: DataFrame) -> DataFrame:
    """(path, class_name, handler, http_method, endpoint, ...) of controllers, nested ones too, with the cross product of all paths and methods.

    Lines and columns count from 1, the end is the place behind the closing
    brace. A file whose brackets don't match has medium confidence. Files
    where the syntax shows no endpoint but patterns do give those, with
    ``parser`` 'pattern' and medium confidence.
    """
    java = files.where("path like '%.java'")
    found = scanned(java, ["path"], ENDPOINT, _endpoints).withColumn("parser", F.lit("syntax"))
    others = extract.endpoints(java).select(F.col("file").alias("path"), "class_name", "handler", "http_method", F.col("path").alias("endpoint"), "response_type")
    others = others.join(found.select("path").distinct(), "path", "left_anti").withColumn("confidence", F.lit("medium")).withColumn("parser", F.lit("pattern"))
    return found.unionByName(others, allowMissingColumns=True)


def divergence(files: DataFrame) -> DataFrame:
    """(path, syntax_only, pattern_only): files where syntax and patterns differ, with the numbers of endpoints that only one finds."""
    java = files.where("path like '%.java'")
    one = scanned(java, ["path"], ENDPOINT, _endpoints).select("path", "http_method", "endpoint").distinct()
    two = extract.endpoints(java).select(F.col("file").alias("path"), "http_method", F.col("path").alias("endpoint")).distinct()
    key = ["path", "http_method", "endpoint"]
    only = one.join(two, key, "left_anti").select("path", F.lit(1).alias("s"), F.lit(0).alias("p")).unionByName(two.join(one, key, "left_anti").select("path", F.lit(0).alias("s"), F.lit(1).alias("p")))
    return only.groupBy("path").agg(F.sum("s").alias("syntax_only"), F.sum("p").alias("pattern_only"))
