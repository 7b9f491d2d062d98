"""Flows through the layers: lookups that may be ambiguous, containment joins, service flows, evidence, diagrams.

Names that have to contain one another meet by the rarest three characters of
the one that is contained, so that a containment join is an equi-join and no
nested loop, also where all names begin alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.labels import page_context, plain_label
from cairn.functions.text import alnum_name, last_segment, stem_name
from cairn.operators.graph import reachable
from cairn.operators.match import flow_confidence
from cairn.operators.select import first_wins, messages, top_k
from cairn.plans.durable import materialize, spread
from cairn.plans.running import numbered

GRAM = 3
#: How many pairs of rows a part of a class makes, and how many pages travel in one row.
PAIRS, CHUNK = 4_000_000, 2_000


# Lookups --------------------------------------------------------------------------------


def resolved_flow(matches: DataFrame, flows: DataFrame) -> DataFrame:
    """(match_ord, flow_ord, ambiguous): the flow with a match's endpoint; among several the only one with its controller and handler.

    ``matches`` (match_ord, endpoint, controller, handler), ``flows`` (flow_ord,
    endpoint, controller, handler). Flows are counted by key before the join.
    """
    by_endpoint = flows.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"), F.min("flow_ord").alias("only"))
    names = [alnum_name(c).alias(c) for c in ("controller", "handler")]
    exact = flows.select("endpoint", *names, "flow_ord").groupBy("endpoint", "controller", "handler").agg(F.count(F.lit(1)).alias("n2"), F.min("flow_ord").alias("only2"))
    m = matches.select("match_ord", "endpoint", *names)
    joined = m.join(by_endpoint, "endpoint", "left").join(exact, ["endpoint", "controller", "handler"], "left")
    flow = F.when(F.col("n") == 1, F.col("only")).when(F.col("n2") == 1, F.col("only2"))
    return joined.select("match_ord", flow.alias("flow_ord"), (F.coalesce("n", F.lit(0)) > 1).__and__(flow.isNull()).alias("ambiguous"))


def first_of_either(rows: DataFrame, others: DataFrame, keys: list[tuple[str, str]], ordinal: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of the first of ``others`` that agrees in any of the key pairs (own column, other's column)."""
    out = rows
    for k, (own, other) in enumerate(keys):
        best = others.where(F.col(other).isNotNull()).groupBy(F.col(other).alias(own)).agg(F.min(F.struct(F.col(ordinal).alias("o"), F.col(value).alias("v"))).alias(f"__{k}"))
        out = out.join(best, own, "left")
    least = F.array_min(F.filter(F.array(*[F.col(f"__{k}") for k in range(len(keys))]), lambda x: x.isNotNull()))
    return out.withColumn(value, least["v"]).drop(*[f"__{k}" for k in range(len(keys))])


def looked_up(rows: DataFrame, table: DataFrame, tiers: list[list[str]], value: str) -> DataFrame:
    """``rows`` with ``value`` from ``table`` by the first tier of columns that finds one; the least value where several do."""
    out = rows
    for k, tier in enumerate(tiers):
        out = out.join(table.groupBy(*tier).agg(F.min(value).alias(f"__{k}")), tier, "left")
    return out.withColumn(value, F.coalesce(*[f"__{k}" for k in range(len(tiers))])).drop(*[f"__{k}" for k in range(len(tiers))])


def entity_of(repositories: DataFrame, entities: DataFrame) -> DataFrame:
    """(repository, entity): the entity of the generic supertype, as the index spells it, else the one that the repository's name starts with."""
    index = entities.select(alnum_name("entity").alias("key"), F.col("entity").alias("known")).groupBy("key").agg(F.min("known").alias("known"))
    generic = alnum_name(last_segment(F.col("generic")))
    stem = alnum_name(F.regexp_replace("repository", "(?i)repository\\z", ""))
    one = repositories.withColumn("key", F.nullif(generic, F.lit(""))).join(index, "key", "left").withColumnRenamed("known", "by_generic").drop("key")
    two = one.withColumn("key", stem).join(index, "key", "left")
    return two.select("repository", F.when(F.col("generic").isNotNull(), F.coalesce("by_generic", last_segment(F.col("generic")))).otherwise(F.col("known")).alias("entity"))


# Containment ------------------------------------------------------------------------------


def _grams(name: Column, n: int) -> Column:
    cut = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda k: F.substring(name, k, F.lit(n))))
    return F.when(F.length(name) >= n, cut).otherwise(F.array().cast("array<string>"))


def containing(names: DataFrame, needles: DataFrame, strict: bool = True, share: int = 10_000) -> DataFrame:
    """(names..., needles...) where the name contains the needle, by an equi-join on the needle's rarest gram.

    ``names`` has a column ``name``, ``needles`` one ``needle``. It is counted
    first how many different names hold each gram of a needle; the needle then
    looks only at the names with its rarest one, and needles with a gram that
    no name has look at none. Needles of less than three characters are their
    own grams. A gram that more than ``share`` names hold is salted: its names
    are dealt over parts, each of which its needles visit. An empty needle is
    in every name only if not ``strict``; nulls contain nothing.
    """
    asked = needles.select("needle").where("needle <> ''").distinct()
    wide = F.when(F.length("needle") >= GRAM, _grams(F.col("needle"), GRAM)).otherwise(F.array("needle"))
    asked = materialize(asked.select("needle", F.explode(wide).alias("gram")), "needles")
    every = F.concat(*[_grams(F.col("name"), n) for n in range(1, GRAM + 1)])
    held = names.select("name").where("name <> ''").distinct().select("name", F.explode(every).alias("gram"))
    held = materialize(held.join(asked.select("gram").distinct(), "gram", "left_semi"), "grams")
    holders = held.groupBy("gram").agg(F.count(F.lit(1)).alias("holders"))
    counted = asked.join(holders, "gram", "left").select("needle", F.struct(F.coalesce("holders", F.lit(0)).alias("holders"), "gram").alias("g"))
    rarest = counted.groupBy("needle").agg(F.min("g").alias("g")).where("g.holders > 0")
    rarest = rarest.select("needle", F.col("g.gram").alias("gram"), F.ceil(F.col("g.holders") / share).cast("int").alias("parts"))
    dealt = held.join(rarest.select("gram", "parts").distinct(), "gram").withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    visits = rarest.select("needle", "gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = dealt.join(visits, ["gram", "part"]).where(F.col("name").contains(F.col("needle"))).select("name", "needle")
    out = names.join(pairs, "name").join(needles, "needle").select(*names.columns, *needles.columns)
    if not strict:
        everything = names.where("name is not null").withColumn("__all", F.lit("")).join(needles.where("needle = ''").withColumn("__all", F.lit("")), "__all").drop("__all")
        out = out.unionByName(everything)
    return out


def contained_either_way(names: DataFrame, needles: DataFrame, strict: bool = True) -> DataFrame:
    """(name, needle) of distinct names and needles where one contains the other."""
    n, d = names.select("name").distinct(), needles.select("needle").distinct()
    one = containing(n, d, strict).select("name", "needle")
    two = containing(d.select(F.col("needle").alias("name")).where("name <> ''"), n.select(F.col("name").alias("needle")))
    return one.union(two.select(F.col("needle").alias("name"), F.col("name").alias("needle"))).distinct()


def matching_pages(records: DataFrame, pages: DataFrame, strict: bool = True) -> DataFrame:
    """(record, page): records with a name that equals, contains or stands in one of a page's names.

    ``records`` (record, name) and ``pages`` (page, needle) have one row a name;
    names are compared by letters and digits. Records with the same set of
    names are a class, pages as well; classes meet first, so that each pair of
    rows is made once and none is compared. A class's records are dealt over as
    many parts as its pairs ask for; pages come there as arrays, so that a pair
    is a step through an array and no row of a join.
    """
    r = records.select("record", alnum_name("name").alias("name")).where("name <> ''")
    p = pages.select("page", alnum_name("needle").alias("needle"))
    r = materialize(r.groupBy("record").agg(F.array_sort(F.collect_set("name")).alias("names")), "records")
    p = materialize(p.groupBy("page").agg(F.array_sort(F.collect_set("needle")).alias("needles")), "pages")
    n, d = r.groupBy("names").agg(F.count(F.lit(1)).alias("records")), p.groupBy("needles").agg(F.count(F.lit(1)).alias("pages"))
    named, asked = n.select("names", F.explode("names").alias("name")), d.select("needles", F.explode("needles").alias("needle"))
    met = materialize(contained_either_way(named, asked, strict).join(named, "name").join(asked, "needle").select("names", "needles").distinct(), "met")
    load = met.join(n, "names").groupBy("needles").agg(F.sum("records").alias("records")).join(d, "needles")
    load = materialize(load.select("needles", F.ceil(F.col("records") * F.col("pages") / PAIRS).alias("parts"), F.ceil(F.col("pages") / CHUNK).alias("chunks")), "load")
    of = lambda row, parts: F.pmod(F.xxhash64(row), F.col(parts)).cast("int")
    dealt = r.join(met, "names").join(load, "needles").select("record", "needles", of("record", "parts").alias("part"))
    # a list drops nulls; a page may be null
    null = F.array_repeat(F.lit(None).cast(p.schema["page"].dataType), F.max(F.col("page").isNull().cast("int")))
    chunks = p.join(load, "needles").groupBy("needles", "parts", of("page", "chunks").alias("chunk")).agg(F.concat(F.collect_list("page"), null).alias("pages"))
    visits = chunks.select("needles", "pages", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"))
    # dealt by number, as adaptive plans would join the parts, which are small until their pairs are made;
    # merged, as the arrays are larger than a plan's estimate, by which they would be broadcast
    return spread(dealt, "needles", "part").join(visits.hint("merge"), ["needles", "part"]).select("record", F.explode("pages").alias("page"))


def page_slice(pages: DataFrame, tables: dict[str, tuple[DataFrame, list[str], str]], start: str) -> dict[str, DataFrame]:
    """Each table's rows that belong to a page: page rows of ``start``, then table by table those that meet the ones before.

    ``tables``: name -> (rows, columns to compare, name of the table that it
    hangs on). All carry ``page`` on, so one pass serves every page.
    """
    out = {start: pages}
    for name, (rows, keys, parent) in tables.items():
        out[name] = rows.join(out[parent].select("page", *keys).distinct(), keys)
    return out


_TRUSTED = "coalesce(confidence, '') <> 'low'"
#: How a page's slice grows: an index, its key columns, and where the keys come from (slice, column, condition). Low flows name no parts of theirs.
SLICE_STEPS = [
    ("ui_calls", ["file"], [("components", "file", None)]),
    ("ui_to_bff", ["call"], [("ui_calls", "call", None), ("page_flows", "call", None)]),
    ("bff_to_be", ["bff_endpoint", "outbound"], [("ui_to_bff", "bff_endpoint", None), ("page_flows", "bff_endpoint", None)]),
    ("bff_endpoints", ["endpoint"], [("ui_to_bff", "bff_endpoint", None), ("page_flows", "bff_endpoint", None)]),
    ("be_endpoints", ["endpoint"], [("bff_to_be", "be_endpoint", None), ("page_flows", "be_endpoint", None)]),
    ("bff_flows", ["endpoint"], [("ui_to_bff", "bff_endpoint", None), ("page_flows", "bff_endpoint", None)]),
    ("be_flows", ["endpoint"], [("bff_to_be", "be_endpoint", None), ("page_flows", "be_endpoint", None)]),
    ("bff_components", ["class_name"], [("bff_endpoints", "class_name", None), ("bff_flows", "controller", None), ("bff_flows", "services", None), ("bff_flows", "clients", None)]),
    ("be_components", ["class_name"], [("be_endpoints", "class_name", None), ("be_flows", "controller", None), ("be_flows", "services", _TRUSTED), ("be_flows", "repositories", _TRUSTED)]),
    ("bff_dtos", ["class_name"], [("bff_endpoints", "types", None)]),
    ("be_dtos", ["class_name"], [("be_endpoints", "types", None)]),
    ("entities", ["entity"], [("be_flows", "entities", _TRUSTED)]),
    ("repositories", ["method_key", "entity"], [("be_flows", "methods", _TRUSTED), ("be_flows", "entities", _TRUSTED)]),
    ("validations", ["class_name"], [("be_dtos", "class_name", None), ("entities", "entity", None)]),
]


def page_slice_rows(own: dict[str, DataFrame], indexes: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every page's slice in one pass: by index the rows (page, ...) that belong to it.

    ``own`` are the slices that pages have by themselves (components,
    page_flows, and what else names a page); an index that is among both has
    its own rows and those that its step finds. Keys are compared by letters
    and digits; columns of arrays give several. Steps whose index isn't given
    are left out, as are sources whose slice is.
    """
    slices = {name: materialize(rows, "slice") for name, rows in own.items()}
    for name, columns, sources in SLICE_STEPS:
        if name not in indexes:
            continue
        rows = indexes[name].withColumn("__row", F.monotonically_increasing_id())
        rows = materialize(rows, "index")
        many = lambda df, c: F.explode(F.col(c)) if dict(df.dtypes)[c].startswith("array") else F.col(c)
        wanted, held = None, None
        for parent, column, condition in sources:
            if parent in slices and column in slices[parent].columns:
                from_ = slices[parent].where(condition) if condition and "confidence" in slices[parent].columns else slices[parent]
                part = from_.select("page", many(from_, column).alias("key"))
                wanted = part if wanted is None else wanted.unionByName(part)
        for column in columns:
            if column in rows.columns:
                part = rows.select("__row", many(rows, column).alias("key"))
                held = part if held is None else held.unionByName(part)
        if wanted is None or held is None:
            continue
        keyed = lambda df, c: df.select(c, alnum_name("key").alias("key")).where("key <> ''").distinct()
        met = keyed(wanted, "page").join(keyed(held, "__row"), "key").select("page", "__row").distinct()
        found = met.join(rows, "__row").drop("__row")
        slices[name] = materialize(found.unionByName(slices[name], allowMissingColumns=True).distinct() if name in slices else found, "slice")
    return slices


def evidence_files(flows: DataFrame, roles: dict[str, list[str]], by: str, trusted: Column, most: int = 8) -> DataFrame:
    """(by, role, file): the distinct files of trusted flows, ``most`` a role in name order."""
    found = None
    for role, columns in roles.items():
        files = flows.where(trusted).select(by, F.lit(role).alias("role"), F.explode(F.array(*columns)).alias("file")).where("file is not null")
        found = files if found is None else found.unionByName(files)
    return top_k(found.distinct(), [by, "role"], [F.col("file")], most).drop("rank")


def uncertainty_notes(records: DataFrame, by: str) -> DataFrame:
    """(by, note): what is known with less than high confidence, as text."""
    low = records.where(F.coalesce("confidence", F.lit("medium")) != "high")
    return low.select(by, F.concat_ws("", F.col("role"), F.lit(": "), F.col("subject"), F.lit(" has "), F.coalesce("confidence", F.lit("medium")), F.lit(" confidence.")).alias("note")).distinct()


def page_flows(calls: DataFrame, targets: DataFrame, routes: DataFrame, service_flows: DataFrame) -> DataFrame:
    """One row per call: ord, page, flow_type, route, call, bff_endpoint, be_endpoint, flow_ord, uncertainties, confidence.

    ``calls`` (ord, file, call, function, bff_endpoint, confidence) meet the
    first of ``targets`` (ord, bff_endpoint, be_endpoint, controller, handler,
    confidence) with their endpoint, the first of ``routes`` (ord, component,
    route) whose component equals, contains or stands in the page's name, and
    the service flow (flow_ord, endpoint, controller, handler) that
    :func:`resolved_flow` finds. What is missing or ambiguous is said, and makes the flow partial.
    """
    context = page_context("file", "call", "function")
    named = calls.withColumns({"page": context["page"], "flow_type": context["flow_type"]})
    target = first_wins(targets, ["bff_endpoint"], "ord").drop("ord").withColumnRenamed("confidence", "__be")
    near = matching_pages(routes.select(F.col("ord").alias("record"), F.col("component").alias("name")), named.select("page", F.col("page").alias("needle")).distinct())
    first = near.groupBy("page").agg(F.min("record").alias("record")).join(routes.select(F.col("ord").alias("record"), "route"), "record").drop("record")
    joined = named.join(target, "bff_endpoint", "left").join(first, "page", "left")
    flow = resolved_flow(joined.select(F.col("ord").alias("match_ord"), F.col("be_endpoint").alias("endpoint"), "controller", "handler"), service_flows)
    out = joined.join(flow.withColumnRenamed("match_ord", "ord"), "ord")
    notes = messages(
        (F.col("bff_endpoint").isNull(), "no endpoint of the call"), (F.col("be_endpoint").isNull(), "no backend endpoint"),
        (F.col("be_endpoint").isNotNull() & F.col("ambiguous"), "several service flows"), (F.col("page") == "UnknownPage", "page unknown"),
    )
    sure = flow_confidence(F.col("confidence"), F.col("__be"), F.lit(None).cast("string"), F.size("uncertainties") > 0)
    return out.withColumn("uncertainties", notes).select("ord", "page", "flow_type", "route", "call", "bff_endpoint", "be_endpoint", "flow_ord", "uncertainties", sure.alias("confidence"))


# Service flows -------------------------------------------------------------------------------


def call_edges(calls: DataFrame) -> DataFrame:
    """(a, b, ...): method calls as edges between Type.method names."""
    target = F.coalesce("receiver_type", "receiver")
    return calls.select(F.concat_ws(".", "class_name", "method").alias("a"), F.concat_ws(".", target, "target").alias("b"), target.alias("target_type"), F.col("target").alias("target_method"))


def reached_calls(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """(endpoint_ord, a, b, target_type, target_method): every call that an endpoint's handler makes, directly or through others."""
    edges = call_edges(calls)
    seeds = endpoints.select(F.col("endpoint_ord").alias("source"), F.concat_ws(".", "controller", "handler").alias("node"))
    reach = reachable(seeds, edges)
    return reach.join(edges, F.col("node") == F.col("a")).select(F.col("source").alias("endpoint_ord"), "a", "b", "target_type", "target_method").distinct()


def _alike(endpoints: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(endpoint_ord, names): at most ``most`` names whose stem contains that of the controller or handler, or the other way round.

    Stems meet once, however many endpoints and names have them; an endpoint's
    first names are among the first of its stems.
    """
    needles = endpoints.select("endpoint_ord", F.explode(F.array(stem_name("controller"), stem_name("handler"))).alias("needle")).where("needle <> ''")
    stems = names.select(F.col("name").alias("full"), stem_name("name").alias("name")).where("name <> ''").distinct()
    first = top_k(stems, ["name"], [F.col("full")], most).drop("rank")
    by_stem = top_k(contained_either_way(stems, needles).join(first, "name").select("needle", "full").distinct(), ["needle"], [F.col("full")], most).drop("rank")
    found = needles.join(by_stem, "needle").select("endpoint_ord", "full").distinct()
    return top_k(found, ["endpoint_ord"], [F.col("full")], most).groupBy("endpoint_ord").agg(F.array_sort(F.collect_list("full")).alias("names"))


def service_flows(endpoints: DataFrame, calls: DataFrame, services: DataFrame, repositories: DataFrame, entities: DataFrame, caps: tuple[int, int, int] = (5, 20, 40)) -> DataFrame:
    """(endpoint_ord, services, repositories, entities, repository_methods, method_calls, confidence) of each endpoint.

    ``services`` (name), ``repositories`` (name), ``entities`` (repository,
    entity). What the call graph reaches counts; where it reaches nothing, up to
    five names alike the controller's or handler's. Confidence is high if
    services and repositories are reached, medium for services alone.
    """
    alike, methods, texts = caps
    endpoints, calls = materialize(endpoints, "endpoints"), materialize(calls, "calls")
    services, repositories = materialize(services, "services"), materialize(repositories, "repositories")
    reached = materialize(reached_calls(endpoints, calls), "reached")
    named = lambda names, kind: names.select(F.col("name").alias("target_type")).distinct().withColumn("kind", F.lit(kind))
    known = named(services, "service").unionByName(named(repositories, "repository"))
    typed = reached.join(known, "target_type", "left").join(entities.select(F.col("repository").alias("target_type"), "entity"), "target_type", "left")
    ordered = lambda c, most: F.slice(F.array_sort(F.array_distinct(F.collect_list(c))), 1, most)
    by = typed.groupBy("endpoint_ord").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "service", F.col("target_type")))).alias("s"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "repository", F.col("target_type")))).alias("r"),
        F.array_sort(F.collect_set("entity")).alias("entities"),
        ordered(F.when(F.col("kind") == "repository", F.col("b")), methods).alias("repository_methods"),
        ordered(F.concat_ws(" -> ", "a", "b"), texts).alias("method_calls"),
    )
    guess_s, guess_r = (_alike(endpoints, names, alike).withColumnRenamed("names", c) for names, c in ((services, "gs"), (repositories, "gr")))
    joined = endpoints.select("endpoint_ord").join(by, "endpoint_ord", "left").join(guess_s, "endpoint_ord", "left").join(guess_r, "endpoint_ord", "left")
    none = F.array().cast("array<string>")
    got = lambda c: F.size(F.coalesce(c, none)) > 0
    pick = lambda a, b: F.when(got(a), F.col(a)).otherwise(F.coalesce(b, none))
    confidence = F.when(got("s") & got("r"), "high").when(got("s"), "medium").otherwise("low")
    rest = [F.coalesce(c, none).alias(c) for c in ("entities", "repository_methods", "method_calls")]
    return joined.select("endpoint_ord", pick("s", "gs").alias("services"), pick("r", "gr").alias("repositories"), *rest, confidence.alias("confidence"))


def _similar_calls(endpoints: DataFrame, outbound: DataFrame, texts: int, clients: int) -> DataFrame:
    """(endpoint_ord, text, client) of outbound calls whose method is like the endpoint's handler or whose client is like its path.

    The first ``texts`` texts and ``clients`` clients of each stem, in name
    order, a row for a text or for a client; with them an endpoint's first ones
    are whole, as they are among the first of its stems.
    """
    found = None
    for own, other in (("handler", "method"), ("path", "client")):
        e = endpoints.select("endpoint_ord", stem_name(own).alias("needle")).where("needle <> ''")
        o = outbound.select("text", "client", stem_name(other).alias("name")).where("name <> ''")
        met = materialize(contained_either_way(o, e), "similar")
        for kind, most in (("text", texts), ("client", clients)):
            of_name = top_k(o.select("name", kind).distinct(), ["name"], [F.col(kind)], most).drop("rank")
            of_stem = top_k(met.join(of_name, "name").select("needle", kind).distinct(), ["needle"], [F.col(kind)], most).drop("rank")
            part = e.join(of_stem, "needle").select("endpoint_ord", *[F.col(c) if c == kind else F.lit(None).cast("string").alias(c) for c in ("text", "client")])
            found = part if found is None else found.union(part)
    return found


def outbound_flows(endpoints: DataFrame, calls: DataFrame, outbound: DataFrame, services: DataFrame, caps: tuple[int, int, int] = (5, 20, 40)) -> DataFrame:
    """(endpoint_ord, services, clients, outbound, method_calls, confidence) of each endpoint (endpoint_ord, controller, handler, path).

    Outbound calls (client, method, http_method, target_path) are those that
    the endpoint reaches through calls (high) and those of its own handler
    (medium); where there are none, those that are like its handler or path
    (low). Services are the reached ones, else those alike. At most 5 services
    and clients, 20 outbound calls and 40 method calls, in name order.
    """
    few, many, texts = caps
    key = lambda t, m: [alnum_name(F.regexp_replace(t, "(?i)(impl|implementation)\\z", "")).alias("k1"), alnum_name(m).alias("k2")]
    text = F.concat_ws("", F.col("http_method"), F.lit(" "), F.col("target_path"), F.lit(" via "), F.col("client"), F.lit("."), F.col("method"))
    endpoints, calls, services = materialize(endpoints, "endpoints"), materialize(calls, "calls"), materialize(services, "services")
    known = materialize(outbound.withColumn("text", text), "outbound")
    keyed = known.select(*key("client", "method"), "text", "client")
    reached = materialize(reached_calls(endpoints, calls), "reached")
    graph = reached.select("endpoint_ord", *key("target_type", "target_method")).distinct().join(keyed, ["k1", "k2"])
    direct = endpoints.select("endpoint_ord", *key("controller", "handler")).join(keyed, ["k1", "k2"])
    level = lambda df, n: df.select("endpoint_ord", "text", "client", F.lit(n).alias("level"))
    evident = level(graph, 2).unionByName(level(direct, 1))
    guessed = level(_similar_calls(endpoints, known, many, few).join(evident.select("endpoint_ord").distinct(), "endpoint_ord", "left_anti"), 0)
    first = lambda c, most: F.slice(F.array_sort(F.collect_set(c)), 1, most)
    by = evident.unionByName(guessed).groupBy("endpoint_ord").agg(first("text", many).alias("outbound"), first("client", few).alias("clients"), F.max("level").alias("level"))
    named = reached.join(services.select(F.col("name").alias("target_type")).distinct(), "target_type", "left_semi").groupBy("endpoint_ord").agg(first("target_type", few).alias("s"))
    told = reached.groupBy("endpoint_ord").agg(first(F.concat_ws(" -> ", "a", "b"), texts).alias("method_calls"))
    joined = endpoints.select("endpoint_ord").join(by, "endpoint_ord", "left").join(named, "endpoint_ord", "left").join(told, "endpoint_ord", "left").join(_alike(endpoints, services, few), "endpoint_ord", "left")
    none = F.array().cast("array<string>")
    confidence = F.when(F.col("level") == 2, "high").when(F.col("level") == 1, "medium").otherwise("low")
    return joined.select("endpoint_ord", F.coalesce("s", "names", none).alias("services"), *[F.coalesce(c, none).alias(c) for c in ("clients", "outbound", "method_calls")], confidence.alias("confidence"))


def reachable_evidence(calls: Column, types: Column) -> Column:
    """Of 'A.m -> B.n' texts the distinct nodes of the given types, in order."""
    nodes = F.flatten(F.transform(calls, lambda c: F.transform(F.split(c, r"\s*->\s*"), lambda x: F.trim(x))))
    wanted = F.transform(types, lambda t: alnum_name(last_segment(t)))
    return F.array_distinct(F.filter(nodes, lambda n: F.array_contains(wanted, alnum_name(F.regexp_extract(n, r"\A([^.]*)", 1)))))


def diagram_flows(flows: DataFrame, matches: DataFrame, services: DataFrame, by: str, most: int = 8) -> DataFrame:
    """(by, ord, steps): a page's flows as label lists for a diagram, distinct, in order of their labels, ``most`` of them.

    ``flows`` (by, call, bff_endpoint, be_endpoint), ``matches`` (bff_endpoint,
    client), ``services`` (be_endpoint, target); the first of a key by name.
    """
    m = matches.groupBy("bff_endpoint").agg(F.min("client").alias("client"))
    s = services.groupBy("be_endpoint").agg(F.min("target").alias("target"))
    joined = flows.join(m, "bff_endpoint", "left").join(s, "be_endpoint", "left")
    steps = F.filter(F.transform(F.array("call", "bff_endpoint", "client", "be_endpoint", "target"), lambda x: plain_label(x)), lambda x: x.isNotNull() & (x != ""))
    distinct = joined.select(by, F.array_join(steps, " > ").alias("steps")).where("steps <> ''").distinct()
    return top_k(distinct, [by], [F.col("steps")], most).select(by, F.col("rank").cast("bigint").alias("ord"), "steps")


def first_items(preferred: DataFrame, other: DataFrame, by: str, order: str, most: int = 20) -> DataFrame:
    """The first ``most`` rows of each group of ``preferred``, or of ``other`` for groups that have none there."""
    rest = other.join(preferred.select(by).distinct(), by, "left_anti")
    return top_k(preferred.unionByName(rest), [by], [F.col(order)], most).drop("rank")


def selected_indexes(rows: DataFrame, plan: list[tuple[str, str, str]]) -> DataFrame:
    """(document, index, ...) of index rows for each kind of document: ``plan`` has (document, index, condition)."""
    out = None
    for document, index, condition in plan:
        part = rows.where(F.col("index") == index).where(condition).withColumn("document", F.lit(document))
        out = part if out is None else out.unionByName(part)
    return out


def by_locale(rows: DataFrame, column: str, collation: str = "UNICODE") -> DataFrame:
    """``rows`` with ``place``, their place in the language order of a column's distinct values.

    The distinct values are dealt by range under the collation and counted a
    range; what stands in earlier ranges is added. Values that the collation
    doesn't tell apart stand by their bytes; nulls have no place.
    """
    values = rows.select(column).where(F.col(column).isNotNull()).distinct()
    return rows.join(numbered(values, [], [F.collate(F.col(column), collation), F.col(column)]), column, "left").select(*rows.columns, "place")
