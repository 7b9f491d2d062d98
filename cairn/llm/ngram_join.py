"""Exact Jaccard self-join of word n-gram sets by PartEnum signatures.

Two sets link when their Jaccard similarity is at least 4/5. If a is the size
of the smaller set and b of the larger, then b <= 5a/4, and the sets differ in
at most (a + b) / 9 <= a / 4 elements. PartEnum (Arasu, Ganti, Kaushik, VLDB
2006) turns such a bound k into equality:

* Sizes are cut into bands; a pair belongs to its smaller set's band. A set
  signs for its own band and, where it can be the larger of a pair, for the
  band below.
* A band with bound k cuts the domain of elements into n1 parts with
  2 n1 > k, so that some part differs in at most one element, and each part
  into n2 subparts, of which at most one then differs. Each choice of all
  subparts of a part but one gives a signature: a hash of the set's elements
  there. Linked sets share one.
* Projections of fewer than two elements gather unrelated sets, so they are
  signed only where needed. If k differences can't spoil all of a set's
  projections of two and more elements, its links are found through these. A
  set that isn't safe in this way signs single elements as well, and if that
  isn't enough its empty projections; two such sets meet there.

Signatures only propose. A parity sketch then rules pairs out for certain: two
sets differ in at least as many elements as their sketches in bits. What is
left is verified on the sets themselves. Elements are 64-bit hashes under a
secret that each run draws, so no text can be written to collide with another;
two different shingles among N do by chance of N^2 / 2^65. Equal sets are one
node, so copies are never paired. Members of a signature pair with its least member only (in
the task first, then between tasks), never all with all.

Where that leaves a signature's members in several components, they are
refined instead of compared: of two linked sets of a elements or more, each
has the other's company among any a - 4a/5 + 1 of its elements, so each open
member signs again with those of its elements that the fewest open members
have. Members that share a passage and nothing else thereby part, whatever
their number; only members of different components that share one of these
rare elements meet, with the sketches in the join's condition.

Nulls and edges: a null text is empty; a text without words has an empty set,
no link and itself as component. Rows that repeat an identifier are separate
documents; a component's identifier is the least one of its rows, nulls
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from secrets import randbits
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.hashing import mix, words
from cairn.llm.tasks import hand_back, id_and_text, map_columns, slices
from cairn.plans.components import connected_components
from cairn.plans.durable import materialize, measured, scratch

#: The least similarity is 4/5; the bounds above hold for it alone.
SHARE, OF = 4, 5
SMALLEST, RATIO = 4, 1.5
BITMAP = 1 << 24
SLOTS = 1 << 20
SKETCH = 16
#: How many earlier elements a meeting knows of; a pair whose first common one lies further back comes out more than once.
EARLIER = 24
#: Rows of a batch of signatures: the executor holds two of them outside its heap for each core.
ROWS = 1 << 16
LONGS = [f"sketch{k}" for k in range(SKETCH)]


class Grams(NamedTuple):
    """Words a shingle has, and the secret of this run that their hashes are made with."""

    n: int
    key: int = 0


def ngram_sets(texts: pa.Array, grams_of: Grams | int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct n-gram hashes; the whole sequence where it is shorter than n words."""
    n, key = grams_of if isinstance(grams_of, Grams) else (grams_of, 0)
    w = words(texts, key=key)
    h, count = w.hash, len(w.hash)
    grams = np.zeros(count, np.uint64)
    for k in range(min(n, count)):
        grams[: count - k] = mix(grams[: count - k] + h[k:] + np.uint64(k + 1))
    out = []
    for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for v in h[a:b]:
                x = mix(x * np.uint64(3) + v)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digests(grams: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit digests of a set, sums of independent hashes of its elements."""
    out = []
    for salt in (0xA5A5A5A5A5A5A5A5, 0x1D8E4E27C47D124F):
        total = mix(grams ^ np.uint64(salt)).sum(dtype=np.uint64) + np.uint64(len(grams))
        out.append(int(mix(np.array([total], np.uint64)).view(np.int64)[0]))
    return out[0], out[1]


def node_of(grams: np.ndarray, collided: frozenset[int]) -> int:
    """A set's node: its first digest, or the second where different sets have the first."""
    one, two = set_digests(grams)
    return two if one in collided else one


def bands(size: int) -> list[tuple[int, int]]:
    """(band's number, its largest size) for each band that a set of this size signs for."""
    low, number, out = SMALLEST, 0, []
    while low <= size:
        high = max(low, int(low * RATIO))
        if size <= high or 4 * size <= 5 * high:
            out.append((number, high))
        low, number = high + 1, number + 1
    return out


def spoilt_by(signed: np.ndarray) -> int:
    """How many differing elements it takes to spoil all these projections, at least.

    One element touches one subpart and spoils all but one of its part's
    projections; a part with two or more signed ones thus takes two elements.
    """
    return int(np.minimum(2, signed.sum(axis=1)).sum()) if signed.shape[1] == 2 else int(np.array([0, 1, 1, 2])[signed.sum(axis=1)].sum())


def parity_sketch(grams: np.ndarray) -> np.ndarray:
    """SKETCH longs; each element flips one bit."""
    odd = np.bincount((mix(grams ^ np.uint64(0x3C3C3C3C)) % np.uint64(SKETCH * 64)).astype(np.int64), minlength=SKETCH * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(grams: np.ndarray) -> np.ndarray:
    """PartEnum signatures of a set for 4/5 similarity."""
    size, out = len(grams), []
    for number, high in bands(size):
        k = high // 4
        n1, n2 = k // 2 + 1 + k // 9, 3 if k <= 16 else 2
        mixed = mix(grams + np.uint64(number * 2 + 1))
        part = (mixed % np.uint64(n1 * n2)).astype(np.int64)
        value = mix(mixed)
        count = np.bincount(part, minlength=n1 * n2).reshape(n1, n2)
        halves = [
            np.bincount(part, weights=(value >> np.uint64(s) & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n1 * n2)
            for s in (0, 32)
        ]
        total = (halves[0].astype(np.uint64) + (halves[1].astype(np.uint64) << np.uint64(32))).reshape(n1, n2)
        left = total.sum(axis=1, keepdims=True, dtype=np.uint64) - total
        held = count.sum(axis=1, keepdims=True) - count
        place = mix((np.arange(n1 * n2) + (number << 40)).astype(np.uint64)).reshape(n1, n2)
        signed, most = mix(left + place), min(k, size // 4)
        out.append(signed[held >= 2])
        if spoilt_by(held >= 2) <= most:
            out.append(signed[held == 1])
            if spoilt_by(held >= 1) <= most:
                out.append(mix(place[held == 0] ^ np.uint64(0x5555555555555555)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def set_rows(docs: DataFrame, id_col: str, text_col: str, n: Grams | int) -> DataFrame:
    """(id, n_shingles, node, check, sketch0...), one row per input row."""

    def make(batch: pa.RecordBatch) -> dict:
        sets = [g for part in slices(batch) for g in ngram_sets(part.column("text"), n)]
        digests = [set_digests(g) for g in sets]
        sketches = np.array([parity_sketch(g) for g in sets], np.int64).reshape(-1, SKETCH)
        return {
            "n_shingles": [len(g) for g in sets],
            "node": [d[0] for d in digests],
            "check": [d[1] for d in digests],
            **dict(zip(LONGS, sketches.T, strict=True)),
        }

    made = ", ".join(["n_shingles long, node long, check long", *(f"{c} long" for c in LONGS)])
    return map_columns(id_and_text(docs, id_col, text_col), ["id"], made, make)


def signature_rows(docs: DataFrame, id_col: str, text_col: str, n: Grams | int, collided: frozenset[int], chunk: int = 1 << 19) -> DataFrame:
    """(sig, salt, lead, node): each task's signatures, combined in the task.

    Of the nodes that share a signature in a chunk, the least stands for them
    (salt 0, no lead); the others come with it as their ``lead`` and a salt of
    their own, so that no signature brings more rows together than there are
    chunks.
    """

    def combine(sigs: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sig, node = np.concatenate(sigs).view(np.int64), np.concatenate(nodes)
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        fresh = np.ones(len(sig), np.bool_)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[fresh], node[fresh]
        first = np.ones(len(sig), np.bool_)
        first[1:] = sig[1:] != sig[:-1]
        lead = node[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
        salt = np.where(first, 0, mix(node.view(np.uint64)).view(np.int64) | 1)
        for at in range(0, len(sig), ROWS):
            some = slice(at, at + ROWS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig[some]), pa.array(salt[some]), pa.array(lead[some], mask=first[some]), pa.array(node[some])], names=["sig", "salt", "lead", "node"]
            )

    def run(batches):
        sigs, nodes, held, seen = [], [], 0, set()
        for batch in batches:
            for part in slices(batch):
                for g in ngram_sets(part.column("text"), n):
                    if len(g) < SMALLEST or (node := node_of(g, collided)) in seen:
                        continue
                    seen.add(node)
                    s = signatures(g)
                    sigs.append(s)
                    nodes.append(np.full(len(s), node, np.int64))
                    held += len(s)
                if held >= chunk:
                    yield from combine(sigs, nodes)
                    sigs, nodes, held, seen = [], [], 0, set()
        if held:
            yield from combine(sigs, nodes)
        hand_back()

    rows = id_and_text(docs, id_col, text_col).select("text")
    return rows.mapInArrow(run, "sig long, salt long, lead long, node long")


def wanted_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: Grams | int, made: str, fn) -> DataFrame:
    """(id, made...): what ``fn`` makes of (ids, n-gram sets) of the rows with an identifier of ``wanted`` (node, id), slice by slice.

    A bitmap of 2^24 slots, whatever the input's size, lets most other rows go
    by unread; those that share a slot come along, for a join to drop.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(BITMAP))
    bits = (
        wanted.select((slot + 1).alias("s"))  # the bitmap functions count from 1
        .groupBy(F.bitmap_bucket_number("s").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
        .collect()
    )
    bitmap = np.zeros(BITMAP // 8 + 4096, np.uint8)
    for row in bits:
        at = (row["bucket"] - 1) * 4096
        bitmap[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches):
        for batch in batches:
            s = batch.column("slot").to_numpy()
            keep = np.flatnonzero(shared.value[s // 8] >> (s % 8).astype(np.uint8) & 1)
            for part in slices(batch.take(pa.array(keep)).select(["id", "text"])):
                yield part.column("id"), ngram_sets(part.column("text"), n)
        hand_back()

    rows = id_and_text(docs, id_col, text_col).withColumn("slot", slot)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: fn(sets(batches)), made.format(id=f"id {kind}"))


def per_set(fn):
    """A function of sets as one of (ids, sets), with the identifiers beside its columns."""

    def run(parts):
        for ids, sets in parts:
            columns = fn(sets)
            yield pa.RecordBatch.from_arrays([ids, *columns.values()], names=["id", *columns])

    return run


def of_wanted(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """``found`` (id, node, ...) without the rows that only share a slot or an identifier with a wanted one."""
    f, w = found.alias("f"), wanted.alias("w")
    return f.join(w, (F.col("f.node") == F.col("w.node")) & F.col("f.id").eqNullSafe(F.col("w.id")), "left_semi")


def fetch_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: Grams | int, collided: frozenset[int]) -> DataFrame:
    """(node, grams) for the nodes of ``wanted`` (node, id), from the texts of one row each."""

    def whole(sets: list[np.ndarray]) -> dict:
        return {"node": pa.array([node_of(g, collided) for g in sets], pa.int64()), "grams": pa.array([g.tobytes() for g in sets], pa.binary())}

    found = wanted_sets(docs, wanted, id_col, text_col, n, "{id}, node long, grams binary", per_set(whole))
    return of_wanted(found, wanted).select("node", "grams")


def crowded_slots(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: Grams | int) -> np.ndarray:
    """How many of the wanted sets have an element, roughly: a count for each of 2^20 hash slots.

    Only an order of elements comes of it, which may be any. A task reports
    the slots that stand out among its own, so that little is sent; the
    result's size is fixed.
    """

    def run(parts):
        counts, upto = np.zeros(SLOTS, np.int32), 0
        for _, sets in parts:
            for g in sets:
                counts[np.unique((g % np.uint64(SLOTS)).astype(np.int32))] += 1
                upto += len(g)
        at = np.flatnonzero(counts > 4 + 4 * upto / SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["slot", "n"])

    found = wanted_sets(docs, wanted, id_col, text_col, n, "slot int, n long", run)
    table = found.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return out


def rare_elements(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: Grams | int, collided: frozenset[int]) -> DataFrame:
    """(node, grams): of each wanted set those elements, rarest first, of which every linked set has one."""
    shared = docs.sparkSession.sparkContext.broadcast(crowded_slots(docs, wanted, id_col, text_col, n))

    def rare(sets: list[np.ndarray]) -> dict:
        kept = []
        for g in sets:
            order = np.lexsort((g, shared.value[(g % np.uint64(SLOTS)).astype(np.int64)]))
            kept.append(g[order[: len(g) - -(-SHARE * len(g) // OF) + 1]].view(np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))
        return {"node": pa.array([node_of(g, collided) for g in sets], pa.int64()), "grams": lists}

    found = wanted_sets(docs, wanted, id_col, text_col, n, "{id}, node long, grams array<long>", per_set(rare))
    return of_wanted(found, wanted).select("node", "grams")


def may_link() -> Column:
    """Sizes and sketches of ``x`` and ``y`` don't rule a link out, word by word without leaving generated code."""
    p, q = F.col("x.n_shingles"), F.col("y.n_shingles")
    bits = [F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in LONGS]
    return (OF * F.least(p, q) >= SHARE * F.greatest(p, q)) & (9 * sum(bits[1:], bits[0]) <= p + q)


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) without those that sizes or sketches rule out."""
    x, y = nodes.alias("x"), nodes.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.node")).join(y, (F.col("b") == F.col("y.node")) & may_link())
    return both.select(*[pairs[c] for c in pairs.columns])


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: Grams | int, collided: frozenset[int]) -> DataFrame:
    """Of the pairs (a, b) those whose sets link; reads the texts of one row per node again."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= 80 * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    inside = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted, asked = measured(inside.join(nodes.select("node", "id"), "node"), "wanted")
    sets, got = measured(fetch_sets(docs, wanted, id_col, text_col, n, collided), "grams")
    if got["n"] > asked["n"]:  # rows that repeat identifier and text
        sets = sets.dropDuplicates(["node"])
    left = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    right = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """One row per input row: id, n_shingles, component_id. What is written on the way goes once the answer is written."""
    with scratch(docs.sparkSession):
        return materialize(_components(docs, id_col, text_col, n), "ngram-components", kept=True)


def _components(docs: DataFrame, id_col: str, text_col: str, words_of: int) -> DataFrame:
    n = Grams(words_of, randbits(64) | 1)
    rows = materialize(set_rows(docs, id_col, text_col, n), "sets")
    # about one pair of different sets in 10^19 has equal first digests
    clash = rows.where("n_shingles > 0").groupBy("node").agg((F.min("check") != F.max("check")).alias("clash")).where("clash")
    collided = frozenset(r["node"] for r in clash.select("node").collect())
    if collided:
        rows = rows.withColumn("node", F.when(F.col("node").isin(*collided), F.col("check")).otherwise(F.col("node")))
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(
        F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n_shingles", *LONGS)]
    )
    nodes = materialize(nodes, "nodes")
    signed = signature_rows(docs, id_col, text_col, n, collided)
    least = F.min("node").over(Window.partitionBy("sig", "salt"))
    shared = materialize(
        signed.withColumn("lead", F.coalesce("lead", least)).where("lead <> node").select("sig", "lead", "node"), "shared"
    )
    star = shared.groupBy(F.col("lead").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    near = materialize(plausible(star, nodes), "near")

    def apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components."""
        p, q = parts.alias("p"), parts.alias("q")
        a = pairs.join(p, F.col("a") == F.col("p.node"), "left").withColumn("ca", F.coalesce("p.component", "a")).drop("node", "component")
        return (
            a.join(q, F.col("b") == F.col("q.node"), "left")
            .withColumn("cb", F.coalesce("q.component", "b"))
            .drop("node", "component")
            .where("ca <> cb")
        )

    def extend(parts: DataFrame | None, pairs: DataFrame) -> DataFrame:
        """Components with the pairs that link: each node's likeliest pair first, then only those whose ends that leaves apart.

        Known components take part as stars, so that few rounds settle new links.
        """
        first = materialize(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"), "first")
        for some in (first, None):
            if some is None:
                some, left = measured(apart(pairs.select("a", "b"), parts).select("a", "b").join(first, ["a", "b"], "left_anti"), "rest")
                if not left["n"]:
                    break
            links = verified(some, nodes, docs, id_col, text_col, n, collided)
            if parts is not None:
                links = links.union(parts.select("node", "component"))
            parts = connected_components(links)
        return parts

    parts = extend(None, near)
    # signatures whose members are still apart
    failed = apart(shared.select("sig", F.col("lead").alias("a"), F.col("node").alias("b")), parts).select("sig").distinct()
    open_ = shared.join(failed, "sig", "left_semi")
    # the only lead of a signature was compared with all its members already
    leads = open_.groupBy("sig").agg((F.min("lead") == F.max("lead")).alias("one"), F.count(F.lit(1)).alias("m")).where("m > 1 or not one")
    ends = F.when(F.col("one"), F.array("node")).otherwise(F.array("lead", "node"))
    members = open_.join(leads, "sig").select(F.explode(ends).alias("node")).distinct()
    members, opened = measured(members.join(nodes.select("node", "id"), "node"), "open")
    if opened["n"]:
        rare = materialize(rare_elements(docs, members, id_col, text_col, n, collided), "rare")
        placed = rare.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.posexplode("grams").alias("pos", "gram"))
        mixed = placed.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
        # what a member shares with other components, in the common order; a pair comes out at the first element that both have
        own = placed.join(mixed.select("gram"), "gram", "left_semi").groupBy("node", "component").agg(F.array_sort(F.collect_set(F.struct("pos", "gram")))["gram"].alias("grams"))
        own = own.select("node", "component", "grams", F.posexplode("grams").alias("pos", "gram"))
        meeting = materialize(own.select("node", "component", "gram", F.slice("grams", F.lit(1), F.least("pos", F.lit(EARLIER))).alias("earlier")), "meeting")
        sketched = meeting.join(nodes.drop("id"), "node")
        x, y = sketched.alias("x"), sketched.alias("y")
        meet = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.component") < F.col("y.component")) & may_link() & ~F.arrays_overlap("x.earlier", "y.earlier")
        across = x.join(y, meet).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        tried = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n").join(tried, ["a", "b"], "left_anti")
        across, met = measured(across, "across")
        if met["n"]:
            parts = extend(parts, across)
    named = nodes.select("node", "id").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    answer = named.join(least, "component").select("node", "component_id")
    some, none = rows.where("n_shingles > 0"), rows.where("n_shingles = 0")
    return (
        some.join(answer, "node")
        .select("id", "n_shingles", "component_id")
        .union(none.select("id", "n_shingles", F.col("id").alias("component_id")))
        .withColumnRenamed("id", id_col)
    )
