"""Mixing, language-model scores, toxicity and media columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import katz, media, mixing, png, toxicity
from cairn.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def water(sizes, budget, most=3):
    """Targets by shares: those above their limit stop there, the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1.0 for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(budget)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_mix_meets_its_targets(docs_of, items):
    rows = items + [(1000 + k, "one two three", "small") for k in range(3)] + [(2000, None, "empty")]
    mixed = mixing.mix(docs_of(rows))
    got = mixed.select("id", "size", "source", "source_size", "target", (F.col("size") * F.size("kept")).alias("taken")).collect()
    assert Counter((r["id"], r["size"]) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken, longest = water(sizes, sum(sizes.values())), defaultdict(int), max(len(WORD.findall(t or "")) for _, t, _ in rows)
    for r in got:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= longest for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values())
    order = ["id", "size", "taken"]
    again = mixing.mix(docs_of(list(reversed(rows)))).select("id", "size", (F.col("size") * F.size("kept")).alias("taken"))
    assert sorted(map(str, again.select(order).collect())) == sorted(map(str, mixed.select("id", "size", (F.col("size") * F.size("kept")).alias("taken")).collect()))


def test_mixture_repeats_documents(docs_of, items):
    docs = docs_of(items)
    out = mixing.mixture(docs)
    assert out.columns == docs.columns and 0 < out.count() <= 3 * docs.count()
    assert mixing.mix(docs_of([])).collect() == mixing.mixture(docs_of([])).collect() == []


def brute_base(rows):
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _, _ in rows}
    c = Counter(w for i, t, _ in rows if not held[i] for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    out = Counter()
    for i, t, _ in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out[(str(i), held[i], len(tokens), sum(c[w] > 0 for w in tokens), n, round(base, 5))] += 1
    return out


def test_base_scores(docs_of, items):
    got = katz.katz_scores(docs_of(items)).collect()
    assert Counter((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == brute_base(items)
    assert all(r["score"] < 0 for r in got)
    assert katz.katz_scores(docs_of([])).collect() == []


class DictionaryKatz:
    """The model with dictionaries: good for a few hundred texts."""

    def __init__(self, texts, upto=5):
        self.one, self.two, self.context = Counter(), Counter(), Counter()
        for text in texts:
            before = "<s>"
            for w in [*words(text), None]:
                self.one[w] += 1
                self.two[before, w] += 1
                self.context[before] += 1
                before = w
        self.d1, self.d2 = self.factors(self.one, upto), self.factors(self.two, upto)
        self.n = sum(self.one.values())
        self.unknown = 1 - sum(self.d1(c) * c for c in self.one.values()) / self.n if self.n else 1.0
        self.after = defaultdict(list)
        for before, w in self.two:
            self.after[before].append(w)
        self.alpha = {}
        for before, seen in self.after.items():
            kept = sum(self.d2(self.two[before, w]) * self.two[before, w] for w in seen)
            self.alpha[before] = (1 - kept / self.context[before]) / (1 - sum(self.unigram(w) for w in seen))

    @staticmethod
    def factors(counts, upto):
        of = Counter(counts.values())
        d = [0.0] * (upto + 1)
        common = (upto + 1) * of[upto + 1] / of[1] if of[1] else 1.0
        for r in range(1, upto + 1):
            good = (r + 1) * of[r + 1] / (r * of[r]) if of[r] else 1.0
            value = (good - common) / (1 - common) if common < 1 else 0.0
            d[r] = value if 0 < value < 1 else (r - 0.5) / r
        return lambda c: d[c] if c <= upto else 1 - 1e-6

    def unigram(self, w):
        return self.d1(self.one[w]) * self.one[w] / self.n if self.one[w] else self.unknown

    def probability(self, w, before):
        c = self.two[before, w]
        return self.d2(c) * c / self.context[before] if c else self.alpha.get(before, 1.0) * self.unigram(w)

    def score(self, text):
        tokens = [*words(text), None]
        return sum(math.log10(self.probability(w, before)) for w, before in zip(tokens, ["<s>", *tokens], strict=False))


def test_katz_scores_are_those_of_a_dictionary_model(spark, docs_of, items):
    stored = spark.read.parquet(f"{SF}/documents.parquet")
    for docs, few in ((docs_of(items), True), (docs_of([r for r in items if r[0] == 70]), True), (stored.where("doc_id < 400"), False)):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        model = DictionaryKatz([t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10])
        got = sorted((str(r["doc_id"]), r["score"]) for r in katz.katz_scores(docs, stored=not few, block_bytes=1 << 24).collect())
        want = sorted((str(i), model.score(t)) for i, t in rows)
        assert [i for i, _ in got] == [i for i, _ in want]
        assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-6)
        for before in ["<s>", "never seen", *list(model.context)[:40]]:
            assert math.isclose(sum(model.probability(w, before) for w in model.one) + model.probability("\0", before), 1, rel_tol=1e-9)


def test_katz_of_texts_that_are_all_held_out(docs_of):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = katz.katz_scores(docs_of([(i, t, "a") for i, t in zip(held, ["a b", None, ""], strict=True)])).collect()
    assert {(r["doc_id"], r["score"], r["n_known"], r["train_tokens"]) for r in got} == {(i, 0.0, 0, 0) for i in held}


def test_katz_beats_the_base_on_held_out_texts(spark):
    out = QUERIES["op4_katz_scores"](spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_toxicity_on_held_out_labels(spark):
    scored = QUERIES["op9_toxicity"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = scored.join(labels, "doc_id").collect()
    for held in (True, False):
        part = [r for r in rows if r["held_out"] == held and r["toxic"] is not None]
        assert sum(r["predicted"] == r["toxic"] for r in part) / len(part) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_edges(spark, docs_of, items):
    docs = docs_of(items)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["vile", "nasty", "rot"] if k % 3 == 0 else ["lamp", "tree", "boat"]) for _ in range(20)), "a") for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] * 2 + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs_of(rows + [(300, None, None), (None, "", None)]), labels).collect()
    assert len(got) == 302 and all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 300)
    model = toxicity.learn(docs_of(rows), labels)
    kept = toxicity.drop_toxic(docs_of(rows), model)
    assert kept.columns == docs.columns and kept.count() == 200


def test_media_round_trip(docs_of, items):
    got = media.media_features(media.encode_media(docs_of(items))).collect()
    by_text = {}
    for r, (i, t, _) in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["payload_sha256"])), sorted(items, key=lambda x: (str(x[0]), "")), strict=True):
        assert str(r["doc_id"]) == str(i)
    want = Counter()
    for i, t, _ in items:
        raw = (t or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[(str(i), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))] += 1
    assert Counter((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    for r in got:
        value = (r["media_bytes"], r["media_sha256"], r["feature"])
        assert by_text.setdefault(r["payload_sha256"], value) == value
    assert media.media_features(media.encode_media(docs_of([]))).collect() == []


def test_png_filters_and_damage():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (9, 64)).astype(np.uint8)
    data = png.encode(image)
    assert (png.decode(data) == image).all()
    smooth = np.add.outer(np.arange(40), np.arange(64)).astype(np.uint8)
    assert (png.decode(png.encode(smooth)) == smooth).all()
    for at in (3, 20, len(data) // 2, len(data) - 3):
        hurt = bytearray(data)
        hurt[at] ^= 1
        with pytest.raises(ValueError):
            png.decode(bytes(hurt))
    left = np.zeros_like(image)
    left[:, 1:] = image[:, :-1]
    above = np.zeros_like(image)
    above[1:] = image[:-1]
    corner = np.zeros_like(image)
    corner[1:, 1:] = image[:-1, :-1]
    guess = (left.astype(int) + above) // 2
    lines = np.zeros((9, 65), np.uint8)
    lines[:, 0], lines[:, 1:] = png.AVERAGE, image - guess.astype(np.uint8)
    assert (png.unfilter(lines) == image).all()
    paeth = np.vectorize(png._paeth)(left.astype(int), above.astype(int), corner.astype(int))
    lines[:, 0], lines[:, 1:] = png.PAETH, image - paeth.astype(np.uint8)
    assert (png.unfilter(lines) == image).all()


def test_feature_is_stable_under_small_change():
    rng = np.random.default_rng(4)  # coarse blocks, so that no coefficient is zero
    x = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    y = x.copy()
    y[5, 5] += 9
    a, b = (bin(int(media.cosine_hash(v), 16) ^ int(media.cosine_hash(x), 16)).count("1") for v in (y, x.T.copy()))
    assert a <= 4 < b
