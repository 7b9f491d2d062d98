"""Exact dedup and the n-gram Jaccard join against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from cairn.llm import exact_dedup, ngram_join, tasks
from cairn.llm.hashing import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n=5):
    w = WORD.findall(lower(text))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(items):
    sets = [shingles(t) for _, t, _ in items]
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(items):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _, _) in enumerate(items))


def test_components_are_those_of_all_pairs(docs_of, items):
    got = Counter(tuple(r) for r in ngram_join.ngram_components(docs_of(items)).collect())
    assert got == brute_components(items)


def test_components_with_chains_and_every_size(docs_of):
    rng = random.Random(11)
    items, i = [], 0
    for size in [1, 2, 4, 5, 6, 8, 9, 12, 16, 25, 40, 41, 90, 150]:
        for _ in range(4):
            words = [f"w{rng.randrange(4000)}" for _ in range(size)]
            for _ in range(6):
                items.append((i, " ".join(words), "a"))
                i += 1
                words = list(words)
                for _ in range(rng.choice([0, 1, max(1, size // 30)])):
                    words[rng.choice([0, -1, rng.randrange(size)])] = f"z{rng.randrange(9)}"
                if rng.random() < 0.3:
                    words.append(f"tail{rng.randrange(3)}")
    got = Counter(tuple(r) for r in ngram_join.ngram_components(docs_of(items)).collect())
    assert got == brute_components(items)


def test_components_of_nothing(docs_of):
    assert ngram_join.ngram_components(docs_of([])).collect() == []
    assert [tuple(r) for r in ngram_join.ngram_components(docs_of([(3, None, "a"), (4, "", "a")])).orderBy("doc_id").collect()] == [(3, 0, 3), (4, 0, 4)]


def test_copies(docs_of, items):
    largest, size = {}, Counter()
    for i, t, _ in items:
        t = t or ""
        size[t] += 1
        largest[t] = max((x for x in (largest.get(t), i) if x is not None), default=None)
    want = Counter((i, largest[t or ""], size[t or ""], i == largest[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in items)
    for parts, fan_in in ((13, 2), (7, 3), (1, 2)):
        assert Counter(tuple(r) for r in exact_dedup.find_copies(docs_of(items).repartition(parts), fan_in=fan_in).collect()) == want


def test_dropping_copies_leaves_one_row_a_text(docs_of, items):
    docs = docs_of(items)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = Counter(r["text"] or "" for r in kept.collect())
    assert set(texts.values()) == {1} and set(texts) == {t or "" for _, t, _ in items}
    assert exact_dedup.find_copies(docs_of([])).collect() == exact_dedup.drop_copies(docs_of([])).collect() == []


def test_a_slice_of_one_short_text(spark, docs_of):
    for size in (1, 2, 3, 4):
        docs = docs_of([(7, " ".join("abcd"[:size]), "a")])
        assert [tuple(r) for r in ngram_join.ngram_components(docs).collect()] == [(7, 1, 7)]
    # a text over 2 MB leaves the row before it alone in its slice
    long = " ".join(f"w{k}" for k in range(400000))
    assert len(long) > 2 << 20
    items = [(1, "two words", "a"), (2, long, "a"), (3, "Two  words", "a")]
    got = Counter(tuple(r) for r in ngram_join.ngram_components(docs_of(items).coalesce(1)).collect())
    assert got == brute_components(items)


def test_words_of_equal_polynomials_stay_apart(docs_of):
    a, b = "x", "y"
    for _ in range(11):  # Thue-Morse words of 2,048 letters: equal polynomial hashes modulo 2^64, whatever the base
        a, b = a + b, b + a
    items = [(k, f"p q r s {w} t u v w", "a") for k, w in enumerate([a, b, a, a[:200], b[:200]])]
    got = Counter(tuple(r) for r in ngram_join.ngram_components(docs_of(items)).collect())
    assert got == brute_components(items) and len({c for _, _, c in got}) == 4


def test_words_that_collide_without_a_key_stay_apart(docs_of):
    a, b = "abcdefghijklmnop", "c2iz2b7r?ut%cf_9"
    plain = words(pa.array([a, b])).hash
    assert plain[0] == plain[1]
    for key in (1, 7, 1 << 63):
        assert len(set(words(pa.array([a, b, a + "x" * 300, b + "x" * 300]), key=key).hash.tolist())) == 4
        assert words(pa.array([a]), key=key).hash[0] == words(pa.array([f"{a} z"]), key=key).hash[0] != plain[0]
    items = [(k, f"p q r s {w} t u v w", "a") for k, w in enumerate([a, b, a])]
    got = Counter(tuple(r) for r in ngram_join.ngram_components(docs_of(items)).collect())
    assert got == brute_components(items) == Counter([(0, 5, 0), (1, 5, 1), (2, 5, 0)])


def test_colliding_digests_are_told_apart(docs_of, items, monkeypatch):
    digests = ngram_join.set_digests
    few = lambda g: (digests(g)[0] % 7, digests(g)[1])
    monkeypatch.setattr(ngram_join, "set_digests", few)
    monkeypatch.setattr(ngram_join, "node_of", lambda g, collided: few(g)[few(g)[0] in collided])
    docs = docs_of(items[:60])
    rows = ngram_join.set_rows(docs, "doc_id", "text", 5).where("n_shingles > 0").select("node", "check").distinct().collect()
    assert len(rows) > 7 >= len({r["node"] for r in rows})
    assert Counter(tuple(r) for r in ngram_join.ngram_components(docs).collect()) == brute_components(items[:60])


def test_texts_that_share_a_passage_are_refined(docs_of):
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(120)]
    items = []
    for k in range(160):  # most of each text is the passage, some pairs link across it
        own = [f"o{k}x{j}" for j in range(rng.choice([4, 30, 60]))]
        items.append((k, " ".join(passage + own), "a"))
        if k % 5 == 0:
            items.append((1000 - k, " ".join([*passage, *own[:-2], "end"]), "a"))
    for k in range(60):  # near copies that link through others only
        words = list(passage)
        for j in range(k % 6):
            words[(j * 17 + k) % 120] = f"q{k}"
        items.append((2000 + k, " ".join(words), "a"))
    got = Counter(tuple(r) for r in ngram_join.ngram_components(docs_of(items)).collect())
    assert got == brute_components(items)


def test_tasks_hand_over_small_batches(spark):
    """Signatures come in batches of bounded rows, encoded texts by slices: the executor holds them outside its heap."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 120), k -> hash(id, k)), ' ') AS text").coalesce(1)
    signed = ngram_join.signature_rows(docs, "doc_id", "text", 5, frozenset())
    assert signed.count() > 2 * ngram_join.ROWS

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
        run = ngram_join.signature_rows(docs, "doc_id", "text", 5, frozenset())
        made = tasks.map_columns(docs, ["doc_id"], "n long", lambda b: {"n": [b.num_rows] * b.num_rows}, 1 << 16)
    batch = pa.RecordBatch.from_pandas(docs.toPandas(), preserve_index=False)
    assert max(b.num_rows for b in run(iter([batch.select(["text"])]))) <= ngram_join.ROWS
    assert len(list(made(iter([batch])))) > 10
