"""Spelling variants, byte-level BPE and vector codes against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import byte_bpe, queries, spelling, vector_codes
from tests.oracle import database, differences

SF = "/root/testdata/sf0.001"


# --- spelling variants -------------------------------------------------------


def letters(c):
    return c.isascii() and c.isalpha() or "À" <= c <= "ÿ"


def plain_words(items):
    """Runs by a walk over characters, slips included."""
    counts = Counter()
    for i, text, _ in items:
        for run in "".join(c if letters(c) else " " for c in text or "").split(" "):
            if run:
                run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(items):
    words = plain_words(items)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        if vs:
            best = min(vs, key=lambda v: (-words[v], v))
            if words[best] >= 2 * words[w]:
                form[w] = best
    out = Counter()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w, n, len(near[w]), form.get(w), words.get(form.get(w)), root] += 1
    return out


def variants(docs):
    found = spelling.spelling_variants(docs)
    assert found.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return Counter(tuple(r) for r in found.collect())


def test_variants_of_all_pairs(docs_of, items):
    rng = random.Random(7)
    words = ["vorrang", "straße", "ÉtédÀ", "élan", "naïveté", "abcdefgh", "aabbaabb", "lorem", "loremi"]
    rows = []
    for k in range(400):
        line = []
        for _ in range(rng.randrange(1, 30)):
            w = list(rng.choice(words))
            if rng.random() < 0.5:
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice(["", "x", "é", "a", "B", w[at]])
            line.append("".join(w))
        rows.append((k, rng.choice([" ", ", ", "1", "×"]).join(line), "a"))
    want = plain_variants(rows + items)
    assert len(want) > 60 and any(n_near > 3 for _, _, n_near, *_ in want)
    assert variants(docs_of(rows + items)) == want


def test_large_anagram_classes_and_long_words(docs_of):
    rng = random.Random(9)
    perms = {"".join(rng.sample("abcdefg", 7)) for _ in range(300)}
    many = sorted(perms) + [p[:3] + "x" + p[3:] for p in sorted(perms)[:40]] + [p[:6] + "y" for p in sorted(perms)[:40]]
    long = "q" * 9000 + "ä" * 9000
    many += [long, long[1:], long + "z", "z" + long[1:]]
    rows = [(k, " ".join(many), "a") for k in range(3)]
    assert variants(docs_of(rows)) == plain_variants(rows)


def test_chains_ties_nulls_and_nothing(docs_of):
    chain = ["house"] * 3 + ["houses"] * 6 + ["housesx"] * 12 + ["housesxy"] * 24 + ["housesxyz"] * 48
    tied = ["maison"] * 3 + ["maisons"] * 9 + ["amaison"] * 9
    rows = [(None, " ".join(chain), "a"), (5, " ".join(tied), "b"), (5, None, "b"), (6, "", "b"), (7, "ab abcd abcde", None)]
    got = variants(docs_of(rows))
    assert got == plain_variants(rows)
    assert {w: f for w, _, _, f, _, _ in got}["maison"] == "amaison"
    assert variants(docs_of([])) == Counter() == variants(docs_of([(1, None, "a")]))


def test_slips_of_every_length():
    for run in ("a", "ab", "straße"):
        starts = [zlib.crc32(f"{k}:".encode()) for k in range(600)]
        made = {spelling.slipped(run, s, 97) for s in starts}
        assert run in made and all(len(m) >= len(run) - 1 for m in made) and len(made) > 1


# --- byte-level BPE ----------------------------------------------------------


@pytest.fixture(scope="module")
def bpe(spark):
    return byte_bpe.Vocabulary(byte_bpe.read_ranks(spark, queries.BYTE_RANKS))


@pytest.fixture(scope="module")
def library(bpe):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def ids_of(encoded):
    return [int.from_bytes(encoded[k : k + 4], "little") for k in range(0, len(encoded), 4)]


HARD = ["", " ", "  two  spaces ", "line\nline\n\n", "Grüße, 東京 und 😀!", "\ttab\t", "a" * 3000, " " * 500 + "x", "aab" * 400, "=" * 333, "I'll we've 'S 12345 <|endoftext|>", "\x00\x1f￿"]


@pytest.mark.parametrize("text", HARD)
def test_ids_are_the_library_s(bpe, library, text):
    assert ids_of(bpe.encode(text)) == library.encode_ordinary(text)
    assert bpe.decode(bpe.encode(text)).decode() == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abeinrstou", max_size=80) | st.text("ab \n'", max_size=80))
def test_any_text_has_the_library_s_ids(bpe, library, text):
    assert ids_of(bpe.encode(text)) == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_joined_tokens_have_the_library_s_ids(bpe, library, data):
    ids = data.draw(st.lists(st.integers(0, len(bpe.ranks) - 1), max_size=12))
    text = b"".join(bpe.token[i] for i in ids).decode("utf-8", "replace")
    assert ids_of(bpe.encode(text)) == library.encode_ordinary(text)


def test_walk_is_merging_by_rank_for_any_vocabulary():
    rng = random.Random(4)
    for _ in range(30):  # small random vocabularies over two letters, each token merged from two before it
        ranks = {bytes([b]): b for b in range(256)}
        made = [b"a", b"b"]
        for _ in range(rng.randrange(1, 25)):
            word = rng.choice(made) + rng.choice(made)
            if word not in ranks and byte_bpe.merge(word, ranks, 1 << 30) != [word] and len(byte_bpe.merge(word, ranks, len(ranks))) == 2:
                ranks[word] = len(ranks)
                made.append(word)
        small = byte_bpe.Vocabulary(ranks)
        for _ in range(60):
            piece = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40)))
            assert [small.token[i] for i in small.encode_piece(piece)] == ([piece] if piece in ranks else byte_bpe.merge(piece, ranks, 1 << 30))


def test_a_token_that_merging_never_reaches_stands_for_whole_pieces_only():
    ranks = {bytes([b]): b for b in range(256)} | {b"xyz": 256, b"xx": 257}
    odd = byte_bpe.Vocabulary(ranks)
    assert odd.encode_piece(b"xyz") == [256]
    assert [odd.token[i] for i in odd.encode_piece(b"xyzx")] == [b"x", b"y", b"z", b"x"]
    with pytest.raises(ValueError, match="lacks"):
        byte_bpe.Vocabulary({b"a": 0})


def test_token_digests(docs_of, items, library):
    rows = [(k, t, "a") for k, t in enumerate(HARD)] + items
    want = Counter()
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        want[i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = byte_bpe.token_digests(docs_of(rows), queries.BYTE_RANKS)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want
    assert byte_bpe.token_digests(docs_of([]), queries.BYTE_RANKS).collect() == []


def test_ids_and_texts_as_columns(docs_of):
    rows = [(k, t, "a") for k, t in enumerate(HARD)] + [(50, None, "a"), (50, "again", "a"), (None, "no id", "a")]
    back = byte_bpe.decode(byte_bpe.encode(docs_of(rows), queries.BYTE_RANKS), queries.BYTE_RANKS)
    assert Counter((r["doc_id"], r["decoded"].decode()) for r in back.collect()) == Counter((i, t or "") for i, t, _ in rows)


def test_kept_answers_may_be_forgotten(bpe):
    texts = ["Vorrang und Anhang", "naïveté quelconque"]
    before = [bpe.encode(t) for t in texts]
    bpe.known.clear()
    bpe.pairs.clear()
    for _ in range(3):
        assert [bpe.encode(t, most=1) for t in texts] == before
    assert bpe.decode(b"") == b""
    with pytest.raises(KeyError):
        bpe.decode((1 << 30).to_bytes(4, "little"))


# --- vector codes ------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, id string, code string, error string, of string, vector string, rows string"


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """All distances with Python's integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for _, v, _ in kept), default=0)
    width = max(1, -(-longest // parts)) * parts
    dims = width // parts
    cap = 1 << 24
    kept = [(i, v, [max(-cap, min(cap, math.floor(256 * x))) for x in v] + [0] * (width - len(v)), lab) for i, v, lab in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[v[p * dims : (p + 1) * dims] for p in range(parts)] for _, _, v, _ in kept]
    books = [[cut[k][p] for k in range(min(entries, len(kept)))] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            members: dict = {}
            for c in cut:
                members.setdefault(nearest(p, c[p])[1], []).append(c[p])
            new.append([[sum(x) // len(members[k]) for x in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])])
        books = new
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    by_label = Counter()
    for (_, _, _, lab), f in zip(kept, found, strict=True):
        by_label[lab] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[lab], sha) for (i, _, _, lab), f in zip(kept, found, strict=True))


def codes(spark, rows):
    got = vector_codes.vector_codes(spark.createDataFrame([(i, v, lab, *["x"] * 6) for i, v, lab in rows], VECTORS).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return Counter(tuple(r) for r in got.collect())


def as_float(x):
    import numpy as np

    return float(np.float32(x))


def test_codes_are_those_of_all_distances(spark):
    rng = random.Random(2)
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
    rows = [(k * 3 % 101 + k, [as_float(x + rng.gauss(0, 0.05)) for x in rng.choice(centres)], rng.choice([0, 1, 2, None])) for k in range(260)]
    rows += rows[:7] + [(None, rows[0][1], None), (None, rows[3][1], 5)]  # repeated rows, null ids
    rows += [(1000, None, 1), (1001, [0.1] * 63 + [None], 1), (1002, [float("nan")] * 64, 1), (1003, [float("inf")] + [0.0] * 63, 1)]
    rows += [(1004, [as_float(3e38)] * 64, 1), (1005, [as_float(-3e38)] * 64, 1), (1006, [1.5] * 30, 2), (1007, [], 2)]
    assert codes(spark, rows) == plain_codes(rows)


def test_codes_with_ties_few_rows_and_odd_lengths(spark):
    same = [(k, [0.5] * 64, 1) for k in range(90)]
    assert codes(spark, same) == plain_codes(same)
    few = [(k, [as_float(((k * 7 + j) % 5) / 4) for j in range(37)], k % 2) for k in range(10)]
    assert codes(spark, few) == plain_codes(few)
    assert codes(spark, []) == Counter() == codes(spark, [(1, None, 1), (2, [None], 1)])


def test_every_label_of_its_own(spark):
    rows = [(k, [as_float((k * j % 17) / 16) for j in range(16)], k if k > 80 else 3) for k in range(1500)]
    assert codes(spark, rows) == plain_codes(rows)


def test_bounds_hold_and_leave_few_to_refine():
    import numpy as np

    rng = np.random.default_rng(5)
    entries = rng.integers(-300, 300, (64, 4))
    parts = rng.integers(-400, 400, (500, 4))
    book = vector_codes.CellFile(entries)
    exact = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    lower, upper = book.bounds(parts)
    assert (lower <= exact).all() and (exact <= upper).all()
    index, distance = book.nearest(parts)
    assert (index == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert (lower <= upper.min(axis=1, keepdims=True)).mean() < 0.25


def test_vector_codes_equal_their_sql(spark):
    name = "op13_vector_codes"
    assert differences(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], database(SF)) == ""


def test_new_queries_return_their_columns(spark):
    rows = plain_variants([(r["doc_id"], r["text"], None) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    assert Counter(tuple(r) for r in queries.QUERIES["op11_spelling_variants"](spark, SF).collect()) == rows
