"""Language-model scoring with a Katz backoff model of word bigrams.

Tokens are lower-cased words and one end per text. P(w | v) is the bigram's
Good-Turing discounted share of its context where the pair was seen in
training, else alpha(v) P(w); P(w) likewise is the word's discounted share of
all tokens, else what discounting leaves, which is the unknown word's. alpha(v)
is the mass that v's discounted bigrams leave, over the unigram mass of the
words not seen behind v, so each context's probabilities sum to one exactly.
Counts above five keep all but a millionth, so that every context leaves some.

All counts are of all training texts and of words and pairs themselves (64-bit
hashes). Nothing of them is held by the driver or broadcast:

1. Each block of texts reduces to its distinct words and pairs, cut into
   groups by hash: one row a block and group, with the sorted keys and their
   counts in binary columns. Every group has the same share of all keys, a
   frequent word's pairs included, and meets in one task.
2. There counts are summed over blocks and returned to each block in the order
   of its own keys, with a mark on what the block is the first to have.
3. A block scores its texts with these. Of the pairs that it was first to have
   it adds up the mass of each context; of tokens that no training text has
   behind their context it keeps the context.
4. The contexts' masses, summed over blocks, are the table of backoff weights,
   which those tokens join.

Nulls and edges: a null text is empty and scores its end alone; a null
identifier hashes as the empty string; rows that repeat are scored alike.
Without training texts every word is unknown and has the whole mass. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.hashing import mix, words
from cairn.llm.tasks import id_and_text, slices
from cairn.plans.durable import materialize

END, START = np.uint64(0x0E2D0F7E47), np.uint64(0x57A27D)
GT_UPTO = 5
#: What a count above GT_UPTO keeps.
NEARLY = 1 - 1e-6
#: Levels of keys.
WORD, PAIR = 0, 1


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def in_blocks(docs: DataFrame, id_col: str, text_col: str, parts: int) -> tuple[DataFrame, int]:
    """(block, id, text, train) and the number of blocks: ``block`` is one of ``parts`` of an input split."""
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.spark_partition_id())
    n_splits = docs.select(split.alias("split")).distinct().count()
    rows = id_and_text(docs, id_col, text_col).select("id", "text", split.alias("split"), F.pmod(F.monotonically_increasing_id(), F.lit(parts)).alias("part"))
    return rows.select(F.xxhash64("split", "part").alias("block"), "id", "text", (~held_out("id")).alias("train")), n_splits * parts


def bytes_of(size: str) -> int:
    size = size.strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(size[-1:], 0)
    return int(size[:-1] if unit else size) << unit


class Tokens(NamedTuple):
    """A slice's tokens, ends included: words, pairs with the word before, those words, and each text's number of tokens."""

    word: np.ndarray
    pair: np.ndarray
    before: np.ndarray
    length: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    w = words(texts)
    length = np.diff(w.offsets) + 1
    word = np.insert(w.hash, w.offsets[1:], END)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum(length) - length] = START
    return Tokens(word, mix(before * np.uint64(3) + mix(word)), before, length)


def group_of(key: np.ndarray, groups: int) -> np.ndarray:
    return (mix(key ^ np.uint64(0x6A09E667)) % np.uint64(groups)).astype(np.int64)


def distinct_keys(rows: DataFrame, groups: int) -> DataFrame:
    """(grp, block, level, keys, counts): a block's distinct words and pairs of a group, sorted, with their occurrences in training texts."""

    def rows_of(block: int, level: int, key: np.ndarray, n: np.ndarray) -> Iterator[dict]:
        g = group_of(key, groups)
        order = np.argsort(g, kind="stable")
        bounds = np.searchsorted(g[order], np.arange(groups + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[k] : bounds[k + 1]]
            yield {"grp": int(k), "block": block, "level": level, "keys": key[at].tobytes(), "counts": n[at].astype(np.int32).tobytes()}

    def run(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for part in slices(batch):
                t = tokens(part.column("text"))
                train = np.repeat(part.column("train").to_numpy(zero_copy_only=False), t.length)
                blocks = np.repeat(part.column("block").to_numpy(), t.length)
                for block in np.unique(blocks).tolist():
                    mine = blocks == block
                    for level, key in ((WORD, t.word), (PAIR, t.pair)):
                        key, inverse = np.unique(key[mine], return_inverse=True)
                        n = np.bincount(inverse, weights=train[mine], minlength=len(key)).astype(np.int32)
                        held.setdefault((block, level), []).append((key, n))
                        if len(held[block, level]) >= 24:
                            held[block, level] = [merged(held[block, level])]
        while held:
            (block, level), parts = held.popitem()
            made = list(rows_of(block, level, *merged(parts)))
            for a in range(0, len(made), 64):
                yield pa.RecordBatch.from_pylist(made[a : a + 64], schema=schema)

    schema = pa.schema([("grp", pa.int32()), ("block", pa.int64()), ("level", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    return rows.select("block", "text", "train").mapInArrow(run, "grp int, block long, level int, keys binary, counts binary")


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted list of distinct keys with summed counts."""
    if len(parts) == 1:
        return parts[0]
    key = np.concatenate([k for k, _ in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], np.concatenate([n for _, n in parts])[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first).astype(np.int32) if len(key) else n


def summed_counts(keys: DataFrame) -> DataFrame:
    """(grp, block, level, totals, spectrum): each block's keys answered by their counts in all blocks, in the order of the block's keys.

    A total is negative (minus one, minus the count) where the block is the
    first to have the key. ``spectrum``, on one row of a group, has how many
    distinct keys have each count up to GT_UPTO + 1, how many any, and the sum.
    """

    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"grp": [], "block": [], "level": [], "totals": [], "spectrum": []}, schema=schema)
        table = table.sort_by("block")
        lists = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")]
        sizes = np.array([len(x) for x in lists])
        key = np.concatenate(lists)
        order = np.argsort(key, kind="stable")
        first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in table.column("counts")]).astype(np.int64)
        sums = np.add.reduceat(n[order], np.flatnonzero(first))
        total = np.empty(len(key), np.int64)
        total[order] = np.where(first, -1 - sums[np.cumsum(first) - 1], sums[np.cumsum(first) - 1])
        spectrum = [int((sums == r).sum()) for r in range(1, GT_UPTO + 2)] + [int((sums > 0).sum()), int(sums.sum())]
        packed = [small(x) for x in np.split(total, np.cumsum(sizes)[:-1])]
        return pa.table({"grp": table.column("grp"), "block": table.column("block"), "level": table.column("level"), "totals": pa.array(packed, pa.binary()), "spectrum": pa.array([spectrum] + [None] * (len(lists) - 1), pa.list_(pa.int64()))}, schema=schema)

    schema = pa.schema([("grp", pa.int32()), ("block", pa.int64()), ("level", pa.int32()), ("totals", pa.binary()), ("spectrum", pa.list_(pa.int64()))])
    return keys.groupBy("grp", "level").applyInArrow(run, "grp int, block long, level int, totals binary, spectrum array<long>")


def small(x: np.ndarray) -> bytes:
    """Integers in the narrowest width that holds all but a few; those follow as (position, value)."""
    body = np.where((x > -127) & (x < 127), x, 127).astype(np.int8)
    wide = np.flatnonzero(body == 127)
    return np.concatenate([np.array([len(x), len(wide)], np.int64).view(np.int8), body, wide.astype(np.int32).view(np.int8), x[wide].astype(np.int64).view(np.int8)]).tobytes()


def wide(data: bytes | memoryview) -> np.ndarray:
    raw = np.frombuffer(data, np.int8)
    n, k = np.frombuffer(raw[:16].tobytes(), np.int64)
    out = raw[16 : 16 + n].astype(np.int64)
    at = np.frombuffer(raw[16 + n : 16 + n + 4 * k].tobytes(), np.int32)
    out[at] = np.frombuffer(raw[16 + n + 4 * k :].tobytes(), np.int64)
    return out


def discounts(counts_of_counts: list[int], upto: int = GT_UPTO) -> np.ndarray:
    """Katz's factors d[r] for counts r = 0..upto (d[0] unused) and, last, for all above. Absolute discounting where Good-Turing is undefined."""
    n = [0, *counts_of_counts]
    d = np.full(upto + 2, NEARLY)
    common = (upto + 1) * n[upto + 1] / n[1] if n[1] else 1.0
    for r in range(1, upto + 1):
        good = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 1.0
        value = (good - common) / (1 - common) if common < 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


class Model(NamedTuple):
    """What scoring needs besides counts: a few numbers, whatever the corpus."""

    tokens: int
    types: int
    texts: int
    words: np.ndarray
    pairs: np.ndarray
    unknown: float

    def share(self, n: np.ndarray, level: int) -> np.ndarray:
        """What discounting leaves of a count."""
        return (self.words, self.pairs)[level][np.minimum(n, GT_UPTO + 1)]

    def unigram(self, n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, n * self.share(n, WORD) / max(self.tokens, 1), self.unknown)


def learned(answers: DataFrame, rows: DataFrame) -> Model:
    """Discounts and totals from the groups' spectra."""
    sums = answers.where("spectrum is not null").select("level", *[F.get("spectrum", F.lit(k)).alias(f"s{k}") for k in range(GT_UPTO + 3)])
    by = {r["level"]: [r[f"s{k}"] for k in range(GT_UPTO + 3)] for r in sums.groupBy("level").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(GT_UPTO + 3)]).collect()}  # two rows
    w, p = by.get(WORD, [0] * (GT_UPTO + 3)), by.get(PAIR, [0] * (GT_UPTO + 3))
    texts = rows.agg(F.count_if("train").alias("n")).first()["n"]
    d = discounts(w[: GT_UPTO + 1])
    few = sum(r * w[r - 1] for r in range(1, GT_UPTO + 1))
    kept = sum(d[r] * r * w[r - 1] for r in range(1, GT_UPTO + 1)) + NEARLY * (w[-1] - few)
    left = 1 - kept / w[-1] if w[-1] else 1.0
    return Model(w[-1], w[-2], texts, d, discounts(p[: GT_UPTO + 1]), left)


#: What a block has to say: a text's score as far as its pairs are seen, a context's pairs, a text's tokens that back off.
TEXT, CONTEXT, BACKOFF = 0, 1, 2
FACTS = {
    "kind": pa.int32(), "row": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(),
    "context": pa.int64(), "total": pa.int64(), "lost": pa.float32(), "mass": pa.float32(), "n": pa.int64(),
}


class Keyed:
    """A block's distinct keys of a level, by group, with a value for each."""

    def __init__(self, key: np.ndarray, groups: int):
        g = group_of(key, groups)
        self.order = np.argsort(g, kind="stable")
        self.key, self.groups = key, groups
        self.bounds = np.searchsorted(g[self.order], np.arange(groups + 1))
        self.value = np.zeros(len(key), np.int64)

    def answer(self, group: int, values: np.ndarray) -> None:
        at = self.order[self.bounds[group] : self.bounds[group + 1]]
        if len(at) != len(values):
            raise RuntimeError("a block's texts changed between two reads of the input")
        self.value[at] = values

    def place(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        if (self.key[at] != key).any():
            raise RuntimeError("a block's texts changed between two reads of the input")
        return at


def block_facts(rows: DataFrame, answers: DataFrame, model: Model, groups: int) -> DataFrame:
    """(block, id, FACTS...): what each block finds with the counts that it asked for."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def facts(ids: pa.Array, **columns) -> pa.Table:
        made = {c: pa.array(columns[c]).cast(t) if c in columns else pa.nulls(len(ids), t) for c, t in FACTS.items()}
        return pa.table({"id": ids, **made})

    def run(texts: pa.Table, answered: pa.Table) -> Iterator[pa.Table]:
        m = shared.value
        parts = [p for batch in texts.to_batches() for p in slices(batch)]
        found = [tokens(p.column("text")) for p in parts] if len(parts) < 4 else None  # a small block's tokens are kept
        read = lambda k: found[k] if found else tokens(parts[k].column("text"))
        asked: dict[int, list] = {WORD: [], PAIR: []}
        for k in range(len(parts)):
            t = read(k)
            asked[WORD].append(np.unique(t.word))
            asked[PAIR].append(np.unique(t.pair))
        keyed = {level: Keyed(np.unique(np.concatenate(lists)), groups) for level, lists in asked.items()}
        del asked
        for g, level, totals in zip(answered.column("grp").to_pylist(), answered.column("level").to_pylist(), answered.column("totals"), strict=True):
            keyed[level].answer(g, wide(totals.as_buffer()))
        told = np.zeros(len(keyed[PAIR].key), np.bool_)
        own: list[tuple] = []
        begin = 0
        for k, p in enumerate(parts):
            t = read(k)
            at = keyed[PAIR].place(t.pair)
            count, word = keyed[PAIR].value[at], keyed[WORD].value[keyed[WORD].place(t.word)]
            first_here = count < 0
            count, word = np.where(first_here, -1 - count, count), np.where(word < 0, -1 - word, word)
            # a context occurs as often as its word; that of a text's first token once a training text
            start = np.cumsum(t.length) - t.length
            context = np.empty_like(word)
            context[1:] = word[:-1]
            context[start] = m.texts
            low, seen = m.unigram(word), count > 0
            high = np.where(seen, count * m.share(count, PAIR), 1.0) / np.where(seen, context, 1)
            value = np.where(seen, np.log10(high), np.log10(low))
            base = np.log10((word + 0.1) / (m.tokens + 0.1 * (m.types + 1)))
            add = lambda x: np.add.reduceat(x, start)  # noqa: E731  every text has its end
            row = np.arange(begin, begin + len(t.length))
            yield facts(p.column("id"), kind=np.full(len(row), TEXT), row=row, n_tokens=t.length, n_known=add((word > 0).astype(np.int64)), base_score=add(base), score=add(value))
            back = np.flatnonzero(~seen & (context > 0))
            if len(back):
                by = np.lexsort((t.before[back], np.repeat(row, t.length)[back]))
                back = back[by]
                text, before = np.repeat(row, t.length)[back], t.before[back]
                fresh = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (before[1:] != before[:-1])]))
                n = np.diff(np.append(fresh, len(back)))
                yield facts(pa.nulls(len(fresh), p.column("id").type), kind=np.full(len(fresh), BACKOFF), row=text[fresh], context=before[fresh].view(np.int64), n=n)
            mine = np.flatnonzero(first_here & seen & ~told[at])
            _, once = np.unique(at[mine], return_index=True)
            mine = mine[once]
            told[at[mine]] = True
            own.append((t.before[mine], context[mine], (count * (1 - m.share(count, PAIR)))[mine], low[mine]))
            begin += len(row)
        before, context, lost, mass = (np.concatenate(x) for x in zip(*own, strict=True))
        del own, keyed, told
        key, first, inverse = np.unique(before, return_index=True, return_inverse=True)
        sums = [np.bincount(inverse, weights=x, minlength=len(key)) for x in (lost, mass)]
        yield facts(pa.nulls(len(key), texts.column("id").type), kind=np.full(len(key), CONTEXT), context=key.view(np.int64), total=context[first], lost=sums[0], mass=sums[1])

    def tagged(key: tuple, texts: pa.Table, answered: pa.Table) -> pa.Table:
        made = pa.concat_tables(run(texts, answered))
        return made.add_column(0, "block", pa.array(np.full(made.num_rows, key[0].as_py()), pa.int64()))

    names = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.float32(): "float"}
    out = f"block long, id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} {names[t]}" for c, t in FACTS.items())
    both = rows.select("block", "id", "text").groupBy("block").cogroup(answers.select("block", "grp", "level", "totals").groupBy("block"))
    return both.applyInArrow(tagged, out)


def backoff_weights(facts: DataFrame) -> DataFrame:
    """(context, total, alpha): the mass that a context's pairs leave, over the unigram mass of the words not seen behind it."""
    by = facts.where(F.col("kind") == CONTEXT).groupBy("context").agg(F.max("total").alias("total"), F.sum(F.col("lost").cast("double")).alias("lost"), F.sum(F.col("mass").cast("double")).alias("mass"))
    return by.select("context", "total", (F.col("lost") / F.col("total") / F.greatest(1 - F.col("mass"), F.lit(1e-12))).alias("alpha"))


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The input is read twice and has to be cut into splits alike both times.
    That holds for a table read straight from files (``stored``); anything else
    is written first.
    """
    if not stored:
        docs = materialize(docs.select(id_col, text_col), "texts")
    split = bytes_of(docs.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    rows, groups = in_blocks(docs, id_col, text_col, max(1, split // block_bytes))
    groups = max(groups, 1)
    answers = materialize(summed_counts(distinct_keys(rows, groups)), "answers")
    model = learned(answers, rows)
    facts = materialize(block_facts(rows, answers, model, groups), "facts")
    weights = materialize(backoff_weights(facts), "backoff")
    texts = facts.where(F.col("kind") == TEXT)
    back = facts.where(F.col("kind") == BACKOFF).select("block", "row", "context", "n").join(weights, "context")
    back = back.groupBy("block", "row").agg(F.sum(F.col("n") * F.log10("alpha")).alias("back"))
    return texts.join(back, ["block", "row"], "left").select(
        F.col("id").alias(id_col),
        held_out("id").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("score") + F.coalesce("back", F.lit(0.0))).alias("score"),
    )
