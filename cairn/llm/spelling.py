"""Spelling variants grouped by anagram hashing.

A word's anagram key is the sum of its letters' fifth powers, so words of the
same letters share it, and taking a letter away takes its power off the key.
Every word stands under its own key (power 0) and, for each of its different
letters, under the key without it. Two words that differ by one added or
removed letter meet where one stands whole and the other without that letter;
two that differ by one exchanged letter meet where both stand without theirs.
A difference of two fifth powers tells its letters, so a pair meets under one
key only, and rows of equal power under a key are anagrams of each other, at
least two edits apart: they are not paired.

Letter order is verified in two steps: the join asks for equal first or equal
last halves besides (one edit leaves one of them whole), which keeps the words
of a large anagram class apart, then ``levenshtein`` decides.

Nulls and edges: a null or empty text has no word; a null id counts as empty
in the slips. Repeated rows count again. Words of any length take part; keys
are sums modulo 2^62. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.tasks import slices
from cairn.plans.durable import materialize, measured, scratch

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def lower(run: str) -> str:
    """A-Z to a-z; every other letter stays."""
    return run.lower() if run.isascii() else run.translate(_LOWER)


def slipped(run: str, start: int, every: int) -> str:
    """The run, without one letter where the CRC-32 (continued from ``start``, that of the text's prefix) is a multiple of ``every``."""
    h = zlib.crc32(run.encode(), start)
    at = h % len(run)
    return run if h % every else run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str, text_col: str, every: int, shortest: int, most: int = 1 << 18) -> DataFrame:
    """(word, n) over all texts. A task counts up to ``most`` words before it hands them on; the rest is a plain sum by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array(list(made.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in slices(batch, most=4 << 20):
                for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    start = zlib.crc32(b"%s:" % (i or "").encode())
                    for found, n in Counter(RUN.findall(text)).items():
                        word = slipped(lower(found), start, every)
                        if len(word) >= shortest:
                            made[word] += n
                if len(made) >= most:
                    yield out()
                    made.clear()
        yield out()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _power(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def anagram_rows(words: DataFrame) -> DataFrame:
    """(word, n) to the rows under which a word may meet others: key, power of the letter taken away (0: none), half, and ``first`` on rows of last halves."""
    within = F.lit((1 << 62) - 1)
    letters = F.split("word", "")
    key = F.aggregate(letters, F.lit(0).cast("long"), lambda total, c: (total + _power(c)).bitwiseAND(within))
    taken = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.array_distinct(letters), _power))
    rows = words.select("word", "n", F.length("word").alias("size"), key.alias("whole"), F.explode(taken).alias("power"))
    rows = rows.select("word", "n", "size", "power", (F.col("whole") - F.col("power")).bitwiseAND(within).alias("key"))
    half = F.expr("cast(floor((size - if(power = 0, 0, 1)) / 2) as int)")
    rows = rows.withColumn("half", half).withColumns(
        {"first": F.xxhash64(F.lit(1), F.expr("substring(word, 1, half)")), "last": F.xxhash64(F.lit(2), F.expr("substring(word, size - half + 1, half)"))}
    )
    both = F.array(
        F.struct(F.col("first").alias("part"), F.lit(None).cast("long").alias("first")),
        F.struct(F.col("last").alias("part"), F.col("first").alias("first")),
    )
    return rows.select("word", "n", "power", "key", F.inline(both))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), each pair of words one edit apart once."""
    rows = anagram_rows(words)
    a, b = rows.alias("a"), rows.alias("b")
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.power") != F.col("b.power"))
    # a pair with equal first halves met there already
    once = F.col("a.first").isNull() | (F.col("a.first") != F.col("b.first"))
    edit = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    joined = a.join(b, met & once & (F.col("a.word") < F.col("b.word")) & edit)
    return joined.select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, shortest: int = 5, least: int = 3, times: int = 2
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words are runs of letters, lower-cased in A-Z, one of ``every`` with a
    letter lost, of ``shortest`` letters and ``least`` occurrences or more. A
    word's form is its most frequent near word (ties: the smallest) if that is
    ``times`` as frequent or more; the root is where following forms ends.
    """
    with scratch(docs.sparkSession):
        counted = word_counts(docs, id_col, text_col, every, shortest).where(F.col("n") >= least)
        words = materialize(counted, "words")
        pairs = near_pairs(words)
        ends = F.array(
            F.struct("word", "n", "other", "other_n"),
            F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")),
        )
        near = pairs.select(F.inline(ends)).groupBy("word")
        near = near.agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
        linked = words.join(near, "word", "left")
        enough = -F.col("best.minus") >= times * F.col("n")
        linked = linked.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, F.col("best.other")).alias("form"),
            F.when(enough, -F.col("best.minus")).alias("form_n"),
        )
        linked = materialize(linked, "forms")
        roots = _roots(linked.where("form is not null").select("word", F.col("form").alias("root")))
        out = linked.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
        return materialize(out.select("word", "n", "n_near", "form", "form_n", "root"), "variants", kept=True)


def _roots(steps: DataFrame) -> DataFrame:
    """(word, root) at the ends of chains, by pointer doubling; counts grow along a chain, so a few rounds reach every end."""
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved, seen = measured(moved, "roots", moved=F.sum(F.col("moved").cast("long")))
        steps = moved.select("word", "root")
        if not seen.get("moved"):
            return steps
