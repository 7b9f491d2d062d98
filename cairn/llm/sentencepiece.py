"""SentencePiece encoding and decoding as a lattice of table operations.

The distinct pre-tokens of a few megabytes of text are a table of characters.
Substrings of bounded length explode from it, one length at a time, as long as
some piece begins so; an equi-join with the piece table (on 64-bit hashes of
the bytes) leaves the lattice's edges; edges are grouped by pre-token and end
position; a fold over the end positions keeps, for all pre-tokens at once, the
best edge into each (Viterbi; at equal sums the longer piece). Texts look
their pre-tokens up. Decoding joins the ids back to the pieces' bytes.

:func:`encode_relational` is the same over Spark rows from end to end, with
:func:`encode_words` as its lattice and the fold as a higher-order
``aggregate``. The query doesn't run on it; the README says why, with figures.

Nulls and edges: a null or empty text has no ids and decodes to itself. A
character outside the vocabulary becomes the byte pieces of its UTF-8 form. A
text that has the space mark U+2581 of its own decodes to a space there, and
its ``round_trip`` is false. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.hashing import words as split_words
from cairn.llm.pieces import PRE_TOKEN, SPACE, Pieces, check_cuts, load, pre_tokens
from cairn.llm.tasks import id_and_text, map_columns, slices
from cairn.plans.durable import materialize

#: What a substring is to the piece table, if not the row of a piece.
PREFIX, ABSENT = -1, -2


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of values[s : s + n] over starts and lengths."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    upto = np.cumsum(lengths)
    at = np.repeat(starts - (upto - lengths), lengths)
    return values[at + np.arange(total)]


def _hashes(items: list[str]) -> np.ndarray:
    w = split_words(pa.array(items), lower=False)
    return w.range_hash(*_rows(items))


def _rows(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(x.encode("utf-8", "surrogatepass")) for x in items])
    return np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)


def blocks(distinct: list[str], most: int = 1 << 18) -> list[list[str]]:
    """Pre-tokens in runs of about ``most`` characters, so that the edges of one lattice stay small."""
    block = np.cumsum([len(x) for x in distinct]) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(distinct)]
    return [distinct[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Lattice:
    """The piece table as sorted hash columns, and the encoder and decoder over it."""

    def __init__(self, pieces: Pieces):
        self.unknown, self.longest = pieces.unknown, pieces.longest
        items = list(pieces.score)
        h = _hashes(items)
        order = np.argsort(h)
        self.piece = h[order]
        self.id = np.array([pieces.score[p][0] for p in items], np.int64)[order]
        self.score = np.array([pieces.score[p][1] for p in items])[order]
        self._fill(np.unique(_hashes(sorted({p[:n] for p in items for n in range(1, len(p) + 1)}))))
        self.byte_id = np.array(pieces.byte_id, np.int64)
        texts = [*pieces.text, "\ufffd".encode()]  # the last one stands for ids outside the vocabulary
        sizes = np.array([len(t) for t in texts], np.int64)
        self.text_at, self.text_size = np.cumsum(sizes) - sizes, sizes
        self.text = np.frombuffer(b"".join(texts), np.uint8)

    def _fill(self, prefixes: np.ndarray) -> None:
        """The join's build side: an open-addressed table from a hash to its piece's row, PREFIX or ABSENT."""
        row = np.minimum(np.searchsorted(self.piece, prefixes), len(self.piece) - 1)
        row = np.where(self.piece[row] == prefixes, row, PREFIX)
        bits = max(4, int(4 * len(prefixes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.row = np.zeros(1 << bits, np.uint64), np.full(1 << bits, ABSENT, np.int64)
        slot, left = (prefixes >> self.shift).astype(np.int64), np.arange(len(prefixes))
        while len(left):
            free = left[self.row[slot[left]] == ABSENT]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.key[slot[put]], self.row[slot[put]] = prefixes[put], row[put]
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece's row for each hash; PREFIX if a piece only begins so, ABSENT if none does."""
        slot = (h >> self.shift).astype(np.int64)
        out = self.row[slot]
        other = np.flatnonzero((out != ABSENT) & (self.key[slot] != h))
        while len(other):
            slot[other] = (slot[other] + 1) & self.mask
            out[other] = self.row[slot[other]]
            other = other[(out[other] != ABSENT) & (self.key[slot[other]] != h[other])]
        return out

    def edges(self, data: np.ndarray, w, char: np.ndarray, last: np.ndarray, node: np.ndarray):
        """(source, target, score, row of the piece table or -1 - byte position) of every edge."""
        found = []
        alive = np.arange(len(char) - 1)
        for length in range(1, self.longest + 1):
            alive = alive[alive + length <= last[alive]]
            if not len(alive):
                break
            h = w.range_hash(char[alive], char[alive + length])
            row = self.find(h)
            hit = row >= 0
            a, at = alive[hit], row[hit]
            found.append((node[a], node[a] + length, self.score[at], at))
            if length == 1:
                a = alive[~hit]
                found.append((node[a], node[a] + 1, np.full(len(a), self.unknown), -1 - char[a]))
            alive = alive[row != ABSENT]
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def encode(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens in a row, number of ids of each)."""
        if not distinct:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w = split_words(pa.array(distinct), lower=False)
        data = w.data
        begin, _ = _rows(distinct)
        char = np.flatnonzero((data & 0xC0) != 0x80)
        owner = np.searchsorted(begin, char, side="right") - 1
        n = np.bincount(owner, minlength=len(distinct))
        upto = np.cumsum(n)
        base = upto - n + np.arange(len(distinct))  # a pre-token of n characters has n + 1 nodes
        node = np.arange(len(char)) + owner
        last = upto[owner]
        char = np.append(char, len(data))
        source, target, score, piece = self.edges(data, w, char, last, node)
        first_node = np.repeat(base, n + 1)
        step = target - first_node[target]
        width = np.int64(len(first_node) + 1)
        order = np.argsort(step * width + target, kind="stable")
        # edges were made by increasing length; at equal sums the longest comes first
        source, target, score, piece, step = (x[order] for x in (source, target, score, piece, step))
        best = np.zeros(len(first_node))
        into = np.full(len(first_node), -1, np.int64)
        bounds = np.searchsorted(step, np.arange(1, int(step[-1]) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            t, total = target[a:b], best[source[a:b]] + score[a:b]
            seg = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            top = np.maximum.reduceat(total, seg)
            sizes = np.diff(np.append(seg, b - a))
            at = np.where(total == np.repeat(top, sizes), np.arange(a, b), -1)
            into[t[seg]] = np.maximum.reduceat(at, seg)
            best[t[seg]] = top
        # walk back from the last nodes, all pre-tokens at once
        at, who = base + n, np.arange(len(distinct))
        walked, whose = [], []
        while len(at):
            e = into[at]
            walked.append(e)
            whose.append(who)
            at = source[e]
            go = at > base[who]
            at, who = at[go], who[go]
        walked, whose = np.concatenate(walked[::-1]), np.concatenate(whose[::-1])
        walked = walked[np.argsort(whose, kind="stable")]
        whose = np.sort(whose, kind="stable")
        p = piece[walked]
        ids = np.where(p >= 0, self.id[np.maximum(p, 0)], 0)
        if (p < 0).any():
            start = np.maximum(-1 - p, 0)
            size = np.where(p < 0, char[np.searchsorted(char, start) + 1] - start, 1)
            out = np.repeat(ids, size)
            unknown = np.repeat(p < 0, size)
            out[unknown] = self.byte_id[_gather(data, start[p < 0], size[p < 0])]
            return out, np.bincount(np.repeat(whose, size), minlength=len(distinct))
        return ids, np.bincount(whose, minlength=len(distinct))

    def encode_texts(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text) for texts as lists of pre-tokens."""
        number: defaultdict[str, int] = defaultdict(count().__next__)
        every = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        ids, n = (np.concatenate(x) for x in zip(*map(self.encode, blocks(list(number))), strict=True))
        starts = np.cumsum(n) - n
        out = _gather(ids, starts[every], n[every])
        at = np.concatenate([[0], np.cumsum(n[every])])
        return out, np.diff(at[np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)])

    def decode(self, ids: np.ndarray) -> bytes:
        last = len(self.text_at) - 1
        ids = np.where((ids >= 0) & (ids < last), ids, last)
        return _gather(self.text, self.text_at[ids], self.text_size[ids]).tobytes()


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = 2 << 20) -> DataFrame:
    """One row per input row: id, n_tokens, ids, round_trip (the ids decode to the text)."""
    pieces = load(model_path)
    check_cuts(pieces)
    shared = docs.sparkSession.sparkContext.broadcast(Lattice(pieces))

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        ids, n = shared.value.encode_texts([pre_tokens(t) for t in texts])
        at = np.concatenate([[0], np.cumsum(n)])
        same = [shared.value.decode(ids[at[k] : at[k + 1]])[1:] == t.encode("utf-8", "surrogatepass") for k, t in enumerate(texts)]
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))
        return {"n_tokens": n, "ids": lists, "round_trip": same}

    rows = id_and_text(docs, id_col, text_col)
    return map_columns(rows, ["id"], "n_tokens long, ids array<int>, round_trip boolean", run, most).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; a null list decodes to the empty text, bytes that are not UTF-8 and ids outside the vocabulary to U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(Lattice(load(model_path)))

    def run(batch: pa.RecordBatch) -> dict:
        made = [shared.value.decode(np.array(x or [], np.int64))[1:].decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
        return {"text": made}

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return map_columns(rows, ["id"], "text string", run).withColumnRenamed("id", id_col)


def encode_relational(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids), one row per input row, by table operations alone: texts explode to pre-tokens, whose distinct forms
    :func:`encode_words` encodes, and which meet these by an equi-join and their text by its row number.

    Every pre-token of the corpus passes two exchanges, several times the input; :func:`encode` encodes in the task instead.
    """
    normal = F.concat(F.lit(SPACE), F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(" "), F.lit(SPACE)))
    cut = F.when(F.coalesce(F.col(text_col), F.lit("")) != "", F.regexp_extract_all(normal, F.lit(PRE_TOKEN.pattern), F.lit(0)))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), cut.alias("words"))
    rows = rows.select("id", "row", F.posexplode_outer("words").alias("pos", "word"))
    rows = materialize(rows, "pretokens")
    known = materialize(encode_words(rows.where("word is not null").select("word").distinct(), model_path), "encoded")
    ids = F.flatten(F.array_sort(F.collect_list(F.struct("pos", "ids")))["ids"])  # a text's own pre-tokens
    joined = rows.join(known, "word", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return joined.groupBy("row", "id").agg(ids.alias("ids")).select(F.col("id").alias(id_col), F.size("ids").cast("long").alias("n_tokens"), "ids")


def encode_words(words: DataFrame, model_path: str) -> DataFrame:
    """(word, ids) for distinct pre-tokens (word), relationally.

    Substrings explode from the words, an equi-join with the broadcast piece
    table (its size is the model's) leaves edges, ``groupBy`` collects them by
    word, and ``aggregate`` folds over the end positions with the best sums
    and the paths so far as its state.
    """
    spark = words.sparkSession
    pieces = load(model_path)
    check_cuts(pieces)
    table = F.broadcast(spark.createDataFrame([(p, i, float(s)) for p, (i, s) in pieces.score.items()], "piece string, pid int, score double"))
    ends = words.where(F.col("word") != "").select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("end"))
    cut = F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.col("end")))
    subs = ends.select("word", "end", F.explode(cut).alias("n")).withColumn("piece", F.expr("substring(word, end - n + 1, n)"))
    found = subs.join(table, "piece", "left").where("pid is not null or n = 1")
    edge = F.struct(F.col("n").alias("n"), F.coalesce("pid", F.lit(-1)).alias("pid"), F.coalesce("score", F.lit(pieces.unknown)).alias("score"))
    by_end = found.groupBy("word", "end").agg(F.collect_list(edge).alias("edges"))
    lattice = by_end.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("end", "edges"))).alias("steps"))
    spark_bytes = F.array(*[F.lit(i) for i in pieces.byte_id])
    lattice = lattice.withColumn("raw", F.transform(F.split("word", ""), lambda c: F.hex(F.encode(c, "UTF-8"))))
    fold = F.expr(
        """aggregate(steps,
             cast(array(struct(0D, 0, 0)) as array<struct<total:double,n:int,pid:int>>),
             (state, step) -> concat(state, array(array_max(transform(step.edges,
                e -> struct(state[step.end - e.n].total + e.score as total, e.n as n, e.pid as pid))))))"""
    )
    walk = F.expr(
        """aggregate(steps, struct(size(steps) as at, cast(array() as array<struct<at:int,pid:int>>) as path),
             (s, step) -> if(s.at = 0, s, struct(s.at - best[s.at].n as at,
                concat(array(struct(s.at as at, best[s.at].pid as pid)), s.path) as path))).path"""
    )
    path = lattice.withColumn("best", fold).withColumn("path", walk)
    one = lambda x: F.when(x["pid"] >= 0, F.array(x["pid"])).otherwise(
        F.transform(
            F.regexp_extract_all(F.get(F.col("raw"), x["at"] - 1), F.lit(".."), F.lit(0)),
            lambda b: F.get(spark_bytes, F.conv(b, 16, 10).cast("int")),
        )
    )
    return path.withColumn("bytes", spark_bytes).select("word", F.flatten(F.transform("path", one)).alias("ids"))
