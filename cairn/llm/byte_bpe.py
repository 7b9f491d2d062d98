"""Byte-level BPE by backtracking from longest matches.

A piece (a match of the splitting pattern) is walked once. Its bytes, mapped
to Latin-1 characters, go through an Aho-Corasick automaton of all tokens,
which gives the longest token at every place. From there tokens are laid one
behind the other: a token follows the one before if merging the two tokens'
bytes would end in exactly these two, else its next shorter prefix is tried,
and where none is left the token before goes, and its end is closed for good.
Each place is closed once at most, so the walk is linear. What it ends with is
the one segmentation whose neighbours all go together, which is what merging
by rank gives. Whether two tokens go together is found by undoing their
merges along the cut, and remembered.

A token that merging never reaches from its bytes stands for a piece that
equals it and is used nowhere else.

Nulls and edges: a null or empty text has no token. Texts and pieces of any
length are encoded whole. Ids outside the vocabulary are refused when
decoding; null ids decode to nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.tasks import id_and_text, map_columns, slices

#: Fixed value: how texts are split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = -1


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file (one line a token: base64 and rank), from any place that Spark reads; as large as the vocabulary."""
    lines = spark.read.text(path if "://" in path else f"file://{path}").collect()
    return {base64.b64decode(a): int(b) for a, b in (line.value.split() for line in lines if line.value.strip())}


def merge(word: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Merging by rank, the least (and first) neighbours first, with ranks under ``below`` only: for short words, such as tokens."""
    parts = [word[k : k + 1] for k in range(len(word))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, below), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@dataclass
class Vocabulary:
    """Tokens by rank, with the two tokens that each is merged from (itself for a single byte) and its longest shorter prefix."""

    ranks: dict[bytes, int]
    token: dict[int, bytes] = field(init=False)
    merged: dict[bytes, int] = field(init=False)
    left: dict[int, int] = field(init=False)
    right: dict[int, int] = field(init=False)
    size: dict[int, int] = field(init=False)
    shorter: dict[int, int] = field(init=False)

    def __post_init__(self):
        self.token = {r: t for t, r in self.ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 bytes")
        self.left, self.right, self.merged = {}, {}, {}
        for r, t in self.token.items():
            halves = [t, t] if len(t) == 1 else merge(t, self.ranks, r)
            if len(halves) == 2:
                self.left[r], self.right[r], self.merged[t] = self.ranks[halves[0]], self.ranks[halves[1]], r
        self.size = {r: len(t) for r, t in self.token.items()}
        self.shorter = {r: next((self.merged[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.merged), NONE) for t, r in self.merged.items()}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "known", "pairs")}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for t, r in self.merged.items():
            found.add_word(t.decode("latin-1"), (len(t) - 1, r))
        found.make_automaton()
        return found

    @cached_property
    def pairs(self) -> dict[int, bool]:
        """By both ids in one integer."""
        return {}

    @cached_property
    def known(self) -> dict[str, bytes]:
        encode_piece = self.encode_piece

        class Known(dict):
            def __missing__(self, piece: str) -> bytes:
                path = encode_piece(piece.encode())
                ids = struct.pack(f"<{len(path)}I", *path)
                if len(piece) <= 64:
                    self[piece] = ids
                return ids

        return Known()

    def together(self, a: int, b: int, most: int = 1 << 19) -> bool:
        """Whether merging the bytes of both gives exactly these two; answers are kept in ``pairs``, ``most`` at a time."""
        if len(self.pairs) >= most:
            self.pairs.clear()
        found = self.pairs[a << 32 | b] = self._together(a, b)
        return found

    def _together(self, a: int, b: int) -> bool:
        """Undo the later of the two merges along the cut; what would have been merged across it before that undoes the pair."""
        token, merged = self.token, self.merged
        limit = float("inf")  # merges across the cut are earlier than this, if they come at all
        while True:
            across = merged.get(token[a] + token[b])
            if across is not None and across < limit:
                return False
            ends = self.right[a] == a, self.left[b] == b
            if ends == (True, True):
                return True
            # the cut's left side is merged first where ranks are equal, as it stands first
            if ends[1] or (not ends[0] and a > b):
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [NONE] * (len(piece) + 1)
        for end, (before, r) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - before] = r  # ends ascend: what comes later from the same place is longer
        size, shorter, known = self.size, self.shorter, self.pairs.get
        open_at = bytearray(b"\1") * (len(piece) + 1)
        path: list[int] = []
        at, candidate, last = 0, longest[0], NONE
        while at < len(piece):
            while candidate >= 0:
                end = at + size[candidate]
                if open_at[end]:
                    if last < 0:
                        break
                    fits = known(last << 32 | candidate)
                    if fits or (fits is None and self.together(last, candidate)):
                        break
                candidate = shorter[candidate]
            if candidate >= 0:
                path.append(candidate)
                at, last, candidate = end, candidate, longest[end]
            else:  # nothing leads on from here
                open_at[at] = 0
                path.pop()
                at, candidate = at - size[last], shorter[last]
                last = path[-1] if path else NONE
        return path

    def encode(self, text: str, most: int = 1 << 19) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers; short pieces' ids are kept, ``most`` at a time."""
        if len(self.known) > most:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, _SPLIT.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_SPLIT = regex.compile(PATTERN)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids), one row per input row; ``ids`` holds little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(read_ranks(spark, ranks_path)))

    def run(batch: pa.RecordBatch) -> dict:
        made = [shared.value.encode(t) for part in slices(batch) for t in part.column("text").to_pylist()]
        return {"ids": pa.array(made, pa.binary())}

    return map_columns(id_and_text(docs, id_col, text_col), ["id"], "ids binary", run).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded): ``decoded`` is the bytes that the ids stand for."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(read_ranks(spark, ranks_path)))

    def run(batch: pa.RecordBatch) -> dict:
        return {"decoded": pa.array([shared.value.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.binary())}

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return map_columns(rows, ["id", "ids"], "decoded binary", run).withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded again, digests of both, in one pass."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(read_ranks(spark, ranks_path)))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for part in slices(batch):
            for text in part.column("text").to_pylist():
                ids = shared.value.encode(text)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(shared.value.decode(ids)).hexdigest())
        return out

    rows = id_and_text(docs, id_col, text_col)
    return map_columns(rows, ["id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", run).withColumnRenamed("id", id_col)
