"""Token counts by dynamic programming over a trie of pre-tokens.

A task takes the distinct pre-tokens of its texts in sorted order, which is
the order of a walk through their trie. The unigram forward scores (best sum
of piece scores, and the number of tokens on that path) stand on a stack with
one entry per character of the current path; a new pre-token keeps the part
that it shares with the one before and computes the rest. Each trie node is
thus scored once, and a terminal's count is stored for the texts to look up.
Scores at equal best keep the longer last piece. Nothing is shuffled, and a
task holds no more than the pre-tokens of a few megabytes of text.

Nulls and edges: a null or empty text has no token. A character outside the
vocabulary counts its UTF-8 bytes. A pre-token of any length needs memory in
proportion to that length. An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm.pieces import Pieces, check_cuts, load, pre_tokens
from cairn.llm.tasks import id_and_text, map_columns, slices


def lengths_by_end(pieces: Pieces) -> dict[str, tuple[int, ...]]:
    """For each last character (and each last two), the lengths of the pieces that end so, longest first."""
    found: dict[str, set[int]] = {}
    for p in pieces.score:
        found.setdefault(p[-2:] if len(p) > 1 else p, set()).add(len(p))
    return {k: tuple(sorted(v, reverse=True)) for k, v in found.items()}


def terminal_counts(distinct: list[str], pieces: Pieces, ends: dict[str, tuple[int, ...]]) -> dict[str, int]:
    """Tokens of each pre-token, scored in sorted order with shared prefixes."""
    table, unknown = pieces.score, pieces.unknown
    best, count, out, last = [0.0], [0], {}, ""
    for word in sorted(distinct):
        shared = 0
        for x, y in zip(word, last):
            if x != y:
                break
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            one = word[end - 1]
            top, n = None, 0
            if end > 1:
                for length in ends.get(word[end - 2 : end], ()):
                    if length <= end and (found := table.get(word[end - length : end])):
                        total = best[end - length] + found[1]
                        if top is None or total > top:
                            top, n = total, count[end - length] + 1
            found = table.get(one)
            total, m = (best[end - 1] + found[1], 1) if found else (best[end - 1] + unknown, len(one.encode("utf-8", "surrogatepass")))
            if top is None or total > top:
                top, n = total, count[end - 1] + m
            best.append(top)
            count.append(n)
        out[word] = count[-1]
        last = word
    return out


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = 16 << 20) -> DataFrame:
    """One row per input row: id, n_pretokens, n_tokens."""
    pieces = load(model_path)
    check_cuts(pieces)
    shared = docs.sparkSession.sparkContext.broadcast((pieces, lengths_by_end(pieces)))

    def run(batch: pa.RecordBatch) -> dict:
        out = {"n_pretokens": [], "n_tokens": []}
        for part in slices(batch, most=most):
            texts = [pre_tokens(t) for t in part.column("text").to_pylist()]
            counts = terminal_counts(list(set().union(*texts)), *shared.value)
            for t in texts:
                out["n_pretokens"].append(len(t))
                out["n_tokens"].append(sum(map(counts.__getitem__, t)))
        return out

    rows = id_and_text(docs, id_col, text_col)
    return map_columns(rows, ["id"], "n_pretokens long, n_tokens long", run).withColumnRenamed("id", id_col)
