"""SentencePiece model files: the piece table and the text normalisation that it asks for.

Reads the protobuf wire format directly (a model is a list of pieces, each
with text, score and type), so that drivers and executors need no library.
Scores are used as a unigram model's log-probabilities, whatever trainer made
the file: the best segmentation is the one with the greatest sum of scores. A
character that no piece covers is an unknown of ``least score - 10``, written
as the byte pieces of its UTF-8 form.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

#: Fixed values of the format: piece types, and the penalty of an unknown character.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
SPACE = "▁"

PRE_TOKEN = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        else:
            raise ValueError("not a SentencePiece model")
        yield tag >> 3, value


@dataclass
class Pieces:
    """``score``: matchable pieces to (id, score). ``text``: every id's bytes when decoded."""

    score: dict[str, tuple[int, float]] = field(default_factory=dict)
    byte_id: list[int] = field(default_factory=lambda: [-1] * 256)
    text: list[bytes] = field(default_factory=list)
    unknown: float = 0.0
    longest: int = 1


def load(path: str) -> Pieces:
    out = Pieces()
    with open(path, "rb") as f:
        data = f.read()
    least = 0.0
    for number, value in _fields(data):
        if number != 1:
            continue
        piece = dict(_fields(value))
        text, score, kind = piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)
        i = len(out.text)
        if kind == BYTE:
            b = int(text[3:5], 16)
            out.byte_id[b] = i
            out.text.append(bytes([b]))
        elif kind in (NORMAL, USER_DEFINED):
            out.text.append(text.replace(SPACE, " ").encode())
            out.score[text] = (i, score)
            out.longest = max(out.longest, len(text))
            least = min(least, score)
        else:
            out.text.append(b"")
    if min(out.byte_id) < 0:
        raise ValueError("the model has no byte pieces")
    out.unknown = least - UNKNOWN_PENALTY
    return out


def normalised(text: str) -> str:
    """One space in front, spaces as the space mark; the empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def pre_tokens(text: str) -> list[str]:
    """Pieces of the normalised text that no vocabulary piece crosses: the cuts are before a run of space marks and around newlines."""
    return PRE_TOKEN.findall(normalised(text))


def check_cuts(pieces: Pieces) -> None:
    """The cuts are safe if no piece has a space mark behind another character, and none has a newline."""
    for p in pieces.score:
        if SPACE in p.lstrip(SPACE) or "\n" in p:
            raise ValueError(f"piece {p!r} crosses pre-tokens")


def viterbi(word: str, pieces: Pieces) -> list[int]:
    """Best segmentation of one pre-token, plainly; the operators are tested against it."""
    n = len(word)
    best: list[tuple[float, int, list[int]] | None] = [None] * (n + 1)
    best[0] = (0.0, 0, [])
    for end in range(1, n + 1):
        for start in range(max(0, end - pieces.longest), end):
            found = pieces.score.get(word[start:end])
            if found:
                total, ids = best[start][0] + found[1], [found[0]]
            elif end - start == 1:
                total, ids = best[start][0] + pieces.unknown, [pieces.byte_id[b] for b in word[start:end].encode("utf-8", "surrogatepass")]
            else:
                continue
            if best[end] is None or total > best[end][0]:
                best[end] = (total, start, ids)
    out, end = [], n
    while end:
        out.append(best[end][2])
        end = best[end][1]
    return [i for ids in reversed(out) for i in ids]
