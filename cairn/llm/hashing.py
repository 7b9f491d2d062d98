"""Vectorised word splitting and hashing of Arrow text columns inside tasks.

Texts stay in Arrow's byte buffers; words are runs of bytes outside
0x20 and 0x09-0x0D, exactly ``[^\\x20\\x09-\\x0D]+`` on UTF-8.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_R), -1, 1 << 64))
#: By n, a word's n lowest bytes.
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_POWERS = {"r": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    if len(_POWERS[kind]) < n:
        out = np.full(max(n, 1 << 16), _R if kind == "r" else _INV, np.uint64)
        out[0] = 1
        _POWERS[kind] = np.multiply.accumulate(out)
    return _POWERS[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), applied elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """The words of a batch: byte ranges, 64-bit hashes and, per row, ``offsets`` into them."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray

    @cached_property
    def _prefix(self) -> np.ndarray:
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.multiply(self.data, _powers("r", len(out))[: len(self.data)], out=out[1:], dtype=np.uint64)
        out[1:] += _powers("r", len(out))[: len(self.data)]
        return np.cumsum(out, out=out)

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of short byte ranges (pieces, beginnings of words): a polynomial, so every range costs the same.

        Not for ranges of hundreds of bytes, where polynomials modulo 2^64 have
        equal values by construction; ``hash`` is made otherwise.
        """
        raw = (self._prefix[end] - self._prefix[start]) * _powers("inv", len(self._prefix))[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, longest: int = 256, key: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes at a time, each step mixed in full; BLAKE2 beyond ``longest`` bytes.

    Each step can be inverted by who knows the ``key``, so equal hashes can be
    computed for key 0. Where texts may be made to collide, the caller draws a
    secret of 64 bits for each run; it goes into every step.
    """
    size = end - start
    secret = mix(np.array([key], np.uint64) ^ np.uint64(0x452821E638D01377))[0] if key else np.uint64(0)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    left = np.flatnonzero(size <= longest)
    step = 0
    while len(left):
        at = start[left] + step
        chunk = np.ascontiguousarray(eight[at]).view("<u8").ravel()
        held = np.minimum(end[left] - at, 8)
        chunk &= _LOW_BYTES[held]
        out[left] = mix(out[left] ^ mix((chunk ^ secret) + np.uint64(0xD6E8FEB86659FD93)))
        step += 8
        left = left[size[left] > step]
    for k in np.flatnonzero(size > longest):
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, key=key.to_bytes(8, "little") if key else b"").digest(), "little")
    return out


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and its row offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_binary()).fill_null(b"")
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(buffers[2]) else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return data[first : offsets[-1] if len(offsets) else 0], offsets - first


def words(col: pa.Array | pa.ChunkedArray, lower: bool = True, key: int = 0) -> Words:
    """Split each row into words; ``lower`` maps A-Z to a-z first and changes no other byte. ``key``: that of the words' hashes."""
    data, rows = text_bytes(col)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = np.zeros(len(data) + 2, np.bool_)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    # a row's end also ends a word: cut where one row's last byte meets the next row's first
    change = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = change[::2], change[1::2]
    cuts = rows[1:-1]
    if len(cuts):
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
        cuts = cuts[inside[cuts] & inside[cuts + 1]]
        if len(cuts):
            start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    return Words(data, start, end, hash_ranges(data, start, end, key=key), np.searchsorted(start, rows))
