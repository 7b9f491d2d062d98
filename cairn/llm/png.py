"""Grey 8-bit PNG images: written from and read back to raw rows of samples.

The reader checks the signature, every chunk's CRC-32, the zlib stream's
Adler-32 (by zlib) and the header, and undoes all five scanline filters:
None, Sub and Up for whole images or rows at once with numpy, Average and
Paeth, whose samples depend on their left neighbours, sample by sample.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(samples: np.ndarray, level: int = 1) -> bytes:
    """PNG of a (height, width) array of uint8; one filter for the image, by the least sum of signed residuals."""
    height, width = samples.shape
    up = samples.copy()
    up[1:] -= samples[:-1]
    sub = samples.copy()
    sub[:, 1:] -= samples[:, :-1]
    cost = [int(np.minimum(x, -x).sum(dtype=np.int64)) for x in (samples, sub, up)]
    best = int(np.argmin(cost))
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = (NONE, SUB, UP)[best]
    lines[:, 1:] = (samples, sub, up)[best]
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _paeth(a: int, b: int, c: int) -> int:
    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return a if pa <= pb and pa <= pc else b if pb <= pc else c


def unfilter(lines: np.ndarray) -> np.ndarray:
    """(height, 1 + width) filtered scanlines to samples."""
    kinds, rows = lines[:, 0], lines[:, 1:]
    if len(kinds) and kinds.max() > PAETH:
        raise ValueError("unknown PNG filter")
    out = rows.copy()
    if not kinds.any():
        return out
    if (kinds == SUB).all():
        return np.cumsum(rows, axis=1, dtype=np.uint8)
    if (kinds == UP).all():
        return np.cumsum(rows, axis=0, dtype=np.uint8)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds):
        if kind == SUB:
            out[y] = np.cumsum(rows[y], dtype=np.uint8)
        elif kind == UP:
            out[y] = rows[y] + above
        elif kind >= AVERAGE:
            left = corner = 0
            for x, (r, b) in enumerate(zip(rows[y].tolist(), above.tolist(), strict=True)):
                left = (r + ((left + b) // 2 if kind == AVERAGE else _paeth(left, b, corner))) & 255
                out[y, x], corner = left, b
        above = out[y]
    return out


def decode(data: bytes) -> np.ndarray:
    """Samples of a grey 8-bit, not interlaced PNG; ValueError on any damage."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut PNG chunk")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of PNG chunk {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
    if header is None or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("PNG header")
    width, height = header[:2]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError("PNG data") from e
    if len(raw) != height * (width + 1):
        raise ValueError("PNG size")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))
