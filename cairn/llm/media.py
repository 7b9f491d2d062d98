"""Media columns: payloads as PNG images in binary columns, with perceptual hashes.

A payload of 64 n bytes is an image of width 64 and height n. What is stored
is the PNG; sizes, digests and features come from the samples read back out of
it. The feature is a low-frequency cosine hash: the image averaged (or, where
it is smaller, repeated) to 32 x 32, a DCT-II, and the signs of the 8 x 8
lowest coefficients against their median without the constant one.

Nulls and edges: a null text is the empty text, whose payload is 64 zero
bytes. Equal texts give equal values. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import png
from cairn.llm.tasks import id_and_text, map_columns

WIDTH, SIDE, LOW = 64, 32, 8

_k, _x = np.meshgrid(np.arange(SIDE), np.arange(SIDE), indexing="ij")
DCT = np.cos(np.pi * (2 * _x + 1) * _k / (2 * SIDE))[:LOW]


def payload_samples(text: str | None) -> tuple[np.ndarray, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")
    return np.frombuffer(padded, np.uint8).reshape(-1, WIDTH), len(raw)


def _resize(a: np.ndarray) -> np.ndarray:
    """Rows averaged or repeated to SIDE of them."""
    n = len(a)
    if n <= SIDE:
        return a[np.arange(SIDE) * n // SIDE]
    edges = np.arange(SIDE) * n // SIDE
    return np.add.reduceat(a, edges, axis=0) / np.diff(np.append(edges, n))[:, None]


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits."""
    small = _resize(_resize(samples.astype(np.float64)).T).T
    low = np.round(DCT @ small @ DCT.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each row's payload as a PNG in a binary column."""

    def write(batch: pa.RecordBatch) -> dict:
        made = [payload_samples(t) for t in batch.column("text").to_pylist()]
        return {"n_bytes": [n for _, n in made], "media": [png.encode(s) for s, _ in made]}

    rows = id_and_text(docs, id_col, text_col)
    return map_columns(rows, ["id"], "n_bytes long, media binary", write).withColumnRenamed("id", id_col)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Reads each stored image back: payload and media sizes, digests, feature."""

    def read(batch: pa.RecordBatch) -> dict:
        out = {c.split()[0]: [] for c in FEATURES.split(", ")}
        for data in batch.column("media").to_pylist():
            samples = png.decode(data)
            payload = samples.tobytes()
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-WIDTH:]))
            out["media_bytes"].append(len(data))
            out["media_sha256"].append(hashlib.sha256(data).hexdigest())
            out["feature"].append(cosine_hash(samples))
        return out

    rows = media.select(F.col(id_col).alias("id"), "n_bytes", F.col(media_col).alias("media"))
    return map_columns(rows, ["id", "n_bytes"], FEATURES, read).withColumnRenamed("id", id_col)
