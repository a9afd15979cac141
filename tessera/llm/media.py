"""Media columns: texts stored as lossless WebP images, read back as pixel arrays, with features of the pixels."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm import webp
from tessera.llm.common import map_rows

#: Payloads are padded to this; four samples a pixel make rows of BLOCK / 4 pixels.
BLOCK = 576
WIDTH = BLOCK // 4


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with bytes 255 up to a positive multiple of BLOCK, and the length before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % BLOCK or (0 if raw else BLOCK)), len(raw)


def store(payload: bytes) -> bytes:
    """The payload as one WebP file, or several on end where a side would pass the format's 16,384."""
    p = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 4)
    return b"".join(webp.encode(p[a : a + webp.MOST_SIDE]) for a in range(0, len(p), webp.MOST_SIDE))


def load(media: bytes) -> np.ndarray:
    """The pixels (height, width, 4) of one WebP file or of several on end."""
    parts, at = [], 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        parts.append(webp.decode(media[at : at + n]))
        at += n
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def feature(pixels: np.ndarray) -> str:
    """Mean of each channel and a 64-bit average hash of an 8 by 8 grid of sample means."""
    n = len(pixels)
    means = pixels.reshape(-1, 4).mean(axis=0, dtype=np.float64)
    rows = np.add.reduceat(pixels, np.arange(8) * n // 8, axis=0, dtype=np.int64) if n >= 8 else pixels[np.arange(8) * n // 8].astype(np.int64)
    grid = rows.reshape(8, 8, -1).sum(axis=2)
    bits = (grid > grid.mean()).astype(np.uint8)
    return ",".join(f"{m:.3f}" for m in means) + ":" + np.packbits(bits).tobytes().hex()


def encode_column(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media) of every whole text; null is empty."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(doc_id, text):
        for k, t in zip(doc_id, text, strict=True):
            payload, n = payload_of(t)
            yield k, n, store(payload)

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes bigint, media binary")


def decode_column(media: DataFrame) -> DataFrame:
    """Rows (doc_id, width, height, pixels) of a column of WebP files: pixels as RGBA bytes, row by row; null stays null."""
    kind = dict(media.dtypes)["doc_id"]

    def run(doc_id, blobs):
        for k, m in zip(doc_id, blobs, strict=True):
            p = None if m is None else load(m)
            yield (k, None, None, None) if p is None else (k, p.shape[1], p.shape[0], p.tobytes())

    return map_rows(media.select("doc_id", "media"), run, f"doc_id {kind}, width int, height int, pixels binary")


def features(docs: DataFrame) -> DataFrame:
    """Each text stored, read back from the stored bytes and described; nothing but digests leaves the task.

    A null text is an empty one, whose payload is one block of 255. Repeated rows get equal rows, equal texts equal files;
    an empty table gives no rows, and other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(doc_id, text):
        out = []
        for k, t in zip(doc_id, text, strict=True):
            payload, n = payload_of(t)
            media = store(payload)
            del payload
            pixels = load(media)
            back = pixels.tobytes()
            out.append((k, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels)))
        return out

    return map_rows(
        docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )
