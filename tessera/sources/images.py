"""Picture files as a DataFrame and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import jpeg, png

SCHEMA = "path string, mime string, width int, height int, data binary, error string"


def mime(content: bytes) -> str | None:
    """By the first bytes, never by name."""
    if len(content) < 12:
        return None
    if content[:4] == b"\x89PNG":
        return "image/png"
    if content[:3] == b"\xff\xd8\xff":
        return "image/jpeg"
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        return "image/webp"
    return "image/gif" if content[:4] == b"GIF8" else None


def decode(content: bytes) -> np.ndarray:
    """RGBA samples of a PNG or JPEG; other formats are known but refused."""
    kind = mime(content)
    if kind == "image/png":
        return png.decode(content)
    if kind == "image/jpeg":
        return jpeg.decode(content)
    raise ValueError(f"{kind or 'an unknown format'} is not decoded")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, mime, width, height, data, error) of the files under a path; a file that can't be read is a row with an error."""

    def run(batches):
        for b in batches:
            out = []
            for p, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = c.as_py()
                try:
                    m = decode(c)
                    out.append((p, mime(c), m.shape[1], m.shape[0], m.tobytes(), None))
                except Exception as e:  # a broken file is a fact about that file
                    out.append((p, mime(c), None, None, None, str(e)[:200]))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "mime", "width", "height", "data", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def encode_column(images: DataFrame) -> DataFrame:
    """Rows of (image_id, width, height, data) with `png`, the encoded file."""

    @F.pandas_udf("binary")
    def one(width: pd.Series, height: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([png.encode(np.frombuffer(d, np.uint8).reshape(h, w, 4)) for w, h, d in zip(width, height, data, strict=True)])

    return images.withColumn("png", one("width", "height", "data"))
