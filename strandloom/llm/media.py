"""Media columns: byte payloads stored as lossless WebP images, and decoded to pixel arrays."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import webp
from strandloom.llm.common import cut

WIDTH = 576  # samples of a row; payloads are padded to whole rows
PAD = 255
ROWS = 16_383  # of one image, the most that the format has; a payload beyond 9.4 MB is several images, file after file


def padded(text: bytes | None) -> bytes:
    data = text or b""
    return data + bytes([PAD]) * (-len(data) % WIDTH if data else WIDTH)


def encode_payload(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(webp.encode_grey(samples[at : at + ROWS]) for at in range(0, len(samples), ROWS))


def split_files(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        (size,) = struct.unpack("<I", media[at + 4 : at + 8])
        out.append(media[at : at + 8 + size])
        at += 8 + size
    return out


def decode_pixels(media: bytes) -> np.ndarray:
    """height x width ARGB of one file, or of several of one width below each other."""
    return np.concatenate([webp.decode(x) for x in split_files(media)])


@F.pandas_udf(T.BinaryType())
def encode_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([encode_payload(padded(t)) for t in texts])


PIXELS = T.StructType([T.StructField(n, t) for n, t in (("width", T.IntegerType()), ("height", T.IntegerType()), ("channels", T.IntegerType()), ("samples", T.BinaryType()))])


def pixel_array(argb: np.ndarray) -> np.ndarray:
    """height x width x channels of 8-bit samples: one channel for opaque grey, else red, green, blue and alpha."""
    planes = np.stack([(argb >> np.uint32(k)).astype(np.uint8) for k in (16, 8, 0, 24)], axis=-1)
    grey = (planes[..., :1] == planes[..., 1:3]).all() and (planes[..., 3] == 255).all()
    return planes[..., 1:2] if grey else planes


@F.pandas_udf(PIXELS)
def pixels_udf(media: pd.Series) -> pd.DataFrame:
    """The pixel array of each image, row by row; nulls for a null."""
    rows = []
    for m in media:
        a = pixel_array(decode_pixels(m)) if m is not None else None
        rows.append((None,) * 4 if a is None else (a.shape[1], a.shape[0], a.shape[2], a.tobytes()))
    return pd.DataFrame(rows, columns=[f.name for f in PIXELS]).astype({f.name: "Int32" for f in list(PIXELS)[:3]})


def store(docs: DataFrame) -> DataFrame:
    """Writes (doc_id, n_bytes, media) of docs as a table and returns the table.

    media holds the text's UTF-8 bytes, padded with 255 to whole rows of 576 (one row at least), as grey samples. A null
    text is empty. Equal texts, repeated rows among them, have equal media; very long texts are stored whole. An empty table gives an empty one.
    """
    body = F.col("text").cast("binary")
    return cut(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), encode_udf(body).alias("media")), "media")


FACTS = T.StructType([T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("feature", T.StringType()))])
TAIL = 32


def feature(samples: np.ndarray) -> str:
    """height x width, mean, deviation and a 16-bin histogram of the grey samples."""
    bins = np.bincount(samples.reshape(-1) >> 4, minlength=16)
    return f"{samples.shape[0]}x{samples.shape[1]};{samples.mean():.3f};{samples.std():.3f};" + ",".join(map(str, bins))


@F.pandas_udf(FACTS)
def facts_udf(image: pd.DataFrame) -> pd.DataFrame:
    """What pixel arrays of one channel say: the payload's size, digest and tail, and the image's feature."""
    rows = []
    for width, payload in zip(image["width"], image["samples"]):
        samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), feature(samples)))
    return pd.DataFrame(rows, columns=[f.name for f in FACTS])


def read_back(stored: DataFrame) -> DataFrame:
    """stored with the columns image, the pixel array that its media decodes to, and facts, which that array says."""
    return stored.withColumn("image", pixels_udf("media")).withColumn("facts", facts_udf("image"))
