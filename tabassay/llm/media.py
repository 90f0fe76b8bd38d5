"""Media columns: texts stored as lossless WebP images, decoded again, and features of the pixels.

What a file holds is chosen by its content: a palette, or predictors and cross-colour factors by tile, with
back-references and a colour cache; reading it back inverts all of them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabassay.llm import webp, webp_many
from tabassay.llm.common import by_bytes

#: Sixteen pixels of four samples make a row of 64 bytes; a longer payload goes to further images.
WIDTH, UNIT = 16, 64
ROWS = webp.MOST
#: Bytes of text whose images are written and read together.
BATCH = 1 << 22


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + b"\0" * (max(-(-len(data) // UNIT), 1) * UNIT - len(data)), len(data)


def store_many(payloads: Sequence[bytes]) -> list[bytes]:
    parts = [np.frombuffer(p, np.uint8).reshape(-1, WIDTH, 4) for p in payloads]
    counts = [-(-len(rows) // ROWS) for rows in parts]
    files = iter(webp_many.encode([rows[at : at + ROWS] for rows in parts for at in range(0, len(rows), ROWS)]))
    return [b"".join(islice(files, n)) for n in counts]


def load_many(media: Sequence[bytes]) -> list[np.ndarray]:
    parts = [webp.streams_of(m) for m in media]
    images = iter(webp_many.decode([s for streams in parts for s in streams]))
    return [np.concatenate(list(islice(images, len(streams)))) for streams in parts]


def store(payload: bytes) -> bytes:
    return store_many([payload])[0]


def load(media: bytes) -> np.ndarray:
    return load_many([media])[0]


def feature(pixels: np.ndarray) -> str:
    """Mean, share of samples per eighth of their range, and mean step from a row to the next, as decimal integers."""
    samples = pixels.reshape(-1)
    shares = np.bincount(samples >> 5, minlength=8) * 1000 // len(samples)
    steps = np.abs(np.diff(pixels.astype(np.int16), axis=0)).sum(dtype=np.int64)
    return f"{len(pixels)}x{pixels.shape[1]}|{int(samples.sum(dtype=np.int64)) * 1000 // len(samples)}|{','.join(map(str, shares.tolist()))}|{int(steps) * 1000 // len(samples)}"


def media_batches(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, 1, BATCH):
        rows = []
        payloads, sizes = zip(*map(payload_of, batch.column(1).to_pylist()), strict=True)
        stored = store_many(payloads)
        for n, media, pixels in zip(sizes, stored, load_many(stored), strict=True):
            back = pixels.tobytes()
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels), *([media, back] if keep else [])))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.binary(), pa.binary()] if keep else [])]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", *NAMES[: len(kinds)]])


NAMES = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "pixels")


def media_columns(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """``key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature`` per row; ``keep`` adds the files and the decoded samples.

    Payload columns are of the bytes read back from the stored files. Null and empty texts become 64 zero
    bytes; equal texts give equal values; repeated rows and null keys each give their row; empty tables
    give none. Texts over 1 MB take several images, one after another. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    columns = f"key {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", media binary, pixels binary" * keep
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(lambda it: media_batches(it, keep), columns)
    return out.withColumnRenamed("key", key)
