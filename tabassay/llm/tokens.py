"""Token counts: batch encoding in an Arrow function that returns lengths only.

Arrow batches are cut into parts of about equal bytes, long texts at boundaries the vocabulary never joins
across, and what the library is given at a time is bounded by bytes as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabassay.llm import bpe
from tabassay.llm.common import by_bytes

_memos: dict[str, bpe.Memo] = {}


def count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    memo = _memos.get(path)
    if memo is None:
        memo = _memos[path] = bpe.Memo(path, len)
    for batch in by_bytes(batches, 1):
        n_bytes, n_tokens = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            n_bytes.append(len(text.encode()))
            n_tokens.append(sum(memo.of(text)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["key", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row of ``docs``, whole texts, in one narrow pass.

    Counts are the library's own without special tokens, truncation or padding. Null and empty texts
    count 0; repeated rows and null keys each give their row; an empty table gives none. Other columns
    of ``docs``, whatever their names, are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    counted = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(lambda it: count_batches(it, path), f"key {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
