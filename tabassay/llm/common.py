"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: ``[^\x20\x09-\x0D]+``: a word is a run of anything but blanks, tabs and line breaks.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a worker turns into Python objects at a time; a longer text is alone.
BATCH_BYTES = 1 << 21


#: Bytes of an Arrow batch on its way to or from a worker, in jobs of this package's queries and the pipeline.
TRAVEL_BYTES = 1 << 22


def session(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of at most TRAVEL_BYTES, if its bound was larger.

    Queries and the pipeline, as applications, set this one value once; operators work under any and set nothing.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.match(r"(\d+)\s*([kmgt]?)", spark.conf.get(name).lower()).groups()
    size = int(number) << 10 * " kmgt".index(unit or " ")
    if size > TRAVEL_BYTES:
        spark.conf.set(name, str(TRAVEL_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes in one column (or one row), balanced by bytes.

    Spark bounds its own Arrow batches by bytes; these slices share their memory, and no setting of the session changes.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        parts = int(-(-ends[-1] // most))
        at, share = 0, ends[-1] / parts
        while at < batch.num_rows:
            goal = (ends[at - 1] if at else 0) + share
            upto = max(int(np.searchsorted(ends, goal + 0.5, side="right")), at + 1)
            yield batch.slice(at, upto - at)
            at = upto


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the cluster's shared checkpoint folder, so a lost executor costs no recomputation.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session without one, as in tests, gets a
    temporary folder; on a cluster its absence is an error, because executors could not read one another's files.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.match(r"local($|\[)", sc.master or ""):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


#: A side of a join with so many narrow rows at most is broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, none: bool = False) -> DataFrame | None:
    """``df``, written and counted, with a broadcast hint only if its size allows it. With ``none``, None if it is empty."""
    df = checkpointed(df)
    n = df.count()
    return None if none and not n else F.broadcast(df) if n <= BROADCAST_ROWS else df
