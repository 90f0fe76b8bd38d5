"""Drift of a stream against a fixed baseline: each micro-batch is scored like a synthetic table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tabassay.operators import marginal


def drift_scores(baseline: DataFrame, batch: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), metrics: Sequence[str] = ("ks", "psi")) -> DataFrame:
    """``metric, column, raw`` of a batch against the baseline."""
    own = [m for m in metrics if m in marginal.ALL_NUMERIC]
    shares = [m for m in metrics if m in marginal.COVERAGE]
    out = marginal.numeric_metrics(baseline, batch, numeric, own) if own and numeric else None
    if shares:
        more = marginal.universal_metrics(baseline, batch, numeric, categorical, shares)
        out = more if out is None else out.unionByName(more)
    return out


def monitor(stream: DataFrame, baseline: DataFrame, sink: Callable[[DataFrame, int], None], numeric: Sequence[str], categorical: Sequence[str] = (), metrics: Sequence[str] = ("ks", "psi"), checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Hand each batch's scores to ``sink`` (frame, batch number); an empty batch gives none."""
    columns = [*numeric, *categorical]

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.select(*columns)
        if not batch.isEmpty():
            sink(drift_scores(baseline, batch, numeric, categorical, metrics).withColumn("batch", F.lit(number)), number)

    writer = stream.writeStream.foreachBatch(each)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
