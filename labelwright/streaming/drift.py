"""Drift over a stream, an extension: daily label counts with a watermark, each batch checked against the baseline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelwright.operators.drift import check_drift


def daily_counts(stream: DataFrame, ts: str = "ts", label: str = "label", late: str = "1 day") -> DataFrame:
    """day, label, mass of a stream; a day is closed when the watermark has passed it."""
    counted = stream.withWatermark(ts, late).where(F.col(label).isNotNull()).groupBy(F.window(ts, "1 day").alias("w"), F.col(label).alias("label")).agg(F.count("*").alias("mass"))
    return counted.select(F.to_date("w.start").alias("day"), "label", "mass")


def watch(stream: DataFrame, baseline: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str, **columns: str) -> StreamingQuery:
    """Gives `sink` the verdicts of the days that each micro-batch closes."""

    def judge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            sink(check_drift(baseline, batch, ["day"]))

    return daily_counts(stream, **columns).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(judge).start()
