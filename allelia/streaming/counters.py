"""Streaming versions of mergeable operators: site batches update counters; events are windowed with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.counts import tally


def running_counter(calls: DataFrame) -> DataFrame:
    """Genotype counts by variant over a stream of calls(variant_id, g); use output mode update or complete."""
    return calls.groupBy("variant_id").agg(*tally())


def windowed_events(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) by tumbling window and type, late rows up to a watermark."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
