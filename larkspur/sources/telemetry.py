"""Telemetry: counters and JSON lines; names and numbers only, never content."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "name string, duration_ms long, bytes_in long, bytes_out long, error boolean"


def now_ms() -> int:
    """Milliseconds since 1970."""
    return time.time_ns() // 1_000_000


def elapsed_ms(start_ns: int) -> int:
    """Whole milliseconds since a reading of time.monotonic_ns(), never below 0."""
    return max(0, time.monotonic_ns() - start_ns) // 1_000_000


def events_of(events: DataFrame) -> DataFrame:
    """Events with a name."""
    return events.where(F.col("name").isNotNull() & (F.col("name") != ""))


def counters() -> list[Column]:
    zero = F.lit(0).cast("bigint")
    return [
        F.count("*").alias("events"),
        F.coalesce(F.sum(F.col("error").cast("bigint")), zero).alias("errors"),
        F.coalesce(F.sum("bytes_in"), zero).alias("bytes_in"),
        F.coalesce(F.sum("bytes_out"), zero).alias("bytes_out"),
    ]


def stats(events: DataFrame) -> DataFrame:
    return events_of(events).agg(*counters())


def stats_by_name(events: DataFrame) -> DataFrame:
    """For batch and streams alike."""
    return events_of(events).groupBy("name").agg(*counters())


def line() -> Column:
    """An event as one JSON line, keys in fixed order."""
    return F.to_json(F.struct(F.lit("event").alias("type"), "name", "duration_ms", "bytes_in", "bytes_out", "error"))


def bounds(kind: str, at_ms: int) -> str:
    """The line that starts or stops a log."""
    return f'{{"type":"{kind}","unix_ms":{at_ms}}}'


def write_lines(events: DataFrame, path: str, started_ms: int, stopped_ms: int, enabled: bool = True) -> None:
    """Append JSON lines below `path`: start, events, stop, in files that go by name in this order. Nothing is written when telemetry is off.

    It is one job, whose files are there when all of its tasks have succeeded: a log that has its start has its events and its stop.
    """
    if not enabled:
        return
    edge = events.sparkSession.range(1)
    first, last = (edge.select(F.lit(bounds(kind, at)).alias("value")) for kind, at in (("start", started_ms), ("stop", stopped_ms)))
    first.unionByName(events_of(events).select(line().alias("value"))).unionByName(last).write.mode("append").text(path)
