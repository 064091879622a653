"""Structured Streaming forms: telemetry counters, frontier state, index statistics, windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.functions.evidence import DECISIONS
from larkspur.operators.frontier import MOST_URL
from larkspur.operators.index import accepted, tokens
from larkspur.operators.segmented import SegmentedIndex
from larkspur.sources.telemetry import SCHEMA, stats_by_name


def telemetry_stream(spark: SparkSession, path: str) -> DataFrame:
    """Running counters by name over JSON lines that come into `path` (update or complete mode)."""
    lines = spark.readStream.schema("type string, " + SCHEMA).json(path)
    return stats_by_name(lines.where("type = 'event'"))


def new_urls(arrivals: DataFrame, within: str | None = None) -> DataFrame:
    """Arrivals (url, ...) whose URL has not come before. With `within` (and a watermarked column `at`) state is kept for that long only."""
    rows = arrivals.where(F.col("url").isNotNull() & (F.col("url") != ""))
    return rows.withWatermark("at", within).dropDuplicatesWithinWatermark(["url"]) if within else rows.dropDuplicates(["url"])


def queue_steps(events: list[tuple], waiting: list[tuple[str, int]], capacity: int) -> list[tuple]:
    """(seq, op, url, depth, decision) of events (seq, op, url, depth) on a bounded queue, whose contents `waiting` change in place.

    An enqueue is decided in this order: null or empty is INVALID_URL, a full queue FRONTIER_FULL, too many bytes INVALID_URL,
    a URL that waits now DUPLICATE, all else ALLOW. A pop gives the first that waits, decided ALLOW, or nothing, decided EMPTY:
    what has left may come again.
    """
    out, there = [], {url for url, _ in waiting}
    for seq, op, url, depth in events:
        if op == "pop":
            url, depth = waiting.pop(0) if waiting else (None, None)
            there.discard(url)
            decision = "EMPTY" if url is None else DECISIONS[0]
        elif not url:
            decision = DECISIONS[2]
        elif len(waiting) >= capacity:
            decision = DECISIONS[3]
        elif len(url.encode()) >= MOST_URL:
            decision = DECISIONS[2]
        elif url in there:
            decision = DECISIONS[4]
        else:
            decision = DECISIONS[0]
            waiting.append((url, depth))
            there.add(url)
        out.append((seq, op, url, depth, decision))
    return out


def queue_stream(events: DataFrame, capacity: int) -> DataFrame:
    """Decisions of bounded queues over a stream of events: queue, seq, op, url, depth, decision.

    events: queue (which of many: a host, a shard of hosts), seq (whole number, rising over the batches of a queue), op
    ("enqueue" or "pop"), url, depth. A queue's state is what waits in it, `capacity` items at most; queues are spread over
    tasks. Within a batch a queue's events go by seq.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [])
        waiting = list(zip(*held, strict=True))
        rows = sorted((r for b in batches for r in b[["seq", "op", "url", "depth"]].itertuples(index=False, name=None)), key=lambda r: r[0])
        rows = [(int(s), op, url if isinstance(url, str) else None, None if depth is None or depth != depth else int(depth)) for s, op, url, depth in rows]
        done = queue_steps(rows, waiting, capacity)
        state.update(([u for u, _ in waiting], [d for _, d in waiting]))
        out = pd.DataFrame(done, columns=["seq", "op", "url", "depth", "decision"]).astype({"depth": "Int32"})
        out.insert(0, "queue", key[0])
        yield out

    schema = "queue string, seq bigint, op string, url string, depth int, decision string"
    return events.groupBy(F.col("queue").cast("string").alias("queue")).applyInPandasWithState(step, schema, "urls array<string>, depths array<int>", "append", "NoTimeout")


def windowed_events(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window and type; ts is taken as UTC, and older rows than `late` may be dropped from streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user_id: events no further apart than `gap`."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def index_stream(docs: DataFrame, path: str, profile: str, checkpoint: str) -> StreamingQuery:
    """Index documents (id, url, title, text) as they come: folders of postings, documents and statistics for each batch.

    Of an id's rows the first batch's counts (within a batch, that with the least contents): rows whose id an earlier
    batch has are left out. A batch's folders are overwritten when the batch is tried again, so nothing is counted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = accepted(batch)
        known = _earlier(spark, f"{path}/docs", number)
        rows = rows if known is None else rows.join(known.select("id"), "id", "left_anti")
        rows = rows.select("id", "url", "title", tokens(F.col("text"), profile).alias("tokens")).persist()
        terms = rows.select("id", F.explode("tokens" if profile == "ascii" else F.array_distinct("tokens")).alias("term"))
        terms.groupBy("term", "id").agg(F.count("*").alias("tf")).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        terms.distinct().groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms/batch={number}")
        total = F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("bigint")
        rows.agg(F.count("*").alias("n_docs"), total.alias("total_length")).write.mode("overwrite").parquet(f"{path}/stats/batch={number}")
        # Documents come last: what they list is complete.
        rows.select("id", "url", "title", F.size("tokens").alias("length"), F.lit(True).alias("active")).write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        rows.unpersist()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _earlier(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    """What the batches before this one have written to a folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    old = [n for n in names if n.startswith("batch=") and int(n[6:]) < number]
    return spark.read.parquet(*[f"{folder}/{n}" for n in old]) if old else None


def stream_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: n_docs, total_length, avgdl of all batches so far, from a row a batch."""
    rows = spark.read.parquet(f"{path}/stats").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_length").alias("total_length"))
    return rows.withColumn("avgdl", F.try_divide(F.col("total_length").cast("double"), F.col("n_docs")))


def stream_document_frequency(spark: SparkSession, path: str) -> DataFrame:
    """term, df of all batches so far, from a row a term and batch."""
    return spark.read.parquet(f"{path}/terms").groupBy("term").agg(F.sum("df").alias("df"))


def apply_changes(rows: DataFrame, held: SegmentedIndex, stream: str, number: int) -> None:
    """One batch of changes (seq, op, id, url, title, text) of a stream. A batch that is tried again does what is left of it."""
    rows = rows.persist()
    gone, new = rows.where("op = 'remove'").select("id", "seq"), rows.where("op = 'add'")
    if dict(held.manifest().batches).get(stream, -1) < number:
        held.remove(gone)  # of what was there before this batch
        held.add(new, F.col("seq"), (stream, number))
    # What this batch has added it may remove, but not before it came.
    came = new.where(F.col("text").isNotNull()).groupBy("id").agg(F.min("seq").alias("came"))
    held.remove(gone.join(came, "id").where("seq > came"))
    rows.unpersist()


def changes_stream(changes: DataFrame, held: SegmentedIndex, checkpoint: str, stream: str = "changes", merge: bool = True) -> StreamingQuery:
    """Keep a segmented index up to date with a stream of changes: seq (whole number, rising), op ("add" or "remove"), id, url, title, text.

    A batch is a segment, and a tombstone file where it removes; segments of one size are merged as they become several.
    """

    def write(batch: DataFrame, number: int) -> None:
        apply_changes(batch, held, stream, number)
        if merge:
            held.merge()

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
