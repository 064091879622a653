"""Crawl frontiers as window queries over arrivals (seq), and a closed-world crawl."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.binding import computed
from larkspur.functions.evidence import DECISIONS
from larkspur.functions.text import html_links, html_text, html_title
from larkspur.functions.urls import canonical, resolved
from larkspur.operators.constraints import BROADCAST_ROWS
from larkspur.operators.lineage import cut

MOST_URL = 2048


def decisions(arrivals: DataFrame, capacity: int | None = None) -> DataFrame:
    """arrivals (seq, url, depth) with `decision`, as a bounded queue without pops gives it.

    In this order: null or empty is INVALID_URL, a full queue FRONTIER_FULL, 2048 bytes or more INVALID_URL, one
    that waits already DUPLICATE, all else ALLOW. Which URL is new is told from the
    first arrival of each; only with a capacity does the running count need all arrivals in order.
    """
    fits = F.col("url").isNotNull() & (F.col("url") != "") & (F.octet_length("url") < MOST_URL)
    rows = arrivals.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    # The first arrival of each URL, counted map-side and joined back: a URL that floods the queue meets in no one task.
    first = rows.where("_fits").groupBy("url").agg(F.min("seq").alias("_first"))
    rows = rows.join(first, "url", "left")
    fresh = F.col("_fits") & (F.col("seq") == F.col("_first"))
    full = F.lit(False)
    if capacity is not None:
        rows = before(rows.withColumn("_new", fresh.cast("bigint")), "seq", "_new", "_waiting")
        full = F.col("_waiting") >= capacity
    empty = F.coalesce(F.col("url") == "", F.lit(True))
    decision = F.when(empty, DECISIONS[2]).when(full, DECISIONS[3]).when(~F.col("_fits"), DECISIONS[2]).when(~fresh, DECISIONS[4]).otherwise(DECISIONS[0])
    return rows.withColumn("decision", decision).select(*arrivals.columns, "decision")


def popped(queue: DataFrame, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """The first n arrivals of a queue (seq, ...), and what still waits."""
    first = queue.orderBy("seq").limit(n)
    ids = first.select("seq")
    return first, queue.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, "seq", "left_anti")


def before(rows: DataFrame, order: str | list[str], value: str, name: str, ranges: int | None = None) -> DataFrame:
    """`name`: the sum of `value` over all rows earlier in `order` (one column or several, unique together).

    Rows are dealt to ranges of the order and stored there, so that a row stays in its range; sums of ranges first (a row
    a task), then within each: no single task holds all.
    """
    by = [order] if isinstance(order, str) else order
    dealt = rows.repartitionByRange(*by) if ranges is None else rows.repartitionByRange(ranges, *by)
    rows = cut(dealt.withColumn("_range", F.spark_partition_id()))
    sums = rows.groupBy("_range").agg(F.sum(value).alias("_s"))  # at most a row a partition
    sums = sums.select("_range", F.coalesce(F.sum("_s").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum(value).over(W.partitionBy("_range").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_inner", inner).join(F.broadcast(sums), "_range").withColumn(name, F.col("_before") + F.col("_inner")).drop("_range", "_before", "_inner")


def numbered(rows: DataFrame, order: str | list[str], name: str) -> DataFrame:
    """rows with `name`: 0, 1, ... in `order`."""
    return before(rows.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", name).withColumn(name, F.col(name).cast("bigint")).drop("_one")


def shallower(arrivals: DataFrame) -> DataFrame:
    """Arrivals that an unbounded queue takes: those not seen yet, and those seen only at greater depths."""
    # Only the first arrival at each depth can be taken, so a URL has as many rows as depths when they are put in order.
    rows = arrivals.where(F.col("url").isNotNull() & (F.col("url") != ""))
    first = rows.groupBy("url", "depth").agg(F.min("seq").alias("seq"))
    least = F.min("depth").over(W.partitionBy("url").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    taken = first.withColumn("_least", least).where("_least IS NULL OR depth < _least").select("url", "depth", "seq")
    return rows.join(taken, ["url", "depth", "seq"], "left_semi").select(*arrivals.columns)


def seeds(urls: DataFrame) -> DataFrame:
    """url (canonical), depth 0, of what has a canonical form."""
    return urls.select(canonical(F.col("url")).alias("url"), F.lit(0).alias("depth")).where("url IS NOT NULL").distinct()


def extracted(pages: DataFrame) -> DataFrame:
    """Pages (url, html) with canonical url, title, text and links."""
    return pages.select(canonical(F.col("url")).alias("url"), html_title(F.col("html")).alias("title"), html_text(F.col("html")).alias("text"), html_links(F.col("html")).alias("links"))


def crawl(pages: DataFrame, start: DataFrame, max_depth: int = 2, checkpoint: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """url, depth of every page that is reached in a closed world of pages (url, html), breadth first from `start` (url).

    One step per depth; a link is followed from pages above max_depth, and those of all pages of one URL count. URLs without a page stay in the result as
    frontier (fetched false). `checkpoint` may cut lineage between steps.
    """
    found = pages.where("html IS NOT NULL AND html <> ''").select(canonical(F.col("url")).alias("url"), "html").where("url IS NOT NULL")
    links = found.select("url", F.explode(html_links(F.col("html"))).alias("ref"))
    # Pages are parsed once, whatever the depth; what the steps join is URLs.
    links = checkpoint(computed(links, {"target": resolved(F.col("url"), F.col("ref"))}).where("target IS NOT NULL").select("url", "target").distinct())
    level = seeds(start)
    reached = level
    for depth in range(1, max_depth + 1):
        level = links.join(level.select("url"), "url", "left_semi").select(F.col("target").alias("url")).distinct().join(reached, "url", "left_anti").withColumn("depth", F.lit(depth))
        level = checkpoint(level)
        reached = reached.unionByName(level)
    return reached.join(found.select("url").distinct().withColumn("fetched", F.lit(True)), "url", "left").withColumn("fetched", F.coalesce("fetched", F.lit(False)))
