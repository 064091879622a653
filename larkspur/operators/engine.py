"""The search engine as one object: seed, crawl a closed world of pages, index, search, and tell what happened."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.binding import computed
from larkspur.functions.robots import robots_allowed
from larkspur.functions.text import html_links, html_text, html_title
from larkspur.functions.urls import canonical, may_fetch, resolved
from larkspur.operators import index, rank
from larkspur.operators.constraints import first_of
from larkspur.operators.frontier import numbered
from larkspur.operators.lineage import cut
from larkspur.sources.pages import FetchLimits
from larkspur.sources.telemetry import SCHEMA, elapsed_ms


@dataclass(frozen=True)
class Config:
    user_agent: str = "larkspur"
    max_depth: int = 2
    max_documents: int | None = 256  # None: a crawl ends where its queue does
    limits: FetchLimits = field(default_factory=FetchLimits)
    obey_robots: bool = False
    k1: float = rank.K1
    b: float = rank.B

    @property
    def room(self) -> float:
        """How many documents may come."""
        return math.inf if self.max_documents is None else self.max_documents


def event(name: str, error: bool, bytes_in: Column, bytes_out: Column, duration_ms: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("name"), F.coalesce(F.lit(None) if duration_ms is None else duration_ms, F.lit(0)).cast("bigint").alias("duration_ms"), bytes_in.cast("bigint").alias("bytes_in"), bytes_out.cast("bigint").alias("bytes_out"), F.lit(error).alias("error")
    )


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)


def parsed(pages: DataFrame, config: Config) -> DataFrame:
    """Every page once, by canonical URL: url, effective, size, ok (it counts as fetched), duration_ms, title, text, targets (canonical URLs of its links).

    pages: url, html; status, effective_url and duration_ms where they are there. Of pages with one canonical URL the
    one with the least content is taken. What does not count as fetched is not parsed.
    """
    there = lambda c, other: F.col(c) if c in pages.columns else other
    asked = F.col("url")
    rows = pages.select(
        canonical(asked).alias("url"),
        canonical(F.coalesce(F.nullif(there("effective_url", F.lit("")), F.lit("")), asked)).alias("effective"),
        there("status", F.lit(200)).alias("status"),
        there("duration_ms", F.lit(0)).cast("bigint").alias("duration_ms"),
        "html",
    ).where("url IS NOT NULL")
    rows = first_of(rows, "url", F.struct("html", "status", "effective", "duration_ms"))
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    ok = F.coalesce(may_fetch(F.col("url")) & F.col("status").between(200, 299) & (size > 0) & (size <= config.limits.body_bytes), F.lit(False))
    rows = rows.select("url", "effective", "duration_ms", size.alias("size"), ok.alias("ok"), F.when(ok & F.col("effective").isNotNull(), F.col("html")).alias("html"))
    rows = computed(rows, {"title": html_title(F.col("html")), "text": html_text(F.col("html")), "refs": html_links(F.col("html"))})
    return rows.select("url", "effective", "size", "ok", "duration_ms", "title", "text", F.array_compact(F.transform("refs", lambda r: resolved(F.col("effective"), r))).alias("targets"))


def attempts(world: DataFrame, level: DataFrame, config: Config, robots: DataFrame | None = None) -> DataFrame:
    """What becomes of each URL of a level (url, depth, place): url, depth, place, effective, `event` by name of what happened first.

    world: what parsed() gives. robots: host, body; hosts without a row allow all.
    """
    nothing = F.lit(0)
    rows = level.join(world.select("url", "effective", "size", "ok", "duration_ms", F.octet_length("text").alias("text_bytes")), "url", "left")
    if robots is not None and config.obey_robots:
        path = F.regexp_replace(F.col("url"), "^[a-z]+://[^/?#]*", "")
        rows = rows.withColumn("host", host(F.col("url"))).join(robots.select("host", F.col("body").alias("_robots")), "host", "left")
        rows = rows.withColumn("_may", robots_allowed(path, F.col("_robots"), F.lit(config.user_agent))).drop("_robots", "host")
    else:
        rows = rows.withColumn("_may", F.lit(True))
    size, took = F.coalesce(F.col("size"), nothing), F.col("duration_ms")
    return rows.select(
        "url",
        "depth",
        "place",
        "effective",
        F.when(F.col("depth") > config.max_depth, event("crawl_depth_blocked", False, nothing, nothing))
        .when(~F.col("_may"), event("crawl_robots_blocked", False, nothing, nothing))
        .when(~F.coalesce(F.col("ok"), F.lit(False)), event("crawl_fetch_failed", True, size, nothing, took))
        .when(F.col("effective").isNull(), event("crawl_invalid_effective_url", True, nothing, nothing, took))
        .otherwise(event("crawl_indexed", False, size, F.col("text_bytes"), took))
        .alias("event"),
    )


def seeded(start: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(url, depth 0, place) of the seeds that the frontier takes, and an event for each seed: refused are those without a canonical form, repeats, and all where no document may come.

    Seeds (url) arrive by `seq` where start has it, else as its rows stand.
    """
    seq = F.col("seq").cast("bigint") if "seq" in start.columns else F.monotonically_increasing_id()
    rows = start.select(canonical(F.col("url")).alias("url"), seq.alias("seq")).groupBy("url").agg(F.count("*").alias("n"), F.min("seq").alias("place"))
    taken = rows.where(F.col("url").isNotNull() & F.lit(config.room > 0)).select("url", F.lit(0).alias("depth"), "place")
    nothing = F.lit(0)
    refused = F.when(F.col("url").isNull(), F.col("n")).otherwise(F.col("n") - 1).cast("int")
    refused = refused if config.room > 0 else F.col("n").cast("int")
    ok = F.when(F.col("url").isNull() | F.lit(config.room <= 0), F.lit(0)).otherwise(F.lit(1))
    each = F.concat(F.array_repeat(event("crawl_seed", False, nothing, nothing), ok), F.array_repeat(event("crawl_seed", True, nothing, nothing), refused))
    return taken, rows.select(F.explode(each).alias("event")).select("event.*")


@dataclass(frozen=True)
class Crawled:
    """documents: id (from 1, in the order of the queue), url, title, text. events: telemetry rows. frontier (url, depth, place): what was found and not tried, in the order of depth and place."""

    documents: DataFrame
    events: DataFrame
    frontier: DataFrame


def arrivals(world: DataFrame, good: DataFrame, known: DataFrame, depth: int) -> DataFrame:
    """(url, depth, place) of what the links of the indexed pages good (url, place) bring that is not known yet.

    A link arrives after all links of pages before its own and after those before it on its page; of a URL's links the first
    counts, found map-side. Places number the URLs in that order.
    """
    links = world.select("url", "targets").join(good.select("url", "place"), "url").select(F.col("place").alias("_page"), F.posexplode("targets").alias("_nth", "url"))
    first = links.groupBy("url").agg(F.min(F.struct("_page", "_nth")).alias("_at")).join(known, "url", "left_anti")
    return numbered(first.select("url", "_at.*"), ["_page", "_nth"], "place").select("url", F.lit(depth).alias("depth"), "place")


def crawl(pages: DataFrame, start: DataFrame, config: Config = Config(), robots: DataFrame | None = None, checkpoint: Callable[[DataFrame], DataFrame] = cut) -> Crawled:
    """Crawl a closed world of pages (see parsed()) from `start` (url, and seq where there is an order), one step per depth.

    The queue runs as URLs arrive: seeds, then the links of the first page indexed in the order of the page, and so on; a URL
    is tried once. Links are followed from pages above max_depth. At max_documents indexed pages the crawl ends: what stands
    behind in the queue is not tried, and the last page's links are not taken. Pages are parsed once; what the steps join and
    store is URLs.

    Events: a crawl_seed for each seed, one of crawl_indexed, crawl_fetch_failed, crawl_invalid_effective_url,
    crawl_robots_blocked or crawl_depth_blocked for each URL tried, and crawl_limit or crawl_empty for the end. Ids are
    numbered here, so none can be refused by the index.
    """
    world = checkpoint(parsed(pages, config))
    level, seed_events = seeded(start, config)
    level = checkpoint(level)
    known, waiting, tried, indexed = level.select("url"), level.limit(0), None, 0
    for depth in range(config.max_depth + 1):
        step = checkpoint(attempts(world, level, config, robots))
        good = step.where("event.name = 'crawl_indexed'")
        there, room = good.count(), config.room - indexed
        if there >= room:  # the cap lies in this level
            last = numbered(good.select("place"), "place", "_n").where(F.col("_n") == room - 1).select("place").first()
            reached = F.lit(False) if last is None else F.col("place") <= last[0]
            waiting = step.where(~reached).select("url", "depth", "place")
            step = step.where(reached)
            good = good.where(F.lit(False) if last is None else F.col("place") < last[0])
        tried = step if tried is None else tried.unionByName(step)
        indexed += min(there, room)
        if depth < config.max_depth:
            level = checkpoint(arrivals(world, good, known, depth + 1))
            known = known.union(level.select("url"))
        if indexed >= config.room:
            waiting = waiting.unionByName(level) if depth < config.max_depth else waiting
            break
    spark = pages.sparkSession
    end = "crawl_limit" if indexed >= config.room else "crawl_empty"
    ended = spark.range(1).select(event(end, False, F.lit(0), F.lit(0)).alias("event")).select("event.*")
    good = numbered(tried.where("event.name = 'crawl_indexed'").select(F.col("url").alias("asked"), "depth", "place", "effective"), ["depth", "place"], "_n")
    documents = world.select(F.col("url").alias("asked"), "title", "text").join(good, "asked").select((F.col("_n") + 1).alias("id"), F.col("effective").alias("url"), "title", "text")
    return Crawled(documents, seed_events.unionByName(tried.select("event.*")).unionByName(ended), waiting)


class Engine:
    """An index over documents (id, url, title, text), with search and its telemetry."""

    def __init__(self, documents: DataFrame, config: Config = Config(), profile: str = "unicode"):
        self.config, self.index = config, index.build(documents, profile)

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """id, score, url, title of the best; none for a limit of 0 or an empty index."""
        hits = rank.top(rank.scores(self.index, query, k1=self.config.k1, b=self.config.b), limit)
        return rank.titled(self.index, hits, limit)

    def searched(self, query: str, limit: int = 10) -> tuple[list, DataFrame]:
        """The rows that search() gives, best first, and the telemetry row of the search with the time it took."""
        start = time.monotonic_ns()
        rows = self.search(query, limit).orderBy(F.col("score").desc(), "id").collect()  # at most `limit` rows
        empty = limit <= 0 or not rows and not self.document_count()
        return rows, self.search_event(query, len(rows), elapsed_ms(start), empty)

    def document_count(self) -> int:
        return self.index.docs.count()

    def document(self, doc_id: int) -> DataFrame:
        return self.index.document(doc_id)

    def search_event(self, query: str, results: int, duration_ms: int = 0, empty: bool = False) -> DataFrame:
        """The telemetry row of a search: its query's bytes and its number of results, never the query itself. empty: nothing was asked for, or there is no document."""
        name = "search_empty" if empty else "search"
        return self.index.docs.sparkSession.createDataFrame([(name, duration_ms, len(query.encode()), results, False)], SCHEMA)
