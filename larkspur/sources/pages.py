"""Fetched pages as a source: what counts as fetched, and what of a response is kept."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from larkspur.functions.text import content_type
from larkspur.functions.urls import may_fetch
from larkspur.sources.telemetry import elapsed_ms


@dataclass(frozen=True)
class FetchLimits:
    connect_ms: int = 5_000
    total_ms: int = 15_000
    body_bytes: int = 4 * 1024 * 1024
    redirects: int = 5

    def valid(self) -> bool:
        return self.connect_ms > 0 and self.total_ms > 0 and self.body_bytes > 0 and self.redirects >= 0


def fetched(responses: DataFrame, limits: FetchLimits = FetchLimits()) -> DataFrame:
    """Responses (url, status, headers, body) that count: an allowed URL, a 2xx status, a body that is not empty and within the limit. Adds content_type."""
    if not limits.valid():
        raise ValueError("limits must be positive")
    size = F.octet_length("body")
    return responses.where(may_fetch(F.col("url")) & F.col("status").between(200, 299) & (size > 0) & (size <= limits.body_bytes)).withColumn("content_type", content_type(F.col("headers")))


def http_get(url: str, user_agent: str, limits: FetchLimits) -> dict:
    """One GET request: status, headers, body, error, effective_url, duration_ms.

    The connection must stand within connect_ms and all be read within total_ms; a body over the limit is an error and
    none of it is kept. TLS is verified; redirects are not followed, so the effective URL is the one asked for.
    """
    import http.client
    import ssl
    from urllib.parse import urlsplit

    start = time.monotonic_ns()
    row = {"url": url, "status": 0, "headers": "", "body": None, "error": None, "effective_url": url}
    connection = None

    def left() -> float:
        seconds = limits.total_ms / 1000 - (time.monotonic_ns() - start) / 1e9
        if seconds <= 0:
            raise TimeoutError("total time over the limit")
        return seconds

    try:
        parts = urlsplit(url)
        timeout = min(limits.connect_ms, limits.total_ms) / 1000
        if parts.scheme == "https":
            connection = http.client.HTTPSConnection(parts.hostname, parts.port, timeout=timeout, context=ssl.create_default_context())
        else:
            connection = http.client.HTTPConnection(parts.hostname, parts.port, timeout=timeout)
        connection.connect()
        connection.sock.settimeout(left())
        connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"User-Agent": user_agent})
        sock = connection.sock
        response = connection.getresponse()
        body = bytearray()
        while chunk := response.read1(1 << 16):
            body += chunk
            if len(body) > limits.body_bytes:
                raise ValueError("body over the limit")
            sock.settimeout(left())
        row |= {"status": response.status, "headers": "".join(f"{k}: {v}\r\n" for k, v in response.getheaders()), "body": body.decode("utf-8", "replace")}
    except Exception as e:  # noqa: BLE001  what fails for one URL is that URL's error
        row["error"] = f"{type(e).__name__}: {e}"
    finally:
        if connection:
            connection.close()
    return row | {"duration_ms": elapsed_ms(start)}


RESPONSE = "url string, status int, headers string, body string, error string, effective_url string, duration_ms long"


def _answers(batches: Iterable[list[tuple]], user_agent: str, limits: FetchLimits, at_once: int, delay_ms: int) -> Iterator[list[dict]]:
    """Responses to rows (url, allowed, host) of one task, `at_once` at a time; with a delay those of different hosts only."""
    from concurrent.futures import ThreadPoolExecutor

    begun: dict[str, float] = {}

    def one(row: tuple) -> dict:
        url, allowed, host = row
        if not allowed:
            return {"url": url, "status": 0, "headers": "", "body": None, "error": "URL not allowed", "effective_url": url, "duration_ms": 0}
        if delay_ms:
            time.sleep(max(0.0, begun.get(host, 0.0) + delay_ms / 1000 - time.monotonic()))
            begun[host] = time.monotonic()
        return http_get(url, user_agent, limits)

    with ThreadPoolExecutor(at_once) as pool:
        for rows in batches:
            while rows:  # bodies of so many are held at once, at most
                hosts: set[str] = set()
                now, later = [], []
                for r in rows:
                    fits = len(now) < at_once and (not delay_ms or r[2] not in hosts)
                    (now if fits else later).append(r)
                    hosts.add(r[2])
                yield list(pool.map(one, now))
                rows = later


def _with_policy(urls: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1)), F.lit(""))
    return urls.select("url", may_fetch(F.col("url")).alias("allowed"), host.alias("host"))


def http_pages(urls: DataFrame, user_agent: str, limits: FetchLimits = FetchLimits(), at_once: int = 16, delay_ms: int = 0) -> DataFrame:
    """url, status, headers, body, error, effective_url, duration_ms of live GET requests, `at_once` of a partition's URLs at a time.

    A URL that policy forbids is an error and not asked for. With delay_ms a host's URLs go to one task, one after another, and
    so many milliseconds lie at least between the beginnings of its requests; `at_once` hosts of a task are asked at a time.
    """
    if not limits.valid():
        raise ValueError("limits must be positive")

    def run(frames):
        import pandas as pd

        for answers in _answers((list(f.itertuples(index=False, name=None)) for f in frames), user_agent, limits, at_once, delay_ms):
            yield pd.DataFrame(answers)

    rows = _with_policy(urls)
    return (rows.repartition("host") if delay_ms else rows).mapInPandas(run, RESPONSE)


# -- as a source that Spark reads by its format -----------------------------------


def enqueue(urls: DataFrame, path: str, parts: int, by_host: bool = True) -> None:
    """Append urls (url) to the request queue at `path`: Parquet files, each a task of `live_pages`, with what policy says of every URL.

    With by_host the URLs of a host stand in one file of this call, so that a delay between its requests holds; else they are spread evenly.
    """
    rows = _with_policy(urls)
    (rows.repartition(parts, "host") if by_host else rows.repartition(parts)).write.mode("append").parquet(path)


class LivePages(DataSource):
    """spark.read.format("live_pages").load(path): responses to the URLs of a queue that enqueue() wrote, columns as those of http_pages.

    Options: userAgent (needed), connectMs, totalMs, bodyBytes, atOnce, delayMs. The driver sees the names of the queue's files alone;
    each file is one task, which reads it in batches. A task that is repeated after a loss asks again.
    """

    @classmethod
    def name(cls) -> str:
        return "live_pages"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema: StructType) -> LivePagesReader:
        return LivePagesReader(self.options)


class LivePagesReader(DataSourceReader):
    def __init__(self, options: dict):
        def number(name: str, otherwise: int) -> int:
            return int(options.get(name, otherwise))

        if not options.get("path") or not options.get("userAgent"):
            raise ValueError("live_pages needs a path and the option userAgent")
        default = FetchLimits()
        self.path, self.user_agent = options["path"], options["userAgent"]
        self.limits = FetchLimits(number("connectMs", default.connect_ms), number("totalMs", default.total_ms), number("bodyBytes", default.body_bytes))
        self.at_once, self.delay_ms = number("atOnce", 16), number("delayMs", 0)
        if not self.limits.valid() or self.at_once < 1 or self.delay_ms < 0:
            raise ValueError("limits must be positive")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.path)
        found = sorted(f.path for f in files.get_file_info(fs.FileSelector(base)) if f.is_file and f.path.endswith(".parquet"))
        return [InputPartition(f) for f in found] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        if partition.value is None:  # an empty queue
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_file(partition.value) as f:
            batches = (list(zip(*b.to_pydict().values(), strict=True)) for b in pq.ParquetFile(f).iter_batches(1024, columns=["url", "allowed", "host"]))
            names = [c.split()[0] for c in RESPONSE.split(", ")]
            for answers in _answers(batches, self.user_agent, self.limits, self.at_once, self.delay_ms):
                yield from (tuple(a[c] for c in names) for a in answers)


def register(spark: SparkSession) -> None:
    """Make the format live_pages known to a session."""
    spark.dataSource.register(LivePages)
