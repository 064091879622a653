"""WARC archives: writing, reading back, and one globally ordered capture index.

Records are text that Spark's own writer puts into the shared folder: the
writer's line separator is the CRLF CRLF that ends a record, so every file is
a plain sequence of WARC/1.1 records in one gzip stream; offsets count its
decompressed bytes. Records go to files by classes of their size, so that a file
holds FILE_BYTES at most, or a single record.

The index is an external merge. Each archive file yields one locally sorted
run of captures. The key space (URL key, timestamp, page) is cut into ranges of
about RANGE_ROWS captures; each range's slices of the runs meet in one task,
where a loser tree merges them. Range after range, the captures of a URL follow
each other in time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import scratch, stored, table

CRLF = "\r\n"
#: Captures are numbered in seconds from the start of 2024.
EPOCH_SECONDS = 1704067200
#: Bytes of payloads that a file holds at most, and classes of records: payloads up to so many bytes, records in a file.
FILE_BYTES = 64 << 20
CLASSES = ((1 << 14, 1 << 12), (1 << 20, 1 << 6), (1 << 62, 1))
#: Captures of one range of the index, about.
RANGE_ROWS = 100_000
#: Repeated payloads (28 bytes a row) up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
CAPTURES = (
    "page_id long, url string, urlkey string, ts string, record_type string, refers_to long, "
    "payload_digest string, payload_bytes long, file string, offset long, length long"
)


# -- writing ---------------------------------------------------------------


def plan_captures(pages: DataFrame) -> DataFrame:
    """page_id, url, html, sha, response: the page_id that keeps the payload of its kind; null, if none that has it is named.

    Of equal payloads (null html is the empty payload) the largest page_id is the response. A page without an id refers
    to it like any other; where no page with an id has the payload, it is a response of its own. A page_id that repeats is
    written once a row.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("sha", F.unhex(F.sha1("html")))
    # Only payloads that repeat need a join; where they are few they are broadcast and no html is shuffled.
    same = stored(rows.select("sha", "page_id").groupBy("sha").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads")
    same = F.broadcast(same) if same.count() <= BROADCAST_ROWS else same
    return rows.join(same, "sha", "left").withColumn("response", F.coalesce("response", "page_id"))


def base32(digest: F.Column) -> F.Column:
    """SHA-1 in bare upper-case base32: ten hexadecimal digits are eight letters."""
    letters = [F.lpad(F.conv(F.substring(F.hex(digest), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*letters), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_text(number: str = "page_id") -> F.Column:
    """The whole record but for the CRLF CRLF that ends it."""
    stamp = F.date_format(F.timestamp_seconds(F.lit(EPOCH_SECONDS) + F.pmod(F.coalesce(F.col(number), F.lit(0)), F.lit(1 << 31))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    digest = F.concat(F.lit("sha1:"), base32(F.col("sha")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    clean = F.regexp_replace("url", "[\\x00-\\x20]", "%20")
    revisit = F.coalesce(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.lit(False))
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page, F.lit(">")),
        F.concat(F.lit("WARC-Date: "), stamp),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: "), digest),
        F.concat(F.lit("X-Payload-Length: "), F.octet_length("html")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("response"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.octet_length("html"))),
    ]
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), body)


def write_archives(pages: DataFrame, path: str, records_per_file: int | None = None) -> None:
    """Write one WARC record per row below `path`, through Spark's committer: a lost task leaves no half file behind.

    Each class of sizes that occurs is written by itself, with as many records in a file as its largest ones allow (no more than records_per_file).
    """
    planned = plan_captures(pages)
    size, low = F.octet_length("html"), -1
    sizes = planned.select(size.alias("size")).agg(*[F.max(F.when(F.col("size") <= most, F.col("size"))).alias(f"c{i}") for i, (most, _) in enumerate(CLASSES)], F.max("size").alias("most")).first()
    for i, (most, n) in enumerate(CLASSES):
        if sizes[f"c{i}"] is not None and sizes[f"c{i}"] > low or i == 0:
            rows = planned.where((size > low) & (size <= most)).select(record_text().alias("value"))
            rows.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", min(n, records_per_file or n)).option("compression", "gzip").text(f"{path}/class={i}")
        low = most


# -- reading ---------------------------------------------------------------

_FIELD = re.compile(rb"^([A-Za-z-]+): ?(.*)$")


def records(data: bytes | io.BufferedIOBase):
    """(offset, length, header dict, payload) of each record of a byte string or stream, one in memory at a time; refuses broken archives."""
    stream = io.BytesIO(data) if isinstance(data, (bytes, bytearray, memoryview)) else data
    at, held = 0, b""

    def more(n: int) -> bytes:
        nonlocal held
        while len(held) < n and (chunk := stream.read(max(1 << 16, n - len(held)))):
            held += chunk
        return held

    while more(1):
        end = -1
        while (end := held.find(b"\r\n\r\n")) < 0:
            before = len(held)
            if len(more(before + 1)) == before:
                break
        if end < 0 or not held.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(m.groups() for m in map(_FIELD.match, held[:end].split(b"\r\n")[1:]) if m)
        size = int(head[b"Content-Length"])
        body, stop = end + 4, end + 4 + size + 4
        if more(stop)[stop - 4 : stop] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has no end")
        yield at, stop, head, held[body : body + size]
        at, held = at + stop, held[stop:]


def url_key(url: str) -> str:
    """A sort key that keeps a host's captures together: host labels reversed, then port and path, without scheme, www and fragment."""
    m = re.match(r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url)
    if not m:
        return url.partition("#")[0].lower()
    host, _, port = m[1].rpartition("@")[2].lower().partition(":")
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (m[2] or "/").lower()


def _page(name: bytes) -> int | None:
    number = name.rpartition(b":")[2].rstrip(b">")
    return None if number == b"none" else int(number)


def captures_of(data: bytes | io.BufferedIOBase, file: str) -> list[tuple]:
    """The captures of one archive as a sorted run. A response's digest and length are computed anew from its payload."""
    run = []
    for at, length, head, payload in records(data):
        kind = head[b"WARC-Type"].decode()
        told = head[b"WARC-Payload-Digest"].partition(b":")[2].decode()
        size = int(head[b"X-Payload-Length"])
        if kind == "response":
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest != told or len(payload) != size:
                raise ValueError(f"{file}: the payload at byte {at} differs from its digest")
        url = head[b"WARC-Target-URI"].decode()
        refers = _page(head[b"WARC-Refers-To"]) if kind == "revisit" else None
        run.append((_page(head[b"WARC-Record-ID"]), url, url_key(url), head[b"WARC-Date"].decode(), kind, refers, told, size, file, at, length))
    run.sort(key=_order)
    return run


def _order(c) -> tuple:
    """URL key, timestamp, page (null ones first), and place, so that the order is total."""
    return c[2], c[3], c[0] is not None, c[0] or 0, c[8], c[9]


def _read(batches):
    for batch in batches:
        for path, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
            raw = io.BytesIO(data)
            run = captures_of(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, path.rpartition("/")[2])
            for k in range(0, len(run), 8192):
                yield _batch(run[k : k + 8192])


def _batch(rows: list[tuple], more: str = "") -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in (CAPTURES + more).split(", "))])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


# -- merging ---------------------------------------------------------------


class LoserTree:
    """Merges k sorted runs: each step replays one path, log2(k) comparisons."""

    def __init__(self, runs: list, key):
        self.key, self.runs, self.k = key, [iter(r) for r in runs], len(runs)
        self.head = [self._next(i) for i in range(self.k)]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i, first=True)

    def _next(self, i: int):
        x = next(self.runs[i], None)
        return None if x is None else (self.key(x), x)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; an ended run loses, and ties go to the earlier run."""
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None and (self.head[a] is not None or a < b)
        return (self.head[a][0], a) < (self.head[b][0], b)

    def _replay(self, winner: int, first: bool = False) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0 and first:  # the sibling has not come yet: wait here
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        if not self.k:
            return
        while (best := self.head[w := self.tree[0]]) is not None:
            yield best[1]
            self.head[w] = self._next(w)
            self._replay(w)


RANGED = ", merge_range int, merge_seq long"


def _merge(batches):
    """Merge the slices of all runs that fall into this range."""
    from pyspark import TaskContext

    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            runs.setdefault(c[8], []).append(c)
    for slice_ in runs.values():  # a shuffle may deliver the blocks of a run in another order
        if any(_order(a) > _order(b) for a, b in zip(slice_, slice_[1:], strict=False)):
            slice_.sort(key=_order)
    part, out = TaskContext.get().partitionId(), []
    for n, c in enumerate(LoserTree([runs[f] for f in sorted(runs)], _order)):
        out.append((*c, part, n))
        if len(out) == 8192:
            yield _batch(out, RANGED)
            out = []
    if out:
        yield _batch(out, RANGED)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives below `path`: a sorted run for each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(_read, CAPTURES)


def merged_index(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """Captures in global order of (URL key, timestamp, page): merge_range, then merge_seq within it.

    Ranges are cut at sampled keys, the page among them, so that one very common URL spreads over many.
    """
    n = ranges or max(1, -(-captures.count() // RANGE_ROWS))
    return captures.repartitionByRange(n, "urlkey", "ts", "page_id").mapInArrow(_merge, CAPTURES + RANGED)


def archive(pages: DataFrame, records_per_file: int | None = None, path: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as WARC archives, read them back, and index them by the external merge.

    Returns a row per record: page_id, payload_bytes, payload_digest (base32 SHA-1), record_type (response or
    revisit), refers_to, url, urlkey, ts, file, offset, length, merge_range, merge_seq. Null html is an empty
    payload, null urls are empty, rows without page_id are captures like others (see plan_captures); an empty table
    gives no rows. Timestamps are the capture's number in seconds from a fixed day. Other columns of pages are ignored.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(pages, path, records_per_file)
    files = stored(read_archives(spark, path), "captures")
    return merged_index(files)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 as bare base32, from DuckDB's hexadecimal: 40 bits give 8 letters.
OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha
  FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY sha) AS response FROM p
), c AS (
  SELECT *, list_transform(range(0, 32), lambda i:
    CAST(('0x' || substr(sha, CAST(10 * (i // 8) + 1 AS BIGINT), 10)) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT) & 31) AS five
  FROM r
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(five, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN response IS NULL OR page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM c
"""
