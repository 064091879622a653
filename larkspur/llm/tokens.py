"""Token counts: additive totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch is a set of signed changes: +1 for a document that came, -1 for one
that went, and both for a revised one, each with its counts. Batches are summed
by key before they are written, so a batch's file holds one row a key. A batch
is committed when Spark's committer puts its _SUCCESS file beside the sums: a
batch that failed half way is written anew, one that is committed is never
counted twice. Totals are the sums of all committed batches, so deletes and
revisions need no look at what was there; batches can be folded into one.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import scratch, slices, spread, table

KEY = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"
VOCABULARY = os.environ.get("LARKSPUR_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pre-token pattern that belongs to the byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PARTS = 4


# -- counting ----------------------------------------------------------------


def byte_bpe(vocabulary: bytes) -> Callable[[], Callable[[str], int]]:
    """Counts by a byte-level BPE whose ranks are the lines of `vocabulary`; built once in each task."""

    def make():
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))

    return make


def words() -> Callable[[str], int]:
    return lambda text: len(text.encode("utf-8", "replace").split())


def tokenizers(path: str = VOCABULARY) -> dict[str, Callable]:
    """Version name to maker of a counter: words between ASCII whitespace, and the byte-level BPE of the file at `path` (read on the driver)."""
    with open(path, "rb") as f:
        return {"words-1": words, os.path.basename(path).partition(".")[0]: byte_bpe(f.read())}


def counted(docs: DataFrame, versions: dict[str, Callable], sign: int = 1) -> DataFrame:
    """The signed change that docs (source, lang, text) make, a row for each document and version.

    Null texts count as empty, with no tokens; null sources and langs are keys of their own; repeated rows count each.
    """
    cols = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        makers = {name: make() for name, make in versions.items()}
        for part in (p for b in batches for _, p in slices(b, 2, 1 << 21)):
            source, lang, texts = *part.columns[:2], part.column(2).to_pylist()
            size = pa.array([sign * len(t.encode("utf-8", "replace")) for t in texts], pa.int64())
            one = pa.array([sign] * part.num_rows, pa.int64())
            for name, count in makers.items():
                n = pa.array([sign * count(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([source, lang, pa.array([name] * part.num_rows, pa.string()), one, n, size], [*KEY, *SUMS])

    return cols.mapInArrow(run, SCHEMA)


def summed(changes: DataFrame) -> DataFrame:
    """Sums by key: map-side first, so a source with a third of all rows sends one row a task."""
    return changes.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS])


def revision(before: DataFrame, after: DataFrame, versions: dict[str, Callable]) -> DataFrame:
    """The change from documents as they were to documents as they are."""
    return counted(before, versions, -1).unionByName(counted(after, versions, 1))


# -- rollups -----------------------------------------------------------------


class Rollup:
    """Totals below a shared folder. Batch names are the caller's (a file name, an offset): a name is counted once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Names of the committed batches that stand for themselves, in order; those folded into another are not among them."""
        path, fs = self._hadoop()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        names = [n for n in names if self._done(n)]
        gone = {x for n in names if n.startswith("fold-") for x in self._folded(n)}
        return sorted(n for n in names if n not in gone)

    def _done(self, name: str) -> bool:
        path, fs = self._hadoop(f"{name}/sums/_SUCCESS")
        return bool(fs.exists(path))

    def _folded(self, name: str) -> list[str]:
        return [r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/{name}/of").collect()]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Write the sums of a batch, unless it is committed already (also within a fold); whether it was written."""
        if not batch or "/" in batch or batch.startswith(("_", ".", "fold-")):
            raise ValueError(f"not a batch name: {batch!r}")
        if self._done(f"batch-{batch}"):
            return False
        summed(changes).write.mode("overwrite").parquet(f"{self.path}/batch-{batch}/sums")
        return True

    def fold(self, name: str) -> None:
        """Put the sums of all that is committed into one batch. What it stands for is listed inside, so a crash at any point leaves totals right."""
        of = self.committed()
        if len(of) < 2 or self._done(f"fold-{name}"):
            return
        target = f"{self.path}/fold-{name}"
        totals = self._read(of)
        # The list comes first: it counts once the sums beside it are committed.
        self.spark.createDataFrame([(x,) for x in of], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{target}/of")
        totals.write.mode("overwrite").parquet(f"{target}/sums")

    def _read(self, names: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/{n}/sums" for n in names]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return summed(self.spark.read.schema(SCHEMA).parquet(*paths))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_bytes over all committed batches; keys that came to nothing are left out."""
        rows = self._read(self.committed())
        return rows.where(" OR ".join(f"{c} <> 0" for c in SUMS))


def history(docs: DataFrame) -> list[tuple[str, DataFrame | None, DataFrame | None]]:
    """What happens to documents (doc_id, source, lang, text) in the queries: batches (name, rows that go, rows that come).

    All documents come, in PARTS batches by their number. Then those whose number ends in 3 are deleted; those that end
    in 7 are revised (their text grows and their language becomes unknown); of the revised those that end in 07 are deleted
    under their new text; and those that end in 13 come back. Null numbers count as 0.
    """
    nth = F.coalesce(F.col("doc_id"), F.lit(0))
    rows = docs.select(nth.alias("nth"), "source", "lang", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    revised = rows.where("nth % 10 = 7").select("nth", "source", F.lit(None).cast("string").alias("lang"), F.concat(F.lit("revised: "), text, F.lit(" again "), text).alias("text"))
    out = [(f"load-{p}", None, rows.where(nth % PARTS == p)) for p in range(PARTS)]
    return [
        *out,
        ("delete-1", rows.where("nth % 10 = 3"), None),
        ("revise-1", rows.where("nth % 10 = 7"), revised),
        ("delete-2", revised.where("nth % 100 = 7"), None),
        ("load-again", None, rows.where("nth % 100 = 13")),
    ]


def rolled(spark: SparkSession, sf_dir: str, versions: dict[str, Callable]) -> DataFrame:
    """Totals after the whole history of the documents: every batch is delivered, two are delivered twice, and all is folded half way."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    rollup = Rollup(spark, scratch(spark, "rollup"))
    for name, gone, come in history(docs):
        change = counted(gone, versions, -1) if come is None else counted(come, versions) if gone is None else revision(gone, come, versions)
        rollup.commit(name, change)
        if name == "load-1":
            rollup.commit(name, change)  # a second delivery changes nothing
        if name == "delete-1":
            rollup.fold("half")
            rollup.commit(name, change)  # nor does one of a folded batch
    return rollup.totals()


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by words and by byte-level BPE after inserts, deletes and revisions."""
    return rolled(spark, sf_dir, tokenizers())


def token_counts_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by words alone, which SQL can count."""
    return rolled(spark, sf_dir, {"words-1": words})


WORDS_SQL = """
WITH d AS (SELECT coalesce(doc_id, 0) AS nth, source, lang, coalesce(text, '') AS text FROM documents),
e AS (
  SELECT nth, source, lang, text FROM d WHERE (nth % 10 <> 3 AND nth % 10 <> 7) OR nth % 100 = 13
  UNION ALL SELECT nth, source, NULL, 'revised: ' || text || ' again ' || text FROM d WHERE nth % 10 = 7 AND nth % 100 <> 7
)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs,
       CAST(sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS n_tokens, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes
FROM e GROUP BY 1, 2
"""
