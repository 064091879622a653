"""Inverted index: documents, postings and corpus statistics as DataFrames.

Two profiles: "ascii" counts every token of letters and digits; "unicode" keeps
one posting per distinct token of the first tokens of a document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import ascii_tokens, unicode_tokens
from larkspur.operators.constraints import first_of

PROFILES = ("ascii", "unicode")


def tokens(text: Column, profile: str) -> Column:
    if profile not in PROFILES:
        raise ValueError(f"no such profile: {profile}")
    return ascii_tokens(text) if profile == "ascii" else unicode_tokens(text)


#: Documents whose postings of a term go to one file of a stored index.
FILE_DOCS = 4_000_000


def accepted(docs: DataFrame, id_col: str = "id", order: Column | None = None) -> DataFrame:
    """Documents that may be added: an id that is not 0, a text, and of rows with one id the first in `order`."""
    return first_of(docs.where(F.col(id_col).isNotNull() & (F.col(id_col) != 0) & F.col("text").isNotNull()), id_col, order)


@dataclass(frozen=True)
class Index:
    """docs: id, url, title, length, active. postings: term, id, tf. Both may be tables on disk.

    An index that is not stored also has rows (id, url, title, tokens), from which a query can be answered without
    making postings of all other terms.
    """

    profile: str
    docs: DataFrame
    postings: DataFrame
    rows: DataFrame | None = None
    buckets: int = 0

    def save(self, path: str, buckets: int = 64) -> Index:
        """Write both; postings are laid out by term hash and sorted by term, so that a query reads the row groups of its terms.

        A bucket is dealt out by document over as many files as the number of documents needs: a word that all of them
        have meets in no one task.
        """
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        spark = self.docs.sparkSession
        files = 1 + spark.read.parquet(f"{path}/docs").count() // FILE_DOCS
        by_term = self.postings.withColumn("bucket", bucket(F.col("term"), buckets))
        dealt = by_term.repartition(F.col("bucket"), F.pmod(F.xxhash64("id"), F.lit(files)))
        dealt.sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        return load(spark, path, self.profile, buckets)

    def postings_of(self, terms: list[str]) -> DataFrame:
        """The postings of these terms. Terms and buckets stand in the filter as values, so that other buckets' files are not opened."""
        rows = self.postings.where(F.col("term").isin(terms))
        if not self.buckets or not terms:
            return rows
        spark = self.docs.sparkSession
        of = spark.range(1).select(F.array(*[bucket(F.lit(t), self.buckets) for t in terms]).alias("b")).first()["b"]
        return rows.where(F.col("bucket").isin(sorted(set(of))))

    def removed(self, ids: DataFrame, small: bool = False) -> Index:
        """With documents (id) marked as removed. They stay in counts of documents and terms, and leave total length.

        small: the caller knows that the ids may be broadcast.
        """
        gone = ids.select(F.col("id"), F.lit(True).alias("_gone")).dropDuplicates(["id"])
        docs = self.docs.join(gone, "id", "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone")
        rows = self.rows
        if rows is not None:
            rows = rows.withColumnRenamed("_gone", "_was").join(F.broadcast(gone) if small else gone, "id", "left")
            rows = rows.withColumn("_gone", F.col("_was") | F.col("_gone").isNotNull()).drop("_was")
        return Index(self.profile, docs, self.postings, rows, self.buckets)

    def stats(self) -> DataFrame:
        """One row: n_docs, total_length (of active documents), avgdl."""
        total = F.coalesce(F.sum(F.when(F.col("active"), F.col("length"))), F.lit(0)).cast("bigint")
        return self.docs.agg(F.count("*").alias("n_docs"), total.alias("total_length")).withColumn("avgdl", F.try_divide(F.col("total_length").cast("double"), F.col("n_docs")))

    def document_frequency(self) -> DataFrame:
        """term, df: from rows of tokens each document's distinct terms are counted in one exchange."""
        entries = self.postings if self.rows is None else self.rows.select(F.explode(F.array_distinct("tokens")).alias("term"))
        return entries.groupBy("term").agg(F.count("*").alias("df"))

    def document(self, doc_id: int) -> DataFrame:
        return self.docs.where((F.col("id") == doc_id) & F.lit(doc_id != 0))


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(docs: DataFrame, profile: str = "ascii", order: Column | None = None, unique: bool = False) -> Index:
    """Index documents (id, text, and url and title where they have them). Of rows with one id the first in `order` counts.

    unique: the caller has seen to it that ids differ.
    """
    rows = docs.where(F.col("id").isNotNull() & (F.col("id") != 0) & F.col("text").isNotNull()) if unique else accepted(docs, "id", order)
    for c in ("url", "title"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(""))
    rows = rows.select("id", "url", "title", tokens(F.col("text"), profile).alias("tokens"))
    entries = rows.select("id", F.explode("tokens" if profile == "ascii" else F.array_distinct("tokens")).alias("term"))
    postings = entries.groupBy("term", "id").agg(F.count("*").alias("tf")) if profile == "ascii" else entries.withColumn("tf", F.lit(1).cast("bigint"))
    return Index(profile, rows.select("id", "url", "title", F.size("tokens").alias("length"), F.lit(True).alias("active")), postings, rows.withColumn("_gone", F.lit(False)))


def load(spark: SparkSession, path: str, profile: str, buckets: int = 0) -> Index:
    """A stored index; `buckets` as it was saved with (0: its postings are not laid out by term)."""
    return Index(profile, spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"), None, buckets)
