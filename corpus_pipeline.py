"""A corpus pipeline: toxicity, language, near duplicates, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept
and returns a DataFrame; run() writes each stage's rows as Parquet in the shared
folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontam, jaccard, langid, mixing, toxicity
from larkspur.llm.common import fold, free, stored, table

#: Texts whose language is told with less certainty than this are rejected, with those that have no letter.
LEAST_CERTAIN = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold. The model learns from the labelled ones of three folds in four. All the caller's columns stay as they are."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    score = free("toxic_score", docs.columns)
    return toxicity.score_toxicity(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a language told with some certainty. The network learns from two folds in three."""
    net = langid.train(langid.language_sample(docs, fold(F.col("doc_id"), 3) != 1))
    if not net.languages:  # nothing to learn from: only texts without a letter are known to have no language
        return docs.where(F.col("text").rlike(r"\p{L}"))
    pred, score = (free(c, docs.columns) for c in ("lang_pred", "lang_score"))
    return langid.identify(docs, net, (pred, score)).where((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= LEAST_CERTAIN)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id; of several rows with that id, one.

    Groups are of rows, told apart by a key of their own: rows that share an id, or have none, are one group only
    where their texts are alike. Rows without doc_id come after all others of their group.
    """
    key = free("row_key", docs.columns)
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    groups = jaccard.similar_groups(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(key).alias("key"))
    # Only ids are grouped and joined with the texts.
    keep = keyed.select(key, "doc_id").join(groups, key).groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.key").alias(key))
    keep = stored(keep, "keep")
    keep = F.broadcast(keep) if keep.count() <= jaccard.BROADCAST_ROWS else keep
    return keyed.join(keep, key, "left_semi").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark within its edit budget."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mixture of sources."""
    return mixing.mix(docs, mixing.TARGETS)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_leaks),
    ("mixing", mixed),
]

#: Models and edit distances have no SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
