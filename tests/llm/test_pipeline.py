"""The pipeline's stages against what their operators find, one after another."""

from pyspark.sql import functions as F

import corpus_pipeline as p
from larkspur.llm import decontam, langid, mixing
from larkspur.llm.common import stored
from tests.conftest import rows


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    now = docs
    for name, stage in p.STAGES:
        before = now
        now = stored(stage(spark, before, sf), "pipeline-test")
        kept[name] = now
        if name != "mixing":
            assert now.columns == docs.columns
            assert now.join(before, "doc_id", "left_anti").count() == 0
        assert now.count() > 0
    assert kept["near_duplicates"].select("text").distinct().count() == kept["near_duplicates"].count()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontam.find_leaks(kept["decontamination"], bench).count() == 0
    assert kept["decontamination"].count() < kept["near_duplicates"].count()
    assert kept["mixing"].count() == kept["decontamination"].count()
    assert p.run(spark, sf).count() == kept["mixing"].count()


def test_stages_on_odd_rows(spark, sf):
    docs = spark.createDataFrame(
        [(1, None, "en", "src0", 0), (2, "", "en", None, 0), (3, "the and of it is " * 9, None, "src1", 9), (None, "the and of it is " * 9, "en", "src1", 9), (4, "the one and the other", "en", "x", 9), (4, "the one and the other", "en", "x", 9)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    now = docs
    for _, stage in p.STAGES:
        now = stored(stage(spark, now, sf), "pipeline-odd")
    assert {r["doc_id"] for r in now.collect()} >= {4}
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_unlike_rows_of_one_id_or_none_stay(spark, sf):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    data = [(None, a), (None, a), (None, b), (None, c), (None, None), (None, ""), (9, c), (7, d), (7, d), (7, e), (5, e), (3, "alone")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, source string").repartition(3)
    out = p.one_of_each_group(spark, docs, sf)
    assert out.columns == docs.columns
    want = [(None, a), (None, b), (None, None), (None, ""), (9, c), (7, d), (5, e), (3, "alone")]
    assert rows(out) == sorted(((i, t, "x") for i, t in want), key=repr)


def test_language_stage_keeps_clear_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = p.keep_known_language(spark, docs, sf)
    assert out.count() > 0.97 * docs.count()
    assert out.where(~F.col("text").rlike(r"\p{L}")).count() == 0
    assert mixing.TARGETS and langid.UNKNOWN == "und"


def test_the_caller_s_columns_stay(spark, sf):
    """Columns that are named like what the stages make come back as they were, a map among them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").withColumns({c: F.concat(F.lit(f"my {c} "), F.col("doc_id")) for c in ("row_key", "toxic_score", "Lang_pred", "lang_score", "component_id", "edits")})
    docs = docs.withColumn("m", F.create_map(F.lit("k"), "doc_id"))
    now = docs
    for name, stage in p.STAGES:
        now = stored(stage(spark, now, sf), "pipeline-columns")
        assert now.columns[: len(docs.columns)] == docs.columns, name
    mine = {r["doc_id"]: r for r in docs.collect()}
    assert now.count() > 10 and all(tuple(r)[: len(docs.columns)] == tuple(mine[r["doc_id"]]) for r in now.collect())
