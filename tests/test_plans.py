"""Plans: what reaches the scan, and what is not shuffled."""

import re

import pytest

from larkspur.operators import index, rank
from larkspur.plans import catalogue as c


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, sf):
    text = plan(c.doc_length(spark, sf))
    assert "Not(EqualTo(doc_id,0))" in text
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


@pytest.mark.parametrize("name", ["tokenize_ascii", "tokenize_unicode", "html_text", "html_links", "page_extract", "url_resolve", "segment_documents", "evidence_valid", "source_usable", "telemetry_jsonl", "fetch_filter"])
def test_row_wise_queries_do_not_shuffle(spark, sf, name):
    text = plan(c.queries()[name](spark, sf))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


def test_no_query_leaves_the_jvm(spark, sf):
    for name, query in c.queries().items():
        assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan(query(spark, sf))), name


def test_ranking_scans_without_shuffle(spark, sf):
    scored = rank.scores(index.build(c.documents(spark, sf)), c.QUERY)
    assert "Exchange" not in plan(scored)
    assert "TakeOrderedAndProject" in plan(rank.top(scored, 10))


def test_stored_index_reads_the_terms_alone(spark, sf, tmp_path):
    """The scores of a stored index open the buckets of the query's terms and read their rows."""
    built = index.build(c.documents(spark, sf)).save(str(tmp_path / "i"))
    text = plan(rank.scores(built, "worthless the"))
    assert re.search(r"PartitionFilters: \[bucket#\d+ IN \(\d+,\d+\)\]", text)
    assert re.search(r"PushedFilters: \[In\(term, \[the,worthless\]\)|PushedFilters: \[In\(term, \[worthless,the\]\)", text)
    few = built.postings_of(["the"])
    assert len(few.inputFiles()) <= len(built.postings.inputFiles()) and few.select("bucket").distinct().count() == 1
    a = {r["id"]: round(r["score"], 9) for r in rank.search(built, c.QUERY).collect()}
    b = {r["id"]: round(r["score"], 9) for r in rank.search(index.build(c.documents(spark, sf)), c.QUERY).collect()}
    assert a == b


def test_document_frequency_is_one_exchange(spark, sf):
    assert plan(c.doc_freq(spark, sf)).count("Exchange hashpartitioning") == 1


def test_boolean_search_is_one_pass(spark, sf):
    text = plan(c.fts_boolean(spark, sf))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1
