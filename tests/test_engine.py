import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import sql, text, urls
from larkspur.operators import engine, frontier, graph
from larkspur.plans.catalogue import ROBOTS
from tests.conftest import rows

WORLD = [
    ("http://h/a", '<title>A</title>start <a href="/b">b</a><a href="/missing">m</a>', 200),
    ("http://h/b", 'second <a href="/c">c</a><a href="/a">a</a>', 200),
    ("http://h/c", 'third <a href="/d">d</a>', 200),
    ("http://h/d", "fourth", 200),
    ("http://h/gone", "text", 404),
    ("http://localhost/x", "text", 200),
    ("not a url", "text", 200),
]


def world(spark):
    return spark.createDataFrame(WORLD, "url string, html string, status int")


def start(spark, *seeds):
    return spark.createDataFrame([(s,) for s in seeds], "url string")


def test_crawl(spark):
    got = engine.crawl(world(spark), start(spark, "HTTP://H/a#x", "http://h/gone", "http://localhost/x", "bad"), engine.Config(max_depth=1))
    assert rows(got.documents.select("id", "url", "title")) == [(1, "http://h/a", "A"), (2, "http://h/b", "")]
    names = sorted((r["name"], r["error"]) for r in got.events.collect())
    # Four seeds, one of them no URL; links of the last depth are not taken.
    assert names == [("crawl_empty", False)] + [("crawl_fetch_failed", True)] * 3 + [("crawl_indexed", False)] * 2 + [("crawl_seed", False)] * 3 + [("crawl_seed", True)]
    assert got.frontier.count() == 0
    capped = engine.crawl(world(spark), start(spark, "http://h/a"), engine.Config(max_depth=5, max_documents=3))
    assert capped.documents.count() == 3 and capped.events.where("name = 'crawl_limit'").count() == 1
    assert capped.frontier.count() == 0  # the third page's links are not taken
    none = engine.crawl(world(spark), start(spark, "http://h/a"), engine.Config(max_documents=0))
    assert none.documents.count() == 0 and sorted((r["name"], r["error"]) for r in none.events.collect()) == [("crawl_limit", False), ("crawl_seed", True)]


def test_robots(spark):
    robots = spark.createDataFrame([("h", "User-agent: *\nDisallow: /b\n")], "host string, body string")
    config = engine.Config(max_depth=2, obey_robots=True)
    got = engine.crawl(world(spark), start(spark, "http://h/a"), config, robots)
    assert [r["url"] for r in got.documents.collect()] == ["http://h/a"]
    assert got.events.where("name = 'crawl_robots_blocked'").count() == 1


def test_search(spark):
    docs = engine.crawl(world(spark), start(spark, "http://h/a"), engine.Config(max_depth=3)).documents
    e = engine.Engine(docs)
    assert e.document_count() == 4
    assert [r["url"] for r in e.search("third").collect()] == ["http://h/c"]
    assert e.search("third", 0).count() == 0 and e.search("", 5).count() == 0
    assert engine.Engine(docs.limit(0)).search("x").count() == 0
    assert e.search_event("third", 1).first()[:] == ("search", 0, 5, 1, False)
    hits, told = e.searched("third")
    assert [r["url"] for r in hits] == ["http://h/c"] and told.first()["name"] == "search" and told.first()["bytes_out"] == 1 and told.first()["duration_ms"] > 0
    assert e.searched("nowhere")[1].first()[:1] == ("search",) and e.searched("third", 0)[1].first()[:1] == ("search_empty",)
    assert engine.Engine(docs.limit(0)).searched("x")[1].first()[:1] == ("search_empty",)
    assert [r["url"] for r in e.document(1).collect()] == ["http://h/a"]


def test_pop_and_evidence(spark):
    q = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "seq long, url string")
    first, rest = frontier.popped(q)
    assert rows(first) == [(1, "a")] and rows(rest) == [(2, "b"), (3, "c")]
    e = graph.with_evidence(spark.createDataFrame([(1, 7), (2, None)], "id long, evidence_id long"), spark.createDataFrame([(7, "c", "FACT")], "id long, claim string, classification string"))
    assert rows(e.select("id", "claim")) == [(1, "c"), (2, None)]


def test_sql_functions(spark):
    names = sql.register(spark)
    assert "url_canonical" in names
    data = [("HTTP://A.b:80?x#y", "<title> t </title>É B-c_d <b>x</b>&amp;lt;'<a href='/q'>", "The É B-c_d 17")]
    df = spark.createDataFrame(data, "u string, h string, t string")
    df.createOrReplaceTempView("sql_functions_test")
    ours = df.select(
        urls.canonical(F.col("u")), urls.may_fetch(F.lower("u")), text.html_title(F.col("h")), text.html_text(F.col("h")), text.html_links(F.col("h")), text.ascii_tokens(F.col("t")), text.unicode_tokens(F.col("t"))
    ).first()
    long = [("http://h" + "/q" * n, r, t) for n in (1019, 1020, 1025) for r, t in (("?x", "a```b```c$$x$$"), ("../y/./z", "\\[z\\]q\\(w"), ("//o", "plain"), ("#f", ""), (None, None))]
    odd = spark.createDataFrame(long + [("http://h?x", "a", "`` ``` x"), ("mailto:x", "/a", "$$"), (None, "a", "é\\]")], "u string, r string, t string")
    both = odd.select(
        urls.canonical(F.col("u")), F.expr("url_canonical(u)"), urls.resolved(F.col("u"), F.col("r")), F.expr("url_resolve(u, r)"), text.segments(F.col("t")), F.expr("text_segments(t)"),
    )
    assert all(r[0] == r[1] and r[2] == r[3] and r[4] == r[5] for r in both.collect())
    cases = spark.createDataFrame([c[:3] for c in ROBOTS], "p string, b string, a string")
    assert [r[0] for r in cases.select(F.expr("robots_allows(p, b, a)")).collect()] == [c[3] for c in ROBOTS]
    theirs = spark.sql("SELECT url_canonical(u), url_allowed(lower(u)), html_title(h), html_text(h), html_links(h), ascii_tokens(t), unicode_tokens(t) FROM sql_functions_test").first()
    assert tuple(ours) == tuple(theirs)
    assert spark.sql("SELECT truth_class(3, 1)").first()[0] == "UNCERTAIN"


def queue(pages, seeds, max_depth, max_documents):
    """A crawl by a queue: (id, url) of documents, names of events, what waits."""
    waiting, known, documents, events = [], set(), [], []
    for url in seeds:
        fresh = url is not None and url not in known and max_documents > 0
        events.append(("crawl_seed", not fresh))
        if fresh:
            known.add(url)
            waiting.append((url, 0))
    while waiting and len(documents) < max_documents:
        url, depth = waiting.pop(0)
        if url not in pages:
            events.append(("crawl_fetch_failed", True))
            continue
        documents.append((len(documents) + 1, url))
        events.append(("crawl_indexed", False))
        for link in pages[url] if depth < max_depth and len(documents) < max_documents else ():
            if link not in known:
                known.add(link)
                waiting.append((link, depth + 1))
    events.append(("crawl_limit" if len(documents) >= max_documents else "crawl_empty", False))
    return documents, sorted(events), waiting


@pytest.mark.parametrize("cap", [1, 4, 9, 1000])
def test_crawl_is_a_queue(spark, cap):
    """Documents, ids, events and what waits are those of a queue, on graphs whose URLs do not arrive in their own order."""
    rng = random.Random(cap)
    urls_ = [f"http://h/{rng.randrange(1000)}-{k}" for k in range(30)]
    pages = {u: [rng.choice(urls_) for _ in range(rng.randrange(6))] for u in urls_[:22]}
    seeds = [urls_[k] for k in (7, 3, 3, 25, 0)]
    data = [(u, " ".join(f"<a href='{x}'>l</a>" for x in links) + " text") for u, links in pages.items()]
    rng.shuffle(data)
    start_ = spark.createDataFrame([(k, u) for k, u in enumerate([*seeds, "no url"])], "seq long, url string").repartition(3)
    got = engine.crawl(spark.createDataFrame(data, "url string, html string").repartition(4), start_, engine.Config(max_depth=2, max_documents=cap))
    documents, events, waiting = queue(pages, [*seeds, None], 2, cap)
    assert rows(got.documents.select("id", "url")) == sorted(documents, key=repr)
    assert sorted((r["name"], r["error"]) for r in got.events.collect()) == events
    assert [(r["url"], r["depth"]) for r in got.frontier.orderBy("depth", "place").collect()] == waiting


def test_first_links_come_first(spark):
    """Not the order of URLs but that of links and seeds decides what a cap lets in."""
    world_ = spark.createDataFrame([("http://h/s", '<a href="/z">1</a><a href="/a">2</a>'), ("http://h/z", "z"), ("http://h/a", "a")], "url string, html string")
    capped = engine.crawl(world_, start(spark, "http://h/s"), engine.Config(max_documents=2))
    assert rows(capped.documents.select("id", "url")) == [(1, "http://h/s"), (2, "http://h/z")] and [r["url"] for r in capped.frontier.collect()] == ["http://h/a"]
    one = engine.crawl(world_, start(spark, "http://h/z", "http://h/a").coalesce(1), engine.Config(max_documents=1))
    assert rows(one.documents.select("id", "url")) == [(1, "http://h/z")]


def test_crawl_of_all_pages_has_no_cap(spark, tmp_path):
    """More pages than the default cap: crawl_events tells of all of them, and ends at an empty queue."""
    from larkspur.plans.catalogue import crawl_events

    spark.range(300).select(F.col("id").alias("page_id"), F.format_string("http://h/%d", "id").alias("url"), F.lit("text").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["name"]: (r["events"], r["bytes_in"]) for r in crawl_events(spark, str(tmp_path)).collect()}
    assert got == {"crawl_seed": (300, 0), "crawl_indexed": (300, 1200), "crawl_empty": (1, 0)}
