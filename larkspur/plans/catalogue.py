"""Named queries over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import evidence as ev
from larkspur.functions import text as tx
from larkspur.functions import urls
from larkspur.functions.binding import computed
from larkspur.functions.robots import robots_allowed
from larkspur.functions.sql import register
from larkspur.operators import constraints, engine, frontier, fts, graph, index, rank
from larkspur.operators.lineage import shared_folder
from larkspur.operators.segmented import SegmentedIndex
from larkspur.sources import store, telemetry
from larkspur.sources.pages import FetchLimits, fetched
from larkspur.streaming.streams import queue_stream, telemetry_stream, windowed_events

#: The query texts of the ranking queries, and what is removed in the tombstone query.
QUERY = "idiot worthless the thtion ñdo"
REPEATED = "worthless worthless moron the"
PAGE_QUERY = "attion thanedble the ner"
REMOVED = "id % 7 = 3"
PHRASE = ["of", "the"]
NEAR = ("worthless", "the", 5)
COVER = ["of", "the", "and"]
RANK_PHRASES = [["of", "the"], ["worthless"], ["web"]]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (never 0), text."""
    return read(spark, sf_dir, "documents").where("doc_id <> 0").select(F.col("doc_id").alias("id"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (never 0, once each), url, title, text of the pages. Ids that repeat are sought before anything is parsed."""
    rows = constraints.first_of(read(spark, sf_dir, "pages").where("page_id <> 0 AND html IS NOT NULL").withColumnRenamed("page_id", "id").select("id", "url", "html"), "id")
    return computed(rows, {"title": tx.html_title(F.col("html")), "text": tx.html_text(F.col("html"))}).select("id", "url", "title", "text")


def rounded(hits: DataFrame, k: int = 10) -> DataFrame:
    """The best k with scores as they compare between engines."""
    hits = hits.withColumn("score", F.round("score", 6))
    return hits.orderBy(F.col("score").desc(), "id").limit(k).select(F.col("id").alias("doc_id"), "score")


# -- tokens and statistics ---------------------------------------------------


def tokenize_ascii(spark, sf):
    return documents(spark, sf).select(F.col("id").alias("doc_id"), F.array_join(tx.ascii_tokens(F.col("text")), " ").alias("tokens"))


def tokenize_unicode(spark, sf):
    return documents(spark, sf).select(F.col("id").alias("doc_id"), F.array_join(tx.unicode_tokens(F.col("text")), " ").alias("tokens"))


def term_freq(spark, sf):
    return index.build(documents(spark, sf)).postings.select("term", F.col("id").alias("doc_id"), "tf")


def doc_freq(spark, sf):
    return index.build(documents(spark, sf)).document_frequency()


def doc_length(spark, sf):
    return index.build(documents(spark, sf)).docs.select(F.col("id").alias("doc_id"), F.col("length").cast("bigint").alias("length"))


def corpus_stats(spark, sf):
    return index.build(documents(spark, sf)).stats().withColumn("avgdl", F.round("avgdl", 6))


def postings_binary(spark, sf):
    return index.build(documents(spark, sf), "unicode").postings.select("term", F.col("id").alias("doc_id"))


# -- ranking -----------------------------------------------------------------


def bm25_native(spark, sf):
    return rounded(rank.scores(index.build(documents(spark, sf)), QUERY))


def bm25_native_boost(spark, sf):
    return rounded(rank.scores(index.build(pages(spark, sf), unique=True), PAGE_QUERY, boosts=True))


def bm25_native_tombstone(spark, sf):
    built = index.build(documents(spark, sf))
    return rounded(rank.scores(built.removed(built.docs.where(REMOVED).select("id")), QUERY))


def bm25_segmented(spark, sf):
    """The ranking of bm25_native_tombstone from a stored index: documents come in three segments, some twice, some are removed between, and all is merged."""
    held = SegmentedIndex(spark, shared_folder(spark, "bm25-segmented"))
    rows = documents(spark, sf)
    for part in (0, 1):
        held.add(rows.where(F.col("id") % 3 == part))
        held.remove(rows.where(REMOVED).select("id"))
    held.add(rows)  # those of the first two parts are there, or were
    held.remove(rows.where(REMOVED).select("id"))
    held.merge(everything=True)
    return rounded(held.search(QUERY).hits)


def bm25_repeat_terms(spark, sf):
    return rounded(rank.scores(index.build(documents(spark, sf)), REPEATED))


def bm25_binary(spark, sf):
    return rounded(rank.scores(index.build(documents(spark, sf), "unicode"), QUERY))


def search_results_join(spark, sf):
    built = index.build(pages(spark, sf), "unicode", unique=True)
    hits = rank.scores(built, PAGE_QUERY).withColumn("score", F.round("score", 6))
    return rank.titled(built, rank.top(hits, 10), 10).withColumnRenamed("id", "doc_id")


def engine_searched(spark, sf):
    """The hits of a search through the engine over pages, each with what the search's telemetry tells."""
    found, told = engine.Engine(pages(spark, sf)).searched(PAGE_QUERY)
    hits = spark.createDataFrame([(r["id"], round(r["score"], 6), r["url"], r["title"]) for r in found], "doc_id long, score double, url string, title string")
    event = told.first()  # one row
    return hits.withColumns({c: F.lit(event[c]).cast(k) for c, k in (("name", "string"), ("bytes_in", "bigint"), ("bytes_out", "bigint"), ("error", "boolean"))})


def _arriving(spark, sf):
    """Documents as rows that arrive by doc_id: two by two they share an id, and every ninth has no text."""
    rows = read(spark, sf, "documents")
    return rows.select(F.col("doc_id").alias("seq"), F.floor(F.col("doc_id") / 2).cast("bigint").alias("id"), F.when(F.col("doc_id") % 9 != 4, F.col("text")).alias("text"))


def index_first_wins(spark, sf):
    """Documents of an index that rows with repeated ids were added to, with their lengths and term frequencies' sums."""
    built = index.build(_arriving(spark, sf), order=F.col("seq"))
    sums = built.postings.groupBy("id").agg(F.sum("tf").alias("tf"), F.count("*").alias("terms"))
    return built.docs.join(sums, "id", "left").select(F.col("id").alias("doc_id"), F.col("length").cast("bigint").alias("length"), F.coalesce("tf", F.lit(0)).alias("tf"), F.coalesce("terms", F.lit(0)).alias("terms"))


def bm25_first_wins(spark, sf):
    return rounded(rank.scores(index.build(_arriving(spark, sf), order=F.col("seq")), QUERY))


def bm25_parameters(spark, sf):
    """Another k1 and b, and a limit beyond the number of hits."""
    return rounded(rank.scores(index.build(documents(spark, sf)), "moron idiot", k1=2.0, b=0.25), 10_000_000)


def document_lookup(spark, sf):
    """One document by its id; id 0 is none."""
    built = index.build(documents(spark, sf))
    return built.document(7).unionByName(built.document(0)).select(F.col("id").alias("doc_id"), F.col("length").cast("bigint").alias("length"))


def document_count(spark, sf):
    return index.build(documents(spark, sf)).docs.agg(F.count("*").alias("n"))


def vector_cosine(spark, sf):
    """Cosine of every vector with the first one: the best ten."""
    rows = read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    first = rows.where("vec_id = 0").select("e").first()  # one vector
    probe = F.array(*[F.lit(x) for x in first["e"]]) if first else F.lit(None).cast("array<double>")
    dot = F.aggregate(F.zip_with("e", probe, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    def norm(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))

    scored = rows.where("vec_id <> 0").select("vec_id", F.round(dot / (norm(F.col("e")) * norm(probe)), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), "vec_id").limit(10)


# -- full text ---------------------------------------------------------------


def _positions(spark, sf, words, prefixes=None):
    return fts.positions(documents(spark, sf), "id", only=words, prefixes=prefixes)


def _ids(rows):
    return rows.select(F.col("id").alias("doc_id"))


def fts_phrase(spark, sf):
    return _ids(fts.phrase(_positions(spark, sf, PHRASE), PHRASE))


def fts_prefix(spark, sf):
    return _ids(fts.prefix(_positions(spark, sf, None, ["worth"]), "worth"))


def fts_boolean(spark, sf):
    met = (F.col("a") & F.col("b") | F.col("m")) & ~F.col("i")
    return _ids(fts.boolean(_positions(spark, sf, ["worthless", "the", "moron", "idiot"]), met, a="worthless", b="the", m="moron", i="idiot"))


def fts_column(spark, sf):
    """A word in one column of several."""
    rows = fts.positions(read(spark, sf, "documents").where("doc_id <> 0"), "doc_id", ["source", "lang", "text"], only=["en"])
    return _ids(fts.but_not(fts.term(fts.within(rows, 2), "en"), fts.term(fts.within(rows, 1), "en")))


def fts_rank(spark, sf):
    """The ten best of a phrase and a word in two weighted columns."""
    rows = read(spark, sf, "documents").where("doc_id <> 0")
    hits = fts.ranked(rows, "doc_id", ["source", "text"], RANK_PHRASES, [10.0, 1.0]).withColumn("score", F.round("score", 6))
    return hits.orderBy("score", "id").limit(10).select(F.col("id").alias("doc_id"), "score")


def fts_near(spark, sf):
    return _ids(fts.near(_positions(spark, sf, list(NEAR[:2])), *NEAR))


# -- pages and URLs ----------------------------------------------------------


def html_title(spark, sf):
    return read(spark, sf, "pages").select("page_id", tx.html_title(F.col("html")).alias("title"))


def html_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


def html_links(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.posexplode(tx.html_links(F.col("html"))).alias("nth", "link"))


def page_extract(spark, sf):
    return read(spark, sf, "pages").select(
        "page_id",
        urls.canonical(F.col("url")).alias("url"),
        tx.html_title(F.col("html")).alias("title"),
        F.sha2(tx.html_text(F.col("html")), 256).alias("text_sha256"),
        F.size(tx.html_links(F.col("html"))).alias("n_links"),
    )


def url_canonical(spark, sf):
    return read(spark, sf, "pages").select("page_id", urls.canonical(F.col("url")).alias("url"))


def url_policy(spark, sf):
    return read(spark, sf, "pages").select("page_id", urls.may_fetch(F.col("url")).alias("allowed"))


def url_resolve_sql(spark, sf):
    """The same through SQL functions."""
    register(spark)
    read(spark, sf, "pages").createOrReplaceTempView("larkspur_pages")
    return spark.sql("SELECT page_id, nth, ref, url_resolve(url, ref) AS target FROM (SELECT page_id, url, posexplode(links) AS (nth, ref) FROM (SELECT page_id, url, html_links(html) AS links FROM larkspur_pages))")


def segments_sql(spark, sf):
    register(spark)
    read(spark, sf, "conversations").createOrReplaceTempView("larkspur_conversations")
    return spark.sql("SELECT s.kind AS kind, count(*) AS n, sum(s.length) AS total_bytes FROM (SELECT explode(spans) AS s FROM (SELECT text_segments(text) AS spans FROM larkspur_conversations)) GROUP BY s.kind")


def robots_pages(spark, sf):
    """Whether a page's path may be fetched under rules made of its number: through the Column form and the SQL function, which must agree."""
    register(spark)
    rows = read(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-zA-Z]+://[^/?#]*", "").alias("path"))
    last = (F.col("page_id") % 10).cast("string")
    body = F.concat(F.lit("# rules\nUser-agent: other\nDisallow: /\n\nUser-Agent: Bot\nDisallow: /en\nAllow: /en/"), last, F.lit("\n\nUser-agent: *\nDisallow: /fr/"), last)
    rows = rows.withColumn("body", body)
    both = [robots_allowed(F.col("path"), F.col("body"), F.lit("bOT")), F.expr("robots_allows(path, body, 'bOT')")]
    return rows.select("page_id", both[0].alias("allowed"), both[0].eqNullSafe(both[1]).alias("agree"))


def _links(spark, sf):
    rows = read(spark, sf, "pages").select("page_id", "url", F.posexplode(tx.html_links(F.col("html"))).alias("nth", "ref"))
    return computed(rows, {"target": urls.resolved(F.col("url"), F.col("ref"))}).drop("url")


def url_resolve(spark, sf):
    return _links(spark, sf)


def _arrivals(spark, sf):
    """Links in page order as arrivals, with depths that fall back and forth."""
    rows = _links(spark, sf).where("target IS NOT NULL")
    return rows.select((F.col("page_id") * 10_000 + F.col("nth")).alias("seq"), F.col("target").alias("url"), (F.col("page_id") % 3).cast("int").alias("depth"))


def link_frontier_dedup(spark, sf):
    return frontier.decisions(_arrivals(spark, sf))


def frontier_bounded(spark, sf):
    return frontier.decisions(_arrivals(spark, sf), capacity=256)


def frontier_pop(spark, sf):
    """The first hundred of a queue of links, in order of arrival, and how many still wait."""
    first, rest = frontier.popped(_arrivals(spark, sf), 100)
    return first.select("seq", "url").unionByName(rest.agg(F.count("*").alias("seq")).withColumn("url", F.lit(None).cast("string")))


def frontier_depth_min(spark, sf):
    return frontier.shallower(_arrivals(spark, sf))


def crawl_closed_world(spark, sf):
    rows = read(spark, sf, "pages")
    return frontier.crawl(rows, rows.select("url"), max_depth=1)


def fetch_filter(spark, sf):
    """Pages as responses whose status and headers follow from their number."""
    rows = read(spark, sf, "pages").select(
        "page_id", "url", (F.lit(200) + F.pmod("page_id", F.lit(5)) * 75).cast("int").alias("status"),
        F.concat(F.lit("Server: x\r\nCONTENT-TYPE:  text/html; n="), F.col("page_id"), F.lit("\r\nX: y\r\n")).alias("headers"), F.col("html").alias("body"),
    )
    return fetched(rows, FetchLimits()).select("page_id", "status", "content_type")


def fetch_limits(spark, sf):
    """Limits made of the numbers of parts, valid or not."""
    rows = read(spark, sf, "part").select("p_partkey", *[(F.col("p_size") % n - 1).cast("int").alias(c) for n, c in ((3, "connect"), (5, "total"), (7, "body"), (4, "redirects"))])
    return rows.select("p_partkey", urls.limits_valid(F.col("connect"), F.col("total"), F.col("body"), F.col("redirects")).alias("valid"))


def _world(spark, sf):
    """Suppliers as pages in a tree: each links to two others by relative references and to one that is missing; some answer with an error, or from another URL."""
    k = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(
        F.concat(F.lit("http://World.example:80/s/"), k).alias("url"),
        F.concat(F.lit("<title>"), F.col("s_name"), F.lit("</title><p>number "), k, F.lit(" </p><a href='./x/../"), 2 * k + 1, F.lit("'>l</a><a href=\"/s/"), 2 * k + 2, F.lit("#r\">r</a><a href='/gone/"), k, F.lit("'>g</a>")).alias("html"),
        F.when(k % 7 == 5, 500).otherwise(200).alias("status"),
        F.when(k % 11 == 9, F.lit("ftp://elsewhere/")).when(k % 5 == 4, F.concat(F.lit("HTTP://moved.example/s/"), k)).alias("effective_url"),
        (k * 3).cast("bigint").alias("duration_ms"),
    )


def _crawled(spark, sf):
    start = spark.createDataFrame([(1, "http://world.example/s/0"), (2, "http://world.example/s/1"), (3, "http://WORLD.example/s/1#again"), (4, "not a url")], "seq long, url string")
    return engine.crawl(_world(spark, sf), start, engine.Config(max_depth=3, max_documents=1000))


def crawl_documents(spark, sf):
    """Documents of a crawl over four levels from three seeds, two of which are one."""
    return _crawled(spark, sf).documents.select("id", "url", "title", F.length("text").alias("n_chars"))


def crawl_depths(spark, sf):
    """Telemetry of the same crawl: seeds, what was tried, and its end."""
    return _crawled(spark, sf).events.groupBy("name", "error").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("duration_ms"), F.sum("bytes_in").alias("bytes_in"))


def crawl_capped(spark, sf):
    """The same crawl, ended at five documents: what it indexed, and what waits, each in the order of the queue."""
    start = spark.createDataFrame([(1, "http://world.example/s/0"), (2, "http://world.example/s/1")], "seq long, url string")
    got = engine.crawl(_world(spark, sf), start, engine.Config(max_depth=3, max_documents=5))
    waiting = frontier.numbered(got.frontier.withColumnRenamed("place", "at"), ["depth", "at"], "place")
    return got.documents.select("url", F.lit("indexed").alias("state"), F.col("id").alias("place")).unionByName(waiting.select("url", F.lit("waiting").alias("state"), (F.col("place") + 1).alias("place")))


# Robots files with a path, an agent and whether the path may be fetched.
ROBOTS = (
    ("/a", "User-agent: *\nDisallow: /a\n", "bot", False),
    ("/a", "User-agent: *\r\nDisallow: /a\r\n", "bot", True),
    ("/a/b", "User-agent: *\nDisallow: /a\nAllow: /a/b\n", "bot", True),
    ("/a", "User-agent: *\nAllow: /a\nDisallow: /a\n", "bot", True),
    ("/a", "User-agent: *\nDisallow:\n", "bot", True),
    ("/a", "User-agent: bot\nUser-agent: other\nDisallow: /a\n", "bot", True),
    ("/a", "User-agent: BOT\nDisallow: /a # note\n", "bot", True),
    ("/a x", "User-agent: BOT\nDisallow: /a \n", "bot", False),
    ("/a", "User-agent: other\nDisallow: /\n", "bot", True),
    ("/a", "Disallow: /\n", "bot", True),
    ("/x", "User-agent: *\nDisallow : /x\n", "bot", True),
    ("/x", "  uSeR-AgEnT:\t*\n dIsAlLoW:   /x", "", False),
)


def robots_decision(spark, sf):
    cases = F.array(*[F.struct(F.lit(i).alias("case_id"), F.lit(p).alias("path"), F.lit(b).alias("body"), F.lit(a).alias("agent")) for i, (p, b, a, _) in enumerate(ROBOTS)])
    rows = spark.range(1).select(F.explode(cases).alias("c")).select("c.*")
    return rows.select("case_id", robots_allowed(F.col("path"), F.col("body"), F.col("agent")).alias("allowed"))


# -- segments, hashes --------------------------------------------------------


def segment_documents(spark, sf):
    rows = documents(spark, sf).select(F.col("id").alias("doc_id"), F.explode(tx.segments(F.col("text"))).alias("s"))
    return rows.select("doc_id", F.col("s.index").alias("nth"), F.col("s.kind").alias("kind"), F.col("s.start").alias("start"), F.col("s.length").alias("length"))


def segment_counts(spark, sf):
    rows = read(spark, sf, "conversations").select(F.explode(tx.segments(F.col("text"))).alias("s"))
    return rows.groupBy(F.col("s.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum("s.length").alias("total_bytes"))


def content_dedup(spark, sf):
    return constraints.once(documents(spark, sf), F.col("text"), "id").select(F.col("id").alias("doc_id"), "sha256")


def chunk_hash_dedup(spark, sf):
    rows = documents(spark, sf).select(F.col("id").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "chunk"))
    rows = rows.where(F.length("chunk") > 0).withColumn("place", F.col("doc_id") * 1_000_000 + F.col("ordinal"))
    return constraints.once(rows, F.col("chunk"), "place").select("doc_id", "ordinal", "sha256")


# -- graph -------------------------------------------------------------------


def _nodes(spark, sf):
    """Suppliers that are not in debt, and nations, as nodes: 1000 + nation, 1000000 + supplier."""
    nations = read(spark, sf, "nation").select((F.col("n_nationkey") + 1000).cast("bigint").alias("id"), F.lit(5).alias("kind"), F.col("n_name").alias("label"))
    suppliers = read(spark, sf, "supplier").where("s_acctbal >= 0").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.lit(1).alias("kind"), F.col("s_name").alias("label"))
    return nations.unionByName(suppliers)


def _edges(spark, sf):
    """From every supplier to its nation, and from the nation to the supplier numbered as it; every eleventh supplier points at itself."""
    s = read(spark, sf, "supplier")
    src = F.col("s_suppkey") + 1_000_000
    dst = F.when(F.col("s_suppkey") % 11 == 0, src).otherwise((F.col("s_nationkey") + 1000).cast("bigint"))
    return s.select((F.col("s_suppkey") + 1).alias("id"), src.alias("src"), dst.alias("dst"), (F.col("s_suppkey") % 8).cast("int").alias("kind"), F.col("s_acctbal").alias("weight"))


def graph_valid_edges(spark, sf):
    return graph.valid_edges(_edges(spark, sf), _nodes(spark, sf)).select("id", "src", "dst", "kind", "weight")


def graph_orphans(spark, sf):
    return graph.orphans(_edges(spark, sf), _nodes(spark, sf)).select("id", "src", "dst")


def graph_self_loops(spark, sf):
    return _edges(spark, sf).where("src = dst").select("id", "src")


def graph_runtime_edges(spark, sf):
    return graph.runtime_edges(_edges(spark, sf), _nodes(spark, sf)).select("id", "src", "dst", "kind", "weight")


def graph_find(spark, sf):
    """An edge and a node by id; id 0 finds none."""
    edges, nodes = _edges(spark, sf), _nodes(spark, sf)
    found = graph.find(edges, 12).select("id", F.col("src").alias("at")).unionByName(graph.find(edges, 0).select("id", F.col("src").alias("at")))
    return found.unionByName(graph.find(nodes, 1003).select("id", F.col("kind").cast("bigint").alias("at")))


def graph_neighbours(spark, sf):
    """What suppliers 1 to 9 point at."""
    start = read(spark, sf, "supplier").where("s_suppkey BETWEEN 1 AND 9").select((F.col("s_suppkey") + 1_000_000).alias("id"))
    return graph.neighbours(_edges(spark, sf), start)


def _additions(spark, sf):
    """Suppliers as nodes in a tree, some of an unknown kind, and customers as edges between them; even places are nodes, odd ones edges."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    nodes = read(spark, sf, "supplier").select((2 * k).alias("seq"), F.when(k % 4 > 0, 2 * F.floor(k / 3)).cast("bigint").alias("parent_seq"), (k % 10).cast("int").alias("kind"), F.repeat("s_name", 8).alias("label"))
    edges = read(spark, sf, "customer").select((2 * c + 1).alias("seq"), (2 * (c % 97)).cast("bigint").alias("src_seq"), (2 * (c % 89)).cast("bigint").alias("dst_seq"), (c % 8).cast("int").alias("kind"), F.col("c_acctbal").alias("weight"))
    return nodes, edges


def _numbered(nodes, edges):
    n = nodes.select(F.lit("node").alias("what"), "seq", "id", F.col("parent_id").alias("a"), F.octet_length("label").cast("bigint").alias("b"))
    return n.unionByName(edges.select(F.lit("edge").alias("what"), "seq", "id", F.col("src").alias("a"), F.col("dst").alias("b")))


def graph_runtime(spark, sf):
    """Nodes and edges of a runtime graph with the ids of their one sequence."""
    return _numbered(*graph.runtime_graph(*_additions(spark, sf)))


def graph_runtime_capped(spark, sf):
    """The same with room for thirty nodes and forty edges, cleared after place 20."""
    nodes, edges = (graph.since_clear(x, spark.createDataFrame([(20,), (4,)], "seq long")) for x in _additions(spark, sf))
    return _numbered(*graph.runtime_graph(nodes, edges, node_capacity=30, edge_capacity=40))


def graph_kind_counts(spark, sf):
    return graph.first_wins(_nodes(spark, sf)).groupBy(ev.named(F.col("kind"), ev.NODE_KINDS, "unknown").alias("kind")).agg(F.count("*").alias("n"))


# -- evidence ----------------------------------------------------------------


def _claims(spark, sf):
    """Labelled documents as evidence: a label of quality supports its document's source, a toxic one conflicts."""
    docs = read(spark, sf, "documents").select("doc_id", "source", "lang")
    labels = read(spark, sf, "labels")
    return labels.join(docs, "doc_id")


def graph_evidence_link(spark, sf):
    """Documents as edges from source to language, with the label that speaks for or against them where there is one."""
    edges = read(spark, sf, "documents").select(F.col("doc_id").alias("edge_id"), "source", "lang", F.col("doc_id").alias("evidence_id"))
    labels = read(spark, sf, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q"))
    evidence = labels.select("id", F.concat(F.lit("quality "), F.col("q")).alias("claim"), F.when(F.col("q") == 1, "FACT").otherwise("UNCERTAIN").alias("classification"))
    return graph.with_evidence(edges, evidence).select("edge_id", "source", "lang", "claim", "classification")


def fts_cover_rank(spark, sf):
    """Documents that hold all of three words, by the density of their covers; words of the source weigh ten times those of the text."""
    rows = read(spark, sf, "documents").where("doc_id <> 0")
    hits = fts.cover_ranked(rows, "doc_id", ["source", "text"], COVER, [1.0, 0.1]).withColumn("score", F.round("score", 6))
    return hits.select(F.col("id").alias("doc_id"), "score")


def graph_reach(spark, sf):
    """Customers and parts of a graph of orders' lines: what four of the first suppliers reach within three steps, with the fewest."""
    lines = read(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    supplies = lines.select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    back = lines.where(F.col("l_partkey") % 5 == 0).select((F.col("l_partkey") * 2 + 1).alias("src"), (F.col("l_suppkey") * 2).alias("dst"))
    start = read(spark, sf, "supplier").where("s_suppkey <= 4").select((F.col("s_suppkey") * 2).alias("id"))
    return graph.reach(supplies.unionByName(back), start, 3)


def lateral_links(spark, sf):
    """Links and targets of pages through the SQL table functions."""
    register(spark)
    read(spark, sf, "pages").createOrReplaceTempView("larkspur_pages")
    return spark.sql("SELECT page_id, nth, link, url_resolve(url, link) AS target FROM larkspur_pages, LATERAL page_links(html)")


def lateral_segments(spark, sf):
    """Segments of the turns of conversations through the SQL table function, by kind."""
    register(spark)
    read(spark, sf, "conversations").createOrReplaceTempView("larkspur_turns")
    return spark.sql("SELECT kind, count(*) AS n, sum(length) AS total_bytes, max(start + length) AS longest FROM larkspur_turns, LATERAL segments_of(text) GROUP BY kind")


def crawl_events(spark, sf):
    """Telemetry of a crawl over all pages: what was tried, by outcome."""
    rows = read(spark, sf, "pages").where("url IS NOT NULL")
    return engine.crawl(rows, rows.select("url"), engine.Config(max_depth=0, max_documents=None)).events.groupBy("name").agg(*telemetry.counters())


def truth_classify(spark, sf):
    rows = _claims(spark, sf).groupBy("source", "lang").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("sources"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("conflicts"))
    return rows.withColumn("truth", ev.truth_class(F.col("sources"), F.col("conflicts")))


def single_source_flag(spark, sf):
    rows = _claims(spark, sf).where("toxic = 1").groupBy("source", "lang").agg(F.count("*").alias("sources"))
    return rows.withColumn("flag", ev.single_source(F.col("sources")))


def _evidence(spark, sf):
    return read(spark, sf, "documents").select(
        "doc_id",
        (F.col("doc_id") % 6).cast("int").alias("kind"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("text")).alias("claim"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, F.unhex(F.lit("00" * 32))).otherwise(F.unhex(F.sha2("text", 256))).alias("hash"),
        (F.col("doc_id") % 8 != 0).alias("verified"),
    )


def evidence_valid(spark, sf):
    rows = _evidence(spark, sf)
    return rows.select("doc_id", ev.evidence_kind_name(F.col("kind")).alias("kind"), ev.evidence_valid(F.col("kind"), F.col("source"), F.col("claim")).alias("valid"))


def source_usable(spark, sf):
    rows = _evidence(spark, sf)
    return rows.select("doc_id", ev.source_usable(F.col("kind"), F.col("source"), F.col("hash"), F.col("verified")).alias("usable"))


def source_reject_code(spark, sf):
    rows = _evidence(spark, sf)
    return rows.select("doc_id", ev.source_reject_code(F.col("kind"), F.when(F.col("source") != "", F.col("source")), F.col("hash"), F.col("verified")).alias("code"))


# -- telemetry ---------------------------------------------------------------


def _telemetry(spark, sf):
    """Events as telemetry: whole parts of values as bytes in, numbers from the properties as bytes out."""
    return read(spark, sf, "events").select(
        F.col("event_type").alias("name"),
        (F.col("event_id") % 1000).alias("duration_ms"),
        F.floor(F.col("value")).cast("bigint").alias("bytes_in"),
        F.get_json_object("props", "$.k").cast("bigint").alias("bytes_out"),
        (F.col("event_type") == "error").alias("error"),
        "event_id",
    )


def telemetry_stats(spark, sf):
    return telemetry.stats(_telemetry(spark, sf))


def telemetry_by_name(spark, sf):
    return telemetry.stats_by_name(_telemetry(spark, sf))


def telemetry_jsonl(spark, sf):
    return _telemetry(spark, sf).select("event_id", telemetry.line().alias("line"))


def _streamed(rows, names):
    """A stream's rows: it runs over all that its source has, and is read back from files in the shared folder."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, names)
    rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def telemetry_streamed(spark, sf):
    """Counters by name of a telemetry log, as a stream keeps them: the log is written, read as a stream, and the last state of each name counts."""
    folder = shared_folder(spark, "telemetry")
    telemetry.write_lines(_telemetry(spark, sf), f"{folder}/log", 1, 2)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    query = telemetry_stream(spark, f"{folder}/log").writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    state = spark.read.parquet(f"{folder}/state")
    return state.where(F.col("batch") == state.agg(F.max("batch")).scalar()).drop("batch")


def queue_streamed(spark, sf):
    """Links as events of seven bounded queues, every fifth a pop: what a stream with the queues as its state decides."""
    rows = _links(spark, sf).where("target IS NOT NULL").select((F.col("page_id") * 10_000 + F.col("nth")).alias("seq"), "target", "page_id")
    pop = F.col("seq") % 5 == 3
    events = rows.select((F.col("page_id") % 7).cast("string").alias("queue"), "seq", F.when(pop, "pop").otherwise("enqueue").alias("op"), F.when(~pop, F.col("target")).alias("url"), F.when(~pop, F.col("page_id") % 3).cast("int").alias("depth"))
    folder = shared_folder(spark, "queue-events")
    events.write.parquet(folder)
    return _streamed(queue_stream(spark.readStream.schema(events.schema).parquet(folder), 16), "queue")


def events_hourly(spark, sf):
    return windowed_events(read(spark, sf, "events")).withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


# -- relational rules --------------------------------------------------------


def constraint_violations(spark, sf):
    """Lines of documents as chunks: what breaks a condition when offsets and counts are off by what the number of the document says."""
    rows = documents(spark, sf).select(
        F.col("id").alias("doc_id"),
        (F.col("id") % 9 - 1).cast("int").alias("ordinal"),
        (F.col("id") % 10).alias("start_offset"),
        (F.col("id") % 13).alias("end_offset"),
        (F.length("text") - 100).alias("token_count"),
    )
    marked = constraints.with_violations(rows, constraints.checks("document_chunks"))
    return marked.where(F.size("violations") > 0).select("doc_id", F.array_join("violations", ",").alias("violations"))


def store_insert(spark, sf):
    """Chunks that are inserted where every third document's are there already: which are refused, and why. Rows are taken in order, the first of a key or hash."""
    docs = read(spark, sf, "documents").where("doc_id <> 0")
    rows = docs.select(
        F.col("doc_id").alias("at"),
        F.concat(F.lit("c"), F.floor(F.col("doc_id") / 4).cast("string")).alias("id"),
        F.when(F.col("doc_id") % 10 != 3, F.concat(F.lit("d"), F.col("doc_id") % 50)).alias("document_id"),
        (F.col("doc_id") % 7 - 1).cast("int").alias("ordinal"),
        F.lit(0).cast("bigint").alias("start_offset"),
        F.length("text").cast("bigint").alias("end_offset"),
        "text",
        F.sha2("text", 256).alias("text_sha256"),
        F.lit(1).alias("token_count"),
    )
    parents = spark.range(45).select(F.concat(F.lit("d"), F.col("id")).alias("id"))
    there = rows.where("at % 300 = 5").select("id", "text_sha256", "document_id", "ordinal")
    taken, refused = store.decided("document_chunks", rows, there, {"documents": parents}, order="at")
    marked = taken.withColumn("violations", F.array().cast("array<string>")).unionByName(refused)
    return marked.groupBy(F.array_join(F.array_sort("violations"), "; ").alias("violations")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def role_violations(spark, sf):
    rows = read(spark, sf, "conversations").withColumn("role", F.when(F.col("turn") % 4 == 3, "bot").otherwise(F.col("role")))
    bad = constraints.split(rows, constraints.checks("messages"))[1]
    return bad.groupBy("role").agg(F.count("*").alias("n"))


def unique_violations(spark, sf):
    rows = documents(spark, sf).withColumn("content_sha256", F.sha2("text", 256))
    return constraints.duplicates(rows, ["content_sha256"])


def fk_orphans(spark, sf):
    """Orders of customers who are in debt, as if those had gone."""
    return constraints.orphans(read(spark, sf, "orders"), "o_custkey", read(spark, sf, "customer").where("c_acctbal >= 0"), "c_custkey").select("o_orderkey", "o_custkey")


def fk_cascade(spark, sf):
    gone = read(spark, sf, "customer").where("c_acctbal < 0")
    return constraints.cascaded(read(spark, sf, "orders"), "o_custkey", gone, "c_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def fk_set_null(spark, sf):
    gone = read(spark, sf, "supplier").where("s_acctbal < 0")
    rows = constraints.set_null(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", gone, "s_suppkey")
    return rows.groupBy(F.col("l_suppkey").isNull().alias("orphaned")).agg(F.count("*").alias("n"))


def latest_fetch_per_source(spark, sf):
    return constraints.latest(read(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def conversation_messages(spark, sf):
    """Sessions with their messages: numbers of turns, characters by role, and the first user's message."""
    rows = read(spark, sf, "conversations")
    first = F.min(F.when(F.col("role") == "user", F.struct("turn", F.col("text").alias("said"))))
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sum(F.when(F.col("role") == "user", F.length("text")).otherwise(0)).cast("bigint").alias("user_chars"),
        F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)).cast("bigint").alias("assistant_chars"),
        first["said"].alias("first_said"),
    )


# Keywords of domains with weights.
KEYWORDS = (("insults", "idiot", 1.0), ("insults", "moron", 0.5), ("insults", "worthless", 2.0), ("licences", "licensed", 1.0), ("licences", "apache", 1.5), ("function-words", "the", 0.25), ("function-words", "und", 0.25))


def keyword_domain_match(spark, sf):
    """Weights of the keywords that documents hold, by domain."""
    table = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(k).alias("keyword"), F.lit(w).alias("weight")) for d, k, w in KEYWORDS])
    words = spark.range(1).select(F.explode(table).alias("k")).select("k.*")
    return rank.domains(documents(spark, sf), words).withColumnRenamed("id", "doc_id")


LAYOUTS = ((10, 4, 2, 2, 8), (32000, 4096, 32, 8, 11008), (0, 4, 2, 2, 8), (4294967295, 4294967295, 4294967295, 1, 1))


def model_layout(spark, sf):
    table = F.array(*[F.struct(*[F.lit(x).cast("bigint").alias(n) for n, x in zip(("vocab", "embed", "layers", "kv", "ffn"), row, strict=True)]) for row in LAYOUTS])
    rows = spark.range(1).select(F.explode(table).alias("m")).select("m.*")
    floats = ev.model_floats(*[F.col(c) for c in ("vocab", "embed", "layers", "kv", "ffn")])
    return rows.select("vocab", "embed", "layers", "kv", "ffn", floats.alias("floats"), ev.checked_multiply(floats, F.lit(4).cast("bigint")).alias("bytes"))


def model_sizes(spark, sf):
    """Sizes of models made of the numbers of parts: null where they do not fit."""
    rows = read(spark, sf, "part").select("p_partkey", *[(F.col(c) * n).cast("bigint").alias(a) for c, n, a in (("p_partkey", 1009, "vocab"), ("p_size", 12_345, "embed"), ("p_size", 1, "layers"), ("p_size", 256, "kv"), ("p_partkey", 1_000_003, "ffn"))])
    floats = ev.model_floats(*[F.col(c) for c in ("vocab", "embed", "layers", "kv", "ffn")])
    return rows.select("p_partkey", floats.alias("floats"), ev.checked_multiply(floats, F.lit(4).cast("bigint")).alias("bytes"))


def _library(spark, sf):
    """Documents as a store: their sources, chunks by every thousandth character, claims of every third chunk, keywords of both, evidence by label, edges between languages."""
    rows = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_id"), "lang", F.length("text").alias("size"))
    chunks = rows.select(F.col("id").alias("document_id"), "lang", F.explode(F.expr("sequence(0, size div 1000)")).alias("ordinal")).withColumn("id", F.concat_ws("/", "document_id", "ordinal"))
    claims = chunks.where(F.col("ordinal") % 3 == 0).select(F.concat(F.lit("c"), "id").alias("id"), F.col("id").alias("chunk_id"), "lang")
    labels = read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).select(F.col("doc_id").cast("string").alias("id"))
    evidence = labels.join(rows, "id").select(F.concat(F.lit("e"), "id").alias("id"), "source_id")
    edges = rows.select(F.col("id").cast("bigint").alias("id"), F.coalesce("lang", F.lit("none")).alias("source_node_id"), F.concat(F.lit("q"), F.col("id").cast("bigint") % 7).alias("target_node_id"), F.concat(F.lit("e"), "id").alias("evidence_id"))
    return {
        "sources": rows.select(F.col("source_id").alias("id")).where("id IS NOT NULL").distinct(), "documents": rows.select("id", "source_id"), "document_chunks": chunks.select("id", "document_id"),
        "chunk_keywords": chunks.where("lang IS NOT NULL").select(F.col("id").alias("chunk_id"), F.col("lang").alias("keyword")), "claims": claims.select("id", "chunk_id"),
        "claim_keywords": claims.select(F.col("id").alias("claim_id"), F.explode(F.array(F.lit("a"), F.coalesce("lang", F.lit("b")))).alias("keyword")), "evidence": evidence, "graph_edges": edges,
    }


def store_delete(spark, sf):
    """What a delete of some sources leaves of each table, of how many rows it takes, and how many references it sets to null; numbers: the sum of those in the keys."""
    tables = {t: rows.persist() for t, rows in _library(spark, sf).items()}
    keys = {t: store.key(t) for t in tables}
    gone = tables["sources"].where(F.ascii(F.substring("id", -1, 1)) % 3 == 1)
    dead = constraints.doomed(tables, store.REFERENCES, keys, "sources", gone)
    left = constraints.after_delete(tables, store.REFERENCES, keys, dead)
    out = []
    for t, rows in {**tables, **left}.items():
        nulls = F.count_if(F.col("evidence_id").isNull()) if "evidence_id" in rows.columns else F.lit(0).cast("bigint")
        numbers = F.coalesce(F.sum(F.nullif(F.regexp_extract(F.concat_ws(",", *keys[t]), "[0-9]+", 0), F.lit("")).cast("bigint")), F.lit(0))
        kept = rows.agg(F.count("*").alias("kept"), nulls.alias("nulls"), numbers.alias("numbers")).withColumn("table", F.lit(t))
        out.append(kept.withColumn("gone", dead[t].agg(F.count("*")).scalar() if t in dead else F.lit(0).cast("bigint")))
    return reduce(DataFrame.unionByName, out).select("table", "kept", "gone", "nulls", "numbers")


NAMES = (
    "tokenize_ascii tokenize_unicode term_freq doc_freq doc_length corpus_stats postings_binary bm25_native bm25_native_boost bm25_native_tombstone bm25_segmented "
    "bm25_repeat_terms bm25_binary search_results_join vector_cosine fts_phrase fts_prefix fts_boolean fts_near html_title html_text html_links page_extract "
    "url_canonical url_policy url_resolve link_frontier_dedup frontier_bounded frontier_depth_min crawl_closed_world fetch_filter robots_decision "
    "segment_documents segment_counts content_dedup chunk_hash_dedup graph_valid_edges graph_orphans graph_self_loops graph_runtime_edges graph_kind_counts graph_evidence_link crawl_events "
    "truth_classify single_source_flag evidence_valid source_usable source_reject_code telemetry_stats telemetry_by_name telemetry_jsonl events_hourly "
    "constraint_violations role_violations unique_violations fk_orphans fk_cascade fk_set_null latest_fetch_per_source conversation_messages "
    "keyword_domain_match model_layout index_first_wins bm25_first_wins bm25_parameters document_lookup document_count fts_column fts_rank fetch_limits "
    "crawl_documents crawl_depths crawl_capped url_resolve_sql segments_sql robots_pages frontier_pop graph_find graph_neighbours graph_runtime graph_runtime_capped "
    "store_insert store_delete model_sizes fts_cover_rank engine_searched telemetry_streamed queue_streamed graph_reach lateral_links lateral_segments"
)


def queries() -> dict:
    return {name: globals()[name] for name in NAMES.split()}


