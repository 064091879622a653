import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from larkspur.functions import evidence as ev
from larkspur.operators import constraints, frontier, fts, graph, index, rank
from larkspur.operators.lineage import Busy
from larkspur.sources import pages, store, telemetry
from larkspur.streaming import streams
from tests.conftest import rows

DOCS = [
    (1, "https://example.test/a", "Linux", "Linux kernel networking socket programming"),
    (2, "https://example.test/b", "Windows", "Windows networking sockets and programming"),
    (3, "https://example.test/c", "Math", "linear algebra and numerical methods"),
]


def docs(spark, data=DOCS):
    return spark.createDataFrame(data, "id long, url string, title string, text string")


def scored(df):
    return {r["id"]: round(r["score"], 6) for r in df.collect()}


def test_ascii_ranking(spark):
    built = index.build(docs(spark))
    assert scored(rank.search(built, "linux networking", boosts=True)) == {1: 1.700833, 2: 0.470004}
    assert scored(rank.search(built, "networking networking")) == {1: 0.940007, 2: 0.940007}
    gone = built.removed(spark.createDataFrame([(1,)], "id long"))
    assert scored(rank.search(gone, "linux networking", boosts=True)) == {2: 0.390192}
    assert scored(rank.search(gone, "linux")) == {}
    assert scored(rank.search(built, "linux networking", k=1)).keys() == {1}
    assert scored(rank.search(built, "")) == {} and scored(rank.search(built, "linux", k=0)) == {}


def test_unicode_ranking(spark):
    data = [(1, "", "", "systems programming"), (2, "", "", "systems programming"), (3, "", "", "unrelated topic")]
    built = index.build(docs(spark, data), "unicode")
    hits = rank.search(built, "systems systems", k=2).collect()
    assert [(r["id"], round(r["score"], 6)) for r in hits] == [(1, 0.470004), (2, 0.470004)]
    assert rank.parameters(math.nan, 2) == (1.2, 0.75) and rank.parameters(2, 0.5) == (2, 0.5)
    first = index.build(docs(spark, [(1, "", "", "C programming systems programming")]), "unicode")
    assert first.postings.count() == 3 and first.docs.first()["length"] == 4 and first.document(999).count() == 0


def test_accepted_and_stored(spark, tmp_path):
    data = [(0, "", "", "no"), (1, "", "", "alpha beta"), (1, "", "", "different text"), (2, "", "", None)]
    kept = index.accepted(docs(spark, data).withColumn("seq", F.monotonically_increasing_id()), order=F.col("seq"))
    assert [(r["id"], r["text"]) for r in kept.collect()] == [(1, "alpha beta")]
    # The first row of an id counts, whatever the partition; a first row without text or id is none.
    late = [(1, "", "", None), (1, "", "", "alpha beta"), (0, "", "", "no"), (2, "", "", "gamma"), (1, "", "", "beta beta"), (2, "", "", "delta"), (2, "", "", "delta")]
    numbered = spark.createDataFrame([(n, *r) for n, r in enumerate(late)], "seq long, id long, url string, title string, text string").repartition(5)
    for profile in index.PROFILES:
        built = index.build(numbered, profile, order=F.col("seq"))
        assert rows(built.postings.select("term", "id", "tf")) == [("alpha", 1, 1), ("beta", 1, 1), ("gamma", 2, 1)]
        assert built.stats().first()["n_docs"] == 2 and rows(built.document_frequency()) == [("alpha", 1), ("beta", 1), ("gamma", 1)]
        assert index.build(numbered, profile).docs.count() == 2
    built = index.build(docs(spark)).save(str(tmp_path / "index"))
    assert built.rows is None
    gone = built.removed(spark.createDataFrame([(1,)], "id long"))
    assert scored(rank.search(gone, "linux networking", boosts=True)) == {2: 0.390192}
    assert scored(rank.search(built, "linux networking", boosts=True)) == {1: 1.700833, 2: 0.470004}
    assert rows(rank.results(built, "linux", 5).select("id", "url")) == [(1, "https://example.test/a")]


def test_empty_index(spark):
    built = index.build(docs(spark).limit(0))
    assert rank.search(built, "linux").count() == 0
    assert built.stats().first()["n_docs"] == 0


def test_full_text(spark):
    at = fts.positions(docs(spark, [(1, "", "", "Zürich du nord"), (2, "", "", "nord du Zurich a b c d"), (3, "", "", "naïve café du")]), "id")
    ids = lambda d: [r["id"] for r in d.orderBy("id").collect()]
    assert ids(fts.term(at, "zurich")) == [1, 2]
    assert ids(fts.phrase(at, ["zurich", "du"])) == [1]
    assert ids(fts.phrase(at, ["du", "nord"])) == [1]
    assert ids(fts.prefix(at, "caf")) == [3]
    assert ids(fts.near(at, "nord", "zurich", 1)) == [1, 2]
    assert ids(fts.near(at, "nord", "d", 2)) == []
    assert ids(fts.near(at, "du", "du", 5)) == []
    met = F.col("x") & ~F.col("y")
    assert ids(fts.boolean(at, met, x="du", y="naive")) == [1, 2]
    two = fts.positions(docs(spark, [(1, "alpha", "beta", "gamma beta"), (2, "beta", "gamma beta", None)]), "id", ["url", "title", "text"])
    assert ids(fts.term(fts.within(two, 1), "beta")) == [1, 2] and ids(fts.term(fts.within(two, 0), "beta")) == [2]
    assert ids(fts.phrase(two, ["gamma", "beta"])) == [1, 2] and ids(fts.phrase(two, ["alpha", "beta"])) == []
    assert ids(fts.but_not(fts.any_of(fts.term(at, "du")), fts.term(at, "naive"))) == [1, 2]
    twice = fts.positions(docs(spark, [(1, "", "", "a a b"), (2, "", "", "a b a")]), "id")
    assert ids(fts.phrase(twice, ["a", "a"])) == [1]


def test_full_text_rank(spark):
    """Against the formula, place by place; words of one column do not run on into the next."""
    data = [(1, "", "red fox", "a red red fox"), (2, "", "blue", "red"), (3, "", None, "fox red fox"), (4, "", "x", ""), (5, "", "y", "z")]
    weights, phrases = [5.0, 1.0], [["red"], ["red", "fox"]]
    held = {i: [(t or "").split(), x.split()] for i, _, t, x in data}
    mean = sum(len(c) for cols in held.values() for c in cols) / len(held)

    def times(ws, p):
        return sum(ws[k : k + len(p)] == p for k in range(len(ws) - len(p) + 1))

    want = {}
    for p in phrases:
        n = sum(any(times(c, p) for c in cols) for cols in held.values())
        idf = max(1e-6, math.log((len(held) - n + 0.5) / (n + 0.5)))
        for i, cols in held.items():
            f = sum(w * times(c, p) for w, c in zip(weights, cols, strict=True))
            if any(times(c, q) for c in cols for q in phrases):
                want[i] = want.get(i, 0) - idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(map(len, cols)) / mean))
    got = {r["id"]: r["score"] for r in fts.ranked(docs(spark, data), "id", ["title", "text"], phrases, weights).collect()}
    assert set(got) == {1, 2, 3} and all(abs(got[i] - want[i]) < 1e-12 for i in got)
    assert fts.ranked(docs(spark, data).limit(0), "id", ["title", "text"], phrases).count() == 0


def test_before_of_numbers_close_together(spark):
    """Ranges follow the numbers: of many close ones and a far one no range holds most."""
    df = spark.range(0, 20_000).select(F.col("id").alias("seq"), F.lit(1).alias("v")).union(spark.createDataFrame([(1 << 60, 1)], "seq long, v int")).repartition(6)
    got = frontier.before(df, "seq", "v", "n", ranges=64)
    assert got.where("n <> least(seq, 20000)").count() == 0 and got.count() == 20_001
    assert frontier.before(df.limit(0), "seq", "v", "n").count() == 0


def test_frontier(spark):
    a = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "b", 1), (4, "", 0), (5, None, 0), (6, "x" * 2048, 0), (7, "c", 0), (8, "a", 0)], "seq long, url string, depth int")
    got = {r["seq"]: r["decision"] for r in frontier.decisions(a).collect()}
    assert got == {1: "ALLOW", 2: "DUPLICATE", 3: "ALLOW", 4: "INVALID_URL", 5: "INVALID_URL", 6: "INVALID_URL", 7: "ALLOW", 8: "DUPLICATE"}
    got = {r["seq"]: r["decision"] for r in frontier.decisions(a, capacity=2).collect()}
    assert got[6] == "FRONTIER_FULL" and got[7] == "FRONTIER_FULL" and got[2] == "DUPLICATE" and got[4] == "INVALID_URL"
    b = spark.createDataFrame([(1, "u", 2), (2, "u", 2), (3, "u", 1), (4, "u", 1), (5, "u", 0), (6, "v", 1)], "seq long, url string, depth int")
    assert sorted(r["seq"] for r in frontier.shallower(b).collect()) == [1, 3, 5, 6]


def test_crawl(spark):
    world = spark.createDataFrame(
        [("http://h/a", '<a href="/b">'), ("http://h/b", '<a href="/c"><a href="/a">'), ("http://h/c", '<a href="/d">'), ("http://h/x", "")], "url string, html string"
    )
    start = spark.createDataFrame([("http://H/a#f",)], "url string")
    got = {r["url"]: (r["depth"], r["fetched"]) for r in frontier.crawl(world, start, 2).collect()}
    assert got == {"http://h/a": (0, True), "http://h/b": (1, True), "http://h/c": (2, True)}


def test_graph(spark):
    nodes = spark.createDataFrame([(1, 1, "s"), (2, 3, "c"), (1, 2, "twice"), (0, 1, "none")], "id long, kind int, label string")
    edges = spark.createDataFrame([(10, 1, 2, 1, 1.0), (11, 1, 999, 1, 1.0), (10, 2, 1, 1, 1.0), (12, 2, 2, 9, math.inf), (0, 1, 2, 1, 1.0)], "id long, src long, dst long, kind int, weight double")
    assert sorted(r["id"] for r in graph.valid_edges(edges, nodes).collect()) == [10, 12]
    assert [r["id"] for r in graph.orphans(edges, nodes).collect()] == [11]
    assert sorted(r["id"] for r in graph.runtime_edges(edges, nodes).collect()) == [0, 10, 10]
    assert sorted(r["id"] for r in graph.first_wins(nodes).collect()) == [1, 2]
    assert rows(graph.neighbours(edges, spark.createDataFrame([(2,)], "id long"))) == [(1,), (2,)]
    run = spark.createDataFrame([(1, None, 8), (2, 1, 1), (3, 9, 1), (4, 1, 0), (5, 2, 8)], "seq long, parent_seq long, kind int")
    assert [(r["seq"], r["id"]) for r in graph.runtime_nodes(run, "seq").orderBy("id").collect()] == [(1, 1), (2, 2), (5, 3)]
    assert graph.runtime_nodes(run, "seq", capacity=1).count() == 1
    assert [r["id"] for r in graph.find(nodes, 2).collect()] == [2] and graph.find(nodes, 0).count() == 0 and graph.find(nodes, 77).count() == 0
    assert rows(graph.first_wins(nodes.withColumn("seq", F.monotonically_increasing_id()), order="seq").select("id", "label")) == [(1, "s"), (2, "c")]


def test_runtime_graph(spark):
    """Against adding one after another: refused parents refuse their children, ids come from one sequence, capacities end both."""
    import random

    rng = random.Random(4)
    for caps in ((None, None), (40, 30), (0, 5)):
        ops, kept, used, seq_of, n_nodes, n_edges, want, next_id = [], {}, set(), [], 0, 0, {}, 1
        for seq in range(300):
            if rng.random() < 0.5 or len(seq_of) < 3:
                parent = rng.choice([None, *seq_of[-12:], seq + 5]) if seq_of else None
                kind = rng.choice([0, 1, 2, 3, 8, 9])
                ops.append(("node", seq, parent, None, kind, 1.0))
                seq_of.append(seq)
                if 1 <= kind <= 8 and (parent is None or parent in kept) and (caps[0] is None or n_nodes < caps[0]):
                    kept[seq] = next_id
                    want["node", seq] = (next_id, kept.get(parent, 0) if parent is not None else 0)
                    next_id, n_nodes = next_id + 1, n_nodes + 1
            else:
                a, b, kind = rng.choice(seq_of), rng.choice([*seq_of, seq + 1]), rng.choice([0, 1, 6, 7])
                weight = rng.choice([1.0, -2.0, math.inf, math.nan])
                ops.append(("edge", seq, a, b, kind, weight))
                if a in kept and b in kept and a != b and 1 <= kind <= 6 and math.isfinite(weight) and (caps[1] is None or n_edges < caps[1]):
                    want["edge", seq] = (next_id, (kept[a], kept[b]))
                    next_id, n_edges = next_id + 1, n_edges + 1
        schema = "what string, seq long, a long, b long, kind int, weight double"
        df = spark.createDataFrame(ops, schema).repartition(3)
        nodes = df.where("what = 'node'").select("seq", F.col("a").alias("parent_seq"), "kind", F.repeat(F.lit("é"), 100).alias("label"))
        edges = df.where("what = 'edge'").select("seq", F.col("a").alias("src_seq"), F.col("b").alias("dst_seq"), "kind", "weight")
        n, e = graph.runtime_graph(nodes, edges, node_capacity=caps[0], edge_capacity=caps[1])
        got = {("node", r["seq"]): (r["id"], r["parent_id"]) for r in n.collect()} | {("edge", r["seq"]): (r["id"], (r["src"], r["dst"])) for r in e.collect()}
        assert got == want
    assert n.where("octet_length(label) > 129").count() == 0
    assert graph.since_clear(nodes, nodes.where("seq < 0")).count() == nodes.count()
    chain = spark.range(1, 200).select(F.col("id").alias("seq"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_seq"), F.when(F.col("id") == 150, 9).otherwise(1).alias("kind"))
    assert graph.runtime_nodes(chain, "seq").agg(F.max("seq")).first()[0] == 149


def test_truth_and_evidence(spark):
    cases = [(0, 5, "UNKNOWN"), (None, None, "UNKNOWN"), (1, 0, "INFERENCE"), (2, 0, "FACT"), (3, 1, "UNCERTAIN"), (2, 2, "CONFLICTED")]
    df = spark.createDataFrame(cases, "s int, c int, truth string")
    assert df.where(ev.truth_class(F.col("s"), F.col("c")) != F.col("truth")).count() == 0
    assert [r[0] for r in df.select(ev.single_source(F.col("s"))).collect()] == [1, 1, 1, 0, 0, 0]
    e = spark.createDataFrame([(0, "s", "c", True), (0, "", "c", False), (1, None, "c", True), (1, "s", "", False), (5, "s", "c", False), (None, "s", "c", False)], "kind int, source string, claim string, ok boolean")
    assert e.where(ev.evidence_valid(F.col("kind"), F.col("source"), F.col("claim")) != F.col("ok")).count() == 0
    s = spark.createDataFrame(
        [(1, "u", bytes(32), True, False, 0), (1, "u", None, True, True, 3), (1, "u", b"x" * 32, True, True, 0), (0, "u", b"x" * 32, True, False, 1), (1, None, None, True, False, 1), (1, "u", b"x" * 32, False, False, 2)],
        "kind int, uri string, hash binary, verified boolean, usable boolean, code int",
    )
    cols = [F.col(c) for c in ("kind", "uri", "hash", "verified")]
    assert s.where((ev.source_usable(*cols) != F.col("usable")) | (ev.source_reject_code(*cols) != F.col("code"))).count() == 0


def test_model_and_checked_arithmetic(spark):
    big = (1 << 63) - 1
    r = spark.range(1).select(
        ev.model_floats(*[F.lit(x) for x in (10, 4, 2, 2, 8)]).alias("f"), ev.checked_multiply(F.lit(4), F.lit(8)).alias("m"), ev.checked_add(F.lit(20), F.lit(12)).alias("a"),
        ev.checked_multiply(F.lit(big), F.lit(2).cast("bigint")).alias("mo"), ev.checked_add(F.lit(big), F.lit(1).cast("bigint")).alias("ao"),
    ).first()
    assert tuple(r) == (388, 32, 32, None, None)
    assert spark.range(1).select(ev.evidence_kind_name(F.lit(4)), ev.evidence_kind_name(F.lit(77)), ev.truth_class_name(F.lit(2))).first()[:] == ("conflicted", "unknown", "UNCERTAIN")


EVENTS = [("search", 7, 10, 3, False), ("fetch_error", 12, 0, 0, True), ("", 1, 1, 1, False), (None, 1, 1, 1, True)]


def test_telemetry(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, telemetry.SCHEMA)
    assert telemetry.stats(events).first()[:] == (2, 1, 10, 3)
    assert telemetry.stats(events.limit(0)).first()[:] == (0, 0, 0, 0)
    out = str(tmp_path / "log")
    telemetry.write_lines(events, out, 1, 2)
    telemetry.write_lines(events, str(tmp_path / "off"), 1, 2, enabled=False)
    assert not (tmp_path / "off").exists()
    lines = [json.loads(r["value"]) for r in spark.read.text(out).collect()]
    assert sorted(x["type"] for x in lines) == ["event", "event", "start", "stop"]
    assert list(next(x for x in lines if x["type"] == "event")) == ["type", "name", "duration_ms", "bytes_in", "bytes_out", "error"]
    q = streams.telemetry_stream(spark, out).writeStream.format("memory").queryName("telemetry_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("telemetry_test")) == [("fetch_error", 1, 1, 0, 0), ("search", 1, 0, 10, 3)]


def test_a_log_is_written_whole_or_not_at_all(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, telemetry.SCHEMA).repartition(3)
    broken = events.withColumn("duration_ms", F.when(F.col("name") == "search", F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("duration_ms")))
    with pytest.raises(Exception, match="broken"):
        telemetry.write_lines(broken, str(tmp_path / "log"), 1, 2)
    assert not [p for p in (tmp_path / "log").rglob("part-*") if "_temporary" not in str(p)]
    telemetry.write_lines(events, str(tmp_path / "log"), 1, 2)
    files = sorted(p.name for p in (tmp_path / "log").glob("part-*"))
    text = "".join((tmp_path / "log" / f).read_text() for f in files).splitlines()
    assert "start" in text[0] and "stop" in text[-1] and len(text) == 4


def test_one_writer_at_a_time(spark):
    spark.sql("DROP DATABASE IF EXISTS store_busy CASCADE")
    store.create(spark, "store_busy")
    new = spark.createDataFrame([("s", "en")], "id string, language string").withColumn("created_at", F.current_timestamp())
    with store.writing(spark, "store_busy"):
        assert store.status(spark, "store_busy") == "BUSY"
        with pytest.raises(Busy):
            store.insert(spark, "store_busy", "sessions", new, busy_ms=200)
        with pytest.raises(Busy):
            store.delete(spark, "store_busy", "sessions", new.select("id"), busy_ms=0)
    assert spark.table("store_busy.sessions").count() == 0 and store.status(spark, "store_busy") == "OK"
    assert store.insert(spark, "store_busy", "sessions", new).count() == 0 and spark.table("store_busy.sessions").count() == 1
    with pytest.raises(ZeroDivisionError), store.writing(spark, "store_busy"):
        1 / 0  # noqa: B018  a writer that fails leaves the store free
    at, fs = store._lock(spark, "store_busy")
    fs.create(at, False).close()  # one that died does not
    assert store.status(spark, "store_busy") == "BUSY" and store.unlock(spark, "store_busy") and not store.unlock(spark, "store_busy")
    spark.sql("DROP DATABASE store_busy CASCADE")


def test_json_escapes(spark):
    name = 'a"b\\c\b\f\n\r\t\x01é'
    df = spark.createDataFrame([(name, 1, 1, 1, False)], telemetry.SCHEMA)
    assert json.loads(df.select(telemetry.line().alias("x")).first()["x"])["name"] == name


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    docs(spark).coalesce(1).write.parquet(src)
    docs(spark, [(4, "", "", "linux again"), (0, "", "", "never")]).coalesce(1).write.mode("append").parquet(src)
    out = str(tmp_path / "index")
    stream = spark.readStream.schema("id long, url string, title string, text string").option("maxFilesPerTrigger", 1).parquet(src)
    streams.index_stream(stream, out, "ascii", str(tmp_path / "cp")).awaitTermination()
    built = index.load(spark, out, "ascii")
    assert built.docs.count() == 4
    assert set(scored(rank.search(built, "linux"))) == {1, 4}
    # A row whose id an earlier batch has is left out; statistics are sums of batches.
    docs(spark, [(1, "", "", "linux linux linux"), (5, "", "", "fifth linux")]).coalesce(1).write.mode("append").parquet(src)
    again = spark.readStream.schema("id long, url string, title string, text string").option("maxFilesPerTrigger", 1).parquet(src)
    streams.index_stream(again, out, "ascii", str(tmp_path / "cp")).awaitTermination()
    built = index.load(spark, out, "ascii")
    assert sorted(r["id"] for r in built.docs.collect()) == [1, 2, 3, 4, 5] and rows(built.postings.where("term = 'linux'").select("id", "tf")) == [(1, 1), (4, 1), (5, 1)]
    assert rows(streams.stream_stats(spark, out).select("n_docs", "total_length")) == rows(built.stats().select("n_docs", "total_length"))
    assert rows(streams.stream_document_frequency(spark, out)) == rows(built.document_frequency())
    urls = spark.readStream.schema("id long, url string, title string, text string").parquet(src)
    q = streams.new_urls(urls).writeStream.format("memory").queryName("urls_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("urls_test").count() == 3


def test_windows_and_sessions(spark):
    e = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-01 00:10:00', 'a', 1.0D, 1), (TIMESTAMP_NTZ'2024-01-01 00:20:00', 'a', 2.0D, 1), (TIMESTAMP_NTZ'2024-01-01 02:00:00', 'a', 4.0D, 1) t(ts, event_type, value, user_id)")
    assert sorted(r["n"] for r in streams.windowed_events(e).collect()) == [1, 2]
    assert sorted(r["n"] for r in streams.sessions(e).collect()) == [1, 2]
    assert streams.windowed_events(e, slide="30 minutes").count() == 4


def test_constraints(spark):
    rows_ = spark.createDataFrame([(0, 0, 5, 1), (-1, 3, 2, 0), (None, 0, 0, -1)], "ordinal int, start_offset int, end_offset int, token_count int")
    marked = constraints.with_violations(rows_, constraints.checks("document_chunks"))
    assert [r["violations"] for r in marked.collect()] == [[], ["ordinal", "end_offset"], ["token_count"]]
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "k long, ref long")
    assert rows(constraints.orphans(child, "ref", parents, "id")) == [(2, 3)]
    gone = parents.where("id = 1")
    assert rows(constraints.cascaded(child, "ref", gone, "id")) == [(2, 3), (3, None)]
    assert rows(constraints.set_null(child, "ref", gone, "id")) == [(1, None), (2, 3), (3, None)]
    assert rows(constraints.duplicates(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], "k int, v string"), ["k"])) == [(1, 2)]
    assert rows(constraints.latest(spark.createDataFrame([(1, 1), (1, 5), (2, 3)], "s int, t int"), "s", ["t"])) == [(1, 5), (2, 3)]


def test_store(spark, tmp_path):
    spark.sql("DROP DATABASE IF EXISTS store_test CASCADE")
    store.create(spark, "store_test")
    store.create(spark, "store_test")
    assert spark.sql("SHOW TABLES IN store_test").where("NOT isTemporary").count() == len(store.tables())
    data = [("a", "http://x/", "web", "h"), ("b", "http://y/", "spoken", "h"), ("c", None, "web", "h"), ("d", "http://z/", "web", "h"), ("d", "http://z/2", "web", "h")]
    new = spark.createDataFrame(data, "id string, canonical_uri string, source_kind string, content_sha256 string")
    for column in ("title", "media_type", "language"):
        new = new.withColumn(column, F.lit(None).cast("string"))
    new = new.withColumns({"retrieved_at": F.lit(None).cast("timestamp"), "trust_tier": F.lit(2)})
    assert store.status(spark, "store_test") == "OK" and store.status(spark, "") == "INVALID" and store.status(spark, "store_none") == "IO"
    assert sorted(r["version"] for r in spark.table("store_test.schema_version").collect()) == [1, 2]
    refused = store.insert(spark, "store_test", "sources", new.coalesce(1))
    assert sorted((r["id"], tuple(r["violations"])) for r in refused.collect()) == [("b", ("source_kind",)), ("c", ("canonical_uri not null",)), ("d", ("key",))]
    assert rows(spark.table("store_test.sources").select("id", "canonical_uri")) == [("a", "http://x/"), ("d", "http://z/")]  # the first of a key
    again = store.insert(spark, "store_test", "sources", new.where("id = 'a'"))
    assert [r["violations"] for r in again.collect()] == [["key"]] and spark.table("store_test.sources").count() == 2
    # What is referred to must be there; numbers go on; what is left out has its default.
    session = spark.createDataFrame([("s", "en")], "id string, language string").withColumn("created_at", F.current_timestamp())
    assert store.insert(spark, "store_test", "sessions", session).count() == 0
    said = spark.createDataFrame([("s", "user", "hi"), ("t", "user", "lost"), ("s", "bot", "no"), ("s", "system", "ok")], "session_id string, role string, content string").withColumn("created_at", F.current_timestamp())
    refused = store.insert(spark, "store_test", "messages", said.coalesce(1))
    assert sorted((r["content"], r["violations"]) for r in refused.collect()) == [("lost", ["session_id references sessions.id"]), ("no", ["role"])]
    assert sorted((r["content"], r["id"]) for r in spark.table("store_test.messages").collect()) == [("hi", 1), ("ok", 4)]
    node = spark.createDataFrame([("n", "k", "l")], "id string, kind string, label string")
    assert store.insert(spark, "store_test", "graph_nodes", node).count() == 0 and spark.table("store_test.graph_nodes").first()["properties_json"] == "{}"
    for child, (parent, _) in store.REFERENCES.items():
        t, _, c = child.partition(".")
        p, _, k = parent.partition(".")
        assert c in store.ddl(t) and k in store.ddl(p)
    spark.sql("DROP DATABASE store_test CASCADE")


def brute_delete(tables, references, table, gone):
    """Deleting one row after another, following references: what is left."""
    left = {t: dict(rows_) for t, rows_ in tables.items()}
    todo = [(table, k) for k in gone if k in left[table]]
    while todo:
        t, k = todo.pop()
        if left[t].pop(k, None) is None:
            continue
        for child, (parent, action) in references.items():
            (of, _, column), (above, _, _) = child.partition("."), parent.partition(".")
            for key_, row in list(left[of].items()) if above == t else ():
                if row[column] == k and action == "cascade":
                    todo.append((of, key_))
                elif row[column] == k:
                    row[column] = None
    return left


@pytest.mark.parametrize("seed", range(4))
def test_deletes_cascade(spark, seed):
    """Over several tables, one that refers to itself and two that refer to each other."""
    rng = random.Random(seed)
    references = {"b.a": ("a.id", "cascade"), "c.b": ("b.id", "cascade"), "a.up": ("a.id", "cascade"), "c.d": ("d.id", "set null"), "d.c": ("c.id", "cascade"), "b.d": ("d.id", "cascade"), "d.a": ("a.id", "set null")}
    columns = {"a": ["up"], "b": ["a", "d"], "c": ["b", "d"], "d": ["c", "a"]}
    tables = {t: {k: {c: rng.choice([None, *range(40)]) if rng.random() < 0.5 else None for c in cs} for k in range(40)} for t, cs in columns.items()}
    frames = {t: spark.createDataFrame([(k, *[r[c] for c in columns[t]]) for k, r in rows_.items()], "id long, " + ", ".join(f"{c} long" for c in columns[t])) for t, rows_ in tables.items()}
    gone = [1, 2, 3, 99]
    keys = {t: ["id"] for t in tables}
    dead = constraints.doomed(frames, references, keys, "a", spark.createDataFrame([(g,) for g in [*gone, 1]], "id long"))
    left = constraints.after_delete(frames, references, keys, dead)
    want = brute_delete({t: {k: dict(r) for k, r in rows_.items()} for t, rows_ in tables.items()}, references, "a", gone)
    for t in tables:
        got = {r["id"]: {c: r[c] for c in columns[t]} for r in left.get(t, frames[t]).collect()}
        assert got == want[t], t
        assert {r["id"] for r in dead[t].collect()} == set(tables[t]) - set(want[t]) if t in dead else len(want[t]) == 40
    assert constraints.doomed(frames, references, keys, "a", spark.createDataFrame([(99,)], "id long")) == {}


def test_store_deletes(spark):
    spark.sql("DROP DATABASE IF EXISTS store_deletes CASCADE")
    store.create(spark, "store_deletes")

    def put(table, data):
        rows_ = spark.createDataFrame(data)
        for f in store.fields(table):
            if f.name not in rows_.columns:
                rows_ = rows_.withColumn(f.name, F.expr(f.default) if f.default else F.lit("0").cast(f.kind) if f.required and f.kind != "timestamp" else F.current_timestamp() if f.required else F.lit(None).cast(f.kind))
        rows_.select(*[F.col(f.name).cast(f.kind) for f in store.fields(table)]).write.mode("append").insertInto(f"store_deletes.{table}")

    put("sources", [{"id": "s1"}, {"id": "s2"}])
    put("documents", [{"id": "d1", "source_id": "s1"}, {"id": "d2", "source_id": "s2"}])
    put("document_chunks", [{"id": "k1", "document_id": "d1"}, {"id": "k2", "document_id": "d2"}])
    put("claims", [{"id": "c1", "chunk_id": "k1"}, {"id": "c2", "chunk_id": "k2"}])
    put("claim_keywords", [{"claim_id": c, "keyword": w} for c in ("c1", "c2") for w in "xy"])
    put("evidence", [{"id": "e1", "source_id": "s1"}, {"id": "e2", "source_id": "s2"}])
    put("graph_edges", [{"id": 1, "evidence_id": "e1"}, {"id": 2, "evidence_id": "e2"}])
    dead = store.delete(spark, "store_deletes", "sources", spark.createDataFrame([("s1",), ("none",)], "id string"))
    assert {t: rows(r) for t, r in dead.items()} == {"sources": [("s1",)], "documents": [("d1",)], "document_chunks": [("k1",)], "claims": [("c1",)], "claim_keywords": [("c1", "x"), ("c1", "y")], "evidence": [("e1",)]}
    left = lambda t, *c: rows(spark.table(f"store_deletes.{t}").select(*c))
    assert left("sources", "id") == [("s2",)] and left("claim_keywords", "claim_id", "keyword") == [("c2", "x"), ("c2", "y")]
    assert left("graph_edges", "id", "evidence_id") == [(1, None), (2, "e2")]
    assert store.delete(spark, "store_deletes", "sources", spark.createDataFrame([("s1",)], "id string")) == {}
    order = constraints.parents_last(store.REFERENCES, store.tables())
    assert all(order.index(c.partition(".")[0]) < order.index(p.partition(".")[0]) for c, (p, _) in store.REFERENCES.items())
    spark.sql("DROP DATABASE store_deletes CASCADE")


@pytest.mark.parametrize("in_order", [1 << 17, 0, 40])
def test_store_takes_the_first_of_every_unique_value(spark, monkeypatch, in_order):
    """Against inserting one after another, several unique values of a row at once: in one task, in rounds, in both."""
    import random

    if in_order:
        monkeypatch.setattr(store, "IN_ORDER", in_order)
    else:  # rounds alone, however little they settle
        monkeypatch.setattr(store, "IN_ORDER", 0)
        monkeypatch.setattr(store, "LITTLE", 1)

    rng = random.Random(8)
    data = [(n, f"c{rng.randrange(60)}", f"d{rng.randrange(6)}" if rng.random() < 0.9 else None, rng.randrange(-1, 30), f"h{rng.randrange(80)}") for n in range(160)]
    there = {("c1", "h1", "d1", 1), ("c2", "h2", "d2", 2)}
    keys, hashes, places = ({x[0] for x in there}, {x[1] for x in there}, {x[2:] for x in there})
    want = set()
    for n, c, d, o, h in data:
        if d is None or d == "d5" or o < 0 or c in keys or h in hashes or (d, o) in places:
            continue
        want.add(n)
        keys.add(c), hashes.add(h), places.add((d, o))
    rows_ = spark.createDataFrame(data, "at long, id string, document_id string, ordinal int, text_sha256 string").repartition(4)
    rows_ = rows_.withColumns({"start_offset": F.col("at"), "end_offset": F.col("at"), "text": F.lit("t"), "token_count": F.lit(1)})
    old = spark.createDataFrame(list(there), "id string, text_sha256 string, document_id string, ordinal int")
    taken, refused = store.decided("document_chunks", rows_, old, {"documents": spark.createDataFrame([(f"d{i}",) for i in range(5)], "id string")}, order="at")
    assert {r["start_offset"] for r in taken.collect()} == want
    assert refused.count() == len(data) - len(want) and refused.where("size(violations) = 0").count() == 0


def test_a_chain_of_rows_is_decided_in_blocks(spark, monkeypatch):
    """Each row shares a value with the next: every second one is taken, without a round for each."""
    monkeypatch.setattr(store, "IN_ORDER", 150)
    chain = spark.range(400).select(F.col("id").alias("at"), F.expr("concat('c', (id + 1) div 2)").alias("id"), F.expr("concat('h', id div 2)").alias("text_sha256"))
    rows_ = chain.select("*", F.lit("d0").alias("document_id"), F.col("at").cast("int").alias("ordinal"), F.col("at").alias("start_offset"), F.col("at").alias("end_offset"), F.lit("t").alias("text"), F.lit(1).alias("token_count"))
    old = spark.createDataFrame([], "id string, text_sha256 string, document_id string, ordinal int")
    cuts = []
    monkeypatch.setattr(store, "cut", lambda df, real=store.cut: (cuts.append(1), real(df))[1])
    taken, refused = store.decided("document_chunks", rows_.repartition(4), old, {"documents": spark.createDataFrame([("d0",)], "id string")}, order="at")
    assert sorted(r["start_offset"] for r in taken.collect()) == list(range(0, 400, 2)) and refused.count() == 200
    assert len(cuts) < 20  # 200 rounds otherwise


def test_store_insert_query_is_one_after_another(spark, sf):
    """The registered query against Python over the same table."""
    from larkspur.plans import catalogue

    docs_ = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id <> 0").collect())
    chunk = [(i, f"c{i // 4}", f"d{i % 50}" if i % 10 != 3 else None, i % 7 - 1, t) for i, t in docs_]
    keys, texts, places = (set(), set(), set())
    for i, c, d, o, t in chunk:
        if i % 300 == 5:
            keys.add(c), texts.add(t), places.add((d, o))
    n = 0
    for _, c, d, o, t in chunk:
        if d is not None and int(d[1:]) < 45 and o >= 0 and c not in keys and t not in texts and (d, o) not in places:
            n += 1
            keys.add(c), texts.add(t), places.add((d, o))
    got = {r["violations"]: r["n"] for r in catalogue.store_insert(spark, sf).collect()}
    assert got[""] == n and sum(got.values()) == len(chunk)


def test_jdbc(spark):
    """Through the database that comes with Spark, in memory."""
    url, driver = "jdbc:derby:memory:larkspur;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    store.write_jdbc(spark.range(100).select("id", (F.col("id") * 2).alias("twice")), url, "numbers", driver=driver)
    got = store.jdbc(spark, url, "numbers", "id", (0, 100), 4, driver=driver)
    assert got.count() == 100 and got.agg(F.sum("twice")).first()[0] == 9900 and got.rdd.getNumPartitions() == 4


def test_http(spark, tmp_path):
    """A server on this machine: body limit, time limits, status, no redirects; as a function and as a format of Spark's."""
    import http.server
    import threading
    import time

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802  the name is the library's
            seen.append((self.headers["Host"], time.monotonic()))
            if self.path == "/slow":
                self.send_response(200)
                self.end_headers()
                for _ in range(40):
                    self.wfile.write(b"x")
                    self.wfile.flush()
                    time.sleep(0.05)
                return
            code = {"/moved": 301, "/gone": 404}.get(self.path, 200)
            body = b"y" * (5000 if self.path == "/big" else 10)
            self.send_response(code)
            if code == 301:
                self.send_header("Location", "/ok")
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("0.0.0.0", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.2:{server.server_port}"
        urls = spark.createDataFrame([(base + p,) for p in ("/ok?q=1", "/moved", "/gone", "/big", "/slow")] + [("http://localhost/",)], "url string")
        got = {r["url"].removeprefix(base): r for r in pages.http_pages(urls, "test", pages.FetchLimits(connect_ms=500, total_ms=600, body_bytes=1000)).collect()}
        assert got["/ok?q=1"]["status"] == 200 and got["/ok?q=1"]["body"] == "y" * 10 and "Content-Type: text/html" in got["/ok?q=1"]["headers"]
        assert got["/moved"]["status"] == 301 and got["/gone"]["status"] == 404
        assert "over the limit" in got["/big"]["error"] and got["/big"]["body"] is None
        assert re.search("limit|timed out", got["/slow"]["error"]) and got["/slow"]["duration_ms"] < 1500
        assert got["http://localhost/"]["error"] == "URL not allowed"
        assert got["/ok?q=1"]["effective_url"] == base + "/ok?q=1"
        seen.clear()
        hosts = [f"127.0.0.{k}:{server.server_port}" for k in (2, 3)]
        polite = spark.createDataFrame([(f"http://{h}/{k}",) for h in hosts for k in range(4)] + [("http://localhost/",), (None,)], "url string").repartition(5)
        assert sum(r["status"] == 200 for r in pages.http_pages(polite, "test", delay_ms=150).collect()) == 8
        for h in hosts:
            at = sorted(t for host, t in seen if host == h)
            assert len(at) == 4 and all(b - a > 0.1 for a, b in zip(at, at[1:], strict=False))
        # The same by format, from a queue on disk.
        pages.register(spark)
        queue = f"file://{tmp_path}/queue"
        pages.enqueue(urls, queue, 3, by_host=False)
        pages.enqueue(urls.limit(0), queue, 3)
        read = spark.read.format("live_pages").option("userAgent", "test").option("connectMs", 500).option("totalMs", 600).option("bodyBytes", 1000)
        table = read.load(queue)
        assert table.rdd.getNumPartitions() >= 3 and table.columns == pages.http_pages(urls, "test").columns
        same = {r["url"].removeprefix(base): r for r in table.collect()}
        assert same.keys() == got.keys()
        for url, r in got.items():
            one, two = (x.asDict() | {"duration_ms": 0, "headers": "" if "Date" in x["headers"] else x["headers"]} for x in (r, same[url]))
            assert one == two or url == "/slow"
        assert re.search("limit|timed out", same["/slow"]["error"])
        pages.enqueue(polite, f"{tmp_path}/polite", 2)
        seen.clear()
        assert read.option("delayMs", 150).load(f"{tmp_path}/polite").where("status = 200").count() == 8
        for h in hosts:
            at = sorted(t for host, t in seen if host == h)
            assert len(at) == 4 and all(b - a > 0.1 for a, b in zip(at, at[1:], strict=False))
        (tmp_path / "none").mkdir()
        assert read.load(f"{tmp_path}/none").count() == 0
        with pytest.raises(Exception, match="userAgent"):
            spark.read.format("live_pages").load(queue).collect()
        start = time.monotonic_ns()
        assert telemetry.elapsed_ms(start + 10**12) == 0 and telemetry.elapsed_ms(start) >= 0 and telemetry.now_ms() > 1_700_000_000_000
    finally:
        server.shutdown()


def test_registries(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"schemaVersion": 1, "sources": [{"id": "a", "url": "https://x/", "kind": "k", "authority": "X", "primary": False, "notes": "n"}]}))
    (tmp_path / "d.json").write_text(json.dumps({"schemaVersion": 1, "domains": [{"id": "d", "nameEn": "D", "nameAr": "د", "keywords": ["x", "x", "y"]}]}, indent=1))
    assert rows(store.source_registry(spark, str(tmp_path / "s.json"))) == [("a", "https://x/", "k", "X", False, "n")]
    assert rows(store.domain_keywords(spark, str(tmp_path / "d.json"))) == [("d", "D", "د", "x"), ("d", "D", "د", "y")]


def test_fetched(spark):
    data = [("http://a/", 200, "Content-Type: text/html\r\n", "x"), ("http://a/", 301, "", "x"), ("http://a/", 200, "", ""), ("http://localhost/", 200, "", "x"), ("http://a/", 299, "", "y" * 10)]
    got = pages.fetched(spark.createDataFrame(data, "url string, status int, headers string, body string"), pages.FetchLimits(body_bytes=5))
    assert [(r["status"], r["content_type"]) for r in got.collect()] == [(200, "text/html")]
    with pytest.raises(ValueError):
        pages.fetched(got, pages.FetchLimits(body_bytes=0))
    bad = pages.http_pages(spark.createDataFrame([("http://127.0.0.1:9/",)], "url string"), "test")
    assert bad.first()["error"] == "URL not allowed"


def test_inserts_store_whole_rows_once(spark, monkeypatch):
    """What the steps of an insert store is keys and unique values: of the columns of contents one copy is made."""
    chain = spark.range(40).select(F.col("id").alias("at"), F.expr("concat('c', (id + 1) div 2)").alias("id"), F.expr("concat('h', id div 2)").alias("text_sha256"))
    rows_ = chain.select("*", F.lit("d0").alias("document_id"), F.col("at").cast("int").alias("ordinal"), F.col("at").alias("start_offset"), F.col("at").alias("end_offset"), F.lit("t").alias("text"), F.lit(1).alias("token_count"))
    old = spark.createDataFrame([], "id string, text_sha256 string, document_id string, ordinal int")
    held = []
    monkeypatch.setattr(store, "cut", lambda df, real=store.cut: (held.append(df.columns), real(df))[1])
    taken, refused = store.decided("document_chunks", rows_, old, {"documents": spark.createDataFrame([("d0",)], "id string")}, order="at")
    assert sum("text" in x for x in held) == 1 and sum("start_offset" in x for x in held) == 1
    want = [f.name for f in store.fields("document_chunks")]
    assert taken.columns == want and refused.columns == [*want, "violations"] and (taken.count(), refused.count()) == (20, 20)
    assert {tuple(r["violations"]) for r in refused.collect()} <= {("key",), ("unique text_sha256",), ("key", "unique text_sha256")} and taken.where("text = 't'").count() == 20
