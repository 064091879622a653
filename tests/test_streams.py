"""Queues and a changing index as streams, against Python."""

import random

from pyspark.sql import functions as F

from larkspur.operators import fts, graph, segmented
from larkspur.streaming import streams
from tests.conftest import rows


def queue_of_c(events, capacity):
    """A fixed array with a count: the first leaves, and the others move up."""
    items, out = [], []
    for seq, op, url, depth in events:
        if op == "pop":
            head = items[0] if items else None
            items = items[1:]
            out.append((seq, op, *(head or (None, None)), "ALLOW" if head else "EMPTY"))
        elif url is None or url == "":
            out.append((seq, op, url, depth, "INVALID_URL"))
        elif len(items) >= capacity:
            out.append((seq, op, url, depth, "FRONTIER_FULL"))
        elif len(url.encode()) >= 2048:
            out.append((seq, op, url, depth, "INVALID_URL"))
        elif any(u == url for u, _ in items):
            out.append((seq, op, url, depth, "DUPLICATE"))
        else:
            items.append((url, depth))
            out.append((seq, op, url, depth, "ALLOW"))
    return out


def test_queues_whose_enqueues_and_pops_interleave(spark, tmp_path):
    rng = random.Random(1)
    src, want, logs = f"file://{tmp_path}/in", [], []
    for queue in ("a", "b"):
        events = [(n, "pop", None, None) if rng.random() < 0.35 else (n, "enqueue", rng.choice(["", None, "é" * 1024, *[f"u{k}" for k in range(9)]]), rng.randrange(3)) for n in range(120)]
        want += [(queue, *e) for e in queue_of_c(events, 4)]
        logs.append([(queue, *e) for e in events])
    ddl = "queue string, seq long, op string, url string, depth int"
    for a in range(0, 120, 40):  # three batches, each with both queues out of order
        part = [e for log in logs for e in log[a : a + 40]]
        rng.shuffle(part)
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(src)
    # Files come by time of change; the batches' order is that in which they were written.
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src)
    q = streams.queue_stream(stream, 4).writeStream.format("memory").queryName("queue_test").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("queue_test")) == sorted(want, key=repr)
    assert {r[-1] for r in want} == {"ALLOW", "DUPLICATE", "EMPTY", "FRONTIER_FULL", "INVALID_URL"}


def test_changes_keep_an_index(spark, tmp_path):
    ddl = "seq long, op string, id long, url string, title string, text string"
    held = segmented.SegmentedIndex(spark, f"file://{tmp_path}/i")
    first = spark.createDataFrame([(1, "add", 1, "", "", "red fox"), (2, "add", 2, "", "", "red"), (3, "remove", 2, None, None, None), (4, "remove", 3, None, None, None), (5, "add", 3, "", "", "blue"), (6, "add", 1, "", "", "late")], ddl)
    second = spark.createDataFrame([(7, "add", 2, "", "", "back"), (8, "remove", 1, None, None, None), (9, "add", 4, "", "", "red red"), (10, "add", 5, "", "", None)], ddl)
    first.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = lambda: spark.readStream.schema(ddl).parquet(f"file://{tmp_path}/in")
    streams.changes_stream(stream(), held, f"{tmp_path}/cp").awaitTermination()
    active = lambda: rows(held.documents().select("id", "length", "active"))
    assert active() == [(1, 2, True), (2, 1, False), (3, 1, True)]
    streams.apply_changes(first, held, "changes", 0)  # the batch is tried again
    assert active() == [(1, 2, True), (2, 1, False), (3, 1, True)]
    second.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    streams.changes_stream(stream(), held, f"{tmp_path}/cp").awaitTermination()
    assert active() == [(1, 2, False), (2, 1, False), (3, 1, True), (4, 2, True)]
    assert held.manifest().n_docs == 4 and held.manifest().total_length == 3
    assert [r["id"] for r in held.search("red").hits.collect()] == [4]


def test_folding_follows_decompositions(spark):
    text = "ĝis Ǆeř ẵ Żółć été İstanbul ŒUVRE Ωώ x̧y ß"
    got = spark.range(1).select(fts.words(F.lit(text))).first()[0]
    assert got == ["gis", "ǆer", "a", "zołc", "ete", "istanbul", "œuvre", "ωώ", "xy", "ß"]
    df = spark.createDataFrame([(1, "Ĝis la revido"), (2, "gas"), (3, None)], "id long, text string")
    assert rows(fts.term(fts.positions(df, "id", only=["gis"]), "gis")) == [(1,)]
    assert rows(fts.positions(df, "id", only=["la"], prefixes=["rev", "g"])) == [(1, 0, 0, "gis"), (1, 0, 1, "la"), (1, 0, 2, "revido"), (2, 0, 0, "gas")]
    assert rows(fts.positions(df, "id")) == [(1, 0, 0, "gis"), (1, 0, 1, "la"), (1, 0, 2, "revido"), (2, 0, 0, "gas")]


def test_covers(spark):
    """Against all stretches of words, on few words so that covers overlap."""
    rng = random.Random(9)
    data = [(k, " ".join(rng.choices("abx", k=rng.randrange(4))) if k % 7 else None, " ".join(rng.choices("abcxy", k=rng.randrange(25)))) for k in range(60)]
    terms, weights, want = ["a", "b", "c", "a"], [1.0, 0.4], {}
    for k, title, text in data:
        ws = [(w, weights[0]) for w in (title or "").split()] + [(w, weights[1]) for w in text.split()]
        full = [(i, j) for i in range(len(ws)) for j in range(i, len(ws)) if {"a", "b", "c"} <= {w for w, _ in ws[i : j + 1]}]
        for i, j in full:
            if not any((x, y) != (i, j) and i <= x and y <= j for x, y in full):
                inside = [v for w, v in ws[i : j + 1] if w in "abc"]
                want[k] = want.get(k, 0.0) + len(inside) / sum(1 / v for v in inside) / (1 + j - i - (len(inside) - 1))
    df = spark.createDataFrame(data, "id long, title string, text string")
    got = {r["id"]: r["score"] for r in fts.cover_ranked(df, "id", ["title", "text"], terms, weights).collect()}
    assert set(got) == set(want) and len(want) > 20 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_reach(spark):
    """Against breadth-first search, with circles, and with a bound on the steps."""
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(60)) for _ in range(70)] + [(None, 1), (1, None), (3, 3)]
    for most in (0, 2, None):
        steps = {0: 0, 5: 0}
        front = [0, 5]
        while front and (most is None or max(steps.values()) < most or not steps):
            new = sorted({d for s, d in edges if s in front and d is not None and d not in steps})
            if not new:
                break
            at = max(steps[f] for f in front) + 1
            steps |= dict.fromkeys(new, at)
            front = new
        df = spark.createDataFrame(edges, "src long, dst long")
        assert rows(graph.reach(df, spark.createDataFrame([(0,), (5,), (5,), (None,)], "id long"), most)) == sorted(steps.items(), key=repr)
