"""The operators for training data against brute force, and on odd input: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import base64
import collections
import gzip
import hashlib
import io
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from larkspur.llm import decontam, jaccard, langid, lm, mixing, quality, queries, tokens, topk, toxicity, warc
from larkspur.llm.common import commonest, fold, scratch, stored
from tests.conftest import rows
from tests.test_queries import same


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    same(spark, sf, queries.queries()[name], queries.oracle_sql()[name])


def test_fold(spark):
    got = spark.range(50).select("id", fold(F.col("id"), 7).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in got)


# -- top-k -------------------------------------------------------------------


def brute_topk(data, k):
    best = {}
    for i, v in data:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(64 * x) for x in v]
            best[i] = max(best.get(i, w), w)
    out = []
    for q in sorted(best):
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(best[q], best[c], strict=True)), c) for c in best if c != q and len(best[c]) == len(best[q]))[:k]
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shape", ["unit", "lengths", "ties", "large"])
def test_topk(spark, shape):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 8))
    if shape == "unit":
        v /= np.linalg.norm(v, axis=1)[:, None]
    elif shape == "lengths":
        v *= rng.lognormal(0, 2, size=(400, 1))
    elif shape == "ties":
        v = np.repeat(v[:4], 100, axis=0)
    else:
        v *= 1e7
    data = [(i, [float(x) for x in v[i]]) for i in range(400)]
    data += [(1000, None), (1020, [float("nan")] * 8), (1040, [None] + [1.0] * 7), (None, [1.0] * 8), (1060, [1.0, 2.0]), (1061, [3.0, 4.0]), (40, data[40][1]), (1080, [0.0] * 8)]
    df = spark.createDataFrame([(i, x, 1) for i, x in data], "vec_id long, e array<double>, len int")
    got = topk.top_k(df, "vec_id", "e", F.col("id") % 20 == 0, k=5, bucket_rows=32, query_rows=8)
    assert rows(got) == brute_topk(data, 5)
    assert topk.top_k(df.limit(0), "vec_id", "e", F.col("id") % 20 == 0).count() == 0


def test_topk_of_falling_lengths(spark):
    """Many rows of the grid of unlike need: the answer is whole though short buckets are sent to few of them."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(4000, 6)) * (0.999 ** np.arange(4000))[:, None] * 10
    data = [(i, [float(x) for x in v[i]]) for i in range(4000)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    out = topk.top_k(df, "vec_id", "embedding", F.col("id") % 20 == 0, k=5, bucket_rows=64, query_rows=16)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_topk(data, 5)


def test_products_of_any_size():
    rng = np.random.default_rng(2)
    for size in (1 << 10, 1 << 28, 1 << 33, 1 << 62):
        a, b = rng.integers(-size, size, (4, 3)), rng.integers(-size, size, (5, 3))
        want = [[max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for q in b] for p in a]
        assert topk.products(a, b).tolist() == want


def test_topk_prunes():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1, 16)) * 60
    near = np.floor(base + rng.normal(size=(20, 16))).astype(np.int64)
    far = np.floor(rng.normal(size=(500, 16)) * 60).astype(np.int64)
    q, ids = near[:1], np.arange(500)
    bound = np.sort(topk.products(q, near)[0])[-10:-9]
    *_, spared = topk.search_bucket(np.array([-1]), q, bound, ids, far, 10)
    assert spared > 300


# -- WARC --------------------------------------------------------------------


def test_warc(spark, tmp_path):
    tricky = "a\r\n\r\nWARC/1.1\r\n\r\nb"
    data = [(1, "http://WWW.b.org/x", "same"), (5, "http://b.org/x", "same"), (2, "http://a.org:8080/", None), (3, None, ""), (4, "http://c.org/ü p\r\n", tricky), (6, "u", "é" * 100_000), (None, "x", "y")]
    df = spark.createDataFrame([(*x, "extra") for x in data], "page_id long, url string, html string, sha string")
    path = str(tmp_path / "warc")
    got = {r["page_id"]: r for r in warc.archive(df, records_per_file=2, path=path).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    for i, _, html in data:
        raw = (html or "").encode()
        assert got[i]["payload_bytes"] == len(raw)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {i: (got[i]["record_type"], got[i]["refers_to"]) for i in (1, 2, 3, 5)} == {1: ("revisit", 5), 2: ("revisit", 3), 3: ("response", None), 5: ("response", None)}
    files = list((tmp_path / "warc").glob("*/*.gz"))
    payloads = {}
    for f in files:
        for _, _, head, payload in warc.records(gzip.decompress(f.read_bytes())):
            if head[b"WARC-Type"] == b"response":
                payloads[warc._page(head[b"WARC-Record-ID"])] = bytes(payload).decode()
                told = head[b"WARC-Payload-Digest"].decode()
                assert told == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert payloads == {5: "same", 3: "", 4: tricky, 6: "é" * 100_000, None: "y"}
    order = [(r["urlkey"], r["ts"], r["page_id"] is not None, r["page_id"] or 0) for r in sorted(got.values(), key=lambda r: (r["merge_range"], r["merge_seq"]))]
    assert order == sorted(order)
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_pages_without_id(spark):
    """They refer to a page that has the payload and an id; without one each is a response of its own. Their order is total."""
    data = [(None, "http://a/", "x"), (7, "http://a/", "x"), (None, "http://b/", "only"), (None, "http://b/", "only"), (3, "http://a/", "x"), (None, None, None)]
    out = warc.archive(spark.createDataFrame(data, "page_id long, url string, html string"))
    got = sorted(((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in out.collect()), key=repr)
    assert got == sorted([(None, "http://a/", "revisit", 7), (7, "http://a/", "response", None), (3, "http://a/", "revisit", 7), (None, "", "response", None)] + [(None, "http://b/", "response", None)] * 2, key=repr)


def test_warc_files_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    """Large payloads have files of their own, however many small ones there are; ranges follow the number of captures."""
    monkeypatch.setattr(warc, "CLASSES", ((100, 50), (10_000, 3), (1 << 62, 1)))
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    data = [(i, f"http://h{i % 7}/{i}", "s" * (i % 90)) for i in range(200)] + [(1000 + i, "http://m/", f"{i}" * 3000) for i in range(7)] + [(2000 + i, "http://l/", f"{i}" * 40_000) for i in range(2)]
    got = warc.archive(spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1), path=str(tmp_path / "w"))
    assert got.count() == 209 and got.select("merge_range").distinct().count() > 3
    assert [len(list((tmp_path / "w" / f"class={i}").glob("*.gz"))) for i in range(3)] == [4, 3, 2]
    one = warc.records(io.BytesIO(b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w" / "class=1").glob("*.gz")))))
    assert sum(1 for _ in one) == 7


def test_loser_tree():
    rng = random.Random(1)
    for k in range(0, 9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(30))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_warc_refuses_broken():
    with pytest.raises(ValueError):
        list(warc.records(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab"))


# -- near duplicates ---------------------------------------------------------


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_groups(data):
    sets = [shingles(t) for _, t in data]
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    low = collections.defaultdict(list)
    for i, (d, _) in enumerate(data):
        if d is not None:
            low[root(i)].append(d)
    return sorted(((d, len(sets[i]), min(low[root(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(data)), key=repr)


def edited(words, n, rng):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
    return " ".join(w)


def test_jaccard(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for group in range(12):
        base = rng.choices(vocabulary, k=rng.choice([6, 20, 120, 400]))
        texts += [edited(base, rng.randrange(0, 1 + len(base) // 40), rng) for _ in range(rng.choice([1, 2, 12]))]
        texts.append(" ".join(base) + " " + passage)
    hot = rng.choices(vocabulary, k=150)
    texts += [edited(hot, rng.randrange(0, 4), rng) for _ in range(150)] + [" ".join(hot)] * 40
    texts += [None, "", " \t\n", "one two", "ONE  two", "one two three", "a b c d e", "A b c d e", "x " * 40_000, "x " * 39_990, "é É", "É É"]
    data = list(enumerate(texts)) + [(3, texts[40]), (None, texts[0]), (None, "nobody is like this one at all")]
    df = spark.createDataFrame([(i, t, 0, "c") for i, t in data], "doc_id long, text string, n int, cid string").repartition(5)
    got = jaccard.similar_groups(df).select("doc_id", "n_shingles", "component_id")
    assert rows(got) == brute_groups(data)
    assert jaccard.similar_groups(df.limit(0)).count() == 0
    assert jaccard.similar_groups(df.where("doc_id = 0")).first()["component_id"] == 0


def test_jaccard_parted_tiles(spark, monkeypatch):
    """Tiles of frequent n-grams in many parts give the same groups."""
    monkeypatch.setattr(jaccard, "PART_ROWS", 7)
    rng = random.Random(9)
    a = [f"a{i}" for i in range(80)]
    data = list(enumerate([edited(a, rng.randrange(0, 3), rng) for _ in range(120)] + [edited(a, 9, rng) for _ in range(20)]))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(jaccard.similar_groups(df).select("doc_id", "n_shingles", "component_id")) == brute_groups(data)


def test_no_cell_holds_a_large_tile(spark):
    """A tile of 20,000 rows, almost all of them in components of their own: cells of about two parts, and all pairs of different components meet just once."""
    n = 20_000
    tile = spark.range(n).select(F.col("id").alias("cid"), F.lit(7).cast("long").alias("tile"), F.when(F.col("id") < 2, -1).otherwise(F.col("id")).alias("label"), F.lit(0).alias("part"))
    dealt = jaccard.cells(tile)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("home") == -1).alias("mains")).cache()
    assert sizes.agg(F.max("n")).first()[0] <= 2.3 * jaccard.PART_ROWS and sizes.agg(F.sum("n")).first()[0] <= n * (n / jaccard.PART_ROWS + 3)
    few = jaccard.cells(tile.where("cid < 1500").withColumn("label", F.when(F.col("cid") % 3 == 0, -1).otherwise(F.col("cid"))))
    a, b = (few.select(F.col("part"), F.col("home").alias(f"home{x}"), F.col("cross"), F.col("cid").alias(x), F.col("label").alias(f"label{x}")) for x in "ab")
    met = a.join(b, ["part", "cross"]).where("a < b AND labela <> labelb AND NOT (cross AND homea = homeb)").groupBy("a", "b").count()
    assert met.where("count > 1").count() == 0 and met.count() == 1500 * 1499 // 2 - 500 * 499 // 2


def test_two_sides_of_a_cell():
    """Only rows of opposite homes are held against each other, whichever side is larger."""
    rng = np.random.default_rng(3)
    for mains in (1, 5, 30):
        n = 40
        size = np.sort(rng.integers(20, 26, size=n)).astype(np.int64)
        home = np.where(rng.permutation(n) < mains, -1, -2)
        bits = [b"\0" * 64] * n
        i, j = jaccard.tile_pairs(np.zeros(n, np.int64), size, np.zeros(n, np.int64), np.arange(n), np.arange(n), home, np.ones(n, bool), bits, lambda x: frozenset(), 80, 100, True)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted((x, y) for x in range(n) for y in range(x) if home[x] != home[y] and 100 * size[y] >= 80 * size[x])


def test_bitmaps_bound():
    rng = np.random.default_rng(2)
    for n, m in ((10, 10), (300, 350), (3000, 2500)):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 1 << 63, m).astype(np.uint64)]))
        differ = len(np.setxor1d(x, y))
        assert jaccard.differing(jaccard.bitmap(x, jaccard.wide_bits(n)), jaccard.bitmap(y, jaccard.wide_bits(m))) <= differ
        assert jaccard.overlap(x, y) == len(np.intersect1d(x, y))


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    links = [(a, b) for a, b in links if a != b]
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    parent = {x: x for e in links for x in e}
    for _ in range(200):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


# -- rows that repeat, and maps, in the mixture --------------------------------


def test_mix_spreads_rows_without_id_and_repeated_ids(spark, monkeypatch):
    """A third of the rows has no id and a third one id: no window holds more than a part of them, and the places are gapless."""
    monkeypatch.setattr(mixing, "HEAVY", 100)
    data = spark.range(6000).select(F.when(F.col("id") % 3 == 1, 5).when(F.col("id") % 3 == 2, F.col("id")).alias("doc_id"), F.lit("x").alias("source"), F.create_map(F.lit("k"), F.col("id")).alias("m"), F.col("id").alias("part"), F.lit(1).alias("range"))
    out = mixing.mix(data, {"*": 1}, block=4)
    assert out.columns[:5] == data.columns
    assert sorted(r["mix_position"] for r in out.collect()) == list(range(6000))
    first = {r["part"]: r["mix_position"] for r in out.collect()}
    assert first == {r["part"]: r["mix_position"] for r in mixing.mix(data.repartition(7), {"*": 1}, block=4).collect()}
    nulls = [first[k] for k in range(0, 6000, 3)]
    assert max(nulls) - min(nulls) > 5000  # not in one range


# -- decontamination ---------------------------------------------------------


def test_templates_are_counted_in_blocks(monkeypatch):
    """Items of one template share almost all q-grams: in blocks of a few thousand the passages are the same."""
    rng = random.Random(6)
    items = [(k, f"the answer to question number {rng.randrange(10**6)} of this long list of questions is {rng.randrange(10**9)}") for k in range(120)]
    texts = [" ".join(t for _, t in items[k : k + 20]).upper() + " and nothing else" for k in range(0, 60, 20)] + ["the answer to question " * 40, items[77][1].replace("long", "lng"), "aaaa" * 300]
    items += [(500, "a" * 90), (501, "short")]
    index = decontam.Index(items)
    whole = index.matches([decontam.plain(t) for t in texts])
    assert {(t, i) for t, i, *_ in whole} >= {(t, k) for t in range(3) for k in range(20 * t, 20 * t + 20)} | {(4, 77)}
    held = []
    shared = decontam.Grams.shared
    monkeypatch.setattr(decontam.Grams, "shared", lambda self, *a: held.append(len((out := shared(self, *a))[0])) or out)
    monkeypatch.setattr(decontam, "MOST_SHARED", 3000)
    assert index.matches([decontam.plain(t) for t in texts]) == whole
    assert len(held) > 50 and max(held) <= 3000 + 2 * max(int(g.count.max()) for g in index.grams)


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute_leaks(docs, items):
    """A tenth of an item's characters, rounded down, may differ; items under 8 characters stand between blanks or ends."""
    want = set()
    for d, t in docs:
        text = " ".join((t or "").lower().split())
        for i, item in items:
            item = " ".join((item or "").lower().split())
            if i is None or not item:
                continue
            hit = f" {item} " in f" {text} " if len(item) < 8 else brute_distance(item, text) <= len(item) // 10
            if hit:
                want.add((d, i))
    return want


def test_decontamination_of_short_items_and_scripts(spark):
    """Budgets count characters, whatever their bytes, and short items have their whole budget."""
    rng = random.Random(12)
    alphabet = "абвгдежзиклмнопрстуфхцчшщ"
    sizes = [1, 3, 5, 7, 8, 9, 10, 12, 15, 16, 19, 20, 22, 23, 24, 29, 30, 31, 33, 39, 40, 64]
    items = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz" if i % 2 else alphabet, k=n))) for i, n in enumerate(sizes)]
    docs = []
    for i, (_, item) in enumerate(items):
        for edits in range(len(item) // 10 + 2):
            chars = list(item)
            for at in rng.sample(range(len(chars)), min(edits, len(chars))):
                kind = rng.randrange(3)
                chars[at] = "!" if kind == 0 else "" if kind == 1 else chars[at] + "!"
            fill = " ".join("".join(rng.choices("0123456789", k=6)) for _ in range(4))
            docs += [(len(docs), f"{fill} {''.join(chars)} {fill}"), (len(docs) + 1, fill + "".join(chars) + fill)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == brute_leaks(docs, items) and len(found) > 80


def test_decontamination_keeps_apart_passages():
    """Of overlapping passages the best stays, of those that lie apart all, however many."""
    index = decontam.Index([(1, "abcdefghij klmnopqrst"), (2, "aaaaaaaaaaaaaaaaaaaa")])
    text = ("abcdefghij klmnopqrst " * 300).strip() + " " + "a" * 200
    got = index.matches([text, "", text])
    for t in (0, 2):
        assert [(e, a, b) for u, i, e, a, b in got if (u, i) == (t, 0)] == [(0, 22 * k, 22 * k + 21) for k in range(300)]
        spans = sorted((a, b) for u, i, _, a, b in got if (u, i) == (t, 1))
        assert len(spans) >= 9 and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_op3_decontam_is_brute_force(spark, sf):
    """The query over the given table: where a document holds an item, its passage is as near as told; no whole copy is missed."""
    docs = dict((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    items = dict((r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    found = decontam.op3_decontam(spark, sf).collect()
    assert found
    for r in found:
        item, text = decontam.plain(items[r["item_id"]]), decontam.plain(docs[r["doc_id"]])
        assert brute_distance(item, text[max(0, r["start"] - 5) : r["end"] + 5]) <= r["edits"] <= len(item) // 10
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert {(d, i) for d, t in docs.items() for i, item in items.items() if decontam.plain(item) in decontam.plain(t)} <= pairs


def test_decontamination(spark):
    rng = random.Random(3)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]

    def prose(n):
        return " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(n))

    items = [(i, prose(rng.randrange(8, 40))) for i in range(12)] + [(100, None), (None, "null id here and there"), (101, "short"), (102, "")]
    docs = []
    for i in range(60):
        t = prose(60)
        if i % 3 == 0:
            item = items[i % 12][1]
            chars = list(item.upper() if i % 2 else item)
            for _ in range(i % 7 * len(item) // 40):
                chars[rng.randrange(len(chars))] = rng.choice("xyz")
            t = t[:100] + "\n" + "".join(chars) + "  \t" + t[100:]
        docs.append((i, t))
    docs += [(60, None), (61, ""), (62, items[0][1]), (62, items[0][1]), (None, items[1][1])]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, edits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench).collect()}
    want = brute_leaks(docs, items)
    assert found == want and len(want) > 15
    kept = decontam.without_leaks(df, bench)
    assert kept.columns == df.columns
    leaked = {d for d, _ in want}
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect() if r["doc_id"] is not None) == sorted((False, d) for d, _ in docs if d is not None and d not in leaked)
    assert decontam.find_leaks(df.limit(0), bench).count() == 0 and decontam.find_leaks(df, bench.limit(0)).count() == 0


def test_decontamination_parts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PART_BYTES", 200)
    items = [(i, f"item number {i} " + "".join(chr(97 + (i * j) % 26) for j in range(60))) for i in range(20)]
    docs = spark.createDataFrame([(i, "before " + t + " after") for i, t in items], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(i, i) for i in range(20)} <= got


# -- classifiers -------------------------------------------------------------

BAD_WORDS = ["gronk", "blarf", "snivelwort"]


def toxic_texts(n, rng):
    words = ["".join(rng.choices(["ba", "lo", "mi", "ne", "ta", "ru"], k=rng.randrange(1, 4))) for _ in range(200)]
    out = []
    for i in range(n):
        t = rng.choices(words, k=rng.randrange(5, 120))
        if i % 5 == 0:
            for _ in range(1 + len(t) // 40):
                t[rng.randrange(len(t))] = rng.choice(BAD_WORDS)
        out.append((" ".join(t), int(i % 5 == 0)))
    return out


def test_toxicity(spark):
    rng = random.Random(5)
    model = toxicity.train(toxic_texts(900, rng))
    held = toxic_texts(300, rng)
    score = model.scorer()
    p = score([t for t, _ in held])
    assert np.mean((p >= toxicity.THRESHOLD) == np.array([y for _, y in held])) > 0.95
    misspelt, clean = score(["ba lo mi snivellwort ne ta", "ba lo mi bamilota ne ta"])
    assert misspelt > clean
    long = "ba lo mi ne " * 20_000
    assert score([long + "gronk " + long])[0] > score([long])[0]
    df = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "gronk blarf", 0.5), (3, "gronk blarf", 0.5)], "doc_id long, text string, toxic_score double")
    got = toxicity.score_toxicity(df, model)
    assert got.columns == ["doc_id", "text", "toxic_score"] and got.count() == 4
    assert all(0 <= r["toxic_score"] <= 1 for r in got.collect())
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0
    for sample in ([], [("a", 1)], [("", 0), ("", 1)]):
        assert 0 <= toxicity.train(sample).scorer()(["x", None])[0] <= 1


def test_toxicity_matches_definition():
    rng = random.Random(6)
    model = toxicity.train(toxic_texts(60, rng), averaged=3, steps=6)
    text = " ".join(rng.choices(["ba", "gronk", "é", "lo"], k=31))
    words = toxicity.words_of(text)

    def vector(w):
        bucket, _ = toxicity.subwords([w])
        return model.embed[bucket].mean(0)

    starts = list(range(0, max(1, len(words) - toxicity.WINDOW + 1), toxicity.STEP)) + [max(0, len(words) - toxicity.WINDOW)]
    best = 0.0
    for s in starts:
        z = np.mean([vector(w) for w in words[s : s + toxicity.WINDOW]], axis=0) @ model.out + model.bias
        best = max(best, float((np.exp(z) / np.exp(z).sum())[1]))
    assert abs(model.scorer()([text])[0] - best) < 1e-9


def test_language(spark):
    rng = random.Random(8)
    speak = {"aa": ["tha", "the", "ing"], "bb": ["ção", "lhe", "não"], "cc": ["ски", "ого", "при"]}
    texts = [(" ".join("".join(rng.choices(s, k=2)) for _ in range(40)).encode(), lang) for lang, s in speak.items() for _ in range(80)]
    net = langid.train(texts[::2] + texts[1::4])
    best, p = net.predict([t for t, _ in texts])
    assert np.mean([net.languages[b] == lang for b, (_, lang) in zip(best, texts, strict=True)]) > 0.97
    assert ((p >= 0) & (p <= 1)).all()
    df = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "12 !?", "q"), (4, "ingthe thaing " * 5000, "q"), (5, "é", "q")], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: r for r in langid.identify(df, net).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und", "und", "und", "aa"] and got[5]["lang_pred"] in speak
    assert got[1]["lang_score"] == 0 and langid.identify(df.limit(0), net).count() == 0
    none = langid.train([])
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.train([(b"abc", "x")]).predict([b"abc"])[1][0] == 1.0


def test_language_windows_cover():
    x, owner, size = langid.windows([b"a" * 300, b"", b"b" * 128, b"c" * 129])
    assert owner.tolist() == [0, 0, 0, 1, 2, 3, 3]
    assert size.tolist() == [128, 128, 52, 1, 128, 128, 5]
    assert (x[0] == ord("a")).all() and x[2, 52:].sum() == 0


def test_language_letters():
    assert not any(map(langid.has_letter, ["", "12 !?", "²", "½ 3", "Ⅷ", "٣", "_", "\u0301"]))
    assert all(map(langid.has_letter, ["é", "1x", "ª", "中", "ʰ", "½a"]))


def test_language_network_is_brute_force():
    """Convolution, maxima and softmax window by window, and gradients against differences."""
    net = langid.Network(["a", "b", "c"], seed=3)
    rng = np.random.default_rng(4)
    net.shift[:] = rng.normal(0, 0.1, len(net.shift))
    x = rng.integers(0, 256, (3, langid.SPAN)).astype(np.uint8)
    x[2, 60:] = 0

    def logits(one):
        e = net.table[np.concatenate([one, np.zeros(max(langid.WIDTHS) - 1, np.uint8)])].astype(np.float64)
        pooled = [max(float((e[i : i + w].ravel() * net.kernels[w][:, f]).sum()) for i in range(langid.SPAN)) for w in langid.WIDTHS for f in range(langid.FILTERS)]
        return np.maximum(0, np.array(pooled) + net.shift) @ net.out + net.bias

    want = np.array([np.exp(z - z.max()) / np.exp(z - z.max()).sum() for z in map(logits, x)])
    assert np.abs(net.probabilities(x) - want).max() < 1e-4
    for a in ("table", "shift", "out", "bias"):
        setattr(net, a, getattr(net, a).astype(np.float64))
    net.kernels = {w: k.astype(np.float64) for w, k in net.kernels.items()}
    wide = net._wide
    net._wide = lambda: np.concatenate([np.pad(net.kernels[w], ((0, (max(langid.WIDTHS) - w) * langid.EMBED), (0, 0))) for w in langid.WIDTHS], axis=1)
    assert np.abs(wide() - net._wide()).max() < 1e-6
    y, weight = np.array([0, 2, 1]), np.array([1.0, 0.5, 2.0])

    def loss():
        h = np.maximum(0, net.pooled(x) + net.shift)
        return float((-np.log(langid.softmax(h @ net.out + net.bias)[np.arange(3), y]) * weight).mean())

    for p, g in zip([net.table, *net.kernels.values(), net.shift, net.out, net.bias], langid.gradients(net, x, y, weight), strict=True):
        for k in rng.choice(p.size, min(p.size, 25), replace=False):
            at, d = np.unravel_index(k, p.shape), 1e-6
            kept = p[at]
            p[at] = kept + d
            up = loss()
            p[at] = kept - d
            down = loss()
            p[at] = kept
            assert abs((up - down) / (2 * d) - g[at]) < 1e-5


def test_language_sample(spark):
    data = [(i, "x" if i % 3 else "y", f"text {i}") for i in range(300)] + [(None, "x", "t"), (1000, None, "t"), (1001, "x", None)]
    df = spark.createDataFrame(data, "doc_id long, lang string, text string")
    sample = langid.language_sample(df, fold(F.col("doc_id"), 3) != 1, most=20)
    assert collections.Counter(lang for _, lang in sample) == {"x": 20, "y": 20}
    assert sample == langid.language_sample(df.repartition(7), fold(F.col("doc_id"), 3) != 1, most=20)


def test_language_sample_reads_whole_texts_and_all_languages(spark):
    """Places lie all over the text, not at its beginning, and a language beyond any round number has its share."""
    long = "".join(chr(97 + i) * 400 for i in range(20))
    df = spark.createDataFrame([(i, "l", long) for i in range(40)], "doc_id long, lang string, text string")
    sample = langid.language_sample(df, F.lit(True))
    assert len(sample) == 160 and len({w[:1] for w, _ in sample}) > 12
    many = spark.createDataFrame([(i, f"l{i % 300}", f"one {i % 300} two") for i in range(900)], "doc_id long, lang string, text string")
    assert len(langid.train(langid.language_sample(many, F.lit(True)), steps=1).languages) == 300


def lines_of(n, rng):
    out = []
    for i in range(n):
        good = [" ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(12)).capitalize() + "." for _ in range(rng.randrange(1, 9))]
        bad = [" ".join("".join(rng.choices("ABCDEFGH", k=5)) + "!!" for _ in range(12)) for _ in range(rng.randrange(1, 9))]
        out.append(("\n".join(good), 1) if i % 3 else ("\n".join(good[:1] + bad), 0))
    return out


def test_quality(spark):
    rng = random.Random(2)
    field = quality.train(lines_of(300, rng))
    held = lines_of(200, rng)
    p = field([t for t, _ in held])
    assert np.mean((p >= 0.5) == np.array([y for _, y in held])) > 0.95
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n\n"), (4, "A good line.\n" * 30_000), (5, "é" * 10)], "doc_id long, text string")
    got = {r["doc_id"]: r["quality_score"] for r in quality.score_quality(df, field).collect()}
    assert got[1] == got[2] and all(0 <= x <= 1 for x in got.values()) and len(got) == 5
    assert quality.score_quality(df.limit(0), field).count() == 0
    for sample in ([], [("a", 1)]):
        assert 0 <= quality.train(sample)(["x"])[0] <= 1


def test_emissions_are_those_of_the_wide_matrix():
    rng = np.random.default_rng(6)
    lines = np.array([1, 4, 1, 2, 9])
    own, theta = rng.normal(size=(lines.sum(), 5)), rng.normal(size=(16, 2))
    assert np.allclose(quality.emissions(own, theta, lines), quality.with_neighbours(own, lines) @ theta)


def test_quality_of_very_many_lines():
    field = quality.train(lines_of(60, random.Random(3)))
    short = "Abc def gh ab cd ef gh.\n" * 50
    got = field([short, short * 4000, None])  # 200,000 lines
    assert all(0 <= x <= 1 for x in got) and abs(got[0] - got[1]) < 0.2


def test_forward_backward():
    rng = np.random.default_rng(1)
    lines = np.array([1, 4, 2])
    emit, trans = rng.normal(size=(7, 2)), rng.normal(size=(2, 2))
    marginal, pair, log_z = quality.forward_backward(emit, trans, lines)
    at, pairs = 0, np.zeros((2, 2))
    for n, z in zip(lines, log_z, strict=True):
        weight = {}
        for path in np.ndindex(*[2] * n):
            weight[path] = math.exp(sum(emit[at + i, s] for i, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
        total = sum(weight.values())
        assert abs(math.log(total) - z) < 1e-9
        for i in range(n):
            assert abs(sum(w for p, w in weight.items() if p[i] == 1) / total - marginal[at + i, 1]) < 1e-9
        for p, w in weight.items():
            for a, b in zip(p, p[1:], strict=False):
                pairs[a, b] += w / total
        at += n
    assert np.allclose(pairs, pair)


# -- mixing ------------------------------------------------------------------


def test_schedule(spark):
    for parts in ({"a": 1}, {"a": 3, "b": 2, "*": 2}, {"a": 50, "b": 1, "c": 1, "d": 1, "e": 1, "*": 46}, {f"s{i}": 1 + i for i in range(12)}):
        got = mixing.schedule(spark, parts).orderBy("slot").collect()
        period = sum(parts.values())
        assert [r["slot"] for r in got] == list(range(period))
        had = collections.Counter()
        for r in got:
            assert r["release"] <= r["slot"] < r["deadline"]
            had[r["component"]] += 1
            for name, c in parts.items():
                assert abs(had[name] - c * (r["slot"] + 1) / period) < 1
        assert had == parts
    for bad in ({"a": 0}, {"a": -1}, {"a": 1.5}, {"a": 5000}):
        with pytest.raises(ValueError):
            mixing.checked(bad)


def test_mix(spark):
    data = [(i, "a" if i % 2 else ("b" if i % 3 else None), "t") for i in range(500)] + [(7, "a", "again"), (None, "b", "t"), (None, None, None)]
    df = spark.createDataFrame(data, "doc_id long, source string, slot string")
    got = mixing.mix(df, {"a": 1, "b": 2, "*": 1}, block=4)
    out = got.collect()
    assert len(out) == len(data) and got.columns[:3] == df.columns
    places = [r["mix_position"] for r in out]
    assert len(set(places)) == len(places)
    full = sorted((r["mix_position"], r["mix_component"]) for r in out if r["mix_full"])
    assert [p for p, _ in full] == list(range(len(full))) and len(full) > 200
    for n in range(4, len(full), 4):
        had = collections.Counter(c for _, c in full[:n])
        for name, share in (("a", 0.25), ("b", 0.5), ("*", 0.25)):
            assert abs(had[name] / 4 - share * n / 4) < 1
    again = mixing.mix(df.repartition(9), {"a": 1, "b": 2, "*": 1}, block=4)
    key = lambda d: rows(d.select("doc_id", "source", "mix_slot", "mix_full"))
    assert key(got) == key(again)
    assert mixing.mix(df.limit(0), {"a": 1}).count() == 0
    left = mixing.mix(df, {"a": 1}).where("mix_component = '*'")
    assert left.where("mix_slot IS NOT NULL").count() == 0 and left.count() > 0


# -- token counts ------------------------------------------------------------


def test_mix_keeps_clashing_columns_and_settles_ties(spark):
    """Columns of any name come back as they were; rows that share an id have one order on every layout."""
    names = "doc_id source row component key id tie range nth number before count turn share slot c b _before _slot _parts _key _nth _range _turn _share _number x.y".split()
    rng = random.Random(3)
    data = [(i // 3, rng.choice(["a", "b", None]), *[rng.randrange(5) for _ in names[2:]]) for i in range(400)]
    df = spark.createDataFrame(data, ", ".join(f"`{n}` {'string' if n == 'source' else 'long'}" for n in names))
    parts = {"a": 2, "b": 1, "*": 1}
    got = mixing.mix(df, parts, block=4)
    assert got.columns == [*names, "mix_component", "mix_block", "mix_slot", "mix_position", "mix_full"]
    once = rows(got)
    assert collections.Counter(r[: len(names)] for r in once) == collections.Counter(data)
    assert rows(mixing.mix(df.repartition(7), parts, block=4)) == once == rows(mixing.mix(df.orderBy(F.rand(1)), parts, block=4))
    places = [r[-2] for r in once]
    assert len(set(places)) == len(places) == 400
    many = {f"s{i}": 1 for i in range(200)}
    assert mixing.mix(df, many).where("mix_position IS NOT NULL").count() == 0


def test_rollup(spark):
    versions = {"words-1": tokens.words}
    make = lambda data: tokens.counted(spark.createDataFrame(data, "source string, lang string, text string"), versions)
    r = tokens.Rollup(spark, scratch(spark, "rollup-test"))
    assert r.totals().count() == 0
    assert r.commit("one", make([("a", "en", "x y z"), ("a", "en", "x y z"), ("b", None, ""), (None, "fr", None)]))
    assert not r.commit("one", make([("a", "en", "never")]))
    assert rows(r.totals()) == [("a", "en", "words-1", 2, 6, 10), ("b", None, "words-1", 1, 0, 0), (None, "fr", "words-1", 1, 0, 0)]
    before = spark.createDataFrame([("a", "en", "x y z")], "source string, lang string, text string")
    after = spark.createDataFrame([("a", "de", "x y")], "source string, lang string, text string")
    assert r.commit("two", tokens.revision(before, after, versions))
    want = [("a", "de", "words-1", 1, 2, 3), ("a", "en", "words-1", 1, 3, 5), ("b", None, "words-1", 1, 0, 0), (None, "fr", "words-1", 1, 0, 0)]
    assert rows(r.totals()) == want
    r.fold("f1")
    assert r.committed() == ["fold-f1"] and rows(r.totals()) == want
    assert not r.commit("two", make([("a", "en", "never")])) and rows(r.totals()) == want
    assert r.commit("three", tokens.counted(before, versions, -1))
    assert ("a", "en", "words-1", 1, 3, 5) not in rows(r.totals())
    r.fold("f2")
    assert r.committed() == ["fold-f2"]
    with pytest.raises(ValueError):
        r.commit("a/b", make([]))


def test_rollup_survives_crashes(spark):
    versions = {"words-1": tokens.words}
    r = tokens.Rollup(spark, scratch(spark, "rollup-crash"))
    change = tokens.counted(spark.createDataFrame([("a", "en", "x y")], "source string, lang string, text string"), versions)
    tokens.summed(change).write.parquet(f"{r.path}/batch-x/sums")
    path, fs = r._hadoop("batch-x/sums/_SUCCESS")
    fs.delete(path, False)  # as a job that died before it committed leaves it
    assert r.totals().count() == 0
    assert r.commit("x", change) and rows(r.totals()) == [("a", "en", "words-1", 1, 2, 3)]
    spark.createDataFrame([("batch-x",)], "batch string").write.parquet(f"{r.path}/fold-half/of")
    assert rows(r.totals()) == [("a", "en", "words-1", 1, 2, 3)]


def test_op6_token_counts_is_brute_force(spark, sf):
    """The query against counting, in Python, the documents that are left."""
    counters = {name: make() for name, make in tokens.tokenizers().items()}
    want = collections.defaultdict(lambda: [0, 0, 0])
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n, text, lang = r["doc_id"] or 0, r["text"] or "", r["lang"]
        if n % 10 == 3 and n % 100 != 13 or n % 100 == 7:
            continue
        if n % 10 == 7:
            text, lang = f"revised: {text} again {text}", None
        for name, count in counters.items():
            total = want[r["source"], lang, name]
            for k, x in enumerate((1, count(text), len(text.encode()))):
                total[k] += x
    assert rows(tokens.op6_token_counts(spark, sf)) == sorted(((*k, *v) for k, v in want.items()), key=repr)


def test_byte_bpe():
    toy = b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)) + b"\n" + base64.b64encode(b"ab") + b" 256\n"
    count = tokens.byte_bpe(toy)()
    assert count("") == 0 and count("abab") == 2 and count("ab é") == 4


# -- language model ----------------------------------------------------------


def brute_tree(texts, depth):
    """Counts of the decisions of each (context, bits), straight from the definition."""
    count = collections.defaultdict(lambda: [0, 0])
    for t in texts:
        raw = lm.END * depth + t + lm.END
        for i in range(depth, len(raw)):
            for j in range(8):
                node, bit = (1 << j) | (raw[i] >> (8 - j)), (raw[i] >> (7 - j)) & 1
                for d in range(depth + 1):
                    count[(raw[i - d : i], node)][bit] += 1
    return count


def test_context_tree_weighting(spark):
    texts = ["abracadabra abracadabra", "banana band", "", "é"]
    low = [t.encode() for t in texts]
    count = brute_tree(low, lm.DEPTH)

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(ctx, node):
        e = log_kt(*count[(ctx, node)])
        if len(ctx) == lm.DEPTH:
            return e
        below = sum(weighted(bytes([b]) + ctx, node) for b in range(256) if (bytes([b]) + ctx, node) in count)
        return np.logaddexp(e, below) - math.log(2)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counted = lm.counts(df)
    nodes = lm.tree(counted.where("gram IS NOT NULL").select("gram", "n")).collect()
    assert len(nodes) == len([k for k in count])
    for r in nodes[::17]:
        ctx = r["ctx"].to_bytes(lm.DEPTH, "big")[lm.DEPTH - r["depth"] :]
        assert [r["n0"], r["n1"]] == count[(ctx, r["node"])]
        assert abs(r["log_pw"] - weighted(ctx, r["node"])) < 1e-6

    def log10_byte(ctx, byte):
        total = 0.0
        for j in range(8):
            node, bit, p = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1, None
            for d in range(lm.DEPTH, -1, -1):
                c = ctx[lm.DEPTH - d :]
                if (c, node) in count:
                    a, b = count[(c, node)]
                    kt = (b + 0.5) / (a + b + 1)
                    w = 1.0 if d == lm.DEPTH else math.exp(log_kt(a, b) - math.log(2) - weighted(c, node))
                    p = kt if p is None else w * kt + (1 - w) * p
            p = 0.5 if p is None else p
            total += math.log10(p if bit else 1 - p)
        return total

    got = {r["doc_id"]: r["score"] for r in lm.score_texts(df, F.lit(True)).collect()}
    for i in (1, 2, 3):
        raw = lm.END * lm.DEPTH + low[i] + lm.END
        want = sum(log10_byte(raw[k - lm.DEPTH : k], raw[k]) for k in range(lm.DEPTH, len(raw)))
        assert math.isclose(got[i], want, rel_tol=1e-6)


def test_lm_scores_from_the_whole_tree(spark, monkeypatch):
    """Whatever part of the strings is broadcast, every node that was counted speaks, exactly."""
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 7))) for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    count = brute_tree([t.encode() for t in texts[:30]], lm.DEPTH)
    below = collections.defaultdict(set)
    for ctx, node in count:
        if ctx:
            below[(ctx[1:], node)].add((ctx, node))
    weight, log_pw = {}, {}
    for key in sorted(count, key=lambda k: -len(k[0])):
        a, b = count[key]
        kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        leaf = len(key[0]) == lm.DEPTH
        log_pw[key] = kt if leaf else np.logaddexp(kt, sum(log_pw[c] for c in below[key])) - math.log(2)
        weight[key] = 1.0 if leaf else math.exp(kt - math.log(2) - log_pw[key])

    def log10_of(text):
        raw, total = lm.END * lm.DEPTH + text + lm.END, 0.0
        for k in range(lm.DEPTH, len(raw)):
            for j in range(8):
                node, p = (1 << j) | (raw[k] >> (8 - j)), None
                for d in range(lm.DEPTH, -1, -1):
                    if (key := (raw[k - d : k], node)) in count:
                        a, b = count[key]
                        p = (b + 0.5) / (a + b + 1) if p is None else weight[key] * (b + 0.5) / (a + b + 1) + (1 - weight[key]) * p
                p = 0.5 if p is None else p
                total += math.log10(p if (raw[k] >> (7 - j)) & 1 else 1 - p)
        return total

    for head in (0, 200, 1 << 22):
        monkeypatch.setattr(lm, "HEAD_GRAMS", head)
        got = {r["doc_id"]: r["score"] for r in lm.score_texts(df, F.col("doc_id") < 30).collect()}
        for i in (0, 7, 29, 30, 39):
            assert math.isclose(got[i], log10_of(texts[i].encode()), rel_tol=1e-6)


def test_lm_base_and_edges(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", 3)
    data = [(1, "The the cat"), (2, None), (3, ""), (4, "unseen É words the"), (5, "a\x0bb c\x1cd"), (None, "the"), (6, "the cat " * 30_000)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in data], "doc_id long, text string, score double")
    learn = F.coalesce(F.col("doc_id") != 4, F.lit(True))
    got = {r["doc_id"]: r for r in lm.score_texts(df, learn).collect()}
    words = {i: (t or "").encode().lower().split() + [b""] for i, t in data}
    c = collections.Counter(w for i, ws in words.items() if i != 4 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        assert got[i]["n_tokens"] == len(ws) and got[i]["n_known"] == sum(c[w] > 0 for w in ws) and got[i]["train_tokens"] == n
        assert math.isclose(got[i]["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert got[i]["score"] < 0 or i in (2, 3)
    assert lm.score_texts(df.limit(0), learn).count() == 0
    blank = lm.score_texts(df.where("doc_id = 1"), F.lit(False)).first()
    assert blank["train_tokens"] == 0 and math.isclose(blank["score"], 12 * 8 * math.log10(0.5), rel_tol=1e-6)


def test_lm_tells_nul_from_the_end(spark):
    """A text that holds NUL is not scored like one that ends there."""
    data = [(i, "ab") for i in range(40)] + [(100, "ab\0"), (101, "ab\0ab"), (102, "ab")]
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(spark.createDataFrame(data, "doc_id long, text string"), F.col("doc_id") < 40).collect()}
    assert got[102] > -1 and got[100] < got[102] - 1 and got[101] < got[102] - 2


def test_lm_tells_text_from_noise(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 400").limit(60)
    noise = docs.select((F.col("doc_id") + 10**6).alias("doc_id"), F.reverse("text").alias("text"))
    got = lm.score_texts(docs.select("doc_id", "text").union(noise), F.col("doc_id") < 10**6).groupBy(F.col("doc_id") < 10**6).agg(F.avg("bits_per_byte").alias("b")).collect()
    bits = {r[0]: r["b"] for r in got}
    assert bits[True] + 0.5 < bits[False]


# -- folds, and the queries as they are registered ------------------------------


def with_table(sf, tmp_path, name, change):
    """A copy of the tables in which change(pandas frame) has made `name` anew."""
    folder = tmp_path / f"sf-{name}-{len(list(tmp_path.iterdir()))}"
    folder.mkdir()
    for f in os.listdir(sf):
        if f != f"{name}.parquet":
            os.symlink(f"{sf}/{f}", folder / f)
    table = pq.read_table(f"{sf}/{name}.parquet")
    frame = change(table.to_pandas())
    pq.write_table(pa.Table.from_pandas(frame, schema=table.schema, preserve_index=False), folder / f"{name}.parquet")
    return str(folder)


def crc(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


@pytest.mark.parametrize(("query", "label", "parts", "held", "least"), [("op4_toxicity", "toxic", 4, 2, 0.3), ("op8_quality", "quality", 3, 1, 0.5)])
def test_labels_of_held_out_rows_move_no_score(spark, sf, tmp_path, query, label, parts, held, least):
    """A row a document with what the contract names; other labels in the held-out fold change nothing, in the others they do."""
    run = queries.queries()[query]

    def flipped(which):
        def change(frame):
            at = frame["doc_id"].map(lambda i: (crc(i, parts) == held) == which)
            frame.loc[at, label] = 1 - frame.loc[at, label]
            return frame

        return change

    got = {r["doc_id"]: r for r in run(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in got.items():
        assert r["held_out"] == (crc(i, parts) == held) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)
    scores = {i: r["score"] for i, r in got.items()}
    same_ = {r["doc_id"]: r["score"] for r in run(spark, with_table(sf, tmp_path, "labels", flipped(True))).collect()}
    assert same_ == scores
    other = {r["doc_id"]: r["score"] for r in run(spark, with_table(sf, tmp_path, "labels", flipped(False))).collect()}
    assert other != scores


def test_languages_of_held_out_rows_move_no_prediction(spark, sf, tmp_path):
    def renamed(which):
        def change(frame):
            at = frame["doc_id"].map(lambda i: (crc(i, 3) == 1) == which)
            frame.loc[at, "lang"] = "zz"
            frame["source"] = "elsewhere"
            return frame

        return change

    take = lambda path: {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in langid.op7_langid(spark, path).collect()}
    got = take(sf)
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(got) == set(langs) and all(got[i][0] == (crc(i, 3) == 1) and 0 <= got[i][2] <= 1 for i in got)
    held = [i for i in got if got[i][0] and langs[i]]
    assert np.mean([got[i][1] == langs[i] for i in held]) > 0.9
    assert take(with_table(sf, tmp_path, "documents", renamed(True))) == got
    assert {p for _, p, _ in take(with_table(sf, tmp_path, "documents", renamed(False))).values()} == {"zz"}


def test_op10_lm_is_brute_force(spark, sf, tmp_path):
    """Tokens, known ones, N and the base over the whole table; held-out texts teach nothing, others do."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    words = {i: t.encode().lower().split() + [b""] for i, t in docs.items()}
    c = collections.Counter(w for i, ws in words.items() if crc(i, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm.op10_lm(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r["held_out"] == (crc(i, 7) == 2) and r["n_tokens"] == len(words[i]) and r["train_tokens"] == n and r["n_known"] == sum(w in c for w in words[i])
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[i]), rel_tol=1e-9) and r["score"] < 0
    held = sorted(i for i in docs if crc(i, 7) == 2)
    told = sorted(i for i in docs if crc(i, 7) != 2)

    def rewritten(one):
        def change(frame):
            frame.loc[frame["doc_id"] == one, "text"] = "qzxj " * 400
            return frame

        return change

    for one, moves in ((held[0], False), (told[0], True)):
        after = {r["doc_id"]: r["score"] for r in lm.op10_lm(spark, with_table(sf, tmp_path, "documents", rewritten(one))).collect()}
        assert (max(abs(after[i] - got[i]["score"]) for i in docs if i != one) > 1e-3) == moves


def test_op5_jaccard_is_brute_force(spark, sf):
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(jaccard.op5_jaccard(spark, sf)) == brute_groups(data)


def test_jaccard_of_long_sets_and_common_passages(spark):
    """Long documents that share passages, some alike and some not: those that meet too seldom leave, no link is lost."""
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(4000)]
    passages = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(6)]
    texts = []
    for _ in range(14):
        base = rng.choices(vocabulary, k=rng.choice([300, 1500, 2600]))
        held = " ".join(rng.sample(passages, 3))
        for edits in rng.sample([0, 3, 10, 25, 34, 40, 60], 4):
            texts.append(edited(base, edits * len(base) // 1500, rng) + " " + held)
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    assert rows(jaccard.similar_groups(df).select("doc_id", "n_shingles", "component_id")) == brute_groups(data)


def test_commonest(spark):
    """Whole classes from the top, and a part of the one that does not fit: never more than asked for, few less."""
    df = spark.createDataFrame([(i, 1 + 1000 // (i + 1)) for i in range(2000)], "k long, n long")
    for most in (0, 1, 5, 40, 700, 5000):
        got = sorted(commonest(df, "n", "k", most).collect(), key=lambda r: r["k"])
        assert len(got) <= max(most, 0) * 1.1 + 5 and len(got) >= min(2000, 0.7 * most - 5)
        assert [r["k"] for r in got][: len(got) // 2] == list(range(len(got) // 2))
    assert commonest(df.limit(0), "n", "k", 5).count() == 0
    assert commonest(df, "n", "k", 1999, part=False).count() < 1500 and commonest(df, "n", "k", 2000, part=False).count() == 2000


def test_stored(spark):
    df = stored(spark.range(5), "test")
    assert df.count() == 5 and "larkspur-test" in df.inputFiles()[0]


def test_op10_scoring_holds_little_at_once():
    """What a task needs beside the model is bounded by a piece, not by the batch of texts."""
    import tracemalloc

    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, 1 << 14).astype(np.uint8).tobytes() for _ in range(256)]
    score = lm.Scorer((np.empty(0, np.uint64), np.empty(0, np.float32)))
    tracemalloc.start()
    for _, part in lm.pieces([pa.RecordBatch.from_arrays([pa.array(range(256)), pa.array(texts)], ["doc_id", "text"])], ["doc_id", "text"]):
        g, begin = lm.grams(part)
        lm.rare_of(g, begin, score(g))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
