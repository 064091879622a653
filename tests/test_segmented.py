"""The stored index that changes, against one built anew."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import index, rank, segmented
from tests.conftest import rows

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
DDL = "id long, text string, title string"


def doc(rng, k):
    return (k, " ".join(rng.choices(WORDS, weights=[40, 20, 10, 5, 3, 2, 1, 1], k=rng.randint(1, 30))), f"t{k}")


def rounded(df):
    return sorted((round(-r["score"], 9), r["id"]) for r in df.collect())


@pytest.mark.parametrize("profile", ["ascii", "unicode"])
def test_changes_in_any_order_equal_a_rebuild(spark, tmp_path, monkeypatch, profile):
    monkeypatch.setattr(segmented, "BLOCK_DOCS", 8)
    monkeypatch.setattr(segmented, "FIRST_BLOCKS", 2)
    rng = random.Random(3)
    held = segmented.SegmentedIndex(spark, f"file://{tmp_path}/i", profile)
    there: dict[int, tuple] = {}
    gone: set[int] = set()
    for step in ["add", "remove", "add", "add", "merge", "remove", "add", "merge"]:
        before = held.manifest()
        if step == "add":
            new = [doc(rng, rng.randrange(1, 90)) for _ in range(25)] + [(0, "alpha", ""), (None, "alpha", ""), (91, None, "")]
            after = held.add(spark.createDataFrame([(n, *d) for n, d in enumerate(new)], "n long, " + DDL), F.col("n"))
            for d in new:
                if d[0] and d[1] is not None and d[0] not in there:
                    there[d[0]] = d
        elif step == "remove":
            ids = [rng.randrange(1, 100) for _ in range(12)]
            after = held.remove(spark.createDataFrame([(i,) for i in ids], "id long"))
            gone |= set(ids) & set(there)
        else:
            after = held.merge(everything=True)
            assert len(after.segments) == 1 and len(after.gone) <= 1
        assert after.version == before.version + 1 and held.manifest() == after
    built = index.build(spark.createDataFrame(list(there.values()), DDL), profile).removed(spark.createDataFrame([(i,) for i in gone], "id long"))
    stats, now = built.stats().first(), held.manifest()
    assert (now.n_docs, now.total_length) == (stats["n_docs"], stats["total_length"]) and abs(now.avgdl - stats["avgdl"]) < 1e-12
    assert rows(held.documents().select("id", "title", "length", "active")) == rows(built.docs.select("id", "title", "length", "active"))
    for query, k in (("alpha zeta zeta", 5), ("eta", 3), ("theta beta", 200), ("nowhere", 3), ("", 3)):
        found = held.search(query, k)
        assert rounded(found.hits) == rounded(rank.search(built, query, k)), query
        assert found.read <= found.blocks
    # A removed id never comes back.
    assert held.add(spark.createDataFrame([(min(gone), "alpha", "back")], DDL)) == now and held.remove(spark.createDataFrame([(min(gone),)], "id long")) == now
    assert held.vacuum() > 0 and held.manifest() == now and rounded(held.search("alpha", 5).hits) == rounded(rank.search(built, "alpha", 5))


def test_blocks_that_cannot_enter_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segmented, "BLOCK_DOCS", 16)
    monkeypatch.setattr(segmented, "FIRST_BLOCKS", 2)
    data = [(k, "rare " * (9 if k in (7, 500) else 1) + "word " * (20 if k not in (7, 500) else 1), "") for k in range(1, 600)]
    held = segmented.SegmentedIndex(spark, f"file://{tmp_path}/i")
    held.add(spark.createDataFrame(data, DDL))
    found = held.search("rare", 2)
    assert [r["id"] for r in found.hits.orderBy("id").collect()] == [7, 500]
    assert found.blocks > 30 and found.read <= 4


def test_the_later_of_two_writers_is_told(spark, tmp_path, monkeypatch):
    held = segmented.SegmentedIndex(spark, f"file://{tmp_path}/i")
    first = held.add(spark.createDataFrame([(1, "alpha", "")], DDL))
    other = segmented.SegmentedIndex(spark, f"file://{tmp_path}/i")
    was = other.manifest()
    held.add(spark.createDataFrame([(2, "beta", "")], DDL))
    monkeypatch.setattr(other, "manifest", lambda: was)
    with pytest.raises(segmented.Busy):
        other.add(spark.createDataFrame([(3, "gamma", "")], DDL))
    now = held.manifest()
    assert now.version == first.version + 1 and rows(held.documents().select("id")) == [(1,), (2,)]
    assert held.vacuum() > 0 and rows(held.documents().select("id")) == [(1,), (2,)]


def test_tiers_are_merged_from_below(spark, tmp_path):
    held = segmented.SegmentedIndex(spark, f"file://{tmp_path}/i")
    held.add(spark.createDataFrame([doc(random.Random(1), k) for k in range(100, 130)], DDL))
    for k in range(1, 5):
        held.add(spark.createDataFrame([(k, "alpha", "")], DDL))
    assert sorted(n for _, n in held.merge().segments) == [4, 30] and held.merge() == held.manifest()
    assert segmented.SegmentedIndex(spark, f"file://{tmp_path}/none").search("alpha").hits.count() == 0


@pytest.mark.parametrize("profile", ["ascii", "unicode"])
def test_merges_keep_blocks(spark, tmp_path, monkeypatch, profile):
    """Blocks of fair size are merged as they are, small ones together, and a block of many tokens in parts; searches give the same."""
    monkeypatch.setattr(segmented, "BLOCK_DOCS", 16)
    monkeypatch.setattr(segmented, "MOST_TOKENS", 60)
    rng = random.Random(5)
    held = segmented.SegmentedIndex(spark, f"file://{tmp_path}/i", profile)
    data = [doc(rng, k) for k in range(1, 141)]
    for a, b in ((0, 100), (100, 103), (103, 105), (105, 140)):
        held.add(spark.createDataFrame(data[a:b], DDL))
    monkeypatch.setattr(segmented, "_block", None)  # no block is dealt anew
    now = held.merge(everything=True)
    sizes = [r["n"] for r in held._read("docs", [n for n, _ in now.segments], segmented.DOCS).groupBy("block").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 140 and max(sizes) < 32 and 7 <= len(sizes) <= 11
    built = index.build(spark.createDataFrame(data, DDL), profile)
    assert rows(segmented.opened(held.postings(now)).select("term", "id").distinct()) == rows(built.postings.select("term", "id"))
    for query, k in (("alpha zeta zeta", 5), ("theta beta", 200)):
        assert rounded(held.search(query, k).hits) == rounded(rank.search(built, query, k))
