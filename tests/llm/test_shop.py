"""Rolling medians, spelling variants and packing against brute force, and on odd input."""

import collections
import itertools
import json
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from larkspur.llm import packing, rolling, spelling
from larkspur.llm.common import stored
from tests.conftest import rows

# -- rolling medians -----------------------------------------------------------


def brute_medians(points, span):
    out = []
    for i, s, t, c in points:
        if t is None:
            continue
        w = sorted(x for _, s2, t2, x in points if t2 is not None and s2 == s and t - span < t2 <= t and x is not None)
        n = len(w)
        if n < 2:
            out.append((i, s, n, None, None, None))
            continue
        m = w[(n - 1) // 2] + w[n // 2]
        d = sorted(abs(2 * x - m) for x in w)
        mad = d[(n - 1) // 2] + d[n // 2]
        out.append((i, s, n, m, mad, None if c is None else 2 * abs(2 * c - m) > 3 * mad))
    return sorted(out, key=repr)


def points_of(shape, count, seed):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        s = rng.choice([None, "a", "a", "a", "b"])
        t = rng.randrange(-3, 9) * 100 if shape == "ties" else rng.randrange(-300, 900) * 10
        value = {"wide": int(rng.lognormvariate(3, 2) * rng.choice([1, 1, -1])), "ties": rng.randrange(4), "heavy": 0 if rng.random() < 0.5 else rng.randrange(-50, 500)}[shape]
        out.append((i if i % 40 else None, s, None if i % 50 == 7 else t, None if rng.random() < 0.1 else value))
    return out


@pytest.mark.parametrize(("shape", "hot_rows", "part_rows"), [("wide", 10**6, 1024), ("wide", 100, 8), ("ties", 0, 40), ("heavy", 0, 8), ("heavy", 0, 40)])
def test_rolling(spark, shape, hot_rows, part_rows):
    points = points_of(shape, 500, 5)
    df = spark.createDataFrame(points, "id long, series string, at long, c long").withColumn("slot", F.lit("the caller's"))
    assert rows(rolling.rolling_medians(df, 1000, hot_rows, part_rows)) == brute_medians(points, 1000)


def test_rolling_edges(spark):
    ddl = "id long, series string, at long, c long"
    assert rows(rolling.rolling_medians(spark.createDataFrame([], ddl))) == []
    points = [(1, "a", 0, None), (2, "a", 0, None), (3, "b", 5, 7), (4, "b", 5, 7), (4, "b", 5, 7), (5, "b", 5 + rolling.HOUR, 9), (6, "b", 4 + rolling.HOUR, None)]
    for hot in (0, 100):
        assert rows(rolling.rolling_medians(spark.createDataFrame(points, ddl), hot_rows=hot)) == brute_medians(points, rolling.HOUR)


def test_one_value_fills_a_hot_series(spark):
    """Shards of one value are never sent."""
    points = [(i, "a", i, 3 if i % 10 else i) for i in range(400)]
    assert rows(rolling.rolling_medians(spark.createDataFrame(points, "id long, series string, at long, c long"), 150, 0, 16)) == brute_medians(points, 150)


def test_windows_against_sorting():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        v = rng.integers(-20, 20, size=n).astype(np.int64)
        index, lo = rolling.Windows(v), rng.integers(0, n, size=20)
        hi, mid2 = np.minimum(n, lo + rng.integers(1, 30, size=20)), rng.integers(-45, 45, size=20)
        k = np.array([rng.integers(1, h - i + 1) for i, h in zip(lo, hi, strict=True)])
        one, two = index.deviations(lo, hi, mid2, k)
        none = np.empty(0, np.int64)
        same = rolling.bisected(index, lo, hi, mid2, k, np.zeros(20, np.int64), np.zeros(20, np.int64), np.full(20, 200), none, none, none)
        for i in range(20):
            w = v[lo[i] : hi[i]]
            d = np.sort(np.abs(2 * w - mid2[i]))
            assert one[i] == same[i] == d[k[i] - 1] and (k[i] == len(d) or two[i] == d[k[i]])
            assert index.kth(lo[i : i + 1], hi[i : i + 1], k[i : i + 1] - 1)[0] == np.sort(w)[k[i] - 1]


def test_cuts_part_evenly_and_isolate_heavy_values():
    v = np.sort(np.concatenate([np.zeros(500, np.int64), np.arange(1, 501)]))
    cuts = rolling.cuts_of([v[::2], v[1::2]], [500, 500], 10)
    sizes = np.bincount(np.searchsorted(cuts, v, "right"))
    assert {0, 1} <= set(cuts.tolist()) and sizes[np.searchsorted(cuts, 0, "right")] == 500 and max(sizes[np.searchsorted(cuts, 1, "right") :]) <= 110


@pytest.mark.parametrize("numbers", [[], [7], [3, 3, 3], [0, 255], [-1, 255], [1 << 40, 0, 5], [-(1 << 63), (1 << 63) - 1, 0], list(range(-70000, 70000, 7))])
def test_packed_numbers_come_back(numbers):
    x = np.array(numbers, np.int64)
    packed = rolling._packed(x)
    back = rolling._longs(packed)
    assert back.dtype == np.int64 and back.tolist() == numbers and rolling._many(packed) == len(numbers)
    assert len(packed) <= 9 + 8 * len(numbers)


def test_clicks(spark):
    given = "click_id long, ts timestamp_ntz, kind string, value double"
    data = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-03-10 02:30:00.000001', 'a', 0.005), (1, timestamp_ntz'2024-03-10 02:30:00.000001', 'a', 0.005), (2, null, 'a', 1.0), (null, timestamp_ntz'1969-12-31 23:59:59.999999', null, double('nan')), (null, timestamp_ntz'1969-12-31 23:59:59.999999', null, 1e300) AS t(click_id, ts, kind, value)")
    assert [t for _, t in data.dtypes] == [x.split()[1].replace("long", "int") for x in given.split(", ")]
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # where 02:30 of that day is skipped
    try:
        assert rows(rolling.click_points(data)) == [(1, "a", 1710037800000001, 1), (None, None, -1, None), (None, None, -1, None)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


# -- spelling --------------------------------------------------------------------


def brute_variants(docs, least_length, least_count, times):
    n = collections.Counter()
    for d, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            if h % 199 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            n[r] += 1
    w = {k: v for k, v in n.items() if len(k) >= least_length and v >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, count = {}, {}
    for a in w:
        found = [b for b in w if abs(len(a) - len(b)) < 2 and near(a, b)]
        best = min(found, key=lambda b: (-w[b], b), default=None)
        count[a], form[a] = len(found), best if best is not None and w[best] >= times * w[a] else None

    def root(a):
        return a if form[a] is None else root(form[a])

    return sorted(((a, form[a], root(a), w[a], count[a], w.get(form[a])) for a in w), key=repr)


@pytest.mark.parametrize("least", [(2, 2, 2), (3, 1, 3), (6, 5, 5)])
def test_spelling(spark, least):
    rng = random.Random(2)
    words = lambda: rng.choice(["AAbb", "aaaaaa", "banana", "Éaaé"]) if rng.random() < 0.2 else "".join(rng.choice("aabÀ") for _ in range(rng.randint(1, 6)))
    docs = [(d if d % 50 else None, " ".join(words() for _ in range(rng.choice([0, 5, 40])))) for d in range(250)] + [(7, None), (8, ""), (9, "12 . 34"), (9, "x" * 50_000 + " banana")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("the caller's"))
    got = spelling.variants(df, *least).select("word", "form", "root", "n", "n_near", "form_n")
    assert rows(got) == brute_variants(docs, *least)


def test_spelling_query(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet")
    docs = list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))
    assert rows(spelling.op12_spelling(spark, sf)) == brute_variants(docs, 6, 5, 5)


def test_spelling_of_nothing(spark):
    assert rows(spelling.variants(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_long_words(spark, monkeypatch):
    """Words of around LONG code points, in strings and in hashes, are near as others are; a very long one takes no square of its length."""
    monkeypatch.setattr(spelling, "LONG", 8)
    rng = random.Random(5)
    base = ["".join(rng.choices("abcde", k=k)) for k in (6, 7, 8, 9, 10, 30) for _ in range(3)]
    docs = [(d, " ".join(rng.choice(base) if rng.random() < 0.6 else (w := rng.choice(base))[: (i := rng.randrange(len(w)))] + rng.choice(["", "a", "bb"]) + w[i + 1 :] for _ in range(60))) for d in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = spelling.variants(df, 2, 1, 2).select("word", "root", "n", "n_near", "form_n")
    assert rows(got) == sorted(((w, r, n, k, m) for w, _, r, n, k, m in brute_variants(docs, 2, 1, 2)), key=repr)
    monkeypatch.undo()
    long = "ab" * 100_000
    two = spelling.variants(spark.createDataFrame([(k, f"{long} {long}x {long[:-1]}c") for k in range(30)], "doc_id long, text string"), 6, 5, 1)
    assert sorted((len(r["word"]), r["n_near"]) for r in two.where("n > 20").collect()) == [(200_000, 1), (200_000, 2), (200_001, 1)]


def test_collisions_join_nothing():
    found = spelling.met([(spelling.WHOLE, 0, "abc", None, 5), (spelling.SHORTER, 1, "axbc", None, 3), (spelling.SHORTER, 0, "zzzz", None, 9), (spelling.PLACE, 1, "abc", None, 5), (spelling.PLACE, 1, "axc", None, 4), (spelling.PLACE, 1, "zzz", None, 8)])
    assert sorted(found) == [("abc", 1, 3, "axbc"), ("abc", 1, 4, "axc"), ("axbc", 1, 5, "abc"), ("axc", 1, 5, "abc")]


def test_deletion_keys_are_hashes_of_the_strings():
    words = ["abcabc", "aab", "zé", "b"]
    row, place, short, _, _ = spelling.deletion_keys(words)  # also of rests of no code point
    rest = [words[r][:p] + words[r][p + 1 :] for r, p in zip(row, place, strict=True)]
    whole = dict(zip(rest, spelling.deletion_keys(rest)[4], strict=True))
    assert all(whole[s] == h for s, h in zip(rest, short, strict=True)) and len(set(whole.values())) == len(set(rest))


def test_long_chains_of_forms(spark):
    forms = [(f"w{i}", f"w{i + 1}" if i % 100 < 99 else None) for i in range(200)]
    got = dict(rows(spelling.rooted(spark.createDataFrame(forms, "word string, form string"))))
    assert got == {f"w{i}": "w99" if i < 100 else "w199" for i in range(200)}


# -- packing ---------------------------------------------------------------------


def least_bins(sizes, capacity):
    """The fewest sequences, by trying all."""
    best = len(sizes)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(sizes):
            best = len(room)
            return
        for k in range(len(room)):
            if room[k] >= sizes[i] and room[k] not in room[:k]:
                place(i + 1, [*room[:k], room[k] - sizes[i], *room[k + 1 :]])
        place(i + 1, [*room, capacity - sizes[i]])

    place(0, [])
    return best


def right(patterns, counts, capacity):
    got = np.zeros(capacity + 1, np.int64)
    for content, n in patterns:
        assert n > 0 and sum(s * k for s, k in content) <= capacity
        for s, k in content:
            got[s] += n * k
    assert (got == counts).all()


def test_bin_completion_finds_the_fewest():
    rng = random.Random(4)
    for _ in range(60):
        sizes = sorted((rng.randint(3, 20) for _ in range(rng.randint(0, 9))), reverse=True)
        counts = np.bincount(sizes, minlength=21) if sizes else np.zeros(21, np.int64)
        found = packing.solve(counts, 20)
        right(found, counts, 20)
        assert packing.bins(found) == least_bins(sizes, 20) and packing.least_sequences(counts, 20) <= packing.bins(found)


@pytest.mark.parametrize("shape", ["uniform", "middle", "huge", "none", "full"])
def test_packing_is_never_worse_than_best_fit(shape):
    rng = np.random.default_rng(1)
    counts = {"uniform": lambda: np.bincount(rng.integers(1, 129, size=3000), minlength=129), "middle": lambda: np.bincount(rng.integers(30, 90, size=500), minlength=129), "huge": lambda: np.bincount([1, 88, 40], minlength=129) * 10**9, "none": lambda: np.zeros(129, np.int64), "full": lambda: np.bincount([128] * 5, minlength=129)}[shape]().astype(np.int64)
    found, fit = packing.solve(counts, 128, steps=1500), packing.best_fit(counts, 128)
    right(found, counts, 128)
    right(fit, counts, 128)
    assert packing.least_sequences(counts, 128) <= packing.bins(found) <= packing.bins(fit)


def test_dominated_fillings():
    counts = np.bincount([5, 5, 3, 2, 7], minlength=11)
    assert packing.dominated(((3, 1), (2, 1)), 2, counts)  # 3 and 2 may go for 5 or 7
    assert packing.dominated(((7, 1),), 2, counts)  # 2 fits beside it
    counts[2] = 0
    assert packing.dominated(((5, 1),), 2, counts) and not packing.dominated(((7, 1),), 2, counts)
    assert not packing.dominated(((3, 1),), 0, counts)


def test_encoder_is_the_library_s():
    from tokenizers import Tokenizer

    source = packing.vocabulary()
    encode, whole = packing.encoder(source), Tokenizer.from_str(source)
    texts = ["", "a" * 5000, " " * 300, "x<|endoftext|>y", "\n\n\t a  b　z's 'Ll 12³½", "ab́ \U0001f600 \x00\x7f", "你好, 世界"]
    for text in texts:
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids
    other = json.loads(source)
    other["pre_tokenizer"]["add_prefix_space"] = True
    other = json.dumps(other)
    assert packing.encoder(other)("so it is").tolist() == Tokenizer.from_str(other).encode("so it is", add_special_tokens=False).ids


def check_places(got, capacity=1024):
    used = collections.defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_packing_query(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    t = pq.read_table(f"{sf}/documents.parquet")
    want = []
    for d, text in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, (a, b) in enumerate(itertools.pairwise([0, *range(first, len(ids) + 1, 1024)])):
            want.append((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = packing.op13_packing(spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    counts = np.bincount([r["length"] for r in got], minlength=1025)
    assert check_places(got) == packing.bins(packing.solve(counts)) <= packing.bins(packing.best_fit(counts, 1024))


def test_packing_edges(spark):
    source = packing.vocabulary()
    assert rows(packing.packed(spark.createDataFrame([], "doc_id long, text string"), source)) == []
    docs = [(1, None), (1, None), (None, ""), (2, "word " * 3000), (3, "a")] + [(k, "same text") for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit("the caller's"))
    got = stored(packing.packed(df, source, 64, ids=True), "got")
    assert check_places(got.collect(), 64) == packing.bins(packing.solve(np.bincount([r["length"] for r in got.collect()], minlength=65), 64))
    long = packing.encoder(source)("word " * 3000).tolist() + [2]
    assert sum((r["ids"] for r in sorted(got.where("doc_id = 2 and length > 5").collect(), key=lambda r: r["piece"])), []) == long
    whole = packing.sequences(got).collect()
    assert sum(len(r["ids"]) for r in whole) == got.agg(F.sum("length")).first()[0] and max(len(r["ids"]) for r in whole) <= 64
