"""Groups of spelling variants: words that differ by one code point, the frequent one as the form of the others.

* Words are counted in two steps, in each task and then over all, so that a
  frequent word travels once a task.
* Deletion keys. A word without its code point i has a polynomial hash that
  comes from the hash of what is before i and of what is after it; numpy makes
  those of all places of many words at once, as whole numbers. A word's own hash
  is the key of words that have one code point more; keys with their place are
  those of words of its length that differ there.
* Keys are dealt to partitions by their upper bits and sorted there. Rows of one
  key are compared by the strings themselves, so that a collision joins nothing (those
  of more than LONG code points by two further hashes).
* A key's words are as many as the alphabet has letters, for one deletion. No
  pairs are made all the same: each row learns how many others its key has and
  which is the most frequent, and these add up over a word's keys, as every near
  word shares just one key with it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import mix64, slices, spread, stored, table, whole_groups

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: A-Z to a-z, and nothing else.
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
#: One occurrence in so many (by hash) loses a code point.
EVERY = 199
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Words that a task holds before it hands their counts on.
HELD = 200_000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words and rests of more code points travel as their beginning and two further hashes, and are compared by these: a word without
#: each of its code points would otherwise take the square of its length.
LONG, FURTHER = 256, (np.uint64(0xD1342543DE82EF95), np.uint64(0xBF58476D1CE4E5B9))
#: Kinds of keys: the word itself, the word without a code point, the same with its place.
WHOLE, SHORTER, PLACE = 0, 1, 2


# -- words -----------------------------------------------------------------------


def changed(doc_id: str, run: str) -> str:
    """The run, lower-cased in A-Z; without one code point where EVERY divides the hash of document and run."""
    run = run.lower() if run.isascii() else run.translate(LOWER)
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % EVERY:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def _counted(batches):
    held: Counter = Counter()

    def rows():
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()

    for part in (p for b in batches for _, p in slices(b, 1, 1 << 20)):
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            for run, n in Counter(RUN.findall(text or "")).items():
                held[changed(doc_id, run)] += n
        if len(held) > HELD:
            yield from rows()
    if held:
        yield from rows()


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts that are long and frequent enough; docs: doc_id, text. A null doc_id is written as nothing."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = rows.mapInArrow(_counted, "word string, n long").where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# -- deletion keys ---------------------------------------------------------------


def deletion_keys(words: list[str], base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word without each of its code points: row of the word, place, hash, and whether the code point before is
    another (else that deletion gives the same string); and the hash of each whole word."""
    size = np.array([len(w) for w in words], np.int64)
    point = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(point)) - start[row]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max(initial=0)) + 1, base)]))
        letter = mix64(point + np.uint64(1))
        # before[i]: sum of letter[j] * base^j over j < i; after[i]: the same over j > i. A deletion moves what is after by one.
        term = letter * power[place]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(term)])
        before = sums[:-1] - sums[start[row]]
        after = sums[start[row] + size[row]] - sums[1:]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        short = before + after * inverse
        whole = sums[start + size] - sums[start]
        first = (place == 0) | (np.concatenate([[np.uint64(0)], point[:-1]]) != point)
        return row, place, mix64(short ^ mix64(size[row].astype(np.uint64) - np.uint64(1))), first, mix64(whole ^ mix64(size.astype(np.uint64)))


KEYS = "key long, kind int, place int, word string, rest string, n long"


def names(words: list[str]) -> list[str]:
    """What words travel as: themselves, or where they are LONG their beginning and hashes of the whole."""
    long = [i for i, w in enumerate(words) if len(w) > LONG]
    out = list(words)
    if long:
        hashes = [deletion_keys([words[i] for i in long], base)[4].tolist() for base in FURTHER]
        for i, x, y in zip(long, *hashes, strict=True):
            out[i] = f"{words[i][:LONG]}\0{x:x}.{y:x}"
    return out


def _named(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(names(batch.column("word").to_pylist()), pa.string()), batch.column("word"), batch.column("n")], ["name", "word", "n"])


def _keys(batches):
    for batch in batches:
        words = batch.column("word").to_pylist()
        if not words:
            continue
        name = pa.array(names(words), pa.string())
        size = np.array([len(w) for w in words])
        row, place, short, first, whole = deletion_keys(words)
        with np.errstate(over="ignore"):
            placed = mix64(short + mix64(place.astype(np.uint64) + np.uint64(77)))
        rows = np.concatenate([np.arange(len(words)), row[first], row])
        kind = np.repeat(np.array([WHOLE, SHORTER, PLACE], np.int32), [len(words), int(first.sum()), len(row)])
        at = np.concatenate([np.zeros(len(words), np.int64), place[first], place]).astype(np.int32)
        key = np.concatenate([whole, short[first], placed]).astype(np.int64)
        # What is left of a long word, by two further hashes; null where the word itself tells.
        rest = np.full(len(rows), None, object)
        long = np.flatnonzero(size[rows] - (kind != WHOLE) >= LONG)
        if len(long):
            further = [deletion_keys(words, base) for base in FURTHER]
            x, y = (np.concatenate([f[4], f[2][first], f[2]])[long].tolist() for f in further)
            rest[long] = [f"{a:x}.{b:x}" for a, b in zip(x, y, strict=True)]
        for k in range(0, len(rows), 50_000):
            w = pa.array(rows[k : k + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 50_000]), pa.array(kind[k : k + 50_000]), pa.array(at[k : k + 50_000]), name.take(w), pa.array(rest[k : k + 50_000], pa.string()), batch.column("n").take(w)], ["key", "kind", "place", "word", "rest", "n"])


def met(rows: list[tuple[int, int, str, str | None, int]]) -> list[tuple[str, int, int, str]]:
    """Of the rows (kind, place, word, rest, n) of one key: word, how many near words it meets there, the n and the name of the first of them (largest n, then smallest).

    Whole words meet words that are longer by one, words without a code point those that lack another at the same place; what the
    key stands for is compared as a string (`rest`, where it is too long for that).
    """
    out = []
    sides: dict[tuple, tuple[list, list]] = {}
    for kind, place, word, rest, n in rows:
        if rest is None:
            rest = word if kind == WHOLE else word[:place] + word[place + 1 :]
        if kind == PLACE:
            sides.setdefault((rest, place), ([], []))[0].append((word, n))
        else:
            sides.setdefault((rest, -1), ([], []))[kind].append((word, n))
    for (_, place), (own, longer) in sides.items():
        if place >= 0:
            order = sorted(own, key=lambda x: (-x[1], x[0]))[:2]
            if len(own) > 1:
                out += [(w, len(own) - 1, *(order[1] if w == order[0][0] else order[0])[::-1]) for w, _ in own]
        elif own and longer:
            best = min(longer, key=lambda x: (-x[1], x[0]))
            out.append((own[0][0], len(longer), best[1], best[0]))
            out += [(w, 1, own[0][1], own[0][0]) for w, _ in longer]
    return out


def _met(batches):
    columns = ["word", "near", "best_n", "best"]
    for t in whole_groups(batches, ["key"]):
        key = t.column("key").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        several = np.flatnonzero(np.diff(edges) > 1)  # most keys have one row
        if not len(several):
            continue
        rows = pa.array(np.concatenate([np.arange(edges[k], edges[k + 1]) for k in several]))
        held = list(zip(*(t.column(c).take(rows).to_pylist() for c in ("kind", "place", "word", "rest", "n")), strict=True))
        out, at = [], 0
        for size in np.diff(edges)[several].tolist():
            out += met(held[at : at + size])
            at += size
        for k in range(0, len(out), 50_000):
            w, near, best_n, best = zip(*out[k : k + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())], columns)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, best, best_n of words (word, n; each once): how many words are near, and the first of them by n, then by code points.

    Of near words of equal n that are LONG and begin alike, the hashes decide which is first.
    """
    keys = words.select("word", "n").mapInArrow(_keys, KEYS)
    dealt = keys.repartition(F.shiftrightunsigned("key", 40)).sortWithinPartitions("key")
    found = dealt.mapInArrow(_met, "word string, near long, best_n long, best string")
    # The largest n, and of those the smallest word: min of (-n, word).
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("x"))
    found = found.select(F.col("word").alias("name"), "n_near", F.col("x.best").alias("best"), (-F.col("x.m")).alias("best_n"))
    named = words.select("word", "n").mapInArrow(_named, "name string, word string, n long")
    out = named.join(found, "name", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0))).drop("name")
    # Names of long words back to the words: only those are looked up.
    long = named.where(F.col("name") != F.col("word")).select(F.col("name").alias("best"), F.col("word").alias("_long"))
    return out.join(long, "best", "left").withColumn("best", F.coalesce("_long", "best")).select("word", "n", "n_near", "best", "best_n")


# -- groups ----------------------------------------------------------------------


def rooted(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form; form null or a word with more occurrences): where the forms lead. The distance covered doubles in each step."""
    at = stored(forms.select("word", F.col("form").alias("root")).where("root is not null"), "forms")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")), "forms")
        if after.where("went").isEmpty():
            return forms.select("word").join(after.select("word", "root"), "word", "left").select("word", F.coalesce("root", "word").alias("root"))
        at = after.select("word", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, n, form, form_n, n_near, root for the words of docs (doc_id, text).

    Runs of Latin letters are lower-cased in A-Z; one in EVERY, by the hash of document and run, loses a code point. Words
    have least_length code points and least_count occurrences. Near words differ by one code point inserted, deleted or
    replaced; the form is the near word of largest n (ties: the smallest), if it occurs at least `times` as often. Null and
    empty texts have no words; repeated rows count again; rows without doc_id hash as an empty id. No words give no rows.
    """
    words = stored(word_counts(docs, least_length, least_count), "words")
    good = F.col("best_n") >= times * F.col("n")
    near = stored(near_words(words).select("word", "n", "n_near", F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "near")
    return near.join(rooted(near), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
