"""Benchmark decontamination: passages of documents within an edit budget of a benchmark item.

Texts are lower-cased, their runs of whitespace become one blank, and everything
counts in characters. An item of m characters may differ from a passage by
k = rate * m edits. The q-gram lemma: a passage within k edits shares at least
m - q + 1 - k q of the item's q-grams, and the pairs of positions lie on
diagonals (place in the document less place in the item) that differ by k at
most. So shared q-grams are counted in bands of 2 (k + 1) diagonals that overlap
by half; the regions that reach the bound are verified by an alignment within
the band, with both ends in the document free.

Q is the usual q. An item for which its bound would not be positive, a short
one, is searched by its largest q for which it is: every item has its whole
budget. An item of fewer than Q characters must stand between blanks or ends.

The q-grams of all items are broadcast in parts of bounded size.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import shipped, slices, spread, table

Q = 8
RATE = 0.1
#: Bytes of benchmark text in one broadcast; larger benchmarks are searched part by part.
PART_BYTES = 4 << 20
PIECE = 1 << 18
#: Shared q-grams, each with its item and diagonal, that are held at once; where a piece of text shares more, items and places are taken in blocks.
MOST_SHARED = 1 << 21


#: Stands between texts; no character has these numbers.
GAP, BEYOND = 0x110000, 0x110001
HASH = 0x9E3779B97F4A7C15


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(x: np.ndarray, q: int) -> np.ndarray:
    """A number for each run of q characters: equal runs have equal numbers, and the alignment tells the others apart."""
    n = max(0, len(x) - q + 1)
    g = np.zeros(n, np.uint64)
    for k in range(q):
        g = g * np.uint64(HASH) + x[k : n + k]
    return g ^ (g >> np.uint64(29))


def budget_of(m: int, rate: float = RATE) -> int:
    return int(rate * m + 1e-9)


class Grams:
    """The q-grams of one q: ascending, with the item and place of each."""

    FILTER_BITS = 22

    def __init__(self, q: int, items: list[int], texts: list[np.ndarray]):
        self.q = q
        parts = [_grams(t, q) for t in texts]
        gram = np.concatenate(parts)
        item = np.repeat(items, [len(p) for p in parts])
        place = np.concatenate([np.arange(len(p)) for p in parts])
        order = np.argsort(gram, kind="stable")
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.gram, number, self.first, self.count = (np.unique(gram[order], return_index=True, return_inverse=True, return_counts=True)[k] for k in (0, 2, 1, 3))
        # Entries are ordered by q-gram, then item: a range of items is a range of each q-gram's entries.
        self.most = max(items, default=0)
        self.key = number * (self.most + 1) + self.item
        self.filter = np.zeros(1 << self.FILTER_BITS, bool)
        self.filter[self._slot(self.gram)] = True

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(HASH)) >> np.uint64(64 - self.FILTER_BITS)).astype(np.int64)

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in x, number of the q-gram) of each place of x that holds some item's q-gram."""
        g = _grams(x, self.q)
        at = np.flatnonzero(self.filter[self._slot(g)])
        j = np.minimum(np.searchsorted(self.gram, g[at]), len(self.gram) - 1)
        same = self.gram[j] == g[at]
        return at[same], j[same]

    def within(self, j: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries of the q-grams j begin and end, of items low <= item < high alone."""
        if low <= 0 and high > self.most:
            return self.first[j], self.first[j] + self.count[j]
        return np.searchsorted(self.key, j * (self.most + 1) + low), np.searchsorted(self.key, j * (self.most + 1) + high)

    def shared(self, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, diagonal) of the entries begin..end-1 for each place at."""
        times = end - begin
        k = np.repeat(begin - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        return self.item[k].astype(np.int64), np.repeat(at, times) - self.place[k]


class Index:
    """Items [(item_id, text)] with their budgets and q-grams. Items without a character take no part."""

    def __init__(self, items: list[tuple[int, str | None]], rate: float = RATE):
        rows = [(i, t) for i, t in ((i, plain(t)) for i, t in items) if t]
        self.ids = [i for i, _ in rows]
        self.texts = [t for _, t in rows]
        self.chars = [characters(t) for t in self.texts]
        self.size = m = np.array([len(t) for t in self.texts], np.int64)
        self.budget = np.array([budget_of(n, rate) for n in m.tolist()], np.int64)
        q = np.minimum(Q, m // (self.budget + 1))  # m - q + 1 - k q is positive
        self.need = m - q + 1 - self.budget * q
        self.width = self.budget + 1
        self.grams = [Grams(n, which, [self.chars[i] for i in which]) for n in sorted(set(q.tolist())) if (which := np.flatnonzero(q == n).tolist())]

    def regions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) whose shared q-grams reach the item's bound; band b holds diagonals b w <= d < (b + 2) w.

        Items that share a template with each other and the text share very many q-grams with it: where they are more than
        MOST_SHARED, items are counted in blocks whose bands are about as many, and places in blocks of as many q-grams.
        """
        found = [np.empty(0, np.int64)]
        for grams in self.grams:
            at, j = grams.hits(x)
            edges = [0, len(self.size)]
            if int(grams.count[j].sum()) > MOST_SHARED:
                bands = np.cumsum((len(x) + self.size) // self.width + 2)
                edges = [0, *(np.flatnonzero(np.diff(bands // MOST_SHARED)) + 1).tolist(), len(self.size)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                begin, end = grams.within(j, low, high)
                some = np.flatnonzero(end > begin)
                parts = np.cumsum(end[some] - begin[some]) // MOST_SHARED
                cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(some)]
                key, n = np.empty(0, np.int64), np.empty(0, np.int64)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    item, diagonal = grams.shared(at[some[a:b]], begin[some[a:b]], end[some[a:b]])
                    more = item << 40 | (diagonal // self.width[item] + (1 << 24))  # bands before the start are negative
                    more, times = np.unique(np.concatenate([more, more - 1]), return_counts=True)
                    key, back = np.unique(np.concatenate([key, more]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([n, times]), len(key)).astype(np.int64)
                found.append(key[n >= self.need[key >> 40]])
        key = np.concatenate(found)
        return key >> 40, (key & ((1 << 40) - 1)) - (1 << 24)

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of passages within budget; of overlapping ones for an item, the best, ties to the first."""
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        begin = np.concatenate([[0], np.cumsum(size)])
        x = np.full(begin[-1], GAP, np.uint32)
        for t, a in zip(texts, begin.tolist(), strict=False):
            x[a : a + len(t)] = characters(t)
        items, bands = self.regions(x)
        if not len(items):
            return []
        found = []
        low = bands * self.width[items]
        # A region may touch several texts; the gaps between them match nothing.
        first = np.clip(np.searchsorted(begin, low, side="right") - 1, 0, len(texts) - 1)
        last = np.clip(np.searchsorted(begin, low + 2 * self.width[items] + self.size[items], side="right") - 1, 0, len(texts) - 1)
        for i, d, a, b in zip(items.tolist(), low.tolist(), first.tolist(), last.tolist(), strict=True):
            for t in range(a, b + 1):
                hit = self.verify(i, texts[t], x[begin[t] : begin[t + 1] - 1], d - int(begin[t]))
                if hit:
                    found.append((t, i, *hit))
        found.sort(key=lambda f: (f[0], f[1], f[2], f[3]))
        kept: list[tuple] = []
        ends: list[int] = []  # ends of the passages kept of one text and item, ascending, and where those begin
        starts: list[int] = []
        for k, f in enumerate(found):
            if not k or found[k - 1][:2] != f[:2]:
                ends, starts = [], []
            at = bisect.bisect_right(ends, f[3])
            if at == len(starts) or starts[at] >= f[4]:
                ends.insert(at, f[4])
                starts.insert(at, f[3])
                kept.append(f)
        return kept

    def verify(self, i: int, text: str, chars: np.ndarray, low: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best passage on diagonals low <= d < low + 2 w, if within the budget."""
        item, w = self.texts[i], 2 * int(self.width[i])
        if low + w + len(item) <= 0 or low >= len(text):
            return None
        stop = max(0, low + w + len(item))
        if len(item) < Q and not self.budget[i]:  # between blanks or ends
            at = f" {text} ".find(f" {item} ", max(0, low), stop + 2)
        else:
            at = text.find(item, max(0, low), stop)
        if at >= 0:
            return 0, at, at + len(item)
        return banded(self.chars[i], chars, low, w, int(self.budget[i])) if self.budget[i] else None


def banded(item: np.ndarray, text: np.ndarray, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """Least edits between the whole item and a passage of text, on `width` diagonals from `low` on; where the passage lies.

    Row r, diagonal d stands for item[:r] against a passage that ends at r + low + d. None, as soon as no cell is within the budget.
    """
    m = len(item)
    far = 1 << 20
    window = np.full(m + width, BEYOND, np.uint32)
    a, b = max(0, low), min(len(text), low + m + width)
    if b > a:
        window[a - low : b - low] = text[a:b]
    d = np.arange(width)
    inside = (d + low >= 0) & (d + low <= len(text))
    cost, start = np.where(inside, 0, far), d + low
    ends = d + low
    safe = low >= 0 and low + width + m <= len(text)  # no cell lies outside the text
    for r in range(1, m + 1):
        swap = cost + (window[r - 1 : r - 1 + width] != item[r - 1])
        best, begin = swap, start.copy()
        drop = cost[1:] + 1  # the item's character is missing
        less = drop < swap[:-1]
        best[:-1][less], begin[:-1][less] = drop[less], start[1:][less]
        if not safe:
            best[(ends + r < 0) | (ends + r > len(text))] = far
        # Extra characters of the text: the least of the cells to the left, each a step dearer.
        level = best - d
        least = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == least, d, 0))
        cost, start = least + d, begin[source]
        if r % 8 == 0 and cost.min() > budget:
            return None
    e = int(cost.argmin())
    return (int(cost[e]), max(0, int(start[e])), min(len(text), m + low + e)) if cost[e] <= budget else None


def parts_of(benchmark: DataFrame, rate: float = RATE) -> list[Index]:
    """The benchmark's items in parts of about PART_BYTES. Null ids, null texts and items without a character take no part."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / PART_BYTES))
    for part in range(n):
        items = rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == part).orderBy("i", "t").collect()
        yield Index([(r["i"], r["t"]) for r in items], rate)


def _in_pieces(batch, column):
    """(first row, normalised texts) in pieces of about PIECE bytes."""
    for first, part in slices(batch, column, PIECE):
        yield first, [plain(t) for t in part.column(column).to_pylist()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, edits, start, end: a row for each passage of a document (doc_id, text) within the item's budget.

    A piece of text is held against a bounded number of q-grams at a time, however many items share them.
    start and end are characters of the lower-cased text with single blanks. Null and empty texts hold nothing; repeated
    rows are searched each; null doc_ids stay null; an empty table gives no rows. Other columns are ignored.
    """
    schema = "doc_id long, item_id long, edits int, start int, end int"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def searched(shared):
        def run(batches):
            index = shared()
            for batch in batches:
                ids, rows = batch.column("doc_id").to_pylist(), []
                for first, texts in _in_pieces(batch, "text"):
                    rows += [(ids[first + t], index.ids[i], *rest) for t, i, *rest in index.matches(texts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "edits", "start", "end"])

        return docs.mapInArrow(run, schema)

    found = [searched(shipped(docs.sparkSession, index)) for index in parts_of(benchmark, rate)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs, all their columns, that hold no passage of any item. Rows are judged where they are: no join, no shuffle.

    Null and empty texts hold nothing and stay; repeated rows are judged each; an empty table gives no rows.
    """
    at = docs.columns.index("text")
    schema = T.StructType(docs.schema.fields)

    def kept(df, shared):
        def run(batches):
            index = shared()
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, texts in _in_pieces(batch, at):
                    clean[[first + m[0] for m in index.matches(texts)]] = False
                yield batch.filter(pa.array(clean))

        return df.mapInArrow(run, schema)

    for index in parts_of(benchmark, rate):
        docs = kept(docs, shipped(docs.sparkSession, index))
    return docs


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
