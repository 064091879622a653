"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the average of the embeddings of its character n-grams (3 to 6
bytes of the lower-cased word in angle brackets, and the word itself), hashed
into a fixed number of rows; a window of words is the average of its words; a
linear softmax of two classes reads the window. Embeddings and softmax are
trained jointly, by gradient descent with momentum. A misspelt word shares most n-gram vectors with the
one it comes from.

A text is as toxic as its most toxic window of WINDOW words, so that one
passage counts alike in short and in very long texts. Training takes, for each
text, the gradient of that window.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import fold, label_sample, mix64, shipped, slices, spread, table, trained

SIZES = (3, 4, 5, 6)
BUCKET_BITS = 16
WIDTH = 8
WINDOW, STEP = 8, 4
#: The bound of the training sample: labelled documents, those whose doc_id hashes lowest.
MOST_LABELLED = 6000
THRESHOLD = 0.3
PIECE = 10_000
#: Occurrences in texts of the sample that an n-gram must have to be learnt.
LEAST_TEXTS = 24


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding for each word: bucket numbers, and the word that each belongs to (ascending)."""
    raw = [f"<{w}>".encode("utf-8", "replace") for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    begin = np.concatenate([[0], np.cumsum(size)])
    x = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), size)
    place = np.arange(len(x), dtype=np.uint64) - begin[owner].astype(np.uint64)
    whole = np.add.reduceat(mix64(x | place << np.uint64(8)), begin[:-1]) if len(raw) else np.empty(0, np.uint64)
    buckets, owners = [whole], [np.arange(len(raw))]
    for n in SIZES:
        if len(x) < n:
            continue
        g = np.zeros(len(x) - n + 1, np.uint64)
        for k in range(n):
            g |= x[k : len(x) - n + 1 + k] << np.uint64(8 * k)
        inside = owner[: len(g)] == owner[n - 1 :]
        buckets.append(g[inside] | np.uint64(n << 56))
        owners.append(owner[: len(g)][inside])
    bucket, own = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return (mix64(bucket[order]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), own[order]


def windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and word count of each window of texts of n words laid end to end, and each text's first window."""
    count = 1 + -(-np.maximum(0, n - WINDOW) // STEP)
    first = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(n)), count)
    begin = np.concatenate([[0], np.cumsum(n)])
    start = begin[owner] + np.minimum(STEP * (np.arange(first[-1]) - first[owner]), np.maximum(0, n[owner] - WINDOW))
    return start, np.minimum(WINDOW, n)[owner], first[:-1]


def _means(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[start + size] - total[start]) / np.maximum(1, size)


class Model:
    """embed: (2**BUCKET_BITS, WIDTH); out: (WIDTH, 2); bias: (2,)."""

    def __init__(self, embed, out, bias):
        self.embed, self.out, self.bias = embed, out, bias

    def word_logits(self, words: list[str]) -> np.ndarray:
        """Of each word its part in the log odds of class 1, before averaging over a window."""
        bucket, owner = subwords(words)
        row = self.embed @ (self.out[:, 1] - self.out[:, 0])
        return np.bincount(owner, row[bucket], len(words)) / np.maximum(1, np.bincount(owner, minlength=len(words)))

    def scorer(self):
        """A function of texts to scores that remembers the words it has met; the memory is cleared when full."""
        known: dict[str, float] = {}
        bias = float(self.bias[1] - self.bias[0])

        def score(texts: list[str | None]) -> np.ndarray:
            lists = [words_of(t) for t in texts]
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = [w for ws in lists for w in ws]
            values = list(map(known.get, flat))
            if None in values:
                new = list({w for w, v in zip(flat, values, strict=True) if v is None})
                if len(known) > 300_000:
                    known.clear()
                    new = list(set(flat))
                for k in range(0, len(new), 50_000):
                    part = new[k : k + 50_000]
                    known.update(zip(part, self.word_logits(part).tolist(), strict=True))
                values = list(map(known.get, flat))
            start, size, first = windows(n)
            logit = _means(np.array(values, np.float64), start, size) + bias
            top = np.maximum.reduceat(logit, first) if len(texts) else logit
            return 1 / (1 + np.exp(-np.clip(top, -500, 500)))

        return score


def train(sample: list[tuple[str, int]], averaged: int = 30, steps: int = 90, rate: float = 0.02, seed: int = 11) -> Model:
    """Fit embeddings and softmax jointly. Without labelled texts, or with one class only, scores are constant: the share of ones.

    The first `averaged` steps read the average of the whole text, which finds the n-grams that the positive texts
    have in common; the rest read its highest window. A row's step is its gradient over its curvature, with
    momentum, so that common and rare n-grams move at one pace.
    """
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1e-3, (1 << BUCKET_BITS, WIDTH))
    out = rng.normal(0, 0.5, (WIDTH, 2))
    y = np.array([label for _, label in sample], np.float64)
    if not len(y) or y.min() == y.max() or not any(map(words_of, (t for t, _ in sample))):
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return Model(embed * 0, out, np.array([0.0, math.log(share / (1 - share))]))
    # Words become numbers text by text, and n-grams are kept in pieces of small integers: the driver's memory is small.
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32) for t, _ in sample]
    n, token, size_v = np.array([len(i) for i in ids]), np.concatenate(ids), len(vocabulary)
    names, parts = list(vocabulary), []
    del vocabulary, ids
    for k in range(0, size_v, PIECE):
        bucket, owner = subwords(names[k : k + PIECE])
        parts.append((slice(k, min(size_v, k + PIECE)), bucket.astype(np.int32), owner.astype(np.int32)))
    del names
    share = np.concatenate([1 / np.maximum(1, np.bincount(o, minlength=at.stop - at.start)) for at, _, o in parts])

    def down(row: np.ndarray) -> np.ndarray:
        """From values of rows to averages of words."""
        return np.concatenate([np.bincount(o, row[b], at.stop - at.start) for at, b, o in parts]) * share

    def up(word: np.ndarray) -> np.ndarray:
        """From values of words to sums of rows."""
        total = np.zeros(len(embed))
        for at, b, o in parts:
            total += np.bincount(b, word[at][o], len(embed))
        return total

    start, size, first = windows(n)
    text_of = np.repeat(np.arange(len(n)), np.diff([*first, len(start)]))
    pair, times = np.unique(np.repeat(np.arange(len(n)), n) * size_v + token.astype(np.int64), return_counts=True)
    bias = np.array([0.0, math.log(y.mean() / (1 - y.mean()))])
    speed, curve = np.zeros(len(embed)), np.zeros(len(embed))
    for step in range(steps):
        delta = out[:, 1] - out[:, 0]
        word = down(embed @ delta)
        if step < averaged:
            text, which = pair // size_v, pair % size_v
            weight = times / n[text]
            logit = np.bincount(text, word[which] * weight, len(n))
        else:
            means = _means(word[token], start, size)
            logit = np.maximum.reduceat(means, first)
            best, hit = np.full(len(n), len(means)), np.flatnonzero(means == logit[text_of])
            np.minimum.at(best, text_of[hit], hit)
            each = size[best]
            text = np.repeat(np.arange(len(n)), each)
            which = token[np.repeat(start[best] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))]
            weight = 1 / each[text]
        miss = 1 / (1 + np.exp(-np.clip(logit + bias[1] - bias[0], -50, 50))) - y
        grad = up(np.bincount(which, miss[text] * weight, size_v) * share)
        if step in (0, averaged) or step % 10 == 0:
            curve = up(np.bincount(which, weight**2, size_v) * share**2) + 1e-12
            # Rows that fewer texts need stay as they are: what occurs once or twice would be learnt by heart.
            curve[up(np.bincount(which, minlength=size_v).astype(float)) < LEAST_TEXTS] = np.inf
        speed = 0.9 * speed + grad / curve
        slope = embed.T @ grad
        embed -= rate * speed[:, None] * (delta / (delta @ delta))
        out += rate * np.outer(slope, [1, -1]) / (np.abs(slope).max() + 1e-12) * 0.1
        bias += np.array([0.5, -0.5]) * rate * miss.mean()
    return Model(embed, out, bias)


def score_toxicity(docs: DataFrame, model: Model, name: str = "toxic_score") -> DataFrame:
    """docs with toxic_score (0 to 1) for each row; null and empty texts get the score of no words. A column of that name is replaced.

    Very long texts are read to their end; repeated rows are scored each; an empty table gives no rows.
    """
    sent = shipped(docs.sparkSession, model)  # of fixed size
    return scored_with(docs, name, lambda: sent().scorer())


def scored_with(docs: DataFrame, name: str, make) -> DataFrame:
    """docs and a double column: make() gives, once in each task, a function of a list of texts to scores."""
    from pyspark.sql import types as T

    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches):
        score = make()
        for batch in batches:
            done = [score(part.column(at).to_pylist()) for _, part in slices(batch, at, 1 << 20)]
            new = pa.array(np.concatenate(done) if done else np.empty(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MOST_LABELLED) -> Model:
    """Train on at most `most` labelled documents for which `learn` (a condition on doc_id) holds."""
    return trained(label_sample(docs, labels, "toxic", learn, most), train)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held = fold(F.col("doc_id"), 4) == 2
    model = fit(docs, table(spark, sf_dir, "labels"), ~held)
    return score_toxicity(docs, model).select(
        "doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted")
    )
