"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded; filters of several widths slide over a window of SPAN
bytes; rectified maxima over the window feed a softmax over the languages. A
text is cut into windows that overlap by the widest filter less one, so no
byte sequence is missed; windows of many texts are run as one batch. The
text's probabilities are the mean of its windows', weighted by their bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import fold, joined_bytes, shipped, slices, spread, table

WIDTHS, FILTERS, EMBED = (2, 3, 4, 5), 8, 8
SPAN = 128
STEP = SPAN - max(WIDTHS) + 1
#: The bound of the training sample: texts of each language (those whose doc_id hashes lowest), places of each text,
#: and texts of all languages together, though every language has one.
MOST_TEXTS, MOST_WINDOWS, MOST_IN_ALL = 600, 4, 20_000
#: Languages whose list is broadcast; more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's category L; marks, digits and letter-like numbers are not."""
    return any(m[0].isalpha() for m in _WORD.finditer(text))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(m, SPAN) bytes with zeros beyond the text's end, the text of each window, and its number of bytes."""
    raw, begin = joined_bytes(texts, b"\0" * SPAN)
    size = np.diff(begin) - SPAN
    count = 1 + -(-np.maximum(0, size - SPAN) // STEP)
    owner = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[owner] + nth * STEP
    return np.lib.stride_tricks.sliding_window_view(raw, SPAN)[at], owner, np.minimum(SPAN, np.maximum(1, size[owner] - nth * STEP))


class Network:
    """table: (256, EMBED); kernels: width -> (width * EMBED, FILTERS); shift: (all filters,); out: (all filters, languages); bias."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.table = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.kernels = {w: rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.shift = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, max(1, len(languages)))).astype(np.float32)
        self.bias = np.zeros(max(1, len(languages)), np.float32)

    def _wide(self) -> np.ndarray:
        """All kernels as one matrix over the widest span, so that one product serves them all."""
        wide = np.zeros((max(WIDTHS) * EMBED, len(WIDTHS) * FILTERS), np.float32)
        for i, w in enumerate(WIDTHS):
            wide[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = self.kernels[w]
        return wide

    def pooled(self, x: np.ndarray, where: bool = False):
        """Maxima over the window of each filter, before shift and rectifier; with `where`, also their positions."""
        m = len(x)
        padded = np.zeros((m, SPAN + max(WIDTHS) - 1), np.uint8)
        padded[:, :SPAN] = x
        e = self.table[padded]
        views = np.lib.stride_tricks.sliding_window_view(e.reshape(m, -1), max(WIDTHS) * EMBED, axis=1)[:, ::EMBED]
        z = (views.reshape(m * SPAN, -1) @ self._wide()).reshape(m, SPAN, -1)
        if where:
            at = z.argmax(1)
            return np.take_along_axis(z, at[:, None], 1)[:, 0], at, padded
        return z.max(1)

    def probabilities(self, x: np.ndarray, piece: int = 192) -> np.ndarray:
        out = np.empty((len(x), len(self.bias)), np.float32)
        for k in range(0, len(x), piece):
            out[k : k + piece] = softmax(np.maximum(0, self.pooled(x[k : k + piece]) + self.shift) @ self.out + self.bias)
        return out

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The most likely language's number, and its probability, for each text."""
        x, owner, size = windows(texts)
        p = self.probabilities(x) * size[:, None]
        first = np.searchsorted(owner, np.arange(len(texts)))
        total = np.add.reduceat(p, first, axis=0) / np.add.reduceat(size, first)[:, None]
        best = total.argmax(1)
        return best, np.clip(total[np.arange(len(texts)), best].astype(np.float64), 0, 1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted mean cross-entropy of windows, by table, kernels, shift, out and bias: only the bytes at a filter's maximum take part."""
    z, at, padded = net.pooled(x, where=True)
    h = np.maximum(0, z + net.shift)
    p = softmax(h @ net.out + net.bias)
    p[np.arange(len(x)), y] -= 1
    p *= (weight / len(x))[:, None]
    dh = (p @ net.out.T) * (h > 0)
    table = np.zeros_like(net.table)
    kernels = []
    for j, w in enumerate(WIDTHS):
        kernel, cols = net.kernels[w], slice(j * FILTERS, (j + 1) * FILTERS)
        d = dh[:, cols]  # (windows, filters)
        grad = np.zeros_like(kernel)
        for o in range(w):
            seen = np.take_along_axis(padded, at[:, cols] + o, 1)
            part = kernel[o * EMBED : (o + 1) * EMBED]
            grad[o * EMBED : (o + 1) * EMBED] = np.einsum("mfe,mf->ef", net.table[seen], d)
            np.add.at(table, seen.ravel(), (d[:, :, None] * part.T[None]).reshape(-1, EMBED))
        kernels.append(grad)
    return [table, *kernels, dh.sum(0), h.T @ p, p.sum(0)]


def train(sample: list[tuple[bytes, str]], steps: int = 450, batch: int = 128, rate: float = 0.004, seed: int = 5) -> Network:
    """Adam on the cross-entropy of windows, each weighted so that languages count alike. One language or none needs no training."""
    net = Network(sorted({lang for _, lang in sample}), seed)
    if len(net.languages) < 2:
        return net
    x, owner, _ = windows([t for t, _ in sample])
    rng = np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(net.languages)}
    y = np.array([number[lang] for _, lang in sample])[owner]
    share = np.bincount(y, minlength=len(number))
    weight = (len(y) / len(number) / share)[y]
    params = [net.table, *net.kernels.values(), net.shift, net.out, net.bias]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    while step < steps:  # whole rounds over the sample, more of a small one
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            i = order[k : k + batch]
            step += 1
            for p, g, m in zip(params, gradients(net, x[i], y[i], weight[i]), moments, strict=True):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return net


def language_sample(docs: DataFrame, learn: Column, most: int = MOST_TEXTS) -> list[tuple[bytes, str]]:
    """(window, language): up to MOST_WINDOWS places, spread over the whole text, of at most `most` texts of each language, those whose doc_id hashes lowest.

    Every language of the rows is learnt. Of all together at most MOST_IN_ALL texts are taken, but one of each language
    at least. A place is SPAN characters long. Null texts, langs and ids take no part.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = langs.count()
    most = max(1, min(most, MOST_IN_ALL // max(1, n_langs)))
    # A hash bound for each language keeps about 1.5 times as many as are wanted; the rest go before anything is sorted.
    span = 1 << 32
    langs = langs.select("lang", F.least(F.lit(span), F.floor(F.lit(span) * ((1.5 * most + 50) / F.col("n")))).alias("bound"))
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(span))
    kept = rows.withColumn("key", key).join(F.broadcast(langs) if n_langs <= BROADCAST_LANGUAGES else langs, "lang").where("key < bound")
    # Place i of n lies in the i-th of n equal parts, at a hashed point.
    spare = F.greatest(F.length("text") - SPAN, F.lit(0))
    n = F.least(F.lit(MOST_WINDOWS), F.ceil(F.greatest(F.length("text"), F.lit(1)) / SPAN)).cast("int")
    point = lambda i: (i + F.pmod(F.xxhash64("key", i), F.lit(1000)) / 1000) / n
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", (F.floor(spare * point(i)) + 1).cast("int"), F.lit(SPAN)))
    out: dict[str, list] = {}
    for r in sorted(kept.select("key", "doc_id", "lang", places.alias("places")).collect(), key=lambda r: (r["key"], r["doc_id"], r["places"])):
        out.setdefault(r["lang"], []).append([(p.encode("utf-8", "replace"), r["lang"]) for p in r["places"]])
    return [x for lang in sorted(out) for places in out[lang][:most] for x in places]


def identify(docs: DataFrame, net: Network, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """docs with lang_pred and lang_score (0 to 1) for each row; repeated rows get them each, an empty table gives no rows.

    Null texts, and texts without a letter, are `und` with score 0. Without training texts every row is `und`.
    Columns of those names are replaced; others stay.
    """
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    at = docs.columns.index("text")
    sent = shipped(docs.sparkSession, net)  # of fixed size

    def run(batches):
        net = sent()
        for batch in batches:
            langs, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            for first, part in slices(batch, at, 1 << 20) if net.languages else ():
                texts = part.column(at).to_pylist()
                some = [i for i, t in enumerate(texts) if t is not None and has_letter(t)]
                if some:
                    for i, b, s in zip(some, *net.predict([texts[i].encode("utf-8", "replace") for i in some]), strict=True):
                        langs[first + i], scores[first + i] = net.languages[b], float(s)
            new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 3) == 1
    net = train(language_sample(docs, ~held))
    return identify(spread(docs.select("doc_id", "text")), net).select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
