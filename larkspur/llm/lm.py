"""Language-model scores by context-tree weighting over bytes.

Each byte is coded as eight binary decisions. A decision has a node for every
context depth 0..DEPTH: the preceding bytes of that depth and the bits already
known. A node predicts by the Krichevsky-Trofimov estimate of the bits counted
there, and the nodes from the deepest upwards are mixed with the weights of
context-tree weighting: the posterior probability that a node is a leaf of the
source's tree, 1/2 P_kt / P_w, where P_w = 1/2 P_kt + 1/2 prod P_w(children).

Counts cover all bytes of all training documents. They are summed as counts of
byte strings of DEPTH + 1, from which every node follows. Strings that only
scored texts have stand in the tree with counts of zero, which change no weight:
there the longest context that was counted speaks. From the root downwards every
node gets its mixed estimate by joins with all its parents, and every distinct
string its probability. The HEAD_GRAMS commonest strings travel in a bounded
broadcast, all others by a join; the list decides work, not results.

Beside it stands the base: words by their counts, add-one smoothed. Frequent
words travel in a bounded broadcast, all others by a join.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import commonest, fold, joined_bytes, removed, slices, spread, stored, table

DEPTH = 5
END = b"\xff"
#: Byte strings whose probabilities are broadcast; the others are joined.
HEAD_GRAMS = 1 << 22
#: Words whose counts are broadcast; the others are joined.
HEAD_WORDS = 1 << 18
#: Bytes of text that a task turns into byte strings at once: each takes some 150 bytes on the way.
PIECE = 1 << 19
FLUSH = 400_000


def pieces(batches, columns: list[str]):
    """Lists of column values, dealt anew so that a piece holds about PIECE bytes of text; text comes last, as bytes."""
    for batch in batches:
        for _, part in slices(batch, columns[-1], PIECE):
            cols = [part.column(c).to_pylist() for c in columns]
            cols[-1] = [(x or b"").lower() for x in cols[-1]]  # bytes.lower() changes A-Z alone
            yield cols


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings of DEPTH + 1 bytes that end at each byte and at the end mark of each text, and where each text's begin.

    Before a text stand DEPTH end marks, after it one: END is a byte that UTF-8 has nowhere, so no text holds it.
    """
    raw, begin = joined_bytes(texts, END * DEPTH)
    raw = np.concatenate([np.frombuffer(END * DEPTH, np.uint8), raw])
    n = len(raw) - DEPTH
    g = np.zeros(n, np.uint64)
    for k in range(DEPTH + 1):
        g = (g << np.uint64(8)) | raw[k : n + k]
    keep = np.ones(n, bool)
    for k in range(1, DEPTH):  # of the gap only the first byte is the text's end
        keep[begin[1:] - DEPTH + k] = False
    return g[keep], begin[:-1] - (DEPTH - 1) * np.arange(len(texts))


def _counted(batches):
    words, held, n_held, docs = Counter(), [], 0, 0

    def out(word, gram, n, m):
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(gram, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["word", "gram", "n", "m"])

    def merged():
        g, at = np.unique(np.concatenate([x for x, _, _ in held]), return_inverse=True)
        n, m = (np.bincount(at, np.concatenate([x[k] for x in held])).astype(np.int64) for k in (1, 2))
        return g, n, m

    def flushed():
        keys = list(words)
        counts = [words[k] for k in keys]
        words.clear()
        for k in range(0, len(keys), 20_000):
            part = [x.decode("utf-8", "replace") for x in keys[k : k + 20_000]]
            yield out(part, [None] * len(part), counts[k : k + 20_000], counts[k : k + 20_000])

    for learn, texts in pieces(batches, ["learn", "text"]):
        learned = [x for x, y in zip(texts, learn, strict=True) if y]
        docs += len(learned)
        for x in learned:
            words.update(x.split())
        if len(words) > FLUSH:
            yield from flushed()
        for some, counted in ((learned, True), ([x for x, y in zip(texts, learn, strict=True) if not y], False)):
            if some:
                g, m = np.unique(grams(some)[0], return_counts=True)
                held.append((g, m if counted else np.zeros_like(m), m))
                n_held += len(g)
        if n_held > 4 * FLUSH:
            held = [merged()]
            n_held = len(held[0][0])
            if n_held > 2 * FLUSH:
                yield from _sent(*held[0], out)
                held, n_held = [], 0
    if docs:
        words[b""] += docs  # the end token; no word is empty
    yield from flushed()
    if held:
        yield from _sent(*merged(), out)


def _sent(g, n, m, out):
    for k in range(0, len(g), 20_000):
        part = g[k : k + 20_000].astype(np.int64)
        yield out([None] * len(part), part, n[k : k + 20_000], m[k : k + 20_000])


def counts(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """(word, gram, n, m): n of each word (the empty one is the end token) and each byte string over the texts to learn from (all, if not told).

    m counts the byte strings of all docs; those that only other texts have are there with n = 0.
    """
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    return (
        docs.select(learn.alias("learn"), F.col("text").cast("string").cast("binary").alias("text"))
        .mapInArrow(_counted, "word string, gram long, n long, m long")
        .groupBy("word", "gram")
        .agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    )


# -- the tree --------------------------------------------------------------


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - np.log(np.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence; x >= 1/2."""
    x = np.asarray(x, np.float64)
    down = np.zeros_like(x)
    for k in range(8):
        down += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - down


def _nodes(frames):
    """The eight decisions of each byte string: context, node (a leading one and the known bits), counts of 0 and 1."""
    for frame in frames:
        g, n = frame["gram"].to_numpy(), frame["n"].to_numpy()
        ctx, byte = g >> 8, g & 255
        for j in range(8):
            bit = (byte >> (7 - j)) & 1
            yield pd.DataFrame({"ctx": ctx, "node": ((1 << j) | (byte >> (8 - j))).astype(np.int32), "n0": np.where(bit == 0, n, 0), "n1": np.where(bit == 1, n, 0)})


def _weighed(depth: int, deepest: bool):
    def run(frames):
        for f in frames:
            kt = log_kt(f["n0"].to_numpy(np.float64), f["n1"].to_numpy(np.float64))
            # log(1/2 P_kt + 1/2 prod P_w(children)); at the full depth a node is a leaf
            log_pw = kt if deepest else np.logaddexp(kt, f["below"].to_numpy()) - np.log(2)
            weight = np.ones(len(f)) if deepest else np.exp(np.minimum(0.0, kt - np.log(2) - log_pw))
            yield pd.DataFrame({"depth": depth, "ctx": f["ctx"], "node": f["node"], "n0": f["n0"], "n1": f["n1"], "log_pw": log_pw, "weight": weight})

    return run


def levels(gram_counts: DataFrame) -> list[DataFrame]:
    """The nodes of the weighted tree by depth: depth, ctx, node, n0, n1, log_pw, weight. Depth by depth, children sum into parents."""
    schema = "depth int, ctx long, node int, n0 long, n1 long, log_pw double, weight double"
    sums = [F.sum("n0").alias("n0"), F.sum("n1").alias("n1")]
    rows = gram_counts.mapInPandas(_nodes, "ctx long, node int, n0 long, n1 long").groupBy("ctx", "node").agg(*sums)
    level = stored(rows.mapInPandas(_weighed(DEPTH, True), schema), "tree")
    out = [level]
    for depth in range(DEPTH - 1, -1, -1):
        # The byte farthest back stands highest; without it remains the parent's context.
        up = level.withColumn("ctx", F.col("ctx").bitwiseAND((1 << (8 * depth)) - 1)).groupBy("ctx", "node")
        level = stored(up.agg(*sums, F.sum("log_pw").alias("below")).mapInPandas(_weighed(depth, False), schema), "tree")
        out.insert(0, level)
    return out


def tree(gram_counts: DataFrame) -> DataFrame:
    """All nodes of the weighted tree in one table."""
    whole, *rest = levels(gram_counts)
    for level in rest:
        whole = whole.unionByName(level)
    return whole


# -- probabilities of the byte strings ----------------------------------------


def _estimated(level: DataFrame) -> DataFrame:
    """ctx, node, p, past, left of a level with its parents' p, past, left.

    p is the mixed estimate if no longer context is known; past + left * (a child's estimate) is what a child makes of it.
    A node without counts has its parent's p.
    """
    kt = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    return level.select(
        "ctx",
        "node",
        F.when(F.col("n0") + F.col("n1") > 0, F.col("past") + F.col("left") * kt).otherwise(F.col("p")).alias("p"),
        (F.col("past") + F.col("left") * F.col("weight") * kt).alias("past"),
        (F.col("left") * (1 - F.col("weight"))).alias("left"),
    )


def _valued(batches):
    """Of rows ordered by (ctx, node), where node is a node with its estimate x or 256 + a byte with its count x, the bytes' strings."""
    held = None

    def found(t):
        ctx, node, x = (t.column(k).to_numpy() for k in ("ctx", "node", "x"))
        key = (ctx << 9) | node
        at = np.flatnonzero(node >= 256)
        ctx, byte, m = ctx[at], node[at].astype(np.int64) - 256, x[at].astype(np.int64)
        total = np.zeros(len(at))
        for j in range(8):
            p = x[np.searchsorted(key, (ctx << 9) | (1 << j) | (byte >> (8 - j)))]
            total += np.log10(np.where((byte >> (7 - j)) & 1 == 1, p, 1 - p))
        return pa.RecordBatch.from_arrays([pa.array((ctx << 8) | byte), pa.array(total), pa.array(m)], ["gram", "value", "m"])

    for batch in batches:
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        t = t.combine_chunks()
        if not t.num_rows:
            continue
        ctx = t.column("ctx").to_numpy()
        cut = int(np.searchsorted(ctx, ctx[-1]))  # the last context may go on; it has 511 rows at most
        if cut:
            yield found(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield found(held)


def probabilities(gram_counts: DataFrame) -> DataFrame:
    """(gram, value, m) of each byte string of gram_counts (gram, n, m): log10 of the probability of its last byte given those before it. Stored."""
    whole = levels(gram_counts.select("gram", "n"))
    above = {"p": F.lit(0.5), "past": F.lit(0.0), "left": F.lit(1.0)}
    known = _estimated(whole[0].withColumns(above))
    for depth, level in enumerate(whole[1:]):
        # A node has at most 256 children: no key is hot.
        up = known.withColumnRenamed("ctx", "up")
        known = _estimated(level.withColumn("up", F.col("ctx").bitwiseAND((1 << (8 * depth)) - 1)).join(up, ["up", "node"]))
    strings = gram_counts.select(F.shiftright("gram", 8).alias("ctx"), (F.col("gram").bitwiseAND(255) + 256).cast("int").alias("node"), F.col("m").cast("double").alias("x"))
    rows = known.select("ctx", "node", F.col("p").alias("x")).union(strings)
    out = stored(rows.repartition("ctx").sortWithinPartitions("ctx", "node").mapInArrow(_valued, "gram long, value double, m long"), "values")
    for level in whole:
        removed(level)
    return out


def head_of(values: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest byte strings (ascending), at most HEAD_GRAMS, and their values."""
    found = commonest(values, "m", "gram", HEAD_GRAMS, part=False).select("gram", F.col("value").cast("float").alias("value")).toArrow()
    g, v = found.column("gram").to_numpy().astype(np.uint64), found.column("value").to_numpy()
    order = np.argsort(g)
    return g[order], v[order]


class Scorer:
    """Values of byte strings, NaN for those that are not broadcast. Keeps the ones seen, so that each is sought about once in a task; the memory is of fixed size."""

    BITS = 20

    def __init__(self, head: tuple[np.ndarray, np.ndarray]):
        self.head = head
        self.keys = np.full(1 << self.BITS, np.uint64(1 << 63), np.uint64)
        self.values = np.zeros(1 << self.BITS, np.float32)

    def __call__(self, g: np.ndarray) -> np.ndarray:
        at = ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = self.values[at].astype(np.float64)
        missed = np.flatnonzero(self.keys[at] != g)
        if len(missed):
            new, inverse = np.unique(g[missed], return_inverse=True)
            values = self.sought(new)
            out[missed] = values[inverse]
            where = ((new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)
            self.keys[where], self.values[where] = new, values
            clash = self.keys[where] != new  # several new ones for one slot: the last stays, whole
            if clash.any():
                last = dict(zip(where.tolist(), range(len(where)), strict=True))
                keep = np.fromiter(last.values(), np.int64, len(last))
                self.keys[where[keep]], self.values[where[keep]] = new[keep], values[keep]
        return out

    def sought(self, g: np.ndarray) -> np.ndarray:
        known, values = self.head
        if not len(known):
            return np.full(len(g), np.nan)
        at = np.minimum(np.searchsorted(known, g), len(known) - 1)
        return np.where(known[at] == g, values[at], np.nan)


# -- scores ----------------------------------------------------------------

PER_DOC = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("head_known", pa.int64()), ("head_sum", pa.float64()), ("score", pa.float64()), ("tail", pa.list_(pa.string())), ("tail_n", pa.list_(pa.int32())), ("rare", pa.list_(pa.int64())), ("rare_n", pa.list_(pa.int32()))])


def rare_of(g: np.ndarray, begin: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct byte strings without a value and how often it has each."""
    at = np.flatnonzero(np.isnan(values))
    doc, g = np.searchsorted(begin, at, side="right") - 1, g[at].astype(np.int64)
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])])) if len(g) else np.empty(0, np.int64)
    times = np.diff(np.append(new, len(g)))
    cut = np.searchsorted(doc[new], np.arange(len(begin) + 1))
    return [(g[new[a:b]], times[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _scored(model, head):
    def run(batches):
        from pyspark import TaskContext

        score, known = Scorer(model.value), head.value
        row = TaskContext.get().partitionId() << 36
        for ids, texts in pieces(batches, ["doc_id", "text"]):
            g, begin = grams(texts)
            values = score(g)
            rare = rare_of(g, begin, values)
            sums = np.add.reduceat(np.nan_to_num(values), begin)
            rows = []
            for doc_id, x, s, (r, r_n) in zip(ids, texts, sums.tolist(), rare, strict=True):
                words = x.split()
                words.append(b"")
                logs = [known.get(w) for w in words]
                rest = Counter(w.decode("utf-8", "replace") for w, v in zip(words, logs, strict=True) if v is None) if None in logs else {}
                logs = [v for v in logs if v is not None]
                rows.append((row, doc_id, len(words), len(x), len(logs), float(sum(logs)), s, list(rest), list(rest.values()), r, r_n))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PER_DOC, strict=True)], schema=PER_DOC)

    return run


def score_texts(docs: DataFrame, learn: Column) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    learn: the condition on doc_id for the rows to learn from. score: log10 of the model's probability of the
    text's bytes (A-Z lower-cased) and its end. base_score: sum over words and end of log10((c + 1) / (N + V + 1)).
    Null texts are empty: their one token is the end. Null ids and repeated rows are scored like any other; without
    training rows every decision has probability 1/2 and N = V = 0. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    counted = stored(counts(docs, learn), "counts")
    words = counted.where("word IS NOT NULL").select("word", "n")
    values = probabilities(counted.where("gram IS NOT NULL").select("gram", "n", "m"))
    model = head_of(values)
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = commonest(words.where("n > 0"), "n", "word", HEAD_WORDS).toArrow()
    logs = np.log10(top.column("n").to_numpy().astype(np.float64) + 1)
    head = {w.encode(): x for w, x in zip(top.column("word").to_pylist(), logs.tolist(), strict=True)}
    sc = spark.sparkContext
    schema = "row long, doc_id long, n_tokens long, n_bytes long, head_known long, head_sum double, score double, tail array<string>, tail_n array<int>, rare array<long>, rare_n array<int>"
    scored = stored(docs.mapInArrow(_scored(sc.broadcast(model), sc.broadcast(head)), schema), "scored")
    tail = scored.where(F.size("tail") > 0).select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("k"))
    # A word is here at most once for each document, and the frequent ones are not here: no key is hot.
    known = tail.join(words, "word").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("tail_sum"), F.sum("k").alias("tail_known"))
    rare = scored.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("t")).select("row", F.col("t.rare").alias("gram"), F.col("t.rare_n").alias("k"))
    rare = rare.join(values.select("gram", "value"), "gram").groupBy("row").agg(F.sum(F.col("k") * F.col("value")).alias("rare_sum"))
    whole = float(n + v + 1)
    score = F.col("score") + F.coalesce("rare_sum", F.lit(0.0))
    return (
        scored.drop("tail", "tail_n", "rare", "rare_n")
        .join(known, "row", "left")
        .join(rare, "row", "left")
        .select(
            "doc_id",
            "n_tokens",
            (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
            F.lit(int(n)).cast("long").alias("train_tokens"),
            (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(whole))).alias("base_score"),
            score.alias("score"),
            (-score * F.log2(F.lit(10.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
        )
    )


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), fold(F.col("doc_id"), 7) != 2)
    return out.withColumn("held_out", fold(F.col("doc_id"), 7) == 2)
