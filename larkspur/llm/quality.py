"""Document quality by a linear-chain conditional random field over lines.

Every line gets features of its own (shape, symbols, repetition) and those of
the lines before and after it. A chain of two states, bad and good, is trained
by maximum likelihood with forward-backward; a training document's lines carry
its label. A document's quality is the mean of its lines' marginals of good,
weighted by their lengths, put on a probability scale by a logistic curve that
is fitted on the training documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import fold, joined_bytes, label_sample, mix64, shipped, spread, table, trained
from larkspur.llm.toxicity import scored_with

#: The bound of the training sample: labelled documents, those whose doc_id hashes lowest.
MOST_LABELLED = 3000
THRESHOLD = 0.5

_KINDS = ("letter", "upper", "digit", "stop", "mark", "symbol", "pipe", "blank", "wide")


def _classes() -> np.ndarray:
    """For each byte a mask of its kinds."""
    kind = np.zeros(256, np.uint16)
    bit = {k: 1 << i for i, k in enumerate(_KINDS)}
    for b in range(256):
        c = chr(b)
        if b < 128:
            kind[b] |= bit["letter"] * c.isalpha() | bit["upper"] * c.isupper() | bit["digit"] * c.isdigit()
            kind[b] |= bit["stop"] * (c in ".,;:?'\"-()") | bit["mark"] * (c == "!") | bit["pipe"] * (c == "|") | bit["blank"] * c.isspace()
            kind[b] |= bit["symbol"] * (c in "#$%&*+/<=>@[\\]^_`{}~")
        elif b >= 0xC0:  # one for each character beyond ASCII
            kind[b] |= bit["letter"] | bit["wide"]
    return kind


CLASSES = _classes()
#: Own features of a line, in order.
FEATURES = (
    *(f"share of {k}" for k in _KINDS),
    "log length", "log words", "word length", "adjacent equal words", "distinct words", "ends a sentence", "starts upper", "same as line before", "symbols ending words", "empty",
)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, features), bytes of each line, and lines of each text. A text has one line at least; an empty one is an empty line."""
    raw, begin = joined_bytes(texts, b"\n")
    if not len(texts):
        return np.empty((0, len(FEATURES))), np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    text_of = np.searchsorted(begin, starts, side="right") - 1
    size = ends - starts
    masks = CLASSES[raw]
    n = np.maximum(1, size)
    shares = []
    for i in range(len(_KINDS)):
        total = np.concatenate([[0], np.cumsum((masks >> i) & 1, dtype=np.int64)])
        shares.append((total[ends] - total[starts]) / n)
    # Words, each with a hash of its bytes, lower-cased and without end punctuation.
    blank = (masks >> _KINDS.index("blank")) & 1
    edge = np.diff(np.concatenate([[1], blank, [1]]).astype(np.int8))
    w0, w1 = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    line_of = np.searchsorted(starts, w0, side="right") - 1
    lower = raw | np.where((raw >= 65) & (raw <= 90), 32, 0).astype(np.uint8)
    code = np.where((masks >> _KINDS.index("letter")) & 1 | (raw >= 128), lower, 0).astype(np.uint64)
    place = np.arange(len(raw), dtype=np.uint64) - _places(w0, len(raw))
    hashed = np.where(code > 0, mix64(code | place << np.uint64(8)), 0).astype(np.uint64)
    hashed = np.concatenate([[np.uint64(0)], np.cumsum(hashed, dtype=np.uint64)])
    word = hashed[w1] - hashed[w0]
    words = np.bincount(line_of, minlength=len(starts))
    same = (word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])
    equal = np.bincount(line_of[1:][same], minlength=len(starts))
    order = np.lexsort((word, line_of))
    new = np.ones(len(order), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
    distinct = np.bincount(line_of[order][new], minlength=len(starts))
    odd_end = np.bincount(line_of, ((masks[w1 - 1] >> _KINDS.index("symbol")) & 1) | ((masks[w1 - 1] >> _KINDS.index("mark")) & 1), minlength=len(starts)) if len(w0) else np.zeros(len(starts))
    total = np.concatenate([[0], np.cumsum(np.bincount(line_of, (word & np.uint64(0xFFFFF)).astype(np.float64), minlength=len(starts)))])
    line_hash = np.diff(total)
    again = np.zeros(len(starts))
    again[1:] = (line_hash[1:] == line_hash[:-1]) & (size[1:] == size[:-1]) & (text_of[1:] == text_of[:-1]) & (size[1:] > 0)
    last, head = raw[np.maximum(starts, ends - 1)], raw[starts]
    m = np.maximum(1, words)
    own = np.stack(
        [
            *shares, np.log1p(size), np.log1p(words), np.minimum(40, size / m), equal / m, np.where(words > 0, distinct / m, 1),
            np.isin(last, list(b".!?")) * 1.0, ((head >= 65) & (head <= 90)) * 1.0, again, odd_end / m, (size == 0) * 1.0,
        ],
        axis=1,
    )
    return own, size, np.bincount(text_of, minlength=len(texts))


def _places(w0: np.ndarray, n: int) -> np.ndarray:
    """For each byte the start of the word at or before it."""
    out = np.zeros(n, np.uint64)
    out[w0] = w0
    return np.maximum.accumulate(out)


def with_neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features, those of its neighbours in the text (zeros beyond the ends), and one."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    first = np.cumsum(lines) - lines
    before[first], after[first + lines - 1] = 0, 0
    return np.concatenate([own, before, after, np.ones((len(own), 1))], axis=1)


def emissions(own: np.ndarray, theta: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """with_neighbours(own, lines) @ theta, without the matrix thrice as wide: a text of very many lines stays small."""
    w = own.shape[1]
    out = own @ theta[:w] + theta[3 * w]
    before, after = own @ theta[w : 2 * w], own @ theta[2 * w : 3 * w]
    first = np.cumsum(lines) - lines
    last = first + lines - 1
    inner = np.ones(len(own), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    out[at] += before[at - 1]
    inner[first], inner[last] = True, False
    at = np.flatnonzero(inner)
    out[at] += after[at + 1]
    return out


def forward_backward(emit: np.ndarray, trans: np.ndarray, lines: np.ndarray):
    """Marginals (lines, 2), sums over pairs of neighbours (2, 2), and the log partition of each text.

    All texts advance together, line by line; those that have ended drop out, so the work is that of the lines.
    """
    first = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    first, count = first[order], lines[order]
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    alive = np.searchsorted(-count, -np.arange(int(count.max(initial=0))), side="left") if len(count) else np.empty(0, int)
    alpha[first] = emit[first]
    for t in range(1, len(alive)):
        at = first[: alive[t]] + t
        prev = alpha[at - 1]
        alpha[at] = emit[at] + np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1])
    for t in range(len(alive) - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        nxt = emit[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
    last = np.cumsum(lines) - 1
    log_z = np.logaddexp(alpha[last, 0], alpha[last, 1])
    z = np.repeat(log_z, lines)
    marginal = np.exp(alpha + beta - z[:, None])
    inner = np.ones(len(emit), bool)
    inner[np.cumsum(lines) - lines] = False
    at = np.flatnonzero(inner)
    pair = np.exp(alpha[at - 1][:, :, None] + trans[None] + (emit[at] + beta[at])[:, None, :] - z[at][:, None, None])
    return marginal, pair.sum(0), log_z


class Field:
    """mean, scale: of own features; theta: (features, 2); trans: (2, 2); curve: slope and offset of the document's logistic."""

    def __init__(self, mean, scale, theta, trans, curve):
        self.mean, self.scale, self.theta, self.trans, self.curve = mean, scale, theta, trans, curve

    def inputs(self, texts: list[bytes]):
        own, size, lines = line_features(texts)
        return np.clip((own - self.mean) / self.scale, -4, 4), size, lines

    def line_marginals(self, texts: list[bytes]):
        own, size, lines = self.inputs(texts)
        return forward_backward(emissions(own, self.theta, lines), self.trans, lines)[0][:, 1], size, lines

    def mean_marginal(self, texts: list[bytes]) -> np.ndarray:
        """The length-weighted mean of the marginals of good: an empty line weighs one byte."""
        good, size, lines = self.line_marginals(texts)
        first = np.cumsum(lines) - lines
        weight = size + 1.0
        return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        m = np.clip(self.mean_marginal(raw), 1e-6, 1 - 1e-6) if raw else np.empty(0)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(m / (1 - m)) + self.curve[1])))


def train(sample: list[tuple[str, int]], steps: int = 120, rate: float = 0.05, decay: float = 1e-3) -> Field:
    """Maximum likelihood by Adam. With no labelled text, or one class only, scores are constant: the share of ones."""
    texts = [t.encode("utf-8", "replace") for t, _ in sample]
    y = np.array([label for _, label in sample], np.int64)
    width = len(FEATURES)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Field(np.zeros(width), np.ones(width), np.zeros((3 * width + 1, 2)), np.zeros((2, 2)), (0.0, np.log(share / (1 - share))))
    own, _, _ = line_features(texts)
    field = Field(own.mean(0), own.std(0) + 1e-3, np.zeros((3 * width + 1, 2)), np.zeros((2, 2)), (1.0, 0.0))
    own, size, lines = field.inputs(texts)
    x = with_neighbours(own, lines)
    label = np.repeat(y, lines)
    # Classes count alike, and so do documents, however many lines they have.
    per_text = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) / lines
    weight = np.repeat(per_text, lines)[:, None]
    told = np.eye(2)[label]
    inner = np.ones(len(label), bool)
    inner[np.cumsum(lines) - lines] = False
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (label[inner], label[inner]), 1)
    params = [field.theta, field.trans]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, steps + 1):
        marginal, pair, _ = forward_backward(x @ field.theta, field.trans, lines)
        grads = [x.T @ ((marginal - told) * weight) + decay * field.theta, (pair - pairs) / max(1, inner.sum()) + 0.05 * field.trans]
        for p, g, m in zip(params, grads, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    m = np.clip(field.mean_marginal(texts), 1e-6, 1 - 1e-6)
    logit, slope, offset = np.log(m / (1 - m)), 1.0, 0.0
    for _ in range(50):  # Newton's method for the two numbers of the logistic curve, slightly held back
        p = 1 / (1 + np.exp(-np.clip(slope * logit + offset, -40, 40)))
        r, h = p - y, p * (1 - p) + 1e-9
        g = np.array([r @ logit + 0.1 * (slope - 1), r.sum()])
        hess = np.array([[h @ logit**2 + 0.1, h @ logit], [h @ logit, h.sum() + 1e-6]])
        slope, offset = np.array([slope, offset]) - np.clip(np.linalg.solve(hess, g), -1, 1)
    field.curve = (max(0.0, slope), offset)
    return field


def score_quality(docs: DataFrame, field: Field) -> DataFrame:
    """docs with quality_score (0 to 1) for each row; null and empty texts are one empty line. A column of that name is replaced."""
    return scored_with(docs, "quality_score", shipped(docs.sparkSession, field))  # of fixed size


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MOST_LABELLED) -> Field:
    """Train on at most `most` labelled documents for which `learn` (a condition on doc_id) holds."""
    return trained(label_sample(docs, labels, "quality", learn, most), train)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held = fold(F.col("doc_id"), 3) == 1
    field = fit(docs, table(spark, sf_dir, "labels"), ~held)
    return score_quality(docs, field).select(
        "doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted")
    )
