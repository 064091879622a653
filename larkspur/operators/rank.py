"""BM25 ranking over an index: both profiles, boosts, deterministic top-k."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.binding import computed, let
from larkspur.functions.text import QUERY_TOKENS, ascii_tokens, occurrences, unicode_tokens
from larkspur.operators.constraints import BROADCAST_ROWS
from larkspur.operators.index import Index
from larkspur.operators.lineage import cut

K1, B = 1.2, 0.75
TITLE_BOOST, URL_BOOST = 0.25, 0.10


def parameters(k1: float, b: float) -> tuple[float, float]:
    """k1 and b as they are used: defaults for what is not finite or out of range."""
    return (k1 if math.isfinite(k1) and k1 > 0 else K1), (b if math.isfinite(b) and 0 <= b <= 1 else B)


def bm25(tf: Column, df: Column, length: Column, n_docs: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """0 for no occurrences, no tokens or no documents; an average length of 0 counts as 1."""
    tf, df, length, n = (x.cast("double") for x in (tf, df, length, n_docs))
    average = F.when(avgdl > 0, avgdl).otherwise(1.0)
    score = F.log1p((n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
    return F.when((tf > 0) & (length > 0) & (n > 0), score).otherwise(0.0)


def query_tokens(profile: str, query: str) -> Column:
    """The query's tokens; in the unicode profile each counts once, and the first QUERY_TOKENS are read."""
    text = F.lit(query)
    return ascii_tokens(text) if profile == "ascii" else F.array_distinct(unicode_tokens(text, QUERY_TOKENS))


def query_terms(index: Index, query: str) -> list[str]:
    """The query's tokens, repeats included; their number is bounded by the query's text."""
    return index.docs.sparkSession.range(1).select(query_tokens(index.profile, query).alias("t")).first()["t"]


def scores(index: Index, query: str, boosts: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of all active documents that hold a term of the query, by positive finite score.

    Document frequencies count removed documents too. Boosts: for each query token that the text holds, 0.25 for
    each occurrence in the title and 0.10 in the URL. A stored index is read at the query's terms alone; one that is
    not stored is scanned once, and nothing is shuffled but one row of counts.
    """
    k1, b = parameters(k1, b)
    out = _scanned(index, query, boosts, k1, b) if index.rows is not None else _looked_up(index, query, boosts, k1, b)
    return out.where((F.col("score") > 0) & ~F.isnan("score") & (F.col("score") != float("inf")))


def _boost(term: Column) -> Column:
    title, url = (occurrences(ascii_tokens(F.coalesce(F.col(c), F.lit(""))), term) for c in ("title", "url"))
    return TITLE_BOOST * title + URL_BOOST * url


def _looked_up(index: Index, query: str, boosts: bool, k1: float, b: float) -> DataFrame:
    """From the postings of the query's terms; counts of terms are one row a term."""
    found = query_terms(index, query)
    terms = list(dict.fromkeys(found))
    if not terms:
        return index.docs.select("id", F.lit(0.0).alias("score")).limit(0)
    hits = index.postings_of(terms)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    stats = index.stats()
    n, avgdl = stats.select("n_docs").scalar(), stats.select("avgdl").scalar()
    times = F.create_map(*[F.lit(x) for t in terms for x in (t, found.count(t))])[F.col("term")]
    rows = hits.join(F.broadcast(df), "term").join(index.docs.where("active"), "id")
    value = bm25(F.col("tf"), F.col("df"), F.col("length"), n, avgdl, k1, b)
    value = value + _boost(F.col("term")) if boosts else value
    return rows.groupBy("id").agg(F.sum(value * times).alias("score"))


def _scanned(index: Index, query: str, boosts: bool, k1: float, b: float) -> DataFrame:
    """From rows of tokens: term frequencies by array functions, a document's score within its row.

    Texts are read once: what is stored of each is its length and the frequencies, and title and URL where they count.
    """
    found = query_terms(index, query)
    terms = list(dict.fromkeys(found))
    if not terms:
        return index.docs.select("id", F.lit(0.0).alias("score")).limit(0)
    # Counted once a row, whatever reads the counts.
    wanted = F.array(*[F.lit(t) for t in terms])

    def counts(held: Column) -> Column:
        return F.transform(wanted, lambda t: F.array_contains(held, t).cast("int") if index.profile == "unicode" else occurrences(held, t))

    held = F.filter("tokens", lambda x: x.isin(terms))
    rows = computed(index.rows, {"length": F.size("tokens"), "tf": let(held, counts)})
    rows = cut(rows.select("id", "_gone", "length", "tf", *(["title", "url"] if boosts else [])))
    counted = rows.agg(
        F.count("*").alias("n"),
        F.sum(F.when(~F.col("_gone"), F.col("length")).otherwise(0)).alias("total"),
        *[F.sum((F.col("tf")[i] > 0).cast("bigint")).alias(f"df{i}") for i in range(len(terms))],
    ).first()
    n, avgdl = F.lit(counted["n"]), F.lit((counted["total"] or 0) / counted["n"] if counted["n"] else 0.0)
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        value = bm25(F.col("tf")[i], F.lit(counted[f"df{i}"] or 0), F.col("length"), n, avgdl, k1, b)
        value = value + F.when(F.col("tf")[i] > 0, _boost(F.lit(t))).otherwise(0.0) if boosts else value
        score = score + value * found.count(t)
    hits = rows.where(~F.col("_gone") & F.exists("tf", lambda x: x > 0))
    return computed(hits, {"score": score}).select("id", "score") if boosts else hits.select("id", score.alias("score"))


def top(scored: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The k best, ties to the smaller id: one TakeOrderedAndProject, no global sort."""
    return scored.orderBy(F.col("score").desc(), F.col(id_col)).limit(max(0, k))


def search(index: Index, query: str, k: int = 10, boosts: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    return top(scores(index, query, boosts, k1, b), k)


def results(index: Index, query: str, k: int = 10, boosts: bool = False) -> DataFrame:
    """id, score, url, title of the best k; hits without a document are left out."""
    return titled(index, search(index, query, k, boosts), k)


def titled(index: Index, hits: DataFrame, k: int) -> DataFrame:
    """hits (id, score), at most k, with url and title of their documents; they are broadcast, unless the caller asks for very many."""
    hits = F.broadcast(hits) if k <= BROADCAST_ROWS else hits
    return index.docs.select("id", "url", "title").join(hits, "id").select("id", "score", "url", "title")


def domains(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """id, domain, weight of docs (id, text): the summed weights of a domain's keywords (domain, keyword, weight) that the text holds, each once.

    One scan of the texts; of the keywords Spark broadcasts as many as it may. A keyword is one token of the ascii profile.
    """
    terms = docs.select("id", F.explode(F.array_distinct(ascii_tokens(F.col("text")))).alias("keyword"))
    return terms.join(keywords, "keyword").groupBy("id", "domain").agg(F.sum("weight").alias("weight"))
