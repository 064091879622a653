"""Full-text predicates and ranking over positional postings: terms, prefixes, phrases, NEAR, boolean combinations, columns.

Words are runs of letters and digits with their combining marks, lower-cased,
without marks and without the diacritics of Latin letters, which Unicode's
decompositions name. Each predicate gives the ids of the documents that meet it. With
several columns a posting has the number of its column; `within` narrows a
predicate to some of them.
"""

from __future__ import annotations

import math
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators.lineage import cut

def _folded() -> tuple[str, str]:
    """Lower-case Latin letters that decompose into a plain one and marks, with the plain ones, and after them the marks themselves."""
    letters = [chr(c) for r in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in r]
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in letters if c == c.lower()]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and all(unicodedata.category(x) == "Mn" for x in d[1:])]
    return "".join(c for c, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(d for _, d in pairs)


#: Latin letters with diacritics and the letters they are searched as, place by place; what stands beyond, the combining marks, goes.
ACCENTED, PLAIN = _folded()


def words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\x{300}-\x{36F}]*"), F.lit(0))
    return F.transform(found, lambda w: F.translate(w, ACCENTED, PLAIN))


def positions(docs: DataFrame, id_col: str, text_col: str | list[str] = "text", only: list[str] | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """id, col (the column's number), pos (from 0 in each column), word. Null columns have no words.

    only, prefixes: words, and beginnings of words, that the predicates to come ask for: no row is made of any other.
    """
    names = [text_col] if isinstance(text_col, str) else text_col

    def places(text: Column) -> Column:
        all_ = F.transform(words(F.coalesce(text, F.lit(""))), lambda w, i: F.struct(i.cast("int").alias("pos"), w.alias("word")))
        if only is None and prefixes is None:
            return all_
        asked = [lambda x: x["word"].isin(list(dict.fromkeys(only or [])))] + [lambda x, p=p: x["word"].startswith(p) for p in prefixes or []]
        return F.filter(all_, lambda x: reduce(lambda m, test: m | test(x), asked[1:], asked[0](x)))

    parts = F.array(*[F.struct(F.lit(i).alias("col"), places(F.col(c)).alias("ws")) for i, c in enumerate(names)])
    return docs.select(F.col(id_col).alias("id"), F.explode(parts).alias("p")).select("id", "p.col", F.inline("p.ws"))


def within(rows: DataFrame, *columns: int) -> DataFrame:
    """Postings of these columns alone."""
    return rows.where(F.col("col").isin(list(columns)))


def term(rows: DataFrame, word: str) -> DataFrame:
    return rows.where(F.col("word") == word).select("id").distinct()


def prefix(rows: DataFrame, start: str) -> DataFrame:
    return rows.where(F.col("word").startswith(start)).select("id").distinct()


def phrase(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with the terms one after another in a column: where each term may begin the phrase at one place. One pass over the postings, no self-join."""
    return _phrases(rows, terms).select("id").distinct()


def _phrases(rows: DataFrame, terms: list[str]) -> DataFrame:
    """id, col, start of every occurrence of the phrase."""
    if len(terms) == 1:
        return rows.where(F.col("word") == terms[0]).select("id", "col", F.col("pos").alias("start"))
    nth = F.array(*[F.when(F.col("word") == t, F.lit(i)) for i, t in enumerate(terms)])
    spots = rows.where(F.col("word").isin(list(dict.fromkeys(terms)))).withColumn("nth", F.explode(F.array_compact(nth)))
    found = spots.groupBy("id", "col", (F.col("pos") - F.col("nth")).alias("start")).agg(F.countDistinct("nth").alias("n"))
    return found.where(F.col("n") == len(terms)).drop("n")


def near(rows: DataFrame, left: str, right: str, distance: int = 10) -> DataFrame:
    """Documents with the two words at most `distance` words apart in a column: the words in between number that many at most.

    Of the two words' places in order only neighbours are compared: where any two are near, two neighbours are.
    """
    found = rows.where(F.col("word").isin(left, right))
    w = W.partitionBy("id", "col").orderBy("pos")
    found = found.select("id", "word", (F.col("pos") - F.lag("pos").over(w)).alias("step"), F.lag("word").over(w).alias("last"))
    other = F.lit(True) if left == right else F.col("word") != F.col("last")
    return found.where((F.col("step") <= distance + 1) & other).select("id").distinct()


def boolean(rows: DataFrame, condition: Column, **terms: str) -> DataFrame:
    """Documents that meet a condition over named terms (true where the document has the word), in one pass over the postings.

    A document without any of the words is not looked at: a condition that holds without them is not for this.
    """
    wanted = rows.where(F.col("word").isin(list(dict.fromkeys(terms.values()))))
    held = wanted.groupBy("id").agg(*[F.bool_or(F.col("word") == w).alias(n) for n, w in terms.items()])
    return held.where(condition).select("id")


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "id", "left_semi"), parts)


def any_of(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), parts).distinct()


def but_not(part: DataFrame, without: DataFrame) -> DataFrame:
    return part.join(without, "id", "left_anti")


def ranked(docs: DataFrame, id_col: str, columns: list[str], phrases: list[list[str]], weights: list[float] | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents that hold one of the phrases, smaller being better, as full-text indexes of databases rank.

    For each phrase log((N - n + 1/2) / (n + 1/2)), a millionth at least, times f (k1 + 1) / (f + k1 (1 - b + b D / avg)),
    where f sums its occurrences by the weights of their columns, D and avg count words of all columns; their negated
    sum. One pass counts words and occurrences within each row and stores them; what is shuffled is one row of counts.
    """
    weight = weights or [1.0] * len(columns)
    split = [words(F.coalesce(F.col(c), F.lit(""))).alias(f"_w{i}") for i, c in enumerate(columns)]
    rows = docs.select(F.col(id_col).alias("id"), F.inline(F.array(F.struct(*split))))

    def times(ws: Column, terms: list[str]) -> Column:
        """Places at which the phrase begins."""
        here = lambda x, i: reduce(lambda m, k: m & (F.get(ws, i + k) == terms[k]), range(1, len(terms)), x == terms[0])
        return F.size(F.filter(ws, lambda x, i: F.coalesce(here(x, i), F.lit(False))))

    size = reduce(lambda x, y: x + y, [F.size(f"_w{i}") for i in range(len(columns))])
    held = [times(F.col(f"_w{i}"), p).alias(f"c{n}_{i}") for n, p in enumerate(phrases) for i in range(len(columns))]
    # Texts are read once; what is stored of each is its size and its counts.
    rows = cut(rows.select("id", F.inline(F.array(F.struct(size.cast("double").alias("size"), *held)))))
    of = [[F.col(f"c{n}_{i}") for i in range(len(columns))] for n in range(len(phrases))]
    # Whether a phrase is there at all does not depend on weights.
    there = [reduce(lambda x, y: x | y, [c > 0 for c in cs]) for cs in of]
    counted = rows.agg(F.count("*").alias("n"), F.avg("size").alias("avg"), *[F.count_if(h).alias(f"n{n}") for n, h in enumerate(there)]).first()
    score = F.lit(0.0)
    for n in range(len(phrases)):
        ratio = (counted["n"] - (counted[f"n{n}"] or 0) + 0.5) / ((counted[f"n{n}"] or 0) + 0.5)
        idf = max(1e-6, math.log(ratio))
        f = reduce(lambda x, y: x + y, [F.lit(w) * c for w, c in zip(weight, of[n], strict=True)])
        score = score + F.lit(idf) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("size") / F.lit(counted["avg"] or 1.0)))
    return rows.where(reduce(lambda x, y: x | y, there)).select("id", (-score).alias("score"))


def cover_ranked(docs: DataFrame, id_col: str, columns: list[str], terms: list[str], weights: list[float] | None = None) -> DataFrame:
    """(id, score) of the documents that hold all terms, larger being better, by the density of their covers.

    A cover is a stretch of words that holds all terms and none that does within it; the columns' words follow one another. Each
    adds the number of its terms' occurrences over the sum of their inverse weights (that of a word is its column's), over one
    more than the words in it that are no terms. Each document's occurrences are gone through once, in order: what a cover that
    ends there begins with follows from where each term stood last.
    """
    terms, weight = list(dict.fromkeys(terms)), weights or [1.0] * len(columns)
    split = [words(F.coalesce(F.col(c), F.lit(""))).alias(f"_w{i}") for i, c in enumerate(columns)]
    rows = docs.select(F.col(id_col).alias("id"), F.inline(F.array(F.struct(*split))))

    def places(i: int) -> Column:
        at = reduce(lambda x, y: x + y, [F.size(f"_w{j}") for j in range(i)], F.lit(0))
        found = F.transform(f"_w{i}", lambda x, n: F.struct((at + n).alias("pos"), x.alias("word"), F.lit(1.0 / weight[i]).alias("inverse")))
        return F.filter(found, lambda x: x["word"].isin(terms))

    spots = rows.select("id", F.inline(F.concat(*[places(i) for i in range(len(columns))])))
    order = W.partitionBy("id").orderBy("pos")
    spots = spots.withColumn("n", F.row_number().over(order)).withColumn("sum", F.sum("inverse").over(order))
    here = F.struct("pos", "n", (F.col("sum") - F.col("inverse")).alias("less"))
    last = [F.max(F.when(F.col("word") == t, here)).over(order) for t in terms]
    spots = spots.withColumn("last", F.array(*last)).where(~F.exists("last", lambda x: x.isNull())).withColumn("first", F.array_min("last"))
    lag = F.lag("first.pos").over(order)
    covers = spots.withColumn("lag", lag).where(F.col("lag").isNull() | (F.col("lag") < F.col("first.pos")))
    many = F.col("n") - F.col("first.n") + 1
    noise = F.col("pos") - F.col("first.pos") - (many - 1)
    return covers.groupBy("id").agg(F.sum(many / (F.col("sum") - F.col("first.less")) / (1 + noise)).alias("score"))
