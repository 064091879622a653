"""Relational rules as queries: checks, keys, references and what deletes do to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.lineage import cut

#: Repeated keys up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1 << 20

# What columns may hold.
ROLES = ("user", "assistant", "system")
SOURCE_KINDS = ("local", "web", "user", "system", "unknown")
DOCUMENT_STATES = ("pending", "indexed", "rejected", "failed")
ROBOTS_RESULTS = ("allow", "deny", "unavailable", "unknown")


def checks(table: str) -> dict[str, Column]:
    """The named conditions of a table; one that is null is met, as in SQL."""
    c = F.col
    truth = c("classification").isin("FACT", "INFERENCE", "UNCERTAIN", "UNKNOWN", "CONFLICTED") if table in ("evidence", "claims") else None
    return {
        "messages": lambda: {"role": c("role").isin(*ROLES)},
        "sources": lambda: {"source_kind": c("source_kind").isin(*SOURCE_KINDS), "trust_tier": c("trust_tier").between(0, 4)},
        "evidence": lambda: {"classification": truth},
        "claims": lambda: {"classification": truth},
        "documents": lambda: {"content_bytes": c("content_bytes") >= 0, "status": c("status").isin(*DOCUMENT_STATES)},
        "document_chunks": lambda: {
            "ordinal": c("ordinal") >= 0, "start_offset": c("start_offset") >= 0, "end_offset": c("end_offset") >= c("start_offset"), "token_count": c("token_count") >= 0,
        },
        "chunk_keywords": lambda: {"weight": c("weight") >= 0},
        "claim_keywords": lambda: {"weight": c("weight") >= 0},
        "source_fetches": lambda: {"robots_result": c("robots_result").isin(*ROBOTS_RESULTS)},
    }.get(table, dict)()


def with_violations(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """rows and `violations`: the names of the conditions that are false, of all columns in one pass."""
    broken = [F.when(~condition, F.lit(name)) for name, condition in conditions.items()]
    return rows.withColumn("violations", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))


def split(rows: DataFrame, conditions: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all conditions, and those that do not, with what they break."""
    marked = with_violations(rows, conditions)
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Key values (none null) that occur more than once, with `n`."""
    known = F.lit(True)
    for c in key:
        known &= F.col(c).isNotNull()
    return rows.where(known).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def first_of(rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """rows without the later ones of a key, in `order` (without one, by their contents).

    Which keys repeat is found from the keys alone; where none does, rows are read as they are and nothing else is shuffled.
    """
    again = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    n = again.count()
    if not n:
        return rows
    again = F.broadcast(again) if n <= BROADCAST_ROWS else again
    whole = F.struct(*rows.columns)
    first = rows.join(again, key, "left_semi").groupBy(key).agg(F.min_by(whole, whole if order is None else order).alias("_row")).select("_row.*")
    return rows.join(again, key, "left_anti").select(*rows.columns).unionByName(first.select(*rows.columns))


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is set and names no parent."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)).distinct(), column, "left_anti").select(*rows.columns)


def cascaded(rows: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """What is left of rows when parents go and take them along."""
    return rows.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti").select(*rows.columns)


def set_null(rows: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """rows, with references to parents that go set to null."""
    mark = gone.select(F.col(key).alias(column)).distinct().withColumn("_gone", F.lit(True))
    return rows.join(mark, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*rows.columns)


def _columns(table: str, keys: dict[str, list[str]], references: dict[str, tuple[str, str]]) -> list[str]:
    """The columns by which rows of a table are told apart or referred to."""
    named = [p.partition(".")[2] for p, _ in references.values() if p.partition(".")[0] == table]
    return list(dict.fromkeys([*keys[table], *named]))


def doomed(tables: dict[str, DataFrame], references: dict[str, tuple[str, str]], keys: dict[str, list[str]], table: str, gone: DataFrame) -> dict[str, DataFrame]:
    """By table, the rows that go when those of `table` with the keys `gone` go: their keys and what is referred to of them.

    references: "table.column" -> ("table.column", "cascade" or "set null"); keys: what makes a row of each table, never null.
    A reference that cascades takes its row along, whose own referrers follow, through as many tables and as often as
    it takes: each step looks only for what refers to the rows that the step before found. Tables without such rows are
    left out. Only keys travel; each step is stored.
    """
    wanted = {t: _columns(t, keys, references) for t in tables}
    found: dict[str, DataFrame] = {}
    step = {table: cut(tables[table].select(*wanted[table]).join(gone.select(*keys[table]).distinct(), keys[table], "left_semi"))}
    while step := {t: rows for t, rows in step.items() if not rows.isEmpty()}:
        for t, rows in step.items():
            found[t] = rows if t not in found else found[t].unionByName(rows)
        hits: dict[str, list[DataFrame]] = {}
        for child, (parent, action) in references.items():
            (of, _, column), (above, _, name) = child.partition("."), parent.partition(".")
            if action == "cascade" and above in step and of in tables:
                dead = step[above].select(F.col(name).alias(column)).distinct()
                hits.setdefault(of, []).append(tables[of].select(*dict.fromkeys([*wanted[of], column])).join(dead, column, "left_semi").select(*wanted[of]))
        step = {}
        for t, several in hits.items():
            rows = reduce(DataFrame.unionByName, several)
            rows = rows.dropDuplicates(keys[t]) if len(several) > 1 else rows
            step[t] = cut(rows.join(found[t].select(*keys[t]), keys[t], "left_anti") if t in found else rows)
    return found


def after_delete(tables: dict[str, DataFrame], references: dict[str, tuple[str, str]], keys: dict[str, list[str]], dead: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of each table that loses rows (dead: as doomed() gives them) or whose references are set to null by that."""
    left: dict[str, DataFrame] = {t: tables[t].join(rows.select(*keys[t]), keys[t], "left_anti").select(*tables[t].columns) for t, rows in dead.items()}
    for child, (parent, action) in references.items():
        (of, _, column), (above, _, name) = child.partition("."), parent.partition(".")
        if action == "set null" and above in dead and of in tables:
            left[of] = set_null(left.get(of, tables[of]), column, dead[above], name)
    return left


def parents_last(references: dict[str, tuple[str, str]], names: list[str]) -> list[str]:
    """names in an order in which a table stands after all that refer to it, as far as references run in no circle."""
    refers = {(c.partition(".")[0], p.partition(".")[0]) for c, (p, _) in references.items()}
    out: list[str] = []
    while rest := [n for n in names if n not in out]:
        free = [n for n in rest if not any((m, n) in refers for m in rest if m != n)]
        out += free or rest
    return out


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the last row in `order`."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))  # combined map-side
    return best.select("_row.*")


def once(rows: DataFrame, content: Column, order: str) -> DataFrame:
    """Of rows with equal content (by SHA-256) the first in `order`, with `sha256`. Hashes and order values are compared, never the contents."""
    rows = rows.withColumn("sha256", F.sha2(content, 256))
    return rows.join(rows.groupBy("sha256").agg(F.min(order).alias(order)), ["sha256", order], "left_semi")
