"""Typed graphs: validation of nodes and edges, and the runtime graph's numbering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import cut_bytes
from larkspur.operators.frontier import before
from larkspur.operators.lineage import cut

#: Fixed value: the bytes of a runtime node's label.
LABEL_BYTES = 127


def first_wins(rows: DataFrame, id_col: str = "id", order: str | None = None) -> DataFrame:
    """Rows whose id is set and not 0; of several with one id the first in `order` (without one, by their contents), combined map-side."""
    rows = rows.where(F.col(id_col).isNotNull() & (F.col(id_col) != 0))
    whole = F.struct(*rows.columns)
    return rows.groupBy(id_col).agg(F.min_by(whole, whole if order is None else F.col(order)).alias("_row")).select("_row.*")


def valid_edges(edges: DataFrame, nodes: DataFrame, order: str | None = None) -> DataFrame:
    """Edges (id, src, dst, ...) with ids and two existing ends; the first of an id. Loops and any kind and weight are allowed."""
    ids = nodes.where("id <> 0").select("id").distinct()
    rows = edges.where("src <> 0 AND dst <> 0")
    rows = rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return first_wins(rows, "id", order)


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.where("id <> 0").select("id").distinct()
    a, b = ids.select(F.col("id").alias("src"), F.lit(True).alias("_a")), ids.select(F.col("id").alias("dst"), F.lit(True).alias("_b"))
    return edges.join(a, "src", "left").join(b, "dst", "left").where("_a IS NULL OR _b IS NULL").select(*edges.columns)


def finite(c: str) -> F.Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))


def find(rows: DataFrame, wanted: int, id_col: str = "id") -> DataFrame:
    """The row with this id, of nodes or edges alike; none for 0."""
    return rows.where((F.col(id_col) == wanted) & F.lit(wanted != 0))


def since_clear(rows: DataFrame, clears: DataFrame, order: str = "seq") -> DataFrame:
    """What arrived after the last clear (rows of `order`): before it everything is forgotten, and numbering starts anew."""
    last = clears.agg(F.max(order)).first()[0]  # one number
    return rows if last is None else rows.where(F.col(order) > last)


def rooted(nodes: DataFrame, order: str, checkpoint: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Nodes of a known kind (1 to 8) without a parent, or whose parent stands before them and is itself among the result.

    Chains of parents are followed by doubling: their longest takes log2 steps.
    """
    known = nodes.select(
        F.col(order).alias("n"), F.col("parent_seq").alias("up"),
        (F.coalesce(F.col("kind").between(1, 8), F.lit(False)) & (F.col("parent_seq").isNull() | (F.col("parent_seq") < F.col(order)))).alias("ok"),
    )
    known = checkpoint(known.withColumn("up", F.when(F.col("ok"), F.col("up"))))
    while known.where("up IS NOT NULL").limit(1).count():
        above = known.select(F.col("n").alias("up"), F.col("up").alias("_up"), F.col("ok").alias("_ok"))
        step = known.join(above, "up", "left")
        ok = F.col("up").isNull() & F.col("ok") | F.coalesce("_ok", F.lit(False)) & F.col("ok")
        known = checkpoint(step.select("n", F.when(ok, F.col("_up")).alias("up"), ok.alias("ok")))
    return nodes.join(known.where("ok").select(F.col("n").alias(order)), order, "left_semi").select(*nodes.columns)


def _first(rows: DataFrame, order: str, capacity: int | None) -> DataFrame:
    """The first `capacity` rows in order."""
    if capacity is None:
        return rows
    counted = before(rows.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", "_earlier")
    return counted.where(F.col("_earlier") < capacity).drop("_one", "_earlier")


def runtime_nodes(nodes: DataFrame, order: str, capacity: int | None = None) -> DataFrame:
    """Nodes of a known kind whose parent is none or an accepted node before them; ids follow the order of arrival (a unique whole number) from 1.

    `nodes` has parent_seq: the `order` value of the parent, or null for a root. Beyond `capacity` nodes none is taken.
    """
    kept = rooted(nodes, order)
    numbered = before(kept.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", "_earlier").withColumn("id", (F.col("_earlier") + 1).cast("bigint")).drop("_one", "_earlier")
    return numbered if capacity is None else numbered.where(F.col("id") <= capacity)


def runtime_graph(nodes: DataFrame, edges: DataFrame, order: str = "seq", node_capacity: int | None = None, edge_capacity: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a runtime graph whose additions arrive in one `order`, a unique whole number; ids come from one sequence for both.

    nodes: parent_seq (null for a root), kind, label. edges: src_seq, dst_seq (the ends' `order` values), kind, weight. An
    edge needs two accepted, different nodes that came before it, a kind of 1 to 6 and a finite weight. What is refused takes
    no id. Labels are cut to LABEL_BYTES. Nodes get id and parent_id, edges id, src and dst.
    """
    nodes = _first(rooted(nodes, order), order, node_capacity)
    nodes = nodes.withColumn("label", cut_bytes(F.col("label"), LABEL_BYTES)) if "label" in nodes.columns else nodes
    there = nodes.select(F.col(order).alias("_node"))
    good = edges.where(F.col("kind").between(1, 6) & (F.col("src_seq") != F.col("dst_seq")) & finite("weight"))
    good = good.where((F.col("src_seq") < F.col(order)) & (F.col("dst_seq") < F.col(order)))
    for end in ("src_seq", "dst_seq"):
        good = good.join(there, good[end] == there["_node"], "left_semi")
    good = _first(good, order, edge_capacity)
    both = nodes.select(order).unionByName(good.select(order)).withColumn("_one", F.lit(1).cast("bigint"))
    ids = cut(before(both, order, "_one", "_earlier").select(F.col(order), (F.col("_earlier") + 1).cast("bigint").alias("id")))

    def of(column: str, name: str) -> DataFrame:
        return ids.select(F.col(order).alias(column), F.col("id").alias(name))

    nodes = nodes.join(ids, order).join(of("parent_seq", "parent_id"), "parent_seq", "left").withColumn("parent_id", F.coalesce("parent_id", F.lit(0).cast("bigint")))
    good = good.join(ids, order).join(of("src_seq", "src"), "src_seq").join(of("dst_seq", "dst"), "dst_seq")
    return nodes, good


def runtime_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, weight) between existing, different nodes, of a known kind (1 to 6) and finite weight."""
    rows = edges.where(F.col("kind").between(1, 6) & (F.col("src") != F.col("dst")) & finite("weight"))
    ids = nodes.select("id")
    return rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def with_evidence(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges (evidence_id, ...) with the claim and class of their evidence; edges without any stay."""
    return edges.join(evidence.select(F.col("id").alias("evidence_id"), "claim", "classification"), "evidence_id", "left")


def neighbours(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id) reached from `start` (id) over one edge, in its direction."""
    return edges.join(start.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def reach(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(id, steps) of all that is reached from `start` (id, steps 0) along edges (src, dst), by the fewest steps, `most` at most.

    A step follows the edges of what the step before found first, and of nothing else; it is stored. A circle ends by itself.
    """
    edges = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    front = cut(start.select("id").where("id IS NOT NULL").distinct().withColumn("steps", F.lit(0)))
    seen, steps = front, 0
    while (most is None or steps < most) and not front.isEmpty():
        steps += 1
        found = edges.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        front = cut(found.join(seen.select("id"), "id", "left_anti").withColumn("steps", F.lit(steps)))
        seen = seen.unionByName(front)
    return seen
