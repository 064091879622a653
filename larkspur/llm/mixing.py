"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions alone.

Target weights are whole parts of a period: a source of c parts out of P is due
c blocks in every P slots. Its block j (from 0) has the release time
floor(j P / c) and the deadline ceil((j + 1) P / c). Earliest deadline first
gives each slot to the released block with the nearest deadline (ties: the
source listed first); as the parts sum to P, every block falls between its
release and its deadline, so after any number of slots a source has had its
target to within less than one block.

The schedule repeats after each period, so it is made once, as one SQL fold
over the P slots of a period, and has P rows. A document's place follows from
its number within its source: block b of a source with c parts is slot
(b div c) P + slot of (b mod c). Numbers come from counts of hash ranges and a
window within each range, so no source, however large, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import table

#: The longest period: the schedule has as many rows, and they are broadcast.
MOST_PARTS = 4096
REST = "*"
#: Production targets: the source that floods the corpus is held to a tenth, four trusted ones count double, all not named share the rest.
TARGETS = {"src0": 4, "src1": 2, "src2": 2, "src3": 2, "src4": 2, REST: 28}
BLOCK = 16
#: Hash ranges of a component, and of all together: their counts are broadcast.
RANGES, MOST_RANGES = 4096, 1 << 18
#: Rows of one range that are put in order together.
HEAVY = 50_000


def checked(parts: dict[str, int]) -> dict[str, int]:
    """Weights in whole parts, those of no part left out; refuses what has no schedule."""
    if not all(isinstance(c, int) and not isinstance(c, bool) and c >= 0 for c in parts.values()):
        raise ValueError("weights are whole numbers of parts, none negative")
    kept = {k: c for k, c in parts.items() if c}
    if not 0 < sum(kept.values()) <= MOST_PARTS:
        raise ValueError(f"parts must sum to between 1 and {MOST_PARTS}")
    return kept


def schedule(spark: SparkSession, parts: dict[str, int]) -> DataFrame:
    """One period: slot, component, parts, nth (the component's block within the period), release, deadline.

    A fold over the slots. Its state is the number of blocks that each component has had; each slot goes to the
    least (deadline, component) of those whose next block is released.
    """
    parts = checked(parts)
    period = sum(parts.values())
    names = F.array(*[F.lit(n) for n in parts])
    share = F.array(*[F.lit(c).cast("bigint") for c in parts.values()])
    p = F.lit(period).cast("bigint")

    def slot(state: Column, t: Column) -> Column:
        had = state["had"]
        due = F.transform(
            F.sequence(F.lit(0), F.lit(len(parts) - 1)),
            lambda i: F.when(
                # released: floor(j P / c) <= t
                F.floor(F.get(had, i) * p / F.get(share, i)) <= t,
                F.struct((F.ceil((F.get(had, i) + 1) * p / F.get(share, i))).cast("bigint").alias("deadline"), i.alias("i")),
            ),
        )
        pick = F.array_min(F.filter(due, lambda x: x.isNotNull()))["i"]
        return F.struct(
            F.transform(had, lambda h, i: h + F.when(i == pick, 1).otherwise(0).cast("bigint")).alias("had"),
            F.concat(state["out"], F.array(F.struct(t.cast("bigint").alias("slot"), pick.cast("int").alias("i"), F.get(had, pick).alias("nth")))).alias("out"),
        )

    start = F.struct(
        F.array(*[F.lit(0).cast("bigint")] * len(parts)).alias("had"),
        F.array().cast("array<struct<slot:bigint,i:int,nth:bigint>>").alias("out"),
    )
    fold = F.aggregate(F.sequence(F.lit(0).cast("bigint"), p - 1), start, slot, lambda s: s["out"])
    rows = spark.range(1).select(F.explode(fold).alias("s")).select("s.*")
    c = F.get(share, F.col("i"))
    return rows.select(
        "slot",
        F.get(names, F.col("i")).alias("component"),
        c.alias("parts"),
        "nth",
        F.floor(F.col("nth") * p / c).cast("bigint").alias("release"),
        F.ceil((F.col("nth") + 1) * p / c).cast("bigint").alias("deadline"),
    )


def mix(docs: DataFrame, parts: dict[str, int], block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs, all rows and columns, with mix_component, mix_block, mix_slot, mix_position and mix_full.

    Sources not named in `parts` (null ones too) form the component "*"; where "*" has no parts, and where a source
    has none, its rows keep null slot and position: they are not due. Within a component rows go by a hash of their
    id (rows without id: of the whole row), then by id, so that the order is the same on any layout; `block` rows make a
    block. Where an id repeats so often that more than HEAVY rows share its range, that range goes by hash of the row first.
    mix_slot orders the blocks, mix_position the rows. As long as every component still has blocks (mix_full) each
    has its target to within less than one block; from the slot at which one runs out, the others follow in the
    slots that remain theirs. Nothing is dropped or repeated. Repeated rows take places of their own; an empty
    table gives no rows; columns of those names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_component", "mix_block", "mix_slot", "mix_position", "mix_full")
    parts = checked(parts)
    period = sum(parts.values())
    named = [n for n in parts if n != REST]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    source = F.col(f"`{source_col}`").cast("string")
    # Maps have no hash; written out, they have.
    tie = F.xxhash64(F.to_json(F.struct(whole)) if "map<" in docs.select(whole).schema.simpleString() else whole)
    key = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), tie.cast("string")))
    ranges = min(RANGES, MOST_RANGES // len(parts))
    # The caller's columns travel within one, so that their names meet no other.
    rows = docs.select(
        whole.alias("row"),
        (F.when(source.isin(named), source).otherwise(F.lit(REST)) if named else F.lit(REST)).alias("component"),
        key.alias("key"),
        F.col(f"`{id_col}`").alias("id"),
        tie.alias("tie"),
    ).withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * ranges / (1 << 32)).cast("int"))
    # An id that a third of all rows have fills its range: such ranges are parted by the rows' hashes, the others stay whole.
    counts = rows.groupBy("component", "range").agg((F.floor(F.count("*") / HEAVY) + 1).cast("int").alias("parts"))
    heavy = counts.where("parts > 1")
    rows = rows.join(F.broadcast(heavy), ["component", "range"], "left").withColumn("part", F.pmod("tie", F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    # Rows before each part of a hash range of a component: MOST_RANGES at most, or one a component, and a part for every HEAVY rows beyond.
    before = (
        rows.groupBy("component", "range", "part")
        .count()
        .withColumn("before", F.sum("count").over(W.partitionBy("component").orderBy("range", "part").rowsBetween(W.unboundedPreceding, -1)))
        .select("component", "range", "part", F.coalesce("before", F.lit(0)).alias("before"), "count")
    )
    within = W.partitionBy("component", "range", "part").orderBy("key", "id", "tie")
    rows = rows.withColumn("nth", F.row_number().over(within) - 1).join(before.drop("count"), ["component", "range", "part"])
    rows = rows.withColumn("number", F.col("before") + F.col("nth"))
    rows = rows.withColumn("mix_block", F.floor(F.col("number") / block).cast("bigint"))
    plan = schedule(spark, parts).select("component", F.col("parts").alias("share"), F.col("nth").alias("turn"), "slot")
    shares = F.create_map(*[x for n, c in parts.items() for x in (F.lit(n), F.lit(c).cast("bigint"))])
    rows = rows.withColumn("turn", F.pmod("mix_block", F.coalesce(F.element_at(shares, F.col("component")), F.lit(1))).cast("bigint"))
    rows = rows.join(F.broadcast(plan), ["component", "turn"], "left")
    rows = rows.withColumn("mix_slot", (F.floor(F.col("mix_block") / F.col("share")) * period + F.col("slot")).cast("bigint"))
    rows = rows.withColumn("mix_position", F.col("mix_slot") * block + F.pmod(F.col("number"), F.lit(block)))
    # The first slot that finds its component out of whole blocks; one number, from one row for each component.
    listed = F.array(*[F.struct(F.lit(n).alias("component"), F.lit(c).cast("bigint").alias("c")) for n, c in parts.items()])
    have = before.groupBy("component").agg(F.floor(F.sum("count") / block).cast("bigint").alias("blocks"))
    ends = spark.range(1).select(F.explode(listed).alias("x")).select("x.*").join(have, "component", "left")
    ends = ends.select("component", "c", F.coalesce("blocks", F.lit(0)).cast("bigint").alias("b")).withColumn("turn", F.pmod("b", "c").cast("bigint"))
    ends = ends.join(F.broadcast(plan.drop("share")), ["component", "turn"])
    end = ends.agg(F.min(F.floor(F.col("b") / F.col("c")) * period + F.col("slot")).cast("bigint").alias("end"))
    rows = rows.withColumn("mix_full", F.coalesce(F.col("mix_slot") < end.scalar(), F.lit(False)))
    return rows.select("row.*", F.col("component").alias("mix_component"), "mix_block", "mix_slot", "mix_position", "mix_full")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, TARGETS)


_PERIOD = sum(TARGETS.values())
_NAMED = ", ".join(f"'{n}'" for n in TARGETS if n != REST)
_VALUES = ", ".join(f"({i}, '{n}', {c})" for i, (n, c) in enumerate(TARGETS.items()))
OP2_SQL = f"""
WITH RECURSIVE t(i, component, c) AS (VALUES {_VALUES}),
edf(slot, pick, nth, had) AS (
  SELECT CAST(-1 AS BIGINT), -1, CAST(0 AS BIGINT), (SELECT list(CAST(0 AS BIGINT) ORDER BY i) FROM t)
  UNION ALL
  SELECT e.slot + 1, p.i, e.had[p.i + 1],
         list_transform(e.had, lambda h, k: h + CASE WHEN k = p.i + 1 THEN 1 ELSE 0 END)
  FROM edf e, LATERAL (
    SELECT min_by(i, ((e.had[i + 1] + 1) * {_PERIOD} + c - 1) // c * 1000 + i) AS i
    FROM t WHERE e.had[i + 1] * {_PERIOD} // c <= e.slot + 1
  ) p
  WHERE e.slot + 1 < {_PERIOD}
), plan AS (
  SELECT e.slot, t.component, t.c, e.nth FROM edf e JOIN t ON t.i = e.pick
), d AS (
  SELECT doc_id, source, CASE WHEN source IN ({_NAMED}) THEN source ELSE '*' END AS component FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY component ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS number FROM d
), b AS (
  SELECT r.*, number // {BLOCK} AS block, t.c FROM r JOIN t USING (component)
), s AS (
  SELECT b.*, block // b.c * {_PERIOD} + plan.slot AS slot FROM b JOIN plan ON plan.component = b.component AND plan.nth = block % b.c
), ends AS (
  SELECT min(n // t.c * {_PERIOD} + plan.slot) AS stop
  FROM (SELECT t.component, count(d.component) // {BLOCK} AS n FROM t LEFT JOIN d USING (component) GROUP BY 1) x
  JOIN t USING (component) JOIN plan ON plan.component = x.component AND plan.nth = x.n % t.c
)
SELECT doc_id, source, component AS mix_component, CAST(block AS BIGINT) AS mix_block, CAST(slot AS BIGINT) AS mix_slot,
       CAST(slot * {BLOCK} + number % {BLOCK} AS BIGINT) AS mix_position, slot < stop AS mix_full
FROM s, ends
"""
