"""Exact top-k search by inner product over norm-bucketed vectors.

Rows are ordered by length and packed into buckets of at most `bucket_rows`
vectors of nearly equal length. A query holds a running k-th best score t. In
a bucket whose longest vector has length l, a vector can only enter the answer
if its cosine with the query is at least t / (|q| * l), the local threshold:

* above one, the whole bucket goes (its vectors are too short);
* near one, coordinates prune: on its largest coordinates a unit vector with
  that cosine must lie within a feasible range, and those outside go;
* otherwise lengths prune: vectors shorter than t / |q| go.

What is left is verified by exact integer products.

Buckets meet blocks of queries, never single rows: both are packed matrices,
dealt into the cells of a grid. Each query's first bound comes from the longest
vectors; t / |q| is the length that a vector needs to enter its answer. Queries
are put in order of that length before they are packed, so that a row of the grid
holds queries of like need, and a bucket is sent only to the rows whose least need
its longest vector meets. A cell holds a few blocks of queries and lets its
buckets pass, longest first; the bounds rise as it goes, and it sends on k rows
for a query at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import stored, table

PACKED = "block long, dim int, longest double, need double, ids binary, vecs binary"
#: Local cosine thresholds from which coordinate pruning is tried, and how many coordinates it looks at.
COORDINATE_FROM, FOCUS = 0.6, 3
#: Query blocks that a cell of the grid holds.
CELL_BLOCKS = 4


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """(id, v array<long>, len double): floor(scale * x) for each component, as double.

    Null vectors, those holding null, NaN or infinite components, and null ids take no part. Of rows that
    repeat an id, one stays: the one with the largest vector. Other columns are ignored.
    """
    x = F.col("x")
    ok = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
        .where(F.col("id").isNotNull() & x.isNotNull())
        .where(ok)
        .select("id", F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))
        .groupBy("id")
        .agg(F.max("v").alias("v"))
    )
    return rows.withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def _packed(rows: int):
    """Pack sorted rows of a partition into blocks of `rows` vectors of one dimension."""

    def run(frames):
        from pyspark import TaskContext

        base, n, kept = TaskContext.get().partitionId() << 32, 0, {}
        for frame in frames:
            for dim, part in frame.groupby(frame["v"].map(len), sort=False):
                kept.setdefault(dim, []).append(part)
                while sum(map(len, kept[dim])) >= rows:
                    whole = pd.concat(kept[dim])
                    yield _block(base + n, dim, whole[:rows])
                    kept[dim], n = [whole[rows:]], n + 1
        for dim, parts in kept.items():
            whole = pd.concat(parts)
            if len(whole):
                yield _block(base + n, dim, whole)
                n += 1

    return run


def _block(number: int, dim: int, rows: pd.DataFrame) -> pd.DataFrame:
    vecs = np.stack(rows["v"].to_list()).astype(np.int64) if dim else np.zeros((len(rows), 0), np.int64)
    return pd.DataFrame(
        {
            "block": [number],
            "dim": [dim],
            "longest": [float(rows["len"].max())],
            "need": [float(rows["need"].min()) if "need" in rows else 0.0],
            "ids": [rows["id"].to_numpy(np.int64).tobytes()],
            "vecs": [vecs.astype(_narrowest(vecs)).tobytes()],
        }
    )


def _narrowest(x: np.ndarray):
    """The smallest kind of integer that holds these."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)


def _matrix(ids: bytes, vecs: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    wide = len(vecs) // max(1, len(i) * dim)
    return i, np.frombuffer(vecs, f"i{wide or 8}").reshape(len(i), dim).astype(np.int64)


LOWEST = np.iinfo(np.int64).min // 2


class Block:
    """Queries with the k best seen so far; `bound` is each one's k-th best."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int):
        self.ids, self.vecs, self.k = ids, vecs, k
        self.bound = np.full(len(ids), LOWEST, np.int64)
        self.best = (np.empty(0, np.int64),) * 3  # query number, vec_id, score

    def meet(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        *found, _ = search_bucket(self.ids, self.vecs, self.bound, ids, vecs, self.k)
        q, i, s = (np.concatenate(x) for x in zip(self.best, found, strict=True))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.bound[q[last]] = np.maximum(self.bound[q[last]], s[last])
        self.best = tuple(x[rank < self.k] for x in (q, i, s))

    def seed(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        """First bounds from some vectors, which are met again later."""
        if len(ids) > self.k:
            s = products(self.vecs, vecs)
            s[self.ids[:, None] == ids[None, :]] = LOWEST
            self.bound = np.maximum(self.bound, np.partition(s, len(ids) - self.k, axis=1)[:, len(ids) - self.k])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where every partial sum stays below 2**53, in 64-bit integers below 2**63, else in whole numbers of any size.

    What does not fit a long becomes the nearest long.
    """
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if bound < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return a @ b.T
    limit = np.iinfo(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, limit.min, limit.max).astype(np.int64)


def _needed(seeds: list[tuple], k: int):
    """Query rows (id, v, len) with `need`: the least length that a vector must have to enter the answer, from bounds that the seeds give."""

    def run(frames):
        for frame in frames:
            need = np.zeros(len(frame))
            for dim, part in frame.assign(at=np.arange(len(frame))).groupby(frame["v"].map(len), sort=False):
                block = Block(part["id"].to_numpy(np.int64), np.stack(part["v"].to_list()).astype(np.int64) if dim else np.zeros((len(part), 0), np.int64), k)
                for seed_dim, *seed in seeds:
                    if seed_dim == dim:
                        block.seed(*_matrix(*seed, dim))
                length = part["len"].to_numpy()
                with np.errstate(divide="ignore", invalid="ignore"):
                    need[part["at"].to_numpy()] = np.where((block.bound > 0) & (length > 0), block.bound / length, 0.0)
            yield frame.assign(need=need)

    return run


def search_bucket(q_ids, q, bound, ids, vecs, k):
    """The k best of one bucket for each query, of scores not below `bound` (a k-th best seen elsewhere): rows (query index, id, score).

    Also the counts of pairs left out by length or coordinates, and verified.
    """
    q_len = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    p_len = np.sqrt((vecs.astype(np.float64) ** 2).sum(1))
    longest = p_len.max(initial=0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where((bound > 0) & (q_len > 0) & (longest > 0), bound / (q_len * longest), np.where(bound > 0, np.inf, -np.inf))
    live = np.flatnonzero(local <= 1 + 1e-9)
    spared = (len(q) - len(live)) * len(vecs)
    out = []
    # Length pruning: one cut for all queries whose threshold is loose.
    loose = live[local[live] < COORDINATE_FROM]
    if len(loose):
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(bound[loose] > 0, bound[loose] / q_len[loose], 0.0).min()
        keep = np.flatnonzero(p_len >= need - 1e-6)
        spared += len(loose) * (len(vecs) - len(keep))
        out.append(_best(loose, q_ids, q, bound, ids[keep], vecs[keep], k))
    # Coordinate pruning: within an angle of arccos(local threshold) from the query, the angle to an axis
    # differs from the query's by no more than that.
    tight = live[local[live] >= COORDINATE_FROM]
    if len(tight):
        unit = vecs / np.maximum(p_len, 1e-300)[:, None]
        for i in tight:
            u = q[i] / q_len[i]
            c = min(1.0, local[i])
            keep = p_len >= bound[i] / q_len[i] - 1e-6
            angle = np.arccos(c)
            for f in np.argsort(-np.abs(u))[:FOCUS]:
                to_axis = np.arccos(np.clip(u[f], -1, 1))
                low, high = np.cos(min(np.pi, to_axis + angle)), np.cos(max(0.0, to_axis - angle))
                keep &= (unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9)
            keep = np.flatnonzero(keep)
            spared += len(vecs) - len(keep)
            out.append(_best(np.array([i]), q_ids, q, bound, ids[keep], vecs[keep], k))
    done = [x for x in out if len(x[0])]
    if not done:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), spared
    return *(np.concatenate([x[j] for x in done]) for j in range(3)), spared


def _best(which, q_ids, q, bound, ids, vecs, k):
    """Of these rows the k best for each of the queries `which`, those of score >= bound, ties to the smaller id."""
    if not len(ids) or not len(which):
        return (np.empty(0, np.int64),) * 3
    order = np.argsort(ids, kind="stable")
    ids, vecs = ids[order], vecs[order]
    s = products(q[which], vecs)
    ok = (ids[None, :] != q_ids[which][:, None]) & (s >= bound[which][:, None])
    if len(ids) > k:  # narrow to the k best, with every tie at the cut
        lowest = np.iinfo(np.int64).min
        cut = np.partition(np.where(ok, s, lowest), len(ids) - k, axis=1)[:, len(ids) - k]
        ok &= s >= cut[:, None]
    r, c = np.nonzero(ok)
    order = np.lexsort((ids[c], -s[r, c], r))
    r, c = r[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    r, c = r[rank < k], c[rank < k]
    return which[r], ids[c], s[r, c]


def top_k(
    vectors: DataFrame,
    id_col: str,
    vec_col: str,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    bucket_rows: int = 2048,
    query_rows: int = 2048,
) -> DataFrame:
    """Each query's k best rows by inner product of floor(scale * x): query_id, rank, vec_id, score.

    is_query is a condition on the column `id` (long). A query never returns its own id. Ties go to the smaller
    id. Vectors that are null or hold null or non-finite components take no part; of rows that repeat an id the
    one with the largest vector counts; only vectors of the query's dimension are compared (others have no inner
    product with it); with fewer than k candidates all are returned; an empty table gives an empty result.
    Zero-length vectors score 0. Components and products beyond a long become the nearest long. Other columns of the
    input are ignored.

    Exactness: bounds only ever come from scores seen, and are compared with a tolerance on the safe side.
    """
    spark = vectors.sparkSession
    rows = stored(quantized(vectors, id_col, vec_col, scale), "vectors")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("len").desc(), F.col("id")]
    n_rows, n_queries = rows.count(), rows.where(is_query).count()
    # Equal lengths are parted by id, so one common vector fills many buckets, not one task.
    buckets = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_packed(bucket_rows), PACKED), "buckets")
    # The first bounds come from at most bucket_rows of the longest vectors: that bucket is broadcast.
    seeds = [tuple(r) for r in buckets.select("dim", "ids", "vecs").orderBy(F.col("longest").desc(), "block").limit(1).collect()]
    down = max(1, -(-n_queries // (query_rows * CELL_BLOCKS)))
    needed = rows.where(is_query).mapInPandas(_needed(seeds, k), "id long, v array<long>, len double, need double")
    dealt = needed.repartitionByRange(down, "need", "id").sortWithinPartitions("need", "id")
    queries = stored(dealt.mapInPandas(_packed(query_rows), PACKED).withColumn("down", F.shiftright("block", 32).cast("int")), "queries")
    # The least need of each row of the grid, ascending: one number for some thousands of queries.
    needs = {r["down"]: r["need"] for r in queries.groupBy("down").agg(F.min("need").alias("need")).collect()}
    least = np.minimum.accumulate([needs.get(d, np.inf) for d in range(max(needs, default=-1), -1, -1)] or [np.inf])[::-1]
    # No more cells than full buckets: each cell sends k rows for a query, however little it has seen.
    across = max(1, min(-(-2 * parts // down), -(-n_rows // bucket_rows)))

    def run(frames):
        cell, blocks = None, []

        def results():
            for b in blocks:
                q, i, s = b.best
                if len(q):
                    yield pd.DataFrame({"query_id": b.ids[q], "vec_id": i, "score": s})

        for frame in frames:
            for r in frame.itertuples(index=False):
                if (r.down, r.across) != cell:
                    yield from results()
                    cell, blocks = (r.down, r.across), []
                ids, vecs = _matrix(r.ids, r.vecs, r.dim)
                if not r.is_bucket:
                    blocks.append(Block(ids, vecs, k))
                    for dim, *seed in seeds:
                        if dim == r.dim:
                            blocks[-1].seed(*_matrix(*seed, dim))
                    continue
                for b in blocks:
                    if b.vecs.shape[1] == r.dim:
                        b.meet(ids, vecs)
        yield from results()

    @F.pandas_udf("int")
    def reach(longest: pd.Series) -> pd.Series:
        """How many rows of the grid, from the first, have a need that this length meets."""
        return pd.Series(np.searchsorted(least, longest.to_numpy() + 1e-6, side="right").astype(np.int32))

    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    place = F.pmod(F.xxhash64("block"), F.lit(across)).cast("int")
    met = buckets.withColumn("reach", reach("longest")).where("reach > 0")
    cells = (
        queries.withColumn("is_bucket", F.lit(False)).withColumn("across", upto(F.lit(across)))
        .unionByName(met.withColumns({"is_bucket": F.lit(True), "across": place, "down": upto(F.col("reach"))}).drop("reach"))
    )
    cells = cells.repartition(parts, "down", "across").sortWithinPartitions("down", "across", "is_bucket", F.col("longest").desc(), "block")
    return ranked(cells.mapInPandas(run, "query_id long, vec_id long, score long"), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Of each query's rows the k best, numbered: partial lists of k merge before and after the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all the others, k = 20."""
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, max(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
