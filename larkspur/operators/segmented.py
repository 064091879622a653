"""A stored index that changes: immutable segments under a manifest, tombstones, merging, and a top-k that skips blocks.

A segment holds documents and their postings. Its documents are dealt to blocks
of about BLOCK_DOCS by hash of the id; the postings of a term in a block are one row (several, where its documents are very long), with
ids as offsets from the first, and with what bounds their scores: the
largest term frequency and the least document length. These bounds hold whatever
the statistics of the whole index become. Documents are shuffled to their blocks, and
a block's postings are counted and laid out where its documents are; a merge keeps
blocks as they are and lays out anew only those that are small.

Every change writes files of its own and is committed by one rename, which gives
the next manifest its name: readers see all of it or nothing, and of two writers
that began at one manifest the later is told that the index is busy.

Removed documents stay in counts of documents and terms and leave the total
length; their ids stay taken, through merges too.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators.constraints import BROADCAST_ROWS
from larkspur.operators.index import accepted, bucket, tokens
from larkspur.operators.lineage import Busy, cut
from larkspur.operators.rank import K1, B, bm25, parameters, query_tokens, top

BLOCK_DOCS, BUCKETS = 4096, 64
#: Tokens of a block that are counted at once.
MOST_TOKENS = 1 << 22
#: Segments of one tier (sizes within TIER times of each other) that are merged together.
TIER, SEGMENTS = 4, 4
#: Blocks that a search reads before it knows what score enters.
FIRST_BLOCKS = 8

DOCS = "segment string, id bigint, url string, title string, length int, block int"
POSTINGS = "segment string, term string, block int, n int, max_tf int, min_length int, first bigint, offsets array<bigint>, tfs array<int>, lengths array<int>, bucket int"
LAID = "block int, term string, n int, max_tf int, min_length int, first bigint, offsets array<bigint>, tfs array<int>, lengths array<int>"
GONE = "id bigint, length int"


@dataclass(frozen=True)
class Manifest:
    """version; segments [(name, number of documents)]; names of tombstone files; documents in all, and the length of those not removed; the last batch added of each stream."""

    version: int
    segments: tuple[tuple[str, int], ...]
    gone: tuple[str, ...]
    n_docs: int
    total_length: int
    batches: tuple[tuple[str, int], ...] = ()

    @property
    def avgdl(self) -> float:
        return self.total_length / self.n_docs if self.n_docs else 0.0


@dataclass(frozen=True)
class Found:
    """hits: id, score of the best. blocks: (segment, block) pairs with a term of the query; read: those whose postings were read."""

    hits: DataFrame
    blocks: int
    read: int


class SegmentedIndex:
    """An index in a shared folder. Every method works on the manifest that is the last when it begins."""

    def __init__(self, spark: SparkSession, path: str, profile: str = "ascii"):
        self.spark, self.path, self.profile = spark, path.rstrip("/"), profile

    # -- manifests ---------------------------------------------------------------

    def _hadoop(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> Manifest:
        """The last one that was committed; an empty index where there is none."""
        at, fs = self._hadoop()
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        versions = [int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-")]
        if not versions:
            return Manifest(0, (), (), 0, 0)
        text = self.spark.read.text(f"{self.path}/manifest-{max(versions)}", wholetext=True).first()[0]
        held = json.loads(text)
        return Manifest(max(versions), tuple((n, k) for n, k in held["segments"]), tuple(held["gone"]), held["n_docs"], held["total_length"], tuple((n, k) for n, k in held["batches"]))

    def _commit(self, now: Manifest) -> Manifest:
        """Make `now` the manifest of its version; Busy where that version is there already."""
        text = json.dumps({"segments": now.segments, "gone": now.gone, "n_docs": now.n_docs, "total_length": now.total_length, "batches": now.batches})
        tmp, fs = self._hadoop(f"writing-{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(text.encode()))
        out.close()
        sc = self.spark.sparkContext
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), sc._jsc.hadoopConfiguration())
        options = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        to, _ = self._hadoop(f"manifest-{now.version}")
        try:
            context.rename(fs.makeQualified(tmp), fs.makeQualified(to), options)  # refuses a name that is there
        except Exception as e:
            fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e):
                raise Busy(f"manifest {now.version} is there") from e
            raise
        return now

    # -- tables --------------------------------------------------------------------

    def _read(self, kind: str, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/{kind}"
        return self.spark.read.schema(schema).parquet(*[f"{base}/{n}" for n in names]) if kind != "postings" else self._union([self.spark.read.schema(schema).option("basePath", f"{base}/{n}").parquet(f"{base}/{n}") for n in names])

    @staticmethod
    def _union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def documents(self, manifest: Manifest | None = None) -> DataFrame:
        """segment, id, url, title, length, active of all documents, removed ones too."""
        manifest = manifest or self.manifest()
        gone = self._read("gone", list(manifest.gone), GONE).select("id", F.lit(True).alias("_gone"))
        docs = self._read("docs", [n for n, _ in manifest.segments], DOCS)
        return docs.join(gone, "id", "left").withColumn("active", F.col("_gone").isNull()).drop("_gone", "block")

    def postings(self, manifest: Manifest, terms: list[str] | None = None) -> DataFrame:
        """Rows of blocks, of some terms alone: their buckets and they themselves stand in the filter as values."""
        rows = self._read("postings", [n for n, _ in manifest.segments], POSTINGS)
        if terms is None:
            return rows
        of = self.spark.range(1).select(F.array(*[bucket(F.lit(t), BUCKETS) for t in terms]).alias("b")).first()["b"] if terms else []
        return rows.where(F.col("bucket").isin(sorted(set(of))) & F.col("term").isin(terms))

    # -- changes -------------------------------------------------------------------

    def add(self, docs: DataFrame, order: Column | None = None, batch: tuple[str, int] | None = None) -> Manifest:
        """Add documents (id, text, and url and title where they have them) as a segment; `batch` (stream, number) is noted in the same commit.

        Refused are documents without id (or 0) or text, all but the first of an id in `order`, and ids that the index has or
        had. Where none is left, nothing changes.
        """
        was = self.manifest()
        known = self._read("docs", [n for n, _ in was.segments], DOCS).select("id")
        rows = accepted(docs.join(known, "id", "left_anti"), "id", order)
        for c in ("url", "title"):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(""))
        name = f"s{uuid.uuid4().hex}"
        rows = cut(rows.select("id", "url", "title", tokens(F.col("text"), self.profile).alias("tokens")))
        many, length = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
        batches = was.batches if batch is None else (*[x for x in was.batches if x[0] != batch[0]], batch)
        if not many:
            return was if batches == was.batches else self._commit(Manifest(was.version + 1, was.segments, was.gone, was.n_docs, was.total_length, batches))
        rows = rows.withColumn("block", _block(many)).withColumn("length", F.size("tokens"))
        # With all of a block in one task, its tokens are counted and laid out without travelling.
        dealt = rows.select("block", "id", "length", ("tokens" if self.profile == "ascii" else F.array_distinct("tokens").alias("tokens"))).repartition("block")
        self._write(name, rows.drop("tokens"), _counted(dealt), many)
        return self._commit(Manifest(was.version + 1, (*was.segments, (name, many)), was.gone, was.n_docs + many, was.total_length + length, batches))

    def remove(self, ids: DataFrame) -> Manifest:
        """Mark documents (id) as removed. Ids that the index lacks, or that are removed already, change nothing."""
        was = self.manifest()
        active = self.documents(was).where("active").select("id", "length")
        name = f"g{uuid.uuid4().hex}"
        active.join(ids.select("id").distinct(), "id", "left_semi").write.parquet(f"{self.path}/gone/{name}")
        many, length = self._read("gone", [name], GONE).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if not many:
            return was
        return self._commit(Manifest(was.version + 1, was.segments, (*was.gone, name), was.n_docs, was.total_length - length, was.batches))

    def merge(self, everything: bool = False) -> Manifest:
        """Merge the segments of the lowest tier that has SEGMENTS of them (or all), and the tombstone files. Counts stay as they are."""
        was = self.manifest()
        tiers: dict[int, list[tuple[str, int]]] = {}
        for name, many in was.segments:
            tier = 0
            while many >= TIER ** (tier + 1):
                tier += 1
            tiers.setdefault(tier, []).append((name, many))
        full = [list(was.segments)] if everything and len(was.segments) > 1 else [s for _, s in sorted(tiers.items()) if len(s) >= SEGMENTS][:1]
        if not full:
            return was
        names, name = [n for n, _ in full[0]], f"s{uuid.uuid4().hex}"
        many = sum(k for _, k in full[0])
        docs = self._read("docs", names, DOCS)
        of = F.create_map(*[x for n, k in full[0] for x in (F.lit(n), F.lit(1 + k // BLOCK_DOCS))])
        docs = docs.withColumn("block", F.coalesce("block", F.pmod(F.xxhash64("id"), of[F.col("segment")]).cast("int")))  # files of earlier versions do not tell
        to = F.broadcast(cut(_renumbered(docs.groupBy("segment", "block").agg(F.count("*").alias("n")))))
        held = self._read("postings", names, POSTINGS).join(to, ["segment", "block"]).drop("segment", "block", "bucket").withColumnRenamed("_to", "block")
        few = opened(held.where("_parts > 1"), "block").repartition("block")
        laid = held.where("_parts = 1").drop("_parts").unionByName(_laid(few))
        self._write(name, docs.join(to, ["segment", "block"]).select("id", "url", "title", "length", F.col("_to").alias("block")), laid, many)
        gone = was.gone
        if len(gone) > 1:
            gone = (f"g{uuid.uuid4().hex}",)
            self._read("gone", list(was.gone), GONE).write.parquet(f"{self.path}/gone/{gone[0]}")
        return self._commit(Manifest(was.version + 1, (*[s for s in was.segments if s[0] not in names], (name, many)), gone, was.n_docs, was.total_length, was.batches))

    def _write(self, name: str, docs: DataFrame, laid: DataFrame, many: int) -> None:
        """A segment's files, from documents and postings (LAID) with their blocks."""
        docs.withColumn("segment", F.lit(name)).write.parquet(f"{self.path}/docs/{name}")
        out = laid.withColumn("segment", F.lit(name)).withColumn("bucket", bucket(F.col("term"), BUCKETS))
        # A term that all documents have is in every block: its rows are dealt out over as many files as the segment needs.
        files = F.pmod("block", F.lit(1 + many // (BLOCK_DOCS * 256)))
        out.repartition("bucket", files).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{self.path}/postings/{name}")

    def vacuum(self) -> int:
        """Delete files that the last manifest does not name, and earlier manifests; how many folders and files went. For a time without readers and writers."""
        now, gone = self.manifest(), 0
        keep = {"docs": {n for n, _ in now.segments}, "postings": {n for n, _ in now.segments}, "gone": set(now.gone)}
        for kind, names in keep.items():
            at, fs = self._hadoop(kind)
            for s in fs.listStatus(at) if fs.exists(at) else ():
                if s.getPath().getName() not in names:
                    gone += bool(fs.delete(s.getPath(), True))
        at, fs = self._hadoop()
        for s in fs.listStatus(at) if fs.exists(at) else ():
            name = s.getPath().getName()
            if name.startswith("writing-") or name.startswith("manifest-") and name != f"manifest-{now.version}":
                gone += bool(fs.delete(s.getPath(), True))
        return gone

    # -- search ----------------------------------------------------------------------

    def search(self, query: str, k: int = 10, k1: float = K1, b: float = B) -> Found:
        """The k best documents by BM25, ties to the smaller id: the same as a scan gives.

        Headers tell what a block's documents can score at most. The blocks of the highest bounds are read first; of the
        others only those whose bound reaches the k-th best score so far.
        """
        k1, b = parameters(k1, b)
        now = self.manifest()
        asked = self.spark.range(1).select(query_tokens(self.profile, query).alias("t")).first()["t"]
        terms = list(dict.fromkeys(asked))
        nothing = self.spark.createDataFrame([], "id bigint, score double")
        if not terms or k <= 0 or not now.segments:
            return Found(nothing, 0, 0)
        rows = self.postings(now, terms)
        headers = rows.select("segment", "block", "term", "n", "max_tf", "min_length")
        df = {t: n for t, n in headers.groupBy("term").agg(F.sum("n")).collect()}  # a row a term of the query
        if not df:
            return Found(nothing, 0, 0)
        of = F.create_map(*[F.lit(x) for t in df for x in (t, df[t])])
        times = F.create_map(*[F.lit(x) for t in df for x in (t, asked.count(t))])

        def value(tf: str, length: str) -> Column:
            return times[F.col("term")] * bm25(F.col(tf), of[F.col("term")], F.col(length), F.lit(now.n_docs), F.lit(now.avgdl), k1, b)

        bounds = cut(headers.groupBy("segment", "block").agg(F.sum(value("max_tf", "min_length")).alias("bound")))
        best = bounds.orderBy(F.col("bound").desc(), "segment", "block").limit(FIRST_BLOCKS)
        gone = self._read("gone", list(now.gone), GONE).select("id")

        def scored(blocks: DataFrame) -> DataFrame:
            hits = opened(rows.join(blocks.select("segment", "block"), ["segment", "block"], "left_semi"))
            score = hits.groupBy("id").agg(F.sum(value("tf", "length")).alias("score")).where("score > 0")
            return score.join(gone, "id", "left_anti") if now.gone else score

        first = cut(best)
        hits = cut(top(scored(F.broadcast(first)), k))
        many, least = hits.agg(F.count("*"), F.min("score")).first()
        enter = least * (1 - 1e-12) if many == k else 0.0  # sums of the same numbers may differ in their last digit
        rest = cut(bounds.where(F.col("bound") >= enter).join(F.broadcast(first.select("segment", "block")), ["segment", "block"], "left_anti"))
        n = rest.count()
        if n:
            hits = top(hits.unionByName(scored(F.broadcast(rest) if n <= BROADCAST_ROWS else rest)), k)
        return Found(hits, bounds.count(), first.count() + n)


def _block(many: int) -> Column:
    """The block of an id in a new segment of so many documents."""
    return F.pmod(F.xxhash64("id"), F.lit(1 + many // BLOCK_DOCS)).cast("int")


def _renumbered(sizes: DataFrame) -> DataFrame:
    """Of blocks (segment, block, n) the block of the merged segment, _to, and how many share it, _parts: those with less than half of BLOCK_DOCS are put together up to about BLOCK_DOCS.

    sizes has a row a block, so that windows over all of it are small.
    """
    small = F.col("n") < BLOCK_DOCS // 2
    earlier = F.sum(F.when(small, F.col("n"))).over(W.orderBy("segment", "block").rowsBetween(W.unboundedPreceding, -1))
    rows = sizes.withColumn("_bin", F.when(small, F.floor(F.coalesce(earlier, F.lit(0)) / BLOCK_DOCS)))
    rows = rows.withColumn("_to", F.dense_rank().over(W.orderBy("_bin", F.when(~small, F.col("segment")), F.when(~small, F.col("block")))) - 1)
    return rows.select("segment", "block", "_to", F.count("*").over(W.partitionBy("_to")).alias("_parts"))


def _lists():
    """A function that makes rows (LAID) of blocks and terms, of all their postings' ids, frequencies and lengths, and of where each row's postings start. It travels by value."""

    def lists(block, term, ids, tfs, lengths, starts):
        import numpy as np
        import pyarrow as pa

        ends = np.append(starts, len(ids))
        held = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (ids - np.repeat(ids[starts], np.diff(ends)), tfs, lengths)]
        columns = [block, term, pa.array(np.diff(ends), pa.int32()), pa.array(np.maximum.reduceat(tfs, starts)), pa.array(np.minimum.reduceat(lengths, starts)), pa.array(ids[starts]), *held]
        return pa.RecordBatch.from_arrays(columns, ["block", "term", "n", "max_tf", "min_length", "first", "offsets", "tfs", "lengths"])

    return lists


def _counted(dealt: DataFrame) -> DataFrame:
    """Documents (block, id, length, tokens), all of a block in one partition, to their postings (LAID).

    A task holds MOST_TOKENS tokens at most, or one batch: where a block has more, a term gets a row for each part of it.
    """
    lists, most = _lists(), MOST_TOKENS

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def found(held):
            t = pa.Table.from_batches(held).combine_chunks()
            tokens = t.column("tokens").chunk(0)
            codes = tokens.flatten().dictionary_encode()
            doc = np.repeat(np.arange(t.num_rows), tokens.value_lengths().to_numpy())
            # A document is in its place by id, so that a term's postings come in the order of ids.
            key, tf = np.unique((codes.indices.to_numpy().astype(np.int64) << 32) | doc, return_counts=True)
            code, doc = key >> 32, key & 0xFFFFFFFF
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            if len(starts):
                block = pa.array(np.full(len(starts), t.column("block")[0].as_py()), pa.int32())
                ids, lengths = (t.column(c).to_numpy()[doc] for c in ("id", "length"))
                yield lists(block, codes.dictionary.take(pa.array(code[starts])), ids, tf.astype(np.int32), lengths, starts)

        held, size = [], 0
        for batch in batches:
            block = batch.column("block").to_numpy()
            starts = np.flatnonzero(np.diff(block, prepend=-1)) if len(block) else []
            for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
                part = batch.slice(int(a), int(b - a))
                more = int(part.column("length").to_numpy().sum(dtype=np.int64))
                if held and (size + more > most or held[0].column("block")[0].as_py() != block[a]):
                    yield from found(held)
                    held, size = [], 0
                held, size = [*held, part], size + more
        if held:
            yield from found(held)

    return dealt.sortWithinPartitions("block", "id").mapInArrow(run, LAID)


def _laid(entries: DataFrame) -> DataFrame:
    """Postings (block, term, id, length, tf), all of a block in one partition, to a row for each block and term (LAID)."""

    lists = _lists()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def found(t, starts):
            own = t.select(["block", "term"]).take(pa.array(starts)).combine_chunks()
            return lists(own.column(0).chunk(0), own.column(1).chunk(0), *(t.column(c).to_numpy() for c in ("id", "tf", "length")), starts)

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            block, term = batch.column("block"), batch.column("term")
            new = np.flatnonzero(np.array(pc.or_(pc.not_equal(block[1:], block[:-1]), pc.not_equal(term[1:], term[:-1])))) + 1
            if held and (held[-1].column("block")[-1] != block[0] or held[-1].column("term")[-1] != term[0]):
                new = np.append(0, new)
            if not len(new):  # one group so far
                held.append(batch)
                continue
            last = int(new[-1])
            t = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            yield found(t, np.append(0, new[:-1] + t.num_rows - last))
            held = [batch.slice(last)]
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks(), np.array([0]))

    return entries.select("block", "term", "id", "length", "tf").sortWithinPartitions("block", "term", "id").mapInArrow(run, LAID)


def opened(postings: DataFrame, *more: str) -> DataFrame:
    """Rows of blocks to a row for each posting: term, id, tf, length, and more of the block's columns."""
    rows = postings.select(*more, "term", "first", F.explode(F.arrays_zip("offsets", "tfs", "lengths")).alias("p"))
    return rows.select(*more, "term", (F.col("first") + F.col("p.offsets")).alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length"))
