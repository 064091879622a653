"""What the operators of this subpackage share: storage, folds and samples."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle as pickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word rule `[^\x20\x09-\x0D]+`; bytes.split() splits on the same six.
SPACES = b" \t\n\x0b\x0c\r"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share.

    Where the setting is absent and all executors are threads of this process (tests on one machine), one is chosen
    and set; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        own = sc._jsc.sc().getCheckpointDir()
        if not own.isDefined() and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = own.get() if own.isDefined() else tempfile.mkdtemp(prefix="larkspur-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/larkspur-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(name: str, columns: list[str]) -> str:
    """A column name that meets none of the caller's, as Spark compares them."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def removed(df: DataFrame) -> None:
    """Delete a stored() table that nothing reads any more: what came of it is stored itself.

    The driver's garbage is collected, so that Spark frees the shuffle files that made the table.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def fold(key: Column, parts: int) -> Column:
    """crc32(key as text) mod parts; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: a table of a few splits would keep most of them idle. Larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def commonest(rows: DataFrame, count: str, key: str, most: int, part: bool = True) -> DataFrame:
    """The rows of largest `count`, at most about `most`, found without a sort: whole classes of counts, a sixteenth of a doubling each,
    from the top; of the class that has no room (with `part`) the rows whose key hashes below a bound."""
    size = F.floor(16 * F.log2(F.col(count))).cast("int")
    least, room, over = 1 << 30, most, None
    for k, n in sorted(rows.groupBy(size.alias("size")).count().collect(), reverse=True):  # a row a class
        if n > room:
            over = (size == k) & (F.pmod(F.xxhash64(key), F.lit(n)) < int(0.9 * room))
            break
        least, room = k, room - n
    return rows.where(size >= least if over is None or not part else (size >= least) | over)


def label_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """At most `most` rows (text, y), those whose doc_id hashes lowest: the same rows on every run and layout.

    A doc_id with several label rows takes their largest label; null labels and texts take no part.
    Only ids travel to the sort; the texts of the chosen ones are then read by a broadcast of at most `most` ids.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(learn)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
        .limit(most)
    )
    return (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id")
        .agg(F.max("text").alias("text"), F.max("y").alias("y"))
        .select("text", "y")
    )


def trained(sample: DataFrame, train):
    """train(list of rows as tuples, sorted) run on the bounded sample in one task, where memory is; its result comes back pickled."""

    def run(frames):
        rows = sorted(r for f in frames for r in f.itertuples(index=False, name=None))
        yield pd.DataFrame({"model": [pickle.dumps(train(rows))]})

    made = sample.repartition(1).mapInPandas(run, "model binary").first()
    return train([]) if made is None else pickle.loads(made["model"])  # of an empty sample no task may be made


def shipped(spark: SparkSession, thing):
    """A function that gives `thing` (of bounded size) in a task. It travels by value: executors need not have this package."""
    sent = spark.sparkContext.broadcast(pickle.dumps(thing))
    return lambda: pickle.loads(sent.value)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def joined_bytes(texts: list[bytes], gap: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, `gap` after each, and the offset at which each begins (one more at the end)."""
    sizes = np.fromiter((len(x) + len(gap) for x in texts), np.int64, len(texts))
    return np.frombuffer(gap.join([*texts, b""]), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def slices(batch, column: int | str, most_bytes: int):
    """(first row, part of the Arrow batch) with about most_bytes in a text column, one row at least: only a part at a time becomes Python objects."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most_bytes
    starts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
    for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
        yield int(a), batch.slice(a, b - a)


def whole_groups(batches, keys: list[str]):
    """Tables of whole groups, from batches of rows that are ordered by the keys (none of them null)."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        last = t.slice(t.num_rows - 1)
        other = np.zeros(t.num_rows, bool)
        for k in keys:
            other |= np.array(pa.compute.not_equal(t.column(k), last.column(k)[0]))
        at = np.flatnonzero(other)
        cut = int(at[-1]) + 1 if len(at) else 0  # the last group may go on
        if cut:
            yield t.slice(0, cut).combine_chunks()
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()
