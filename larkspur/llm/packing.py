"""Packing documents into as few sequences of bounded length as can be found.

Texts become token ids and an end id; only what is longer than a sequence is
cut, from its end, so that all pieces but the first are full. How many pieces
there are of each length is all that packing depends on: at most as many numbers
as a sequence has tokens, whatever the number of documents.

* Bin completion. A sequence is begun with the longest piece that is left and
  completed by an undominated filling: one of which no part may be swapped for a
  longer piece that is left out and still fits. Fillings are found from the least
  waste on, by tables of reachable sums, and taken as often as the numbers of
  pieces allow.
* Branch and bound. A branch goes where its waste, or a lower bound for what is
  left, shows that it cannot beat the best solution known. The first solution is
  best fit in order of length; best fit also completes branches that are left.
* Places. A piece's number among those of its length, from the counts by task
  and the piece's number within its task, leads to its sequence and offset.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import shipped, slices, spread, stored, table
from larkspur.llm.tokens import PATTERN

CAPACITY = 1024
#: The id that ends every document.
END = 2
#: Fillings that a branch tries, steps that a search takes in all, and steps after which best fit completes a branch.
FILLINGS, STEPS, COMPLETE = 4, 6000, 200


# -- token ids -------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the other bytes from U+0100 on, in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(source: str):
    """text -> ids (uint32) as the tokenizer of the JSON text `source` gives them, without special tokens added.

    Byte-level BPE whose ids rank its merges, with the usual pattern, is encoded by ranks, which is faster; texts that
    hold a special token's string, and all other tokenizers, by the library of the file.
    """
    import tiktoken
    from tokenizers import Tokenizer

    whole, spec = Tokenizer.from_str(source), json.loads(source)

    def exact(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    usual = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
    if not usual or model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return exact
    special = [x["content"] for x in spec.get("added_tokens", [])]
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    if merged != sorted(merged) or not all(bytes([b]) in ranks for b in range(256)):
        return exact
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return exact(text)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int, place long"


def pieces(docs: DataFrame, source: str, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """A row per piece of the rows of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, with `ids` the ids too.

    A null text is empty: its only id is `end`. Repeated rows and rows without doc_id are documents of their own. bucket and
    place say where a piece stands among those of its length: which task, and which number there.
    """
    given = shipped(docs.sparkSession, source)

    def run(batches):
        encode, seen = encoder(given()), np.zeros(capacity + 1, np.int64)
        bucket = TaskContext.get().partitionId()
        for part in (p for b in batches for _, p in slices(b, 1, 1 << 21)):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                all_ids = np.append(encode(text), np.uint32(end)).astype("<u4")
                start = 0
                for k in range(-(-len(all_ids) // capacity)):
                    stop = len(all_ids) - (-(-len(all_ids) // capacity) - 1 - k) * capacity
                    own = all_ids[start:stop]
                    rows.append((doc_id, k, start, len(own), zlib.crc32(own.tobytes()), bucket, int(seen[len(own)]), *([own.astype(np.int64)] if ids else [])))
                    seen[len(own)] += 1
                    start = stop
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.list_(pa.int64())] if ids else [])]
            names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * ids
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return cols.mapInArrow(run, PIECES + ", ids array<long>" * ids)


# -- packing by numbers of lengths -------------------------------------------------

#: A pattern: the lengths in a sequence with how often each stands there, and how many sequences are like that.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """A lower bound: for each k, pieces over capacity - k share with none of k or more, those over half with none of their kind."""
    size = np.arange(capacity + 1)
    total = np.concatenate([[0], np.cumsum(counts * size)])  # of lengths below the index
    many = np.concatenate([[0], np.cumsum(counts)])
    k, half = np.arange(capacity // 2 + 1), capacity // 2
    large = many[-1] - many[capacity - k + 1]
    middle_n, middle = many[capacity - k + 1] - many[half + 1], total[capacity - k + 1] - total[half + 1]
    small = total[half + 1] - total[np.minimum(k, half + 1)]
    rest = np.maximum(0, small - (middle_n * capacity - middle))
    return int(np.max(large + middle_n - (-rest // capacity)))


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit in falling order of length: each piece goes where it leaves the least room, or begins a sequence. Equal sequences are handled together."""
    room: dict[int, list[list]] = {}  # room left: [contents, sequences]
    for size in range(len(counts) - 1, 0, -1):
        left = int(counts[size])
        for r in sorted(r for r in room if r >= size):
            fits, kept = r // size, []
            for contents, n in room.pop(r) if left else ():
                whole = min(n, left // fits)
                over = min(fits - 1, left - whole * fits) if whole < n else 0
                for times, k in ((whole, fits), (1 if over else 0, over), (n - whole - (1 if over else 0), 0)):
                    if times and k:
                        room.setdefault(r - k * size, []).append([[*contents, (size, k)], times])
                    elif times:
                        kept.append([contents, times])
                left -= whole * fits + over
            if kept:
                room.setdefault(r, []).extend(kept)
            if not left:
                break
        fits = capacity // size
        for times, k in ((left // fits, fits), (1 if left % fits else 0, left % fits)):
            if times:
                room.setdefault(capacity - k * size, []).append([[(size, k)], times])
    return [(tuple(contents), n) for bins in room.values() for contents, n in bins]


class Sums:
    """Which sums can be made of at most so many pieces of each length: after each length, in rising order, a bit per sum."""

    def __init__(self, counts: np.ndarray, room: int):
        self.sizes = [int(s) for s in np.flatnonzero(counts[: room + 1])]
        self.counts, mask, bits = counts, (1 << (room + 1)) - 1, 1
        self.upto = [bits]
        for s in self.sizes:
            n, step = min(int(counts[s]), room // s), 1
            while n:
                take = min(step, n)
                bits |= (bits << (take * s)) & mask
                n, step = n - take, 2 * step
            self.upto.append(bits)

    def sets(self, total: int, k: int | None = None):
        """The sets of pieces with this sum, those of the longest pieces first: ((length, times), ...)."""
        k = len(self.sizes) if k is None else k
        if not total:
            yield ()
        elif self.upto[k] >> total & 1:
            s = self.sizes[k - 1]
            for n in range(min(int(self.counts[s]), total // s), -1, -1):
                if self.upto[k - 1] >> (total - n * s) & 1:
                    for rest in self.sets(total - n * s, k - 1):
                        yield ((s, n), *rest) if n else rest


def dominated(filling: tuple, waste: int, counts: np.ndarray) -> bool:
    """Whether some part of the filling may be swapped for one longer piece that is left out and still fits."""
    if not waste:
        return False
    used = dict(filling)
    sums = {0}
    for s, n in filling:
        sums = {t + k * s for t in sums for k in range(n + 1)}
    most = sum(s * n for s, n in filling) + waste
    return any(counts[x] > used.get(x, 0) for t in sums for x in range(t + 1, min(t + waste, most, len(counts) - 1) + 1))


def completions(counts: np.ndarray, room: int, allowed: int):
    """At most FILLINGS undominated fillings of `room` and their waste, the least waste first; none that wastes more than `allowed`."""
    if room < len(counts) and counts[room]:  # one piece that fits exactly dominates all else
        yield ((room, 1),), 0
        return
    sums, given, looked = Sums(counts, room), 0, 0
    for waste in range(min(room, allowed) + 1):
        if not sums.upto[-1] >> (room - waste) & 1:
            continue
        for filling in sums.sets(room - waste):
            looked += 1
            if not dominated(filling, waste, counts):
                yield filling, waste
                given += 1
            if given == FILLINGS or looked == 8 * FILLINGS:
                break
        if given == FILLINGS or looked >= 8 * FILLINGS:
            return


def bins(patterns: list[Pattern]) -> int:
    return sum(n for _, n in patterns)


def solve(counts: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> list[Pattern]:
    """Patterns that hold counts[s] pieces of each length s. Bin completion within `steps`; from best fit on, only better solutions count."""
    counts = counts.astype(np.int64)
    full = int(counts[capacity]) if len(counts) > capacity else 0
    counts = np.concatenate([counts[:capacity], np.zeros(max(0, capacity - len(counts)) + 1, np.int64)])[: capacity + 1]
    counts[0] = counts[capacity] = 0
    alone = [(((capacity, 1),), full)] if full else []
    best = best_fit(counts, capacity)
    least, total = least_sequences(counts, capacity), int((counts * np.arange(capacity + 1)).sum())

    def branches(left, waste):
        longest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[longest] -= 1
        for filling, lost in completions(rest, capacity - longest, (bins(best) - 1) * capacity - total - waste):
            content: dict[int, int] = {longest: 1}
            for s, n in filling:
                content[s] = content.get(s, 0) + n
            times = min(int(left[s]) // n for s, n in content.items())
            # Where the filling wastes, it is taken as often as the waste allows.
            if lost:
                times = max(1, min(times, ((bins(best) - 1) * capacity - total - waste) // lost))
            yield tuple(sorted(content.items(), reverse=True)), times, lost

    path: list[Pattern] = []
    stack = [(counts, 0, 0, branches(counts, 0))] if counts.any() else []
    while stack and steps and bins(best) > least:
        left, waste, used, more = stack[-1]
        step = next(more, None)
        if step is None or waste > (bins(best) - 1) * capacity - total:
            stack.pop()
            if path:
                path.pop()
            continue
        steps -= 1
        content, times, lost = step
        after = left.copy()
        for s, n in content:
            after[s] -= n * times
        here, used_now, waste_now = [*path, (content, times)], used + times, waste + lost * times
        if not after.any():
            if used_now < bins(best):
                best = here
            continue
        if used_now + least_sequences(after, capacity) >= bins(best):
            continue
        if steps % COMPLETE == 0:
            rest = best_fit(after, capacity)
            if used_now + bins(rest) < bins(best):
                best = here + rest
        path.append((content, times))
        stack.append((after, waste_now, used_now, branches(after, waste_now)))
    return alone + best


# -- places ------------------------------------------------------------------------


def slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, ordered by the first number of its pieces: that number, first sequence, times in a sequence, offset there."""
    out: dict[int, list] = {}
    upto: dict[int, int] = {}
    sequence = 0
    for content, n in patterns:
        offset = 0
        for s, k in content:
            first = upto.get(s, 0)
            out.setdefault(s, []).append((first, sequence, k, offset))
            upto[s] = first + n * k
            offset += s * k
        sequence += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in out.items()}


def pack(rows: DataFrame, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """rows (a stored table of pieces) with sequence_id and offset, without bucket and place.

    The driver gets how many pieces each length has, at most `capacity` numbers. Pieces of one length are numbered by
    the counts of each task, so that a length that a third of all rows have goes through no single task.
    """
    spark = rows.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    by_task = stored(rows.groupBy("bucket", "length").agg(F.count("*").alias("n")), "lengths")
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    given = shipped(spark, slots(solve(counts, capacity, steps)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    columns = [c for c in rows.columns if c not in ("bucket", "place")]
    numbered = rows.join(firsts, ["bucket", "length"]).select(*columns, (F.col("first") + F.col("place")).alias("number"))

    def run(batches):
        where = given()
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length).tolist():
                rows_of = np.flatnonzero(length == s)
                first, begin, times, at = where[s]
                k = np.searchsorted(first, number[rows_of], "right") - 1
                nth = number[rows_of] - first[k]
                sequence[rows_of], offset[rows_of] = begin[k] + nth // times[k], at[k] + nth % times[k] * s
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    ddl = ", ".join(f"{n} {k}" for n, k in numbered.select(*columns).dtypes).replace("bigint", "long")
    return numbered.mapInArrow(run, f"{ddl}, sequence_id long, offset long")


def packed(docs: DataFrame, source: str, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """Each piece of docs (doc_id, text) with its sequence and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset, with `ids` the ids.

    `source` is a tokenizer's JSON text. Null and empty texts have the end id alone. An empty table gives no rows. Other columns are ignored.
    """
    return pack(stored(pieces(spread(docs.select("doc_id", "text")), source, capacity, end, ids), "pieces"), capacity)


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, from packed() with ids; at most `capacity` of them meet."""
    held = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return held.select("sequence_id", F.flatten("x.ids").alias("ids"))


def vocabulary(path: str | None = None) -> str:
    """A tokenizer file's text, read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary())
