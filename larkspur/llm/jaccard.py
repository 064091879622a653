"""Self-join of documents by the Jaccard similarity of their word n-grams.

Every document is a set of 64-bit hashes of its distinct n-grams. Documents of
equal sets are one class; classes are joined:

* Tiles. Two sets of similarity t share at least l n-grams among the first
  |x| - ceil(t |x|) + l of each, in any order common to all. A class stands in
  the tile of each of those n-grams, ordered by size, and meets only those
  whose size lies in its band (t |y| <= |x| <= |y|). l is one for short sets and
  grows with the size: a class that meets others of its band in fewer tiles than
  that has no partner and leaves. The order puts n-grams that very many documents
  have last; a list of them, of bounded size and of counts over all documents, is
  broadcast. The list decides work, not results.
* Places. A pair is made at the first n-gram that both share, and only if what
  follows it in the two sets can still hold the overlap.
* Signatures. A class has a bitmap with the parity of the number of its hashes
  in each of 512 places. The bits in which two bitmaps differ are at most the
  elements in which the sets differ, which bounds the overlap from above. What
  passes is bounded again by bitmaps as wide as the sets.
* Verification. Pairs that pass are verified by intersecting the sorted arrays
  of hashes, which are made from the texts of those documents alone.

Large groups of near copies would give all their pairs. They are joined in two
rounds: in the first each member names two partners at most in a tile, those that
differ least by their bitmaps, and the verified links give components; in the second every remaining pair of a tile
whose members lie in different components is taken. No link between components
is lost, and a tile that lies within one component costs nothing more.

Large tiles are parted: in the first round by hash; in the second, by the rows
counted there, into cells of at most about twice PART_ROWS rows. The commonest
component's members and the others are dealt out, each part of the one meets each
part of the other; the others meet each other in the cells of a triangular grid.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import SPACES, commonest, joined_bytes, mix64, removed, slices, spread, stored, table

BITS = 512
#: The longest list of frequent n-grams that is broadcast.
MOST_FREQUENT = 1 << 20
#: Rows of a large tile that go to one part or cell.
PART_ROWS = 1000
#: A set of n elements shares 1 + n // SHARED n-grams of its prefix with each partner of its size.
SHARED = 32
#: Earlier tiles that a row of the second round carries, to tell whether a pair has met before.
EARLIER = 8
#: Ids up to which a list of documents is broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: First round: how many nearest sizes, and how many first members of the tile, a class looks at.
NEAR, FIRST = 48, 16
PIECE = 1 << 18
#: N-grams of a task's documents that are counted together.
GATHERED = 1 << 21

_IS_SPACE = np.isin(np.arange(256), list(SPACES))
_BYTE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0xA5A5))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text (lower-cased already). A text of fewer words is one n-gram; none, if it has no word."""
    if not texts:
        return []
    raw, begin = joined_bytes(texts, b" ")
    solid = ~_IS_SPACE[raw]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    w0, w1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(w0):
        return [np.empty(0, np.uint64)] * len(texts)
    at = np.flatnonzero(solid)
    size = w1 - w0
    starts = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(starts, size)
    power = np.cumprod(np.full(int(size.max()), _ODD))
    word = mix64(np.add.reduceat(_BYTE[raw[at]] * power[place], starts) + size.astype(np.uint64))
    first = np.searchsorted(w0, begin)  # first word of each text
    n = len(word)
    gram = np.zeros(n, np.uint64)
    for k in range(words):
        gram[: n - k] += word[k:] * power_of(k)
    gram = mix64(gram)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            h = np.sort(gram[a : b - words + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif b > a:
            h = np.uint64(b - a)
            for k in range(a, b):
                h = h * _ODD + word[k]
            out.append(mix64(np.array([h])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def power_of(k: int) -> np.uint64:
    return np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64))


def _pieces(batches, columns):
    for batch in batches:
        for _, part in slices(batch, columns[-1], PIECE):
            cols = [part.column(c).to_pylist() for c in columns]
            cols[-1] = [(x or b"").lower() for x in cols[-1]]
            yield cols


# -- frequent n-grams --------------------------------------------------------


def _repeated(words):
    """N-grams that several of a task's documents have, and of how many: those seen once among GATHERED others are let go."""

    def run(batches):
        pending, n_pending, held, counts = [], 0, [], []

        def merged():
            h, at = np.unique(np.concatenate(held), return_inverse=True)
            return h, np.bincount(at, np.concatenate(counts)).astype(np.int64)

        def gather():
            h, n = np.unique(np.concatenate(pending), return_counts=True)
            held.append(h[n > 1])
            counts.append(n[n > 1])

        for (texts,) in _pieces(batches, ["text"]):
            with np.errstate(over="ignore"):
                sets = shingle_hashes(texts, words)
            pending += sets
            n_pending += sum(map(len, sets))
            if n_pending > GATHERED:
                gather()
                pending, n_pending = [], 0
                if len(held) > 16:
                    h, n = merged()
                    held, counts = [h], [n]
        if pending:
            gather()
        if held:
            h, n = merged()
            h = h.astype(np.int64)
            for k in range(0, len(h), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[k : k + 20_000]), pa.array(n[k : k + 20_000])], ["h", "n"])

    return run


def frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) of the commonest n-grams over all documents, and about how many documents have each (no more than do)."""
    rows = stored(docs.mapInArrow(_repeated(words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "frequent")
    found = commonest(rows, "n", "h", MOST_FREQUENT).toArrow()
    removed(rows)
    h, n = found.column("h").to_numpy().astype(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


# -- classes -----------------------------------------------------------------

ROWS = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("bits", pa.binary()), ("wide", pa.binary()), ("prefix", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32()))])


def digest(h: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix64(h ^ np.uint64(c)).sum(dtype=np.uint64).astype(np.int64)) for c in (0x51ED270B, 0xC2B2AE3D27D4EB4F))


def bitmap(h: np.ndarray, bits: int = BITS) -> bytes:
    return np.packbits(np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def wide_bits(n: int) -> int:
    """Places of a bitmap in which sets of n elements still differ visibly: a power of two, so that wider ones fold onto narrower."""
    return max(BITS, 1 << (n - 1).bit_length())


def differing(x: bytes, y: bytes) -> int:
    """Differing bits of two bitmaps, the longer one folded; at most the elements in which the sets differ."""
    a, b = (np.frombuffer(z, np.uint64) for z in (x, y))
    if len(a) < len(b):
        a, b = b, a
    a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def shared_of(n: int) -> int:
    """N-grams that two similar sets of n elements at least share among their prefixes."""
    return 1 + n // SHARED


def _described(words, num, den, hot_list):
    """Per document its size, digest, bitmap and tiles; num/den is the similarity."""

    def run(batches):
        hot, times = hot_list.value
        maybe = np.zeros(1 << 24, bool)
        maybe[(hot >> np.uint64(40)).astype(np.int64)] = True
        for ids, texts in _pieces(batches, ["doc_id", "text"]):
            rows = []
            with np.errstate(over="ignore"):
                sets = shingle_hashes(texts, words)
                for doc_id, h in zip(ids, sets, strict=True):
                    n = len(h)
                    if not n:
                        rows.append((doc_id, 0, 0, 0, None, None, None, None))
                        continue
                    p = min(n, n - -(-num * n // den) + shared_of(n))
                    often = np.flatnonzero(maybe[(h >> np.uint64(40)).astype(np.int64)])
                    count = np.zeros(n, np.int64)
                    if len(often) and len(hot):
                        at = np.minimum(np.searchsorted(hot, h[often]), len(hot) - 1)
                        count[often] = np.where(hot[at] == h[often], times[at], 0)
                    pick = np.lexsort((h, count))[:p] if count.any() else np.arange(p)
                    rows.append((doc_id, n, *digest(h), bitmap(h), bitmap(h, wide_bits(n)) if n > BITS else None, h[pick].astype(np.int64), (1 + count[pick] // PART_ROWS).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS)

    return run


# -- candidates --------------------------------------------------------------

PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(1, dtype=np.int64)


def tile_pairs(tile, n, pos, cid, label, home, cross, bits, earlier, num, den, everything):
    """Pairs (row numbers) of neighbouring rows of a tile that may be similar; rows come ordered by tile and size.

    everything: all pairs of different labels that have not met in an earlier tile (where `cross`, of different homes
    alone; homes below 0 are the two sides of a cell, whose own rows are not compared at all); else two partners at most, the nearest by bitmap of the NEAR next in size and of the FIRST of the tile. pos: the n-gram's place in the order of each set.
    """
    new = np.concatenate([[True], tile[1:] != tile[:-1]])
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    place = np.arange(len(tile)) - start
    bits = np.frombuffer(b"".join(bits), np.uint64).reshape(len(tile), -1)
    left, right = [], []

    def passing(i, j):
        """Which pairs of rows j before i lie within the band and have places and bitmaps that leave overlap enough; in how many bits they differ."""
        both = -(-num * (n[i] + n[j]) // (den + num))
        ok = (den * n[j] >= num * n[i]) & (cid[i] != cid[j]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= both)
        if everything:
            ok &= (label[i] != label[j]) & ~(cross[i] & (home[i] == home[j]))
        k = np.flatnonzero(ok)
        differ = _popcount(bits[i[k]] ^ bits[j[k]])
        near = differ <= n[i[k]] + n[j[k]] - 2 * both[k]
        return k[near], differ[near]

    def partners(rows, others, steps):
        """Of some other rows of its tile the one that differs least from each row, the first of several."""
        best, who = np.full(len(tile), BITS + 1), np.zeros(len(tile), np.int64)
        for step in range(steps):
            rows = rows[others(rows, step) >= start[rows]] if step else rows
            if not len(rows):
                break
            there = others(rows, step)
            rows, there = rows[there < rows], there[there < rows]
            k, differ = passing(rows, there)
            less = differ < best[rows[k]]
            best[rows[k[less]]], who[rows[k[less]]] = differ[less], there[k[less]]
        found = np.flatnonzero(best <= BITS)
        left.append(found)
        right.append(who[found])

    if not everything:
        partners(np.flatnonzero(place >= 1), lambda rows, step: rows - 1 - step, NEAR)
        partners(np.flatnonzero(place >= 2), lambda rows, step: start[rows] + step, FIRST)
        return np.concatenate(left), np.concatenate(right)
    def take(i, j):
        """Keep the pairs of rows j before i that pass and have not met before."""
        k, _ = passing(i, j)
        fresh = [x for x in k if earlier(i[x]).isdisjoint(earlier(j[x]))]
        left.append(i[fresh])
        right.append(j[fresh])

    live, d = np.flatnonzero((place >= 1) & ~(cross & (home < 0))), 1
    while len(live):
        live = live[place[live] >= d]
        live = live[den * n[live - d] >= num * n[live]]  # sizes only fall further back
        take(live, live - d)
        d += 1
    # Where two sides meet, each row of the smaller side is held against all of the other.
    sides = np.flatnonzero(cross & (home < 0))
    if len(sides):
        cell = np.cumsum(new)[sides]
        cell -= cell[0]
        counts = np.bincount(cell, minlength=cell[-1] + 1)
        low = np.bincount(cell, home[sides] == -2, minlength=len(counts)).astype(np.int64)
        few = (home[sides] == -2) == (2 * low <= counts)[cell]
        some, many, n_few = sides[few], sides[~few], np.bincount(cell[few], minlength=len(counts))
        first = np.cumsum(n_few) - n_few
        cell, d = cell[~few], 0
        while len(many):
            more = n_few[cell] > d
            many, cell = many[more], cell[more]
            if len(many):
                other = some[first[cell] + d]
                take(np.maximum(many, other), np.minimum(many, other))
            d += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def _whole_tiles(batches):
    """Tables of whole tiles, from rows ordered by (tile, part)."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        t = t.combine_chunks()
        if not t.num_rows:
            continue
        tile, part = t.column("tile").to_numpy(), t.column("part").to_numpy()
        last = np.flatnonzero((tile != tile[-1]) | (part != part[-1]))
        cut = last[-1] + 1 if len(last) else 0  # the last tile may go on
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _candidates(num, den, everything):
    def run(batches):
        for t in _whole_tiles(batches):
            c = {k: t.column(k).to_numpy(zero_copy_only=False) for k in ("tile", "part", "n", "pos", "cid", "label", "home", "cross")}
            before = t.column("earlier")
            known: dict[int, frozenset] = {}

            def earlier(i, before=before, known=known):
                if i not in known:
                    known[i] = frozenset(before[int(i)].as_py() or ())
                return known[i]

            # One number for (tile, part): neighbours differ in one of them.
            new = np.concatenate([[True], (c["tile"][1:] != c["tile"][:-1]) | (c["part"][1:] != c["part"][:-1])])
            n, pos = c["n"].astype(np.int64), c["pos"].astype(np.int64)
            i, j = tile_pairs(np.cumsum(new), n, pos, c["cid"], c["label"], c["home"], c["cross"], t.column("bits").to_pylist(), earlier, num, den, everything)
            a, b = np.minimum(c["cid"][i], c["cid"][j]), np.maximum(c["cid"][i], c["cid"][j])
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
            a, b = a[once], b[once]
            for k in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 50_000]), pa.array(b[k : k + 50_000])], schema=PAIRS)

    return run


def _tiles_of_two(num, den):
    """Of rows ordered by (tile, part, n) those with a neighbour in their size band, or of several parts."""

    def run(batches):
        held, paired = None, False
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            t = t.combine_chunks()
            if not t.num_rows:
                continue
            tile, part, parts, n = (t.column(k).to_numpy() for k in ("tile", "part", "parts", "n"))
            n = n.astype(np.int64)
            same = (tile[1:] == tile[:-1]) & (part[1:] == part[:-1]) & (den * n[:-1] >= num * n[1:])
            keep = parts > 1
            keep[1:] |= same
            keep[:-1] |= same
            # The last row may be the first of a pair; it waits, marked by what came before it.
            keep[0] |= paired
            paired = bool(keep[-1])
            yield from t.slice(0, t.num_rows - 1).filter(pa.array(keep[:-1])).to_batches()
            held = t.slice(t.num_rows - 1)
        if held is not None and paired:
            yield from held.to_batches()

    return run


def live_tiles(classes: DataFrame, num: int, den: int) -> DataFrame:
    """cid, n, pos, tile, parts, part: the rows of tiles in which classes meet others of their band, of classes that do so often enough."""
    key = ["tile", "part"]
    entries = (
        classes.select("cid", "n", F.posexplode(F.arrays_zip("x.prefix", "x.parts")).alias("pos", "e"))
        .select("cid", "n", "pos", F.col("e.prefix").alias("tile"), F.col("e.parts").alias("parts"))
        .withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    )
    met = entries.repartition(*key).sortWithinPartitions(*key, "n", "cid").mapInArrow(_tiles_of_two(num, den), "cid long, n int, pos int, tile long, parts int, part int")
    # The least partner in the band has ceil(num n / den) elements.
    need = F.expr(f"1 + ceil({num} * n / {den}) div {SHARED}")
    met = met.withColumn("met", F.count("*").over(Window.partitionBy("cid"))).where(F.col("met") >= need)
    # Of a similar pair's shared n-grams the first stands among these; the places beyond were there for the count.
    return stored(met.where(F.expr(f"pos <= n - ceil({num} * n / {den})")).drop("met"), "tiles")


def cells(open_: DataFrame) -> DataFrame:
    """The rows of open tiles dealt into cells (part) of at most about twice PART_ROWS rows: part, home, cross beside their columns.

    Of a large tile the commonest label's rows (main) and all others are dealt out by hash; each part of the main rows (home
    -1) meets each part of the others (home -2). Among themselves the others meet in the cells of a triangular grid over
    their parts. In a cell that is `cross` rows of one home are not compared.
    """
    large = open_.groupBy("tile", "label").count().groupBy("tile").agg(F.max(F.struct("count", "label")).alias("m"), F.sum("count").alias("all")).where(F.col("all") > PART_ROWS)
    parts = lambda n: F.ceil(n / PART_ROWS).cast("int")
    large = large.select("tile", F.col("m.label").alias("main"), parts(F.col("m.count")).alias("mains"), parts(F.greatest(F.col("all") - F.col("m.count"), F.lit(1))).alias("others"))
    mine = F.pmod(F.xxhash64("cid"), F.when(F.col("label") == F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")

    def cell(part, home, cross):
        return F.struct(part.cast("int").alias("part"), home.cast("int").alias("home"), cross.alias("cross"))

    def met(main, other, home):
        return cell(main * F.col("others") + other, F.lit(home), F.lit(True))

    def grid(k):
        low, high = F.least(mine, k), F.greatest(mine, k)
        return cell(F.col("mains") * F.col("others") + (high * (high + 1) / 2).cast("int") + low, mine, mine != k)

    visits = (
        F.when(F.col("main").isNull(), F.array(cell(F.lit(0), F.lit(0), F.lit(False))))
        .when(F.col("label") == F.col("main"), F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda k: met(mine, k, -1)))
        .otherwise(
            F.concat(
                F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda k: met(k, mine, -2)),
                F.transform(F.sequence(F.lit(0), F.col("others") - 1), grid),
            )
        )
    )
    return open_.drop("part").join(large, "tile", "left").withColumn("v", F.explode(visits)).select("*", "v.part", "v.home", "v.cross").drop("v", "main", "mains", "others")


# -- verification ------------------------------------------------------------


def _sets(words):
    def run(batches):
        for (texts,) in _pieces(batches, ["text"]):
            with np.errstate(over="ignore"):
                sets = [h for h in shingle_hashes(texts, words) if len(h)]
                rows = [(*digest(h), len(h), h.tobytes()) for h in sets]
            if rows:
                d1, d2, n, h = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int32()), pa.array(h, pa.binary())], ["d1", "d2", "n", "h"])

    return run


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the intersection of two ascending arrays without repeats."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0


def _verified(num, den):
    def run(batches):
        for batch in batches:
            keep = []
            for hx, hy in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True):
                x, y = np.frombuffer(hx, np.uint64), np.frombuffer(hy, np.uint64)
                both = overlap(x, y)
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _narrowed(num, den):
    def run(batches):
        for batch in batches:
            n = zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), strict=True)
            bits = zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True)
            keep = [(den + num) * differing(x, y) <= (den - num) * (a + b) for (a, b), (x, y) in zip(n, bits, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def narrowed(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that bitmaps as wide as the sets leave over: long documents fill the bitmaps of the tiles."""
    side = [classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.coalesce("x.wide", "x.bits").alias(f"x{c}")) for c in "ab"]
    kept = stored(pairs.join(side[0], "a").join(side[1], "b").mapInArrow(_narrowed(num, den), "a long, b long"), "narrowed")
    removed(pairs)
    return kept


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Of a stored table of pairs of classes (a, b) those that are similar, by exact intersection of their sets. The table goes."""
    pairs = narrowed(pairs, classes, num, den)
    need = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    who = stored(classes.select("cid", "d1", "d2", "n", "id").join(need, "cid"), "needed")
    ids = who.select(F.coalesce("id", F.lit(-1)).alias("id")).distinct()
    ids = F.broadcast(ids) if who.count() <= BROADCAST_ROWS else ids
    texts = docs.join(ids, F.coalesce(docs["doc_id"], F.lit(-1)) == ids["id"], "left_semi").select("text")
    sets = texts.mapInArrow(_sets(words), "d1 long, d2 long, n int, h binary").dropDuplicates(["d1", "d2", "n"]).join(who.drop("id"), ["d1", "d2", "n"]).select("cid", "h")
    sets = stored(sets, "sets")
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("cid").alias("b"), F.col("h").alias("hb")), "b")
    links = stored(both.mapInArrow(_verified(num, den), "a long, b long"), "links")
    for done in (pairs, who, sets):
        removed(done)
    return links


# -- components --------------------------------------------------------------


def _contracted(batches):
    """The edges of one task as a forest: each node with the smallest that it reaches within the task."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    rows = [(x, r) for x in list(parent) if (r := root(x)) != x]
    for k in range(0, len(rows), 50_000):
        u, v = zip(*rows[k : k + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b): the smallest node of its component, roots included.

    Large-star and small-star steps in turn until every node points at its root; each step is written out.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).mapInArrow(_contracted, "u long, v long").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = stored(small, "edges")
        state = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
        same = edges.agg(*state).first() == after.agg(*state).first()
        removed(after if same else edges)
        if same:
            roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        edges = after


# -- the join ----------------------------------------------------------------


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, n_class (rows of equal sets).

    Texts are lower-cased in A-Z and split at ASCII whitespace. Two rows are linked when 100 * intersection >=
    percent * union of their sets of distinct `words`-word n-grams; component_id is the smallest doc_id that links
    reach. Null, empty and blank texts have no n-gram and are linked with nothing; a null doc_id takes its
    component's smallest (null, if there is none). Repeated rows are copies like any other. An empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    num, den = percent, 100
    hot = spark.sparkContext.broadcast(frequent(docs.select("text"), words))  # at most MOST_FREQUENT entries
    schema = "doc_id long, n int, d1 long, d2 long, bits binary, wide binary, prefix array<long>, parts array<int>"
    rows = stored(docs.mapInArrow(_described(words, num, den, hot), schema), "rows")
    classes = (
        rows.where("n > 0").groupBy("d1", "d2", "n")
        .agg(F.min("doc_id").alias("id"), F.count("*").alias("n_class"), F.min(F.struct("bits", "wide", "prefix", "parts")).alias("x"))
        .select(F.monotonically_increasing_id().alias("cid"), "*")
    )
    classes = stored(classes, "classes")
    tiles = live_tiles(classes, num, den)
    # What has served goes: the prefixes are as large as the sets are long.
    classes, full = stored(classes.withColumn("x", F.col("x").dropFields("prefix", "parts")), "classes"), classes
    removed(full)
    rows, full = stored(rows.select("doc_id", "n", "d1", "d2"), "rows"), rows
    removed(full)
    del full
    bits = classes.select("cid", F.col("x.bits").alias("bits"))
    key = ["tile", "part"]

    def pairs_of(rows: DataFrame, everything: bool) -> DataFrame:
        dealt = rows.select(*key, "n", "pos", "cid", "label", "home", "cross", "bits", "earlier").repartition(*key).sortWithinPartitions(*key, "n", "cid")
        return stored(dealt.mapInArrow(_candidates(num, den, everything), "a long, b long").distinct(), "pairs")

    alone = {"label": F.col("cid"), "home": F.lit(0), "cross": F.lit(False), "earlier": F.lit(None).cast("array<long>")}
    links = verified(pairs_of(tiles.join(bits, "cid").withColumns(alone), False), docs, classes, words, num, den)
    roots = stored(components(links), "roots")
    removed(links)

    # Second round: tiles that hold members of several components.
    named = tiles.drop("parts").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("label", F.coalesce("root", "cid")).drop("root")
    mixed = named.groupBy("tile").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("tile")
    before = Window.partitionBy("cid").orderBy("pos").rowsBetween(-EARLIER, -1)
    open_ = stored(named.join(mixed, "tile", "left_semi").withColumn("earlier", F.collect_list("tile").over(before)).join(bits, "cid"), "open")
    removed(tiles)
    more = verified(pairs_of(cells(open_), True), docs, classes, words, num, den)
    if more.isEmpty():
        found = roots
    else:
        found = stored(components(more.union(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")

    removed(open_)

    # A class's root, the root's smallest doc_id, and from the classes down to the rows.
    of_class = classes.select("cid", "d1", "d2", "n", "id", "n_class").join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = of_class.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = of_class.join(lowest, "root").select("d1", "d2", "n", "n_class", "component_id")
    out = rows.select("doc_id", "n", "d1", "d2").join(of_class, ["d1", "d2", "n"], "left")
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("n_class")).otherwise(F.lit(1)).alias("n_class"),
    )


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "n_shingles", "component_id")
