"""Exact rolling medians and median absolute deviations of series of points.

A point belongs to a series, has a time and perhaps a value. Its window holds
the values of its series in the `span` that ends with it, its own time included.

* Time is cut into slots of one span; several slots of a series and the one
  before them are a group, which holds all that its windows hold.
* Cold series are answered group by group: a wavelet matrix over the values in
  order of time gives the k-th value of any window in as many steps as their
  ranks have bits.
* Hot series are sharded by value range. A group's windows are dealt out by time,
  in cells. Each shard reports how many values it has in each cell; sums of these
  and the points that enter and leave within a cell are the counts of each window by
  shard. Counts pick the shards that hold the ranks asked for and what rank is left
  there (first round); what those shards have in the window's cells meets the windows
  and answers exactly (second round). With the medians known, the same counts bound the
  deviation from both sides, and it is bisected in the shards on its two edges.
* A shard of one value, however often it occurs, is never sent: its count is
  known.

Nothing is sampled for results: the cuts between shards come from order
statistics of the cells and decide work alone.
"""

from __future__ import annotations

import struct
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common
from larkspur.llm.common import removed, table, whole_groups

stored = partial(common.stored, codec="zstd")
HOUR = 3_600_000_000
KEY = ["series", "g"]
#: A series of more rows is hot: one task would not do.
HOT_ROWS = 8192
#: About how many values a shard has of a group, and a cell of a slot.
PART_ROWS = 1024
#: Most shards of a group and cells of a slot; where they do not suffice, they grow with the group.
MOST_PARTS = 256
#: Slots that make up a group, with the slot before them.
SLOTS = 6
#: Values above this size have no exact cents as a double, and count as none.
MOST_CENTS = 1 << 53
#: Points that one index holds in the second round.
TOGETHER = 1 << 15
#: What stands before packed numbers: bytes of each, and the least.
HEADER = "<Bq"


# -- ranks in windows ----------------------------------------------------------


class Windows:
    """The values of points in order of time, answering for any ranges of them at once."""

    def __init__(self, values: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        rank = np.empty(len(values), np.int32)
        rank[order] = np.arange(len(values), dtype=np.int32)
        self.levels = []
        for bit in range(max(1, int(len(values) - 1).bit_length()) - 1 if len(values) else -1, -1, -1):
            zero = (rank >> bit) & 1 == 0
            count = np.concatenate([[0], np.cumsum(zero)]).astype(np.int32)
            self.levels.append((bit, count, int(count[-1])))
            rank = np.concatenate([rank[zero], rank[~zero]])

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each range lo..hi-1, which holds more than k."""
        lo, hi, k, found = lo.astype(np.int32), hi.astype(np.int32), k.astype(np.int32), np.zeros(len(lo), np.int32)
        for bit, count, zeros in self.levels:
            a, b = count[lo], count[hi]
            here = b - a
            up = k >= here
            lo, hi = np.where(up, zeros + lo - a, a), np.where(up, zeros + hi - b, b)
            k = k - np.where(up, here, 0)
            found |= up.astype(np.int32) << bit
        return self.sorted[found] if len(self.sorted) else np.zeros(len(lo), np.int64)

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values of each range are less than `value`."""
        x = np.searchsorted(self.sorted, value).astype(np.int32)
        lo, hi = lo.astype(np.int32), hi.astype(np.int32)
        total = hi - lo
        every, n = x >= len(self.sorted), np.zeros(len(lo), np.int32)
        for bit, count, zeros in self.levels:
            a, b = count[lo], count[hi]
            up = (x >> bit) & 1 == 1
            n += np.where(up, b - a, 0)
            lo, hi = np.where(up, zeros + lo - a, a), np.where(up, zeros + hi - b, b)
        return np.where(every, total, n).astype(np.int64)

    def deviations(self, lo: np.ndarray, hi: np.ndarray, mid2: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k-th smallest |2 value - mid2| (k from 1) of each range and, where it holds so many, the next.

        Bisection over how many of the first k lie below the middle; the others are the nearest above.
        """
        p = self.below(lo, hi, -(-mid2 // 2))  # those with 2 value < mid2
        right = hi - lo - p
        least, most = np.maximum(0, k - right), np.minimum(p, k)
        while len(open_ := np.flatnonzero(least < most)):
            i = (least[open_] + most[open_]) // 2
            a, b, at, m = lo[open_], hi[open_], p[open_], mid2[open_]
            under = m - 2 * self.kth(a, b, at - 1 - i)
            over = 2 * self.kth(a, b, at + k[open_] - 1 - i) - m
            enough = under >= over
            most[open_[enough]] = i[enough]
            least[open_[~enough]] = i[~enough] + 1
        i, size, far = least, hi - lo, np.int64(1) << 62

        def under(j, ok):
            out = np.full(len(lo), far)
            out[ok] = mid2[ok] - 2 * self.kth(lo[ok], hi[ok], (p - 1 - j)[ok])
            return out

        def over(j, ok):
            out = np.full(len(lo), far)
            out[ok] = 2 * self.kth(lo[ok], hi[ok], (p + j)[ok]) - mid2[ok]
            return out

        last = np.maximum(np.where(i > 0, under(i - 1, i > 0), -1), np.where(k > i, over(k - 1 - i, k > i), -1))
        more = k < size
        return last, np.minimum(under(i, more & (i < p)), over(k - i, more & (k - i < right)))


def answers(index: Windows, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubled median and doubled median deviation of ranges of two values at least."""
    n = hi - lo
    median2 = index.kth(lo, hi, (n - 1) // 2) + index.kth(lo, hi, n // 2)
    first, second = index.deviations(lo, hi, median2, (n + 1) // 2)
    return median2, first + np.where(n % 2 == 0, second, first)


def ranges(group: np.ndarray, at: np.ndarray, ask: np.ndarray, when: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the points (ordered by group and time) in the windows that end at `when` in the groups `ask`."""
    if not len(at):
        return np.zeros(len(ask), np.int64), np.zeros(len(ask), np.int64)
    start = min(at.min(), when.min() - span) if len(when) else at.min()
    wide = max(at.max(), when.max() if len(when) else start) - start + 1
    if wide > (1 << 62) // (int(max(group.max(), ask.max() if len(ask) else 0)) + 1):  # no room for both in one number
        return tuple(np.array(x, np.int64) for x in zip(*(_range(group, at, g, t, span) for g, t in zip(ask, when, strict=True)), strict=True)) if len(ask) else (np.zeros(0, np.int64),) * 2
    key = group * wide + (at - start)
    return tuple(np.searchsorted(key, ask * wide + (t - start), "right") for t in (when - span, when))


def _range(group, at, g, t, span):
    a, b = np.searchsorted(group, g), np.searchsorted(group, g, "right")
    return a + np.searchsorted(at[a:b], t - span, "right"), a + np.searchsorted(at[a:b], t, "right")


RESULT = pa.schema([("series", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("median2", pa.int64()), ("mad4", pa.int64()), ("far", pa.bool_())])
RESULT_DDL = "series string, id long, n long, median2 long, mad4 long, far boolean"


def _rows(series, ids, no_id, n, median2, mad4, value, has):
    some = n >= 2
    far = 2 * np.abs(2 * value - median2) > 3 * mad4
    return pa.RecordBatch.from_arrays([series, pa.array(ids, mask=no_id), pa.array(n), pa.array(median2, mask=~some), pa.array(mad4, mask=~some), pa.array(far, mask=~(some & has))], schema=RESULT)


def _numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """A column as whole numbers, and which are not null."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _cold(span):
    def run(batches):
        for t in whole_groups(batches, KEY):
            series, segment = t.column("series").combine_chunks(), t.column("g").to_numpy()
            name = series.dictionary_encode()
            name = (name.combine_chunks() if isinstance(name, pa.ChunkedArray) else name).indices.to_numpy(zero_copy_only=False)
            group = np.concatenate([[0], np.cumsum((name[1:] != name[:-1]) | (segment[1:] != segment[:-1]))])
            at, win = t.column("at").to_numpy(), t.column("win").to_numpy()
            (value, has), (ids, named) = (_numbers(t.column(c).combine_chunks()) for c in ("c", "id"))
            w = np.flatnonzero(win)
            lo, hi = ranges(group[has], at[has], group[w], at[w], span)
            n, median2, mad4 = hi - lo, np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
            two = np.flatnonzero(n >= 2)
            if len(two):
                median2[two], mad4[two] = answers(Windows(value[has]), lo[two], hi[two])
            yield _rows(series.take(pa.array(w)), ids[w], ~named[w], n, median2, mad4, value[w], has[w])

    return run


# -- hot groups ------------------------------------------------------------------


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers as bytes: the least of them, then what each is more, in as few bytes as the largest needs. Differences wrap, so that any 64-bit numbers may stand together."""
    if not len(x):
        return b""
    least, more = int(x.min()), int(x.max()) - int(x.min())
    size = next(size for size in (1, 2, 4, 8) if more < 1 << 8 * size)
    return struct.pack(HEADER, size, least) + (x.astype(np.int64) - np.int64(least)).astype(f"<u{size}").tobytes()


def _longs(x: bytes | None) -> np.ndarray:
    if not x:
        return np.empty(0, np.int64)
    size, least = struct.unpack_from(HEADER, x)
    return np.frombuffer(x, f"<u{size}", offset=struct.calcsize(HEADER)).astype(np.int64) + np.int64(least)


def _many(x: bytes) -> int:
    """How many numbers are packed."""
    return (len(x) - struct.calcsize(HEADER)) // x[0] if x else 0


def _flags(x: bytes | None) -> np.ndarray:
    return np.frombuffer(x or b"", np.uint8).astype(bool)


def _emit(ddl: str):
    """rows (tuples) -> a record batch with the columns of the DDL text."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])
    return lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _parts_of(t: pa.Table, keys: list[str]):
    """(keys' values, part of the table) for each group of a table ordered by the keys."""
    same = np.ones(max(0, t.num_rows - 1), bool)
    for k in keys:
        c = t.column(k).combine_chunks()
        same &= np.array(pa.compute.equal(c.slice(1), c.slice(0, len(c) - 1)))
    edges = [0, *(np.flatnonzero(~same) + 1).tolist(), t.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield tuple(t.column(k)[a].as_py() for k in keys), t.slice(a, b - a)


CELL = "series string, g long, o int, span_cells int, parts int, held long, at binary, c binary, has binary, id binary, named binary, marks binary"


def _cells(batches):
    """Each cell as one row: its points in order of time, and order statistics of its values."""
    emit = _emit(CELL)
    for t in whole_groups(batches, [*KEY, "o"]):
        for key, part in _parts_of(t, [*KEY, "o"]):
            (value, has), (ids, named) = (_numbers(part.column(c).combine_chunks()) for c in ("c", "id"))
            v = np.sort(value[has])
            marks = v[(np.arange(m := min(len(v), MOST_PARTS)) * len(v)) // max(1, m)]
            shape = (part.column(c)[0].as_py() for c in ("span_cells", "parts"))
            yield emit([(*key, *shape, len(v), _packed(part.column("at").to_numpy()), _packed(value), has.tobytes(), _packed(ids), named.tobytes(), _packed(marks))])


CUTS = "series string, g long, cuts binary"


def cuts_of(marks: list[np.ndarray], held: list[int], parts: int) -> np.ndarray:
    """Where shards begin, the first one excepted, from each cell's marks and number of values. A value that would fill several shards gets one of its own."""
    full = [(m, h) for m, h in zip(marks, held, strict=True) if h]
    if not full:
        return np.empty(0, np.int64)
    v, w = np.concatenate([m for m, _ in full]), np.concatenate([np.full(len(m), h / len(m)) for m, h in full])
    order = np.argsort(v, kind="stable")
    v, w = v[order], np.cumsum(w[order])
    cuts = v[np.minimum(np.searchsorted(w, w[-1] * np.arange(1, parts) / parts), len(v) - 1)]
    return np.unique(np.concatenate([cuts, cuts[1:][cuts[1:] == cuts[:-1]] + 1]))


def _cuts(batches):
    emit = _emit(CUTS)
    for t in whole_groups(batches, KEY):
        for key, part in _parts_of(t, KEY):
            yield emit([(*key, _packed(cuts_of([_longs(x) for x in part.column("marks").to_pylist()], part.column("held").to_pylist(), part.column("parts")[0].as_py())))])


PIECE = "series string, g long, o int, shard int, span_cells int, n long, low long, high long, at binary, c binary"


def _pieces(batches):
    """What each shard has of each cell: how many values, from where to where, and the points."""
    emit = _emit(PIECE)
    for b in batches:
        for row in b.to_pylist():
            has = _flags(row["has"])
            at, value = _longs(row["at"])[has], _longs(row["c"])[has]
            shard = np.searchsorted(_longs(row["cuts"]), value, "right")
            order = np.argsort(shard, kind="stable")
            edges = np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist()
            rows = []
            for i, j in zip(edges, [*edges[1:], len(order)], strict=True):
                x = order[i:j]
                rows.append((row["series"], row["g"], row["o"], int(shard[x[0]]), row["span_cells"], j - i, int(value[x].min()), int(value[x].max()), _packed(at[x]), _packed(value[x])))
            if rows:
                yield emit(rows)


HEAD = "series string, g long, o int, shards binary, base binary, lows binary, highs binary"


def _heads(batches):
    """Per cell of a group: its shards with the values they span, and their counts in the cells that all windows of the cell hold whole."""
    emit = _emit(HEAD)
    for t in whole_groups(batches, KEY):
        for key, part in _parts_of(t, KEY):
            o, shard, n = (part.column(c).to_numpy() for c in ("o", "shard", "n"))
            span_cells = part.column("span_cells")[0].as_py()
            shards, shard = np.unique(shard, return_inverse=True)
            sums = np.zeros((span_cells * (SLOTS + 1) + 1, len(shards)), np.int64)
            np.add.at(sums, (o + 1, shard), n)
            sums = np.cumsum(sums, axis=0)
            low, high = np.full(len(shards), np.iinfo(np.int64).max), np.full(len(shards), np.iinfo(np.int64).min)
            np.minimum.at(low, shard, part.column("low").to_numpy())
            np.maximum.at(high, shard, part.column("high").to_numpy())
            for k in range(span_cells, len(sums) - 1):
                yield emit([(*key, k, _packed(shards), _packed(sums[k] - sums[k - span_cells + 1]), _packed(low), _packed(high))])


ASKED = "series string, g long, o int, span_cells int, need array<int>, fixed binary, w binary, at binary, n binary, median2 binary, under binary, low binary, high binary, counts binary"


def candidates(counts: np.ndarray, lows: np.ndarray, highs: np.ndarray, mid2: np.ndarray | None, first: np.ndarray, last: np.ndarray):
    """For windows with counts by shard: which shards may hold the ranks first..last (from 1) of 2 value, or of |2 value - mid2| where that is given.

    Returns a mask of shards, how many values lie in shards that are surely before, and between what the ranks lie.
    """
    if mid2 is None:
        low, high = np.broadcast_to(2 * lows, counts.shape), np.broadcast_to(2 * highs, counts.shape)
    else:
        a, b = 2 * lows - mid2[:, None], 2 * highs - mid2[:, None]
        low, high = np.where((a <= 0) & (b >= 0), 0, np.minimum(np.abs(a), np.abs(b))), np.maximum(np.abs(a), np.abs(b))

    def reached(bound, rank):
        order = np.argsort(bound, axis=1, kind="stable")
        sums = np.cumsum(np.take_along_axis(counts, order, 1), axis=1)
        at = np.argmax(sums >= rank[:, None], axis=1)
        return np.take_along_axis(bound, np.take_along_axis(order, at[:, None], 1), 1)[:, 0]

    least, most = reached(low, first), reached(high, last)
    some = counts > 0
    return some & (high >= least[:, None]) & (low <= most[:, None]), (counts * (some & (high < least[:, None]))).sum(1), least, most


def _asked(span):
    """First round: cells with the counts that hold for all their windows, to requests for shards, a row for each set of shards."""

    def run(batches):
        emit = _emit(ASKED)
        for b in batches:
            for row in b.to_pylist():
                at, has, lows, highs, base = _longs(row["at"]), _flags(row["has"]), _longs(row["lows"]), _longs(row["highs"]), _longs(row["base"])
                shards, before_has = _longs(row["shards"]), _flags(row["before_has"])
                enter, leave = at[has], _longs(row["before_at"])[before_has]
                enter_in, leave_in = (np.searchsorted(highs, x) for x in (_longs(row["c"])[has], _longs(row["before_c"])[before_has]))
                upto, past, gone = (np.searchsorted(x, t, "right") for x, t in ((enter, at), (enter, at - span), (leave, at - span)))
                counts = np.empty((len(at), len(shards)), np.int64)
                for s in range(len(shards)):
                    came, left = np.concatenate([[0], np.cumsum(enter_in == s)]), np.concatenate([[0], np.cumsum(leave_in == s)])
                    counts[:, s] = base[s] + came[upto] - came[past] + left[-1] - left[gone]
                n = counts.sum(1)
                known = row["median2"] is not None
                mid2 = _longs(row["median2"]) if known else np.zeros(len(at), np.int64)
                mask, under = np.zeros_like(counts, bool), np.zeros(len(at), np.int64)
                low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                if len(w := np.flatnonzero(n >= 2)):
                    mask[w], under[w], low[w], high[w] = candidates(counts[w], lows, highs, mid2[w] if known else None, (n[w] + 1) // 2, n[w] // 2 + 1)
                single = lows == highs
                packed = np.packbits(mask, axis=1)
                name = np.ascontiguousarray(packed).view(np.dtype((np.void, packed.shape[1])))[:, 0] if packed.shape[1] else np.zeros(len(at), "V1")
                _, begin, which = np.unique(name, return_index=True, return_inverse=True)
                rows = []
                for k, x in enumerate(begin.tolist()):
                    w = np.flatnonzero(which == k)
                    chosen = np.flatnonzero(mask[x])
                    alone = chosen[single[chosen]]
                    edges = (_packed(low[w]), _packed(high[w])) if len(alone) else (b"", b"")
                    rows.append((row["series"], row["g"], row["o"], row["span_cells"], shards[chosen[~single[chosen]]].tolist(), _packed(lows[alone]), _packed(w), _packed(at[w]), _packed(n[w]), _packed(mid2[w]) if known else b"", _packed(under[w]), *edges, _packed(counts[w][:, alone].ravel())))
                if rows:
                    yield emit(rows)

    return run


def bisected(index: Windows, lo, hi, mid2, k, under, low, high, row, fixed, times):
    """The smallest d between low and high that k values reach: those of the range, `under`, and `times` at `fixed` for each query named in `row`.

    A value reaches d where |2 value - mid2| <= d, or where mid2 is None, 2 value <= d.
    """
    low, high = low.copy(), high.copy()
    at_fixed = fixed if mid2 is None else np.abs(fixed - mid2[row])
    while len(open_ := np.flatnonzero(low < high)):
        d = low + (high - low) // 2
        a, b, m = lo[open_], hi[open_], d[open_]
        if mid2 is None:
            n = index.below(a, b, m // 2 + 1)
        else:  # those under the lower edge do not reach; the edge is (mid2 - d) / 2, rounded up
            n = index.below(a, b, (mid2[open_] + m) // 2 + 1) - index.below(a, b, -((m - mid2[open_]) // 2))
        got = under.copy()
        got[open_] += n
        reach = at_fixed <= d[row]
        np.add.at(got, row[reach], times[reach])
        enough = got[open_] >= k[open_]
        high[open_[enough]] = m[enough]
        low[open_[~enough]] = m[~enough] + 1
    return low


FOUND = "series string, g long, o int, w binary, n binary, first binary"


def _block(rows: list[dict], span: int, deviation: bool) -> list[np.ndarray]:
    """For requests that met their shards: the sums of the two middle values of each of their windows."""
    points, asks = [], []
    for r in rows:
        a = {k: _longs(r[k]) for k in ("at", "median2", "under", "low", "high")} | {"n": _longs(r["n"]), "fixed": 2 * _longs(r["fixed"]), "counts": _longs(r["counts"])}
        at, c = (np.concatenate([_longs(x[k]) for x in r["met"] or ()] or [np.empty(0, np.int64)]) for k in ("at", "c"))
        order = np.argsort(at, kind="stable")
        points.append((at[order], c[order]))
        asks.append(a)
    size, many = [len(p[0]) for p in points], [len(a["at"]) for a in asks]
    group, ask = np.repeat(np.arange(len(rows)), size), np.repeat(np.arange(len(rows)), many)
    q = {k: np.concatenate([a[k] for a in asks]) for k in ("at", "n", "median2", "under")}
    lo, hi = ranges(group, np.concatenate([p[0] for p in points]), ask, q["at"], span)
    index = Windows(np.concatenate([p[1] for p in points]))
    out, n, plain = np.zeros(len(ask), np.int64), q["n"], np.array([not len(a["fixed"]) for a in asks])[ask]
    if len(w := np.flatnonzero((n >= 2) & plain)):
        first, last = (n[w] + 1) // 2 - q["under"][w], n[w] // 2 + 1 - q["under"][w]
        if deviation:
            # Shards nearer to the middle than all that is left count as being under: the nearest of what is left is the first.
            one, two = index.deviations(lo[w], hi[w], q["median2"][w], first)
            out[w] = one + np.where(last > first, two, one)
        else:
            out[w] = index.kth(lo[w], hi[w], first - 1) + index.kth(lo[w], hi[w], last - 1)
    if len(w := np.flatnonzero((n >= 2) & ~plain)):
        seat = np.full(len(ask), -1)
        seat[w] = np.arange(len(w))
        begin = np.concatenate([[0], np.cumsum(many)])
        with_fixed = [k for k, a in enumerate(asks) if len(a["fixed"])]
        row, fixed, times = (np.concatenate(x) for x in zip(*((np.repeat(seat[begin[k] : begin[k + 1]], len(asks[k]["fixed"])), np.tile(asks[k]["fixed"], many[k]), asks[k]["counts"]) for k in with_fixed), strict=True))
        ok = row >= 0
        low, high = (np.zeros(len(ask), np.int64) for _ in range(2))
        for k in with_fixed:
            low[begin[k] : begin[k + 1]], high[begin[k] : begin[k + 1]] = asks[k]["low"], asks[k]["high"]
        mid2 = q["median2"][w] if deviation else None
        one, two = (bisected(index, lo[w], hi[w], mid2, k, q["under"][w], low[w], high[w], row[ok], fixed[ok], times[ok]) for k in ((n[w] + 1) // 2, n[w] // 2 + 1))
        out[w] = one + two if deviation else (one + two) // 2
    return np.split(out, np.cumsum(many)[:-1])


def _found(span, deviation):
    """Second round: about TOGETHER points of several requests are answered at once."""

    def run(batches):
        emit = _emit(FOUND)
        for b in batches:
            held, size = [], 0
            for row in [*b.to_pylist(), None]:
                if held and (row is None or size > TOGETHER):
                    yield emit([(r["series"], r["g"], r["o"], r["w"], r["n"], _packed(x)) for r, x in zip(held, _block(held, span, deviation), strict=True)])
                    held, size = [], 0
                if row is not None:
                    held.append(row)
                    size += sum(_many(x["at"]) for x in row["met"] or ())

    return run


SUMS = "series string, g long, o int, n binary, first binary"


def _ordered(batches):
    """Per cell the counts and sums of its windows in order, from the rows of its sets of shards."""
    emit = _emit(SUMS)
    for b in batches:
        rows = []
        for r in b.to_pylist():
            w = np.concatenate([_longs(x["w"]) for x in r["x"]])
            n, first = np.empty(len(w), np.int64), np.empty(len(w), np.int64)
            n[w], first[w] = np.concatenate([_longs(x["n"]) for x in r["x"]]), np.concatenate([_longs(x["first"]) for x in r["x"]])
            rows.append((r["series"], r["g"], r["o"], _packed(n), _packed(first)))
        if rows:
            yield emit(rows)


def _opened(batches):
    """Rows of cells with their medians and deviations to a row for each window."""
    for b in batches:
        for r in b.to_pylist():
            ids = _longs(r["id"])
            yield _rows(pa.array([r["series"]] * len(ids), pa.string()), ids, ~_flags(r["named"]), _longs(r["n"]), _longs(r["median2"]), _longs(r["mad4"]), _longs(r["c"]), _flags(r["has"]))


def hot_groups(points: DataFrame, span: int) -> DataFrame:
    """Results of the windows of hot groups; points: series, g, o, span_cells, parts, at, c, id. Cells below span_cells are those of the slot before."""

    def dealt(df, *by, then=()):
        return df.repartition(*by).sortWithinPartitions(*by, *then)

    cells = stored(dealt(points, *KEY, "o", then=("at",)).select(*KEY, "o", "span_cells", "parts", "at", "c", "id").mapInArrow(_cells, CELL), "cells")
    cuts = stored(dealt(cells.select(*KEY, "parts", "held", "marks"), *KEY).mapInArrow(_cuts, CUTS), "cuts")
    pieces = stored(cells.where("held > 0").select(*KEY, "o", "span_cells", "at", "c", "has").join(cuts, KEY).mapInArrow(_pieces, PIECE), "pieces")
    removed(cuts)
    heads = stored(dealt(pieces.select(*KEY, "o", "shard", "span_cells", "n", "low", "high"), *KEY).mapInArrow(_heads, HEAD), "heads")
    before = cells.select(*KEY, (F.col("o") + F.col("span_cells")).alias("o"), *[F.col(c).alias(f"before_{c}") for c in ("at", "c", "has")])
    own = cells.where("o >= span_cells")
    cell = [*KEY, "o"]

    def sums(windows: DataFrame, deviation: bool) -> DataFrame:
        asked = windows.join(heads, cell, "left").join(before, cell, "left").mapInArrow(_asked(span), ASKED)
        asked = stored(asked, "asked").withColumn("request", F.concat_ws(",", F.col("need").cast("array<string>")))
        request = [*cell, "request"]
        # A window of cell o lies in the cells from o - span_cells to o.
        needed = asked.select(*request, F.explode("need").alias("shard"), F.col("o").alias("of"), "span_cells").distinct().withColumn("o", F.explode(F.expr("sequence(of - span_cells, of)"))).drop("span_cells")
        needed = needed.join(pieces.select(*cell, "shard", "at", "c"), [*cell, "shard"]).groupBy(*KEY, F.col("of").alias("o"), "request").agg(F.collect_list(F.struct("at", "c")).alias("met"))
        found = asked.join(needed, request, "left").drop("request", "need", "span_cells").mapInArrow(_found(span, deviation), FOUND)
        done = stored(found.groupBy(*cell).agg(F.collect_list(F.struct("w", "n", "first")).alias("x")).mapInArrow(_ordered, SUMS), "sums")
        removed(asked)
        return done

    windows = own.select(*cell, "span_cells", "at", "c", "has")
    medians = sums(windows.withColumn("median2", F.lit(None).cast("binary")), False).withColumnRenamed("first", "median2")
    mads = sums(windows.join(medians.drop("n"), cell), True).select(*cell, F.col("first").alias("mad4"))
    removed(pieces)
    removed(heads)
    return own.select(*cell, "c", "has", "id", "named").join(medians, cell).join(mads, cell).mapInArrow(_opened, RESULT_DDL)


# -- the operator ----------------------------------------------------------------


def rolling_medians(points: DataFrame, span: int = HOUR, hot_rows: int = HOT_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Of each window the count n, doubled median median2, doubled median deviation mad4, and whether its own value is far.

    points: id (long, may be null), series (string; null is a series), at (long, microseconds), c (long or null), a row for
    each window; other columns are ignored. A window holds the values of its series at times over at - span and up to at,
    equal values of different rows all kept. mad4 is the doubled median of |2 c - median2|; far says 2 |2 c - median2| >
    3 mad4. With n < 2, median2, mad4 and far are null; far also where the row has no value. Rows without time take no part.
    Empty tables give no rows. Values are taken to be at most 2^53 in size.
    """
    points = points.where(F.col("at").isNotNull()).select(F.col("id").cast("long").alias("id"), F.when(F.col("series").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("series").cast("string"))).alias("series"), F.col("at").cast("long").alias("at"), F.col("c").cast("long").alias("c"))
    points = stored(points.withColumn("slot", F.expr(f"(at - pmod(at, {span})) div {span}")), "points")

    # A slot is in its segment, and the last of a segment also before the next.
    segment, edge = F.expr(f"(slot - pmod(slot, {SLOTS})) div {SLOTS}"), F.expr(f"pmod(slot + 1, {SLOTS}) = 0")

    def places(has: Column) -> Column:
        def place(g, win):
            return F.struct(g.alias("g"), F.lit(win).alias("win"))

        return F.inline(F.when(edge & has, F.array(place(segment, True), place(segment + 1, False))).otherwise(F.array(place(segment, True))))

    slots = points.groupBy("series", "slot").agg(F.count("c").alias("k"), F.count("*").alias("all"))
    groups = slots.select("series", "k", "all", places(F.lit(True))).groupBy(*KEY).agg(F.sum("k").alias("n"), F.max("k").alias("peak"), F.sum(F.when(F.col("win"), F.col("all"))).alias("own"))
    series = groups.groupBy("series").agg(F.sum("own").alias("rows")).where(F.col("rows") > hot_rows).select("series")
    parts = lambda n, least: F.greatest(F.lit(least), F.least(F.lit(MOST_PARTS), F.ceil(F.col(n) / part_rows))).cast("int")
    hot = stored(groups.where("own > 0").join(series, "series", "left_semi").select(*KEY, parts("n", 2).alias("parts"), F.when(F.col("n") <= 2 * part_rows, 0).otherwise(parts("peak", 1)).alias("span_cells")), "hot")
    any_hot = not hot.isEmpty()
    placed = points.select("series", "at", "c", "id", places(F.col("c").isNotNull()))
    cold = placed.join(hot, KEY, "left_anti") if any_hot else placed
    out = cold.repartition(*KEY).sortWithinPartitions(*KEY, "at").select(*KEY, "at", "c", "id", "win").mapInArrow(_cold(span), RESULT_DDL)
    if any_hot:
        # Of a small group all own slots are one cell.
        o = F.when(F.col("span_cells") == 0, F.col("win").cast("int")).otherwise(F.expr(f"((at - ({SLOTS} * g - 1) * {span}) * span_cells) div {span}").cast("int"))
        out = out.union(hot_groups(placed.join(hot, KEY).withColumn("o", o).withColumn("span_cells", F.greatest("span_cells", F.lit(1))), span))
    return out.select("id", F.when(F.col("series") != "-", F.expr("substring(series, 2)")).alias("series"), "n", "median2", "mad4", "far")


def microseconds(df: DataFrame, name: str) -> Column:
    """A time as whole microseconds since 1970; times without a zone are not moved by any zone."""
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_micros(name)
    since = F.expr(f"cast(cast(`{name}` as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00' as interval second)")
    return (since.cast("decimal(20,6)") * 1_000_000).cast("long")


def cents(value: Column) -> Column:
    """floor(100 * value + 0.5); none for a null, for what is no finite number, and beyond MOST_CENTS."""
    x = F.floor(100 * value.cast("double") + 0.5)
    return F.when(F.abs(value.cast("double")) <= MOST_CENTS / 100, x)


def click_points(clicks: DataFrame) -> DataFrame:
    """id, series, at, c of clicks: each click_id once, clicks without ts left out.

    Of rows of one click_id that differ, the one with the smallest (ts, kind, value) counts; rows without click_id each count for themselves.
    """
    rows = clicks.select(F.col("click_id").cast("long").alias("id"), F.struct(microseconds(clicks, "ts").alias("at"), F.col("kind").cast("string").alias("series"), cents(F.col("value")).alias("c")).alias("x"))
    rows = rows.where("x.at is not null").withColumn("alone", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
    return rows.groupBy("id", "alone").agg(F.min("x").alias("x")).select("id", "x.series", "x.at", "x.c")


def op11_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rolling_medians(click_points(table(spark, sf_dir, "clicks")))
    return found.select(F.col("id").alias("click_id"), F.col("series").alias("kind"), "n", "median2", "mad4", "far")


OP11_SQL = """
WITH c AS (
  SELECT click_id, kind, ts, CAST(floor(100 * value + 0.5) AS BIGINT) AS c
  FROM (SELECT click_id, kind, ts, value, row_number() OVER (PARTITION BY click_id ORDER BY ts, kind, value) AS k FROM clicks WHERE ts IS NOT NULL) WHERE k = 1
), w AS (
  SELECT click_id, kind, c, list(c) FILTER (WHERE c IS NOT NULL) OVER (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL '3599999999 microseconds' PRECEDING AND CURRENT ROW) AS l FROM c
), s AS (
  SELECT click_id, kind, c, list_sort(coalesce(l, [])) AS l FROM w
), m AS (
  SELECT *, len(l) AS n, CASE WHEN len(l) >= 2 THEN l[(len(l) + 1) // 2] + l[len(l) // 2 + 1] END AS median2 FROM s
), d AS (
  SELECT *, list_sort(list_transform(l, lambda x: abs(2 * x - median2))) AS e FROM m
), f AS (
  SELECT *, CASE WHEN n >= 2 THEN e[(n + 1) // 2] + e[n // 2 + 1] END AS mad4 FROM d
)
SELECT click_id, kind, n, median2, mad4, 2 * abs(2 * c - median2) > 3 * mad4 AS far FROM f
"""
