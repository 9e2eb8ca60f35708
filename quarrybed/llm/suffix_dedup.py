"""Suffix-array dedup: remove bytes covered by a string of a fixed length that starts earlier.

Equal strings of LENGTH bytes hold the same least gram (of GRAM bytes, by hash) at the same
place, so strings are gathered by that gram: a *context* is a run of windows of LENGTH bytes
that share it. Contexts meet by gram, first in a map task, then over all; contexts whose
gram is met again are fetched and sorted by their suffixes from the gram on, by
a mergesort whose comparisons find common extensions by binary search over prefix
polynomial hashes. Neighbours in that order and hashes of what precedes the gram say which
windows are equal. Hashes only propose: whatever is removed was compared byte by byte.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, text_or_empty, utf8_buffers, written

LENGTH, GRAM = 100, 32
#: Contexts of one gram from which on its windows are dealt by their own hashes, and bits of the map of such grams.
HOT, HOT_BITS = 20_000, 1 << 24
#: Units that a map task holds, bytes that are hashed at once, units of a bucket, buckets of a task, bytes between collapses in the sort.
FLUSH, BATCH, BUCKET, BUCKETS_A_TASK, SORT_HELD = 300_000, 1 << 20, 200_000, 64, 1 << 24

_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    p = np.empty(n, np.uint64)
    p[0], k = 1, 1
    while k < n:
        m = min(k, n - k)
        p[k : k + m] = p[:m] * np.uint64(int(p[k - 1]) * base & _M64)
        k += m
    return p


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        return cls.up, cls.down


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H[i]: polynomial hash of the first i bytes; the hash of [a, b) is (H[b] - H[a]) / base^a."""
    up, _ = Powers.of(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=h[1:])
    return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: A document is (doc, ta, tb): its id, and 128 bits of its text's SHA-256 where ids repeat.
UNIT = np.dtype([("key", "u8"), ("doc", "i8"), ("ta", "i8"), ("tb", "i8"), ("pos", "i8"), ("nw", "i2"), ("at", "i2")])
SPAN = np.dtype([("doc", "i8"), ("ta", "i8"), ("tb", "i8"), ("start", "i8"), ("end", "i8")])
DOC = ("doc", "ta", "tb")
KEY_MASK = np.uint64((1 << 48) - 1)


def range_hashes(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed polynomial hashes of byte ranges, from prefix hashes."""
    return _mix((h[end] - h[first]) * Powers.of(len(h))[1][first])


def contexts(data: np.ndarray, offsets: np.ndarray, docs: tuple, length: int = LENGTH, gram: int = GRAM, hot=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of documents laid end to end, hashes of their bytes, and where they begin in ``data``.

    A unit has its first window (pos), number of windows (nw) and the place of the gram (at).
    A context of a gram for which ``hot`` (keys -> booleans) holds is taken apart: each window
    is a unit of its own, keyed by the hash of all its bytes.
    """
    n = len(data)
    none = np.zeros(0, UNIT), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n < length:
        return none
    _, down = Powers.of(n + 1)
    h = prefix_hashes(data)
    least = _mix((h[gram:] - h[:-gram]) * down[: n - gram + 1])
    where, g, width, k = np.arange(len(least), dtype=np.int32), least, length - gram + 1, 1
    while k < width:
        step = min(k, width - k)
        right = g[step:] < g[:-step]
        g, where = np.where(right, g[step:], g[:-step]), np.where(right, where[step:], where[:-step])
        k += step
    # windows that lie in one document
    sizes = np.diff(offsets)
    valid = np.zeros(n + 1, np.int32)
    whole = np.flatnonzero(sizes >= length)
    valid[offsets[whole]] += 1
    valid[offsets[whole] + sizes[whole] - length + 1] -= 1
    inside = np.cumsum(valid[: len(g)]) > 0
    new = np.ones(len(g), bool)
    new[1:] = where[1:] != where[:-1]
    new[offsets[whole]] = True
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none
    edge = np.flatnonzero(new | ~inside)
    after = np.append(edge, len(g))[np.searchsorted(edge, first, "right")]
    nw, key, at = after - first, g[first] & KEY_MASK, where[first] - first
    if hot is not None and (apart := hot(key)).any():
        count = nw[apart]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        lone = np.repeat(first[apart], count) + step
        first, nw = np.concatenate((first[~apart], lone)), np.concatenate((nw[~apart], np.ones(len(lone), np.int64)))
        key = np.concatenate((key[~apart], range_hashes(h, lone, lone + length) & KEY_MASK))
        at = np.concatenate((at[~apart], np.zeros(len(lone), np.int64)))
    own = np.searchsorted(offsets, first, "right") - 1
    out = np.empty(len(first), UNIT)
    for name, value in zip(DOC, docs):
        out[name] = value[own]
    out["key"], out["pos"], out["nw"], out["at"] = key, first - offsets[own], nw, at
    return out, range_hashes(h, first, first + nw + length - 1), first


def _same(u: np.ndarray, names) -> np.ndarray:
    """Whether a row agrees with the one before it on some columns."""
    out = np.zeros(len(u), bool)
    if len(u) > 1:
        out[1:] = np.logical_and.reduce([u[n][1:] == u[n][:-1] for n in names])
    return out


def _order(units: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Order by key and context hash, the earliest start first among equals."""
    order = np.argsort(units["key"] ^ _mix(ctx), kind="stable")
    u, c = units[order], ctx[order]
    new = np.ones(len(u), bool)
    new[1:] = (u["key"][1:] != u["key"][:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(new)
    many = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(many):
        v = u[many]
        order[many] = order[many][np.lexsort((v["pos"], v["tb"], v["ta"], v["doc"], c[many], v["key"], group[many]))]
    return order


def collapse(units: np.ndarray, ctx: np.ndarray, begin: np.ndarray, data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(rows of first units, rows of others): every window of the others starts earlier in a first one.

    Contexts with one key and hash are compared byte by byte (``begin``: where they stand in
    ``data``) with the earliest of them; one that is unlike it stays a first one. Units that a
    repeated row has again are in neither.
    """
    if not len(units):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = _order(units, ctx)
    u, c = units[order], ctx[order]
    alike = _same(u, ("key", "nw", "at"))
    alike[1:] &= c[1:] == c[:-1]
    again = alike & _same(u, (*DOC, "pos"))
    lead = np.flatnonzero(~alike)[np.cumsum(~alike) - 1]
    later = np.flatnonzero(alike & ~again)
    equal = _equal_bytes(data, begin[order[later]], begin[order[lead[later]]], u["nw"][later].astype(np.int64) + length - 1)
    first = ~alike
    first[later[~equal]] = True
    return order[first], order[later[equal]]


def spans_of(units: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whole contexts as spans, touching ones joined."""
    return join_spans(tuple(units[n] for n in DOC), units["pos"], units["pos"] + units["nw"] + length - 1)


def join_spans(docs: tuple, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    order = np.lexsort((start, *docs[::-1]))
    docs, start, end = tuple(d[order] for d in docs), start[order], end[order]
    if not len(start):
        return np.empty(0, SPAN)
    # ends grow by document: shift each document's places beyond those of the one before
    new = np.ones(len(start), bool)
    new[1:] = np.logical_or.reduce([d[1:] != d[:-1] for d in docs])
    shift = np.cumsum(new) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    cut = np.ones(len(start), bool)
    cut[1:] = (start + shift)[1:] > reach[:-1]
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(start)) - 1
    out = np.empty(len(first), SPAN)
    for name, d in zip(DOC, docs):
        out[name] = d[first]
    out["start"], out["end"] = start[first], (reach - shift)[last]
    return out


# blobs: arrays by column, so that a shuffle moves few rows and the small columns compress


def to_blob(arr: np.ndarray) -> bytes:
    cols = [arr[n] for n in arr.dtype.names]
    if "doc" in arr.dtype.names:
        k = arr.dtype.names.index("doc")
        cols[k] = np.diff(cols[k], prepend=np.int64(0))
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(arr), -1)[:, ::-1].T).tobytes() if len(arr) else b"" for c in map(np.ascontiguousarray, cols))
    return struct.pack("<q", len(arr)) + zstandard.ZstdCompressor(level=1).compress(raw)


def from_blob(blob: bytes, dtype: np.dtype) -> np.ndarray:
    (n,) = struct.unpack_from("<q", blob)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=max(1, n * dtype.itemsize)), np.uint8) if n else np.zeros(0, np.uint8)
    out, at = np.empty(n, dtype), 0
    for name in dtype.names:
        size = dtype[name].itemsize
        out[name] = np.ascontiguousarray(raw[at : at + size * n].reshape(size, n).T[:, ::-1]).view(dtype[name]).reshape(n) if n else 0
        at += size * n
    if "doc" in dtype.names:
        out["doc"] = np.cumsum(out["doc"])
    return out


def _by_bucket(arr: np.ndarray, bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(arr))):
        yield int(bucket[order[a]]), arr[order[a:b]]


# the suffix sort


class Suffixes:
    """Suffixes from the grams of contexts, compared by prefix hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes=None):
        self.data, self.start, self.end = data, start, end
        self.h = prefix_hashes(data) if hashes is None else hashes(data)
        self.down = Powers.of(len(data) + 1)[1]
        self.probes = max(1, int((end - start).max(initial=1)).bit_length())

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix, by binary search over hashes."""
        a, b, h, down = self.start[x], self.start[y], self.h, self.down
        ha, hb, da, db = h[a], h[b], down[a], down[b]
        low = np.zeros(len(x), np.int64)
        high = np.minimum(self.end[x] - a, self.end[y] - b)
        for _ in range(self.probes):
            mid = (low + high + 1) >> 1
            same = (h[a + mid] - ha) * da == (h[b + mid] - hb) * db
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
        n = self.common(x, y)
        a, b = self.start[x] + n, self.start[y] + n
        ended_x, ended_y = a >= self.end[x], b >= self.end[y]
        top = len(self.data) - 1
        byte = self.data[np.minimum(a, top)].astype(np.int64) - self.data[np.minimum(b, top)]
        return np.where(ended_x & ended_y, or_equal, np.where(ended_x, True, np.where(ended_y, False, byte < 0)))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order by group and suffix: a mergesort, runs of all groups merged side by side.

        An element's place in a merge is its place in its own run and its rank in the other,
        which a binary search over comparisons finds. ``group`` does not decrease.
        """
        n = len(group)
        order = np.arange(n)
        first = np.searchsorted(group, group)
        size = np.searchsorted(group, group, "right") - first
        run = 1
        while run < size.max(initial=0):
            at = np.flatnonzero(size > run)
            inner = at - first[at]
            left = (inner // run) % 2 == 0
            base = first[at] + inner // (2 * run) * 2 * run  # of the pair of runs
            mid = np.minimum(base + run, first[at] + size[at])
            stop = np.minimum(base + 2 * run, first[at] + size[at])
            low, high = np.where(left, mid, base), np.where(left, stop, mid)
            begin = low.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                m = (low[open_] + high[open_]) >> 1
                other, own = order[m], order[at[open_]]
                is_left = left[open_]
                goes = np.empty(len(open_), bool)  # whether the other stands before this one
                if is_left.any():
                    goes[is_left] = self.less(other[is_left], own[is_left], False)
                if (~is_left).any():
                    goes[~is_left] = self.less(other[~is_left], own[~is_left], True)
                low[open_] = np.where(goes, m + 1, low[open_])
                high[open_] = np.where(goes, high[open_], m)
            place = base + (at - np.where(left, base, mid)) + (low - begin)
            merged = order.copy()
            merged[place] = order[at]
            order, run = merged, run * 2
        return order

    def bytes_of(self, x: int) -> bytes:
        return self.data[self.start[x] : self.end[x]].tobytes()


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes at a and at b are the same, compared byte by byte."""
    out = np.ones(len(a), bool)
    for k in range(0, len(a), 8192):
        s = slice(k, k + 8192)
        steps = np.arange(int(n[s].max(initial=0)))
        used = steps < n[s, None]
        top = len(data) - 1
        out[s] = ((data[np.minimum(a[s, None] + steps, top)] == data[np.minimum(b[s, None] + steps, top)]) | ~used).all(axis=1)
    return out


def repeated_windows(units: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, hashes=None) -> np.ndarray:
    """For distinct contexts, sorted by key: which of their windows start earlier in another one.

    ``data`` has their bytes end to end. Gives a matrix, units by windows. ``hashes`` replaces
    the prefix hashes in tests: with weak ones, verification finds the collisions and the
    groups concerned are sorted and classed by their bytes.
    """
    n = len(units)
    flags = np.zeros((n, int(units["nw"].max(initial=0))), bool)
    if n < 2:
        return flags
    at, nw = units["at"].astype(np.int64), units["nw"].astype(np.int64)
    start, end = offsets[:-1] + at, offsets[1:]
    s = Suffixes(data, start, end, hashes)
    group = np.cumsum(np.diff(units["key"], prepend=units["key"][:1]) != 0)
    order = s.sort(group)
    # neighbours: common lengths, verified
    x, y = order[:-1], order[1:]
    near = group[x] == group[y]
    lcp = np.zeros(n, np.int64)
    lcp[1:][near] = s.common(x[near], y[near])
    wrong = np.zeros(n, bool)
    ok = _equal_bytes(data, start[x], start[y], lcp[1:])
    px, py = start[x] + lcp[1:], start[y] + lcp[1:]
    ended = (px >= end[x]) | (py >= end[y])
    top = len(data) - 1
    ok &= ~near | np.where(ended, end[x] - start[x] <= lcp[1:], data[np.minimum(px, top)] < data[np.minimum(py, top)])
    wrong[1:] = near & ~ok
    for g in np.unique(group[order[wrong]]):  # a hash collision: this group by bytes
        a, b = np.searchsorted(group, (g, g + 1))
        own = sorted(range(a, b), key=s.bytes_of)
        order[a:b] = own
        for k in range(a + 1, b):
            p, q = s.bytes_of(own[k - 1 - a]), s.bytes_of(own[k - a])
            lcp[k] = next((i for i, (c, d) in enumerate(zip(p, q)) if c != d), min(len(p), len(q)))
    rank = np.empty(n, np.int64)
    rank[np.lexsort((units["pos"] + at, units["tb"], units["ta"], units["doc"]))] = np.arange(n)
    at_o, nw_o, rank_o, start_o = at[order], nw[order], rank[order], start[order]
    head = np.ones(n, bool)
    head[1:] = ~near
    for back in range(length - gram + 1):  # windows that begin so many bytes before the gram
        has = (back <= at_o) & (back > at_o - nw_o)
        if not has.any():
            continue
        right = np.cumsum(head | (lcp < length - back))
        row = np.flatnonzero(has)
        row = row[np.bincount(right[row])[right[row]] > 1]
        if not len(row):
            continue
        p = start_o[row]
        left = (s.h[p] - s.h[p - back]) * s.down[p - back]
        by = np.lexsort((rank_o[row], left, right[row]))
        row, left = row[by], left[by]
        new = np.ones(len(row), bool)
        new[1:] = (right[row][1:] != right[row][:-1]) | (left[1:] != left[:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = np.flatnonzero(~new)
        if not len(later):
            continue
        same = _equal_bytes(data, start_o[row[later]] - back, start_o[row[lead[later]]] - back, np.full(len(later), back))
        if not same.all():  # a hash collision on the left: class these windows by bytes
            seen: dict = {}
            bad = np.isin(right[row], np.unique(right[row[later[~same]]]))
            keep = later[~bad[later]]
            for k in sorted(np.flatnonzero(bad).tolist(), key=lambda k: rank_o[row[k]]):
                q = start_o[row[k]]
                word = (int(right[row[k]]), data[q - back : q].tobytes())
                if word in seen:
                    keep = np.append(keep, k)
                seen.setdefault(word, k)
            later = keep
        hit = order[row[later]]
        flags[hit, at[hit] - back] = True
    return flags


def flagged_spans(units: np.ndarray, flags: np.ndarray, length: int = LENGTH) -> np.ndarray:
    row, window = np.nonzero(flags)
    p = units["pos"][row] + window
    return join_spans(tuple(units[n][row] for n in DOC), p, p + length)


class Meeting:
    """Contexts of a bucket with their bytes, as they come: equal ones are collapsed each time the held bytes have doubled."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.units, self.ctx, self.texts, self.held, self.next = [], [], [], 0, SORT_HELD

    def add(self, units: np.ndarray, text: bytes):
        """Spans of what proved to start earlier."""
        size = units["nw"].astype(np.int64) + self.length - 1
        end = np.cumsum(size)
        ctx, data = np.empty(len(units), np.uint64), np.frombuffer(text, np.uint8)
        i = 0
        while i < len(units):  # hashed in parts: prefix hashes are long
            base = end[i] - size[i]
            j = max(i + 1, int(np.searchsorted(end, base + BATCH, "right")))
            ctx[i:j] = range_hashes(prefix_hashes(data[base : end[j - 1]]), end[i:j] - size[i:j] - base, end[i:j] - base)
            i = j
        self.units.append(units)
        self.ctx.append(ctx)
        self.texts.append(text)
        self.held += len(text)
        if self.held >= self.next:
            yield self._collapse()
            self.next = max(SORT_HELD, 2 * self.held)

    def _collapse(self) -> np.ndarray:
        u, ctx, raw = np.concatenate(self.units), np.concatenate(self.ctx), b"".join(self.texts)
        size = u["nw"].astype(np.int64) + self.length - 1
        begin = np.cumsum(size) - size
        first, others = collapse(u, ctx, begin, np.frombuffer(raw, np.uint8), self.length)
        spans = spans_of(u[others], self.length)
        first = first[np.argsort(u["key"][first], kind="stable")]
        text = b"".join(raw[a : a + n] for a, n in zip(begin[first].tolist(), size[first].tolist()))
        self.units, self.ctx, self.texts, self.held = [u[first]], [ctx[first]], [text], len(text)
        return spans

    def finish(self):
        """Spans of all that is left: whole contexts, then windows by the suffix sort, some groups at a time."""
        if not self.units:
            return
        yield self._collapse()
        u, data = self.units[0], np.frombuffer(self.texts[0], np.uint8)
        end = np.cumsum(u["nw"].astype(np.int64) + self.length - 1)
        edges = np.append(np.flatnonzero(~_same(u, ("key",))), len(u))
        i = 0
        while i < len(edges) - 1:
            before = end[edges[i] - 1] if edges[i] else 0
            j = max(i + 1, int(np.searchsorted(end[edges[1:] - 1], before + BATCH, "right")))
            a, z = edges[i], edges[j]
            off = np.concatenate(([0], end[a:z] - before))
            yield flagged_spans(u[a:z], repeated_windows(u[a:z], data[before : end[z - 1]], off, self.length, self.gram), self.length)
            i = j


class Keys:
    """Units of a bucket as they come: those whose key is met a second time, and that first one, are passed on."""

    def __init__(self):
        self.alone, self.many = np.zeros(0, UNIT), np.zeros(0, np.uint64)

    def add(self, units: np.ndarray) -> np.ndarray:
        u = np.concatenate((self.alone, units))
        u = u[np.argsort(u["key"], kind="stable")]
        near = _same(u, ("key",))
        mixed = near.copy()
        mixed[:-1] |= near[1:]
        mixed |= np.isin(u["key"], self.many)
        self.alone = u[~mixed]
        self.many = np.union1d(self.many, u["key"][mixed])
        return u[mixed]


# the job


def _keyed(docs: DataFrame, id_col: str, text_col: str, ties: bool, carry: tuple = ()) -> DataFrame:
    """id, doc (a null id is the least long), ta, tb (of the text, where ids repeat), t and the struct ``carried``."""
    more = [F.struct(*[docs[c] for c in carry]).alias("carried")] if carry else []
    t = docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(text_col).alias("t"), *more)
    part = lambda k: (F.conv(F.substring(F.sha2("t", 256), k, 16), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")
    none = F.lit(0).cast("long")
    return t.select("id", F.coalesce("id", F.lit(-(1 << 63))).alias("doc"), (part(1) if ties else none).alias("ta"), (part(17) if ties else none).alias("tb"), "t", *["carried"] * bool(carry))


def _doc_columns(b: pa.RecordBatch) -> tuple:
    return tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(3))


def _unit_batches(batches, length: int, gram: int, hot=None):
    """(units, their hashes, where they begin, text) for slices of about a megabyte of text."""
    for b in batches:
        data, offsets = utf8_buffers(b.column(3))
        docs = _doc_columns(b)
        i = 0
        while i < len(docs[0]):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BATCH, "right")) - 1)
            part = data[offsets[i] : offsets[j]]
            yield *contexts(part, offsets[i : j + 1] - offsets[i], tuple(d[i:j] for d in docs), length, gram, hot), part
            i = j


def _buckets(batches, name: str = "bucket"):
    """(bucket, rows of it) of batches sorted by bucket; the rows are iterated once."""
    at, rows = None, []
    for b in batches:
        buckets = b.column(0).to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(np.diff(buckets, prepend=buckets[:1] - 1)).tolist(), len(buckets)] if len(buckets) else []
        for a, z in zip(cuts, cuts[1:]):
            part = b.slice(a, z - a)
            yield int(buckets[a]) != at, part
            at = int(buckets[a])


def hot_grams(keyed: DataFrame, length: int, gram: int, hot: int) -> bytes:
    """Map (compressed bits) of the grams with about ``hot`` different contexts or more, whose windows are dealt out.

    Different contexts are counted by those whose hash falls in one of so many parts of the
    hash range, some 300 of them at the threshold: a context that recurs all over the corpus
    counts once, and one that is alone in every task counts all the same. The map has HOT_BITS
    bits; a gram that shares the bit of another is dealt out too. It decides how windows are
    dealt and never which of them are compared.
    """
    every = 1 << max(0, (hot // 300).bit_length() - 1)

    def run(batches):
        held, size = [], 0

        def flush():
            pairs = np.unique(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(pairs["key"].astype(np.int64)), pa.array(pairs["ctx"].view(np.int64))], ["key", "ctx"])

        for units, ctx, *_ in _unit_batches(batches, length, gram):
            some = (ctx & np.uint64(every - 1)) == 0
            pairs = np.empty(int(some.sum()), [("key", "u8"), ("ctx", "u8")])
            pairs["key"], pairs["ctx"] = units["key"][some], ctx[some]
            held.append(pairs)
            size += len(pairs)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    different = keyed.select(*DOC, "t").mapInArrow(run, "key long, ctx long").distinct()
    counts = different.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(1, hot // every))
    bit = F.pmod("key", F.lit(HOT_BITS))
    words = counts.groupBy(F.floor(bit / 32).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(32)).cast("int"))).alias("m"))
    found = np.zeros(HOT_BITS // 32, np.uint32)
    for r in words.collect():  # at most HOT_BITS / 32 rows
        found[r["w"]] = r["m"]
    return zlib.compress(found.tobytes(), 1)


def is_hot(bits: bytes):
    """Test of keys by a map of hot grams; None for an empty map."""
    words = np.frombuffer(zlib.decompress(bits), np.uint32)
    if not words.any():
        return None

    def test(keys: np.ndarray) -> np.ndarray:
        at = (keys % np.uint64(HOT_BITS)).astype(np.int64)
        return (words[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)

    return test


SPANS = "doc long, ta long, tb long, start long, end long"


def _span_columns(spans: np.ndarray) -> list:
    return [pa.array(np.ascontiguousarray(spans[n])) for n in SPAN.names]


def repeated_spans(docs: DataFrame, ties: bool, n_bytes: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Spans of bytes covered by windows that start earlier.

    Contexts are dealt to buckets of about BUCKET units by their keys, and tasks take their
    buckets one after another, so what a task holds doesn't grow with the corpus.
    """
    spark = docs.sparkSession
    small_batches(spark)
    units = 2 * n_bytes // (length - gram + 2)  # a gram is least in about so many windows
    tasks = max(2 * partitions(spark), -(-units // (BUCKET * BUCKETS_A_TASK)))
    buckets = tasks * max(4, -(-units // (BUCKET * tasks)))
    keyed = _keyed(docs, id_col, text_col, ties)
    hot_bits = hot_grams(keyed, length, gram, hot)

    def deal(df: DataFrame) -> DataFrame:
        return df.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")

    def scan(batches):
        held, size, place = [], 0, 0

        def flush():
            u, ctx, begin = (np.concatenate([h[k] for h in held]) for k in range(3))
            first, others = collapse(u, ctx, begin, np.concatenate([h[3] for h in held]), length)
            rows: list[list] = [[], [], []]
            spans, first = spans_of(u[others], length), u[np.sort(first)]
            for kind, arr, bucket in ((0, first, (first["key"] % np.uint64(buckets)).astype(np.int64)), (1, spans, spans["doc"] % buckets)):
                for k, part in _by_bucket(arr, bucket):
                    for column, value in zip(rows, (k, kind, to_blob(part))):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], ["bucket", "kind", "blob"])

        for u, ctx, begin, part in _unit_batches(batches, length, gram, is_hot(hot_bits)):
            held.append((u, ctx, begin + place, part))
            size, place = size + len(u), place + len(part)
            if size >= FLUSH or place >= 64 * BATCH:
                yield flush()
                held, size, place = [], 0, 0
        if held:
            yield flush()

    names = ["kind", *SPAN.names, "at", "key"]

    def gather(batches):
        keys, held, size = Keys(), [], 0

        def asks():
            found = keys.add(np.concatenate(held))
            for k in range(0, len(found), 50_000):
                u = found[k : k + 50_000]
                columns = [np.zeros(len(u), np.int32), *(u[n] for n in DOC), u["pos"], u["nw"].astype(np.int64), u["at"].astype(np.int64), u["key"].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

        for new, b in _buckets(batches):
            if new:
                if held:
                    yield from asks()
                keys, held, size = Keys(), [], 0
            for kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if kind:
                    spans = from_blob(blob, SPAN)
                    none = pa.nulls(len(spans), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(spans), np.int32)), *_span_columns(spans), none, none], names)
                    continue
                held.append(from_blob(blob, UNIT))
                size += len(held[-1])
                if size >= 4 * BUCKET:
                    yield from asks()
                    held, size = [], 0
        if held:
            yield from asks()

    dealt = deal(keyed.select(*DOC, "t").mapInArrow(scan, "bucket long, kind int, blob binary"))
    met = written(dealt.mapInArrow(gather, f"kind int, {SPANS}, at long, key long"), "contexts")
    asked = met.where("kind = 0").groupBy(*DOC).agg(F.collect_list(F.struct(F.col("start").alias("pos"), F.col("end").alias("nw"), "at", "key")).alias("asked"))

    def fetch(batches):
        for b in batches:
            data, offsets = utf8_buffers(b.column(3))
            lists = b.column(4)
            at = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.flatten()
            pos, nw, place, key = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            own = np.repeat(np.arange(len(lists)), np.diff(at))
            units = np.zeros(len(own), UNIT)
            for name, values in zip(DOC, _doc_columns(b)):
                units[name] = values[own]
            units["key"], units["pos"], units["nw"], units["at"] = key.astype(np.uint64), pos, nw, place
            begin = offsets[own] + pos
            raw = data.tobytes()
            bucket = (units["key"] % np.uint64(buckets)).astype(np.int64)
            rows: list[list] = [[], [], []]
            for k, idx in _by_bucket(np.arange(len(units)), bucket):
                text = b"".join(raw[p : p + int(w) + length - 1] for p, w in zip(begin[idx].tolist(), units["nw"][idx].tolist()))
                for column, value in zip(rows, (k, to_blob(units[idx]), text)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["bucket", "blob", "text"])

    def sort(batches):
        meeting = Meeting(length, gram)
        out = lambda spans: pa.RecordBatch.from_arrays(_span_columns(spans), list(SPAN.names))
        for new, b in _buckets(batches):
            if new:
                yield from map(out, meeting.finish())
                meeting = Meeting(length, gram)
            units, texts = [from_blob(x, UNIT) for x in b.column(1).to_pylist()], b.column(2).to_pylist()
            yield from map(out, meeting.add(np.concatenate(units), b"".join(texts)))
        yield from map(out, meeting.finish())

    cut = keyed.join(asked, list(DOC)).select(*DOC, "t", "asked").mapInArrow(fetch, "bucket long, blob binary, text binary")
    sorted_spans = written(deal(cut).mapInArrow(sort, SPANS), "spans")
    return met.where("kind = 1").select(*SPAN.names).unionByName(sorted_spans)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = False, carry: tuple = ()) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 (with_text: kept, the
    remaining bytes, and kept_text, which leaves out the bytes of characters cut through).

    A byte goes if a string of ``length`` bytes of its document that covers it also starts
    earlier: in a document with a smaller id, or before in the same one. Strings are those of
    the input. A null text is empty; a null id comes before all others. Rows that share an id
    are ordered by a hash of their texts; a repeated row (same id and text) is one document,
    and each of its rows gets the same answer. Texts shorter than ``length`` lose nothing, an
    empty table gives no rows, and other columns are ignored (``carry`` names some to keep).
    """
    per_id = docs.select(docs[id_col].alias("id"), F.octet_length(text_or_empty(text_col)).alias("n")).groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    most, n_bytes = per_id.agg(F.coalesce(F.max("rows"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    spans = repeated_spans(docs, most > 1, n_bytes, id_col, text_col, length, gram, hot)
    lists = spans.groupBy(*DOC).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = _keyed(docs, id_col, text_col, most > 1, carry).join(lists, list(DOC), "left").select("id", "t", "spans", *["carried"] * bool(carry))

    def cut(batches):
        for b in batches:
            data, offsets = utf8_buffers(b.column(1))
            counts, sums, kept = ([], [], []), [], []
            for k, spans in enumerate(b.column(2).to_pylist()):
                whole = data[offsets[k] : offsets[k + 1]]
                rest, removed, runs = whole.tobytes(), 0, 0
                if spans:
                    a = np.array([(s["start"], s["end"]) for s in spans], np.int64)
                    joined = join_spans((np.zeros(len(a), np.int64),), a[:, 0], a[:, 1])
                    keep = np.ones(len(whole), bool)
                    for s, e in zip(joined["start"], joined["end"]):
                        keep[s:e] = False
                    rest, removed, runs = whole[keep].tobytes(), int((~keep).sum()), len(joined)
                for column, value in zip(counts, (len(whole), removed, runs)):
                    column.append(value)
                sums.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            columns = [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns += [pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())]
                names += ["kept", "kept_text"]
            if carry:
                columns.append(b.column(3))
                names.append("carried")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, kept_text string" * with_text
    if carry:
        kind += f", carried {docs.select(*carry).schema.simpleString()}"
    return joined.mapInArrow(cut, kind).withColumnRenamed("id", id_col)
