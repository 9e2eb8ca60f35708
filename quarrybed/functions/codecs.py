"""Byte-level codecs: varints, delta instructions, dictionary deltas. Plain functions and their Arrow forms."""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CodecError(ValueError):
    """Malformed bytes."""


# varints


def write_size(n: int) -> bytes:
    """Seven bits a byte, least significant first."""
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_size(data: bytes, at: int = 0) -> tuple[int, int]:
    """(number, place after it)."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise CodecError("a number ends too early")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def write_entry_header(code: int, size: int) -> bytes:
    """Type code and size: four bits of size in the first byte, then seven a byte."""
    first, rest = code << 4 | size & 0xF, size >> 4
    return bytes((first | 0x80,)) + write_size(rest) if rest else bytes((first,))


def read_entry_header(data: bytes, at: int = 0) -> tuple[int, int, int]:
    """(type code, size, place after it)."""
    if at >= len(data):
        raise CodecError("an entry is missing")
    byte = data[at]
    code, size = byte >> 4 & 7, byte & 0xF
    at += 1
    if byte & 0x80:
        rest, at = read_size(data, at)
        size |= rest << 4
    return code, size, at


def write_distance(n: int) -> bytes:
    """Most significant first; each byte but the last stands for one more than it shows."""
    out = [n & 0x7F]
    n >>= 7
    while n:
        n -= 1
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(reversed(out))


def read_distance(data: bytes, at: int = 0) -> tuple[int, int]:
    value = -1
    while True:
        if at >= len(data):
            raise CodecError("a distance ends too early")
        byte = data[at]
        at += 1
        value = (value + 1) << 7 | byte & 0x7F
        if byte < 0x80:
            return value, at


# delta instructions

MIN_MATCH, MAX_COPY, MAX_INSERT = 16, 0xFFFFFF, 127


def copy_op(offset: int, size: int) -> bytes:
    """A copy of up to 2^24 - 1 bytes: a bit map says which bytes of offset and size follow."""
    flags, tail = 0x80, bytearray()
    for k in range(4):
        if byte := offset >> 8 * k & 0xFF:
            flags |= 1 << k
            tail.append(byte)
    for k in range(3):
        if (byte := size >> 8 * k & 0xFF) and size != 0x10000:
            flags |= 0x10 << k
            tail.append(byte)
    return bytes((flags,)) + bytes(tail)


def _instructions(ops: list[tuple], base: bytes, target: bytes) -> bytes:
    """Header and instructions; ops are ("copy", offset, size) and ("insert", start, end) on the target."""
    out = bytearray(write_size(len(base)) + write_size(len(target)))
    for kind, a, b in ops:
        if kind == "copy":
            while b > 0:
                n = min(b, MAX_COPY)
                out += copy_op(a, n)
                a, b = a + n, b - n
        else:
            for k in range(a, b, MAX_INSERT):
                part = target[k : min(b, k + MAX_INSERT)]
                out.append(len(part))
                out += part
    return bytes(out)


def cull(places: list, most: int = 64) -> list:
    """At most so many of a list, evenly spaced, the first among them."""
    return places if len(places) <= most else [places[k * len(places) // most] for k in range(most)]


def common_length(a: bytes, b: bytes, i: int, j: int, most: int) -> int:
    """Bytes that a from i and b from j share, by doubling strides."""
    n, step = 0, 32
    most = min(most, len(a) - i, len(b) - j)
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 2)
            while step > 1 and a[i + n : i + n + step] != b[j + n : j + n + step]:
                step //= 2
            if step == 1 and a[i + n] != b[j + n]:
                break
    return n


class RabinIndex:
    """Fingerprints of a base's windows at every 16th place, sorted, and those places.

    A fingerprint at over ``most`` places keeps evenly spaced ones. A bit map of the
    fingerprints' low bits tells most windows of a target apart at once.
    """

    def __init__(self, base: bytes, prints: np.ndarray | None = None, most: int = 64):
        self.base = base
        aligned = (window_fingerprints(base) if prints is None else prints)[::WIDTH]
        order = np.argsort(aligned, kind="stable")
        if len(aligned) > most:
            start = np.searchsorted(aligned[order], aligned[order])
            size = np.searchsorted(aligned[order], aligned[order], "right") - start
            rank = np.arange(len(order)) - start
            slot = -(-rank * most // size)  # row k * size // most is kept, for each k
            order = order[(size <= most) | ((slot < most) & (slot * size // most == rank))]
        self.prints, self.places = aligned[order], order * WIDTH
        self.low = np.zeros(1 << 16, bool)
        self.low[self.prints & 0xFFFF] = True

    def hits(self, prints: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """Places of a target whose fingerprints are in the index, and the range of the index that has each."""
        at = np.flatnonzero(self.low[prints & 0xFFFF])
        first = np.searchsorted(self.prints, prints[at])
        last = np.searchsorted(self.prints, prints[at], "right")
        some = last > first
        return at[some].tolist(), first[some].tolist(), last[some].tolist()


def encode_rabin(base: bytes, target: bytes, index: RabinIndex | None = None, max_size: int | None = None, prints: np.ndarray | None = None) -> bytes | None:
    """Delta by Rabin fingerprints: at each window that the index of the base knows, the longest match, grown backwards too.

    The fingerprints of the target (``prints``, if they are known) come from one pass over
    all of it; only windows that the base has are looked at one by one. None where the delta
    would exceed ``max_size``.
    """
    index = RabinIndex(base) if index is None else index
    at, first, last = index.hits(window_fingerprints(target) if prints is None else prints)
    ops: list[tuple] = []
    pending = size = k = 0
    places = index.places
    while k < len(at):
        here, best, where = at[k], 0, 0
        for p in places[first[k] : last[k]].tolist():
            n = common_length(base, target, p, here, MAX_COPY)
            if n > best:
                best, where = n, p
                if n >= 4096:
                    break
        if best < MIN_MATCH:  # two windows with one fingerprint
            k += 1
            continue
        back = 0
        while back < here - pending and back < where and base[where - back - 1] == target[here - back - 1]:
            back += 1
        if here - back > pending:
            ops.append(("insert", pending, here - back))
            size += here - back - pending
        ops.append(("copy", where - back, best + back))
        size += 4
        pending = here + best
        if max_size is not None and size > max_size:
            return None
        k = bisect_left(at, pending, k + 1)
    if pending < len(target):
        ops.append(("insert", pending, len(target)))
        if max_size is not None and size + len(target) - pending > max_size:
            return None
    out = _instructions(ops, base, target)
    return None if max_size is not None and len(out) > max_size else out


def encode_lines(base: bytes, target: bytes) -> bytes:
    """Delta by an alignment of lines."""
    from .diffs import align

    a, b = base.splitlines(keepends=True), target.splitlines(keepends=True)
    at_a, at_b = [0], [0]
    for x in a:
        at_a.append(at_a[-1] + len(x))
    for x in b:
        at_b.append(at_b[-1] + len(x))
    ops, done = [], 0
    for i, j, n in align(a, b):
        if at_b[j] > done:
            ops.append(("insert", done, at_b[j]))
        ops.append(("copy", at_a[i], at_a[i + n] - at_a[i]))
        done = at_b[j + n]
    if done < len(target):
        ops.append(("insert", done, len(target)))
    return _instructions(ops, base, target)


def shared_rate(base: bytes, target: bytes) -> float | None:
    """Share of the target's bytes that a line alignment copies; null for an empty target."""
    if not target:
        return None
    from .diffs import align

    b = target.splitlines(keepends=True)
    return sum(len(x) for _, j, n in align(base.splitlines(keepends=True), b) for x in b[j : j + n]) / len(target)


def rabin_rate(base: bytes, target: bytes) -> float:
    """Share of the target's bytes that the Rabin delta copies; two empty texts are alike, an empty one is unlike any other."""
    if not base or not target:
        return float(base == target)
    return sum(n for kind, _, n in parse_delta(encode_rabin(base, target))[2] if kind == "copy") / len(target)


def rabin_sampled_rate(base: bytes, target: bytes, least: float = 0.5) -> float:
    """Share of the target's sampled windows whose fingerprint is one of the base's samples; 0 below ``least``.

    A sample is taken every 16 bytes, every 256 of a base of over a million.
    """
    if not base or not target:
        return float(base == target)
    step = 256 if len(base) > 1_000_000 else WIDTH
    a, b = window_fingerprints(base)[::step], window_fingerprints(target)[::step]
    rate = float(np.isin(b, a).mean()) if len(a) and len(b) else 0.0
    return rate if rate >= least else 0.0


def parse_delta(delta: bytes) -> tuple[int, int, list[tuple]]:
    """(base size, target size, instructions): ("copy", offset, size) or ("insert", bytes, size)."""
    base_size, at = read_size(delta)
    target_size, at = read_size(delta, at)
    ops = []
    while at < len(delta):
        flags = delta[at]
        at += 1
        if flags & 0x80:
            offset = size = 0
            for k in range(7):
                if flags >> k & 1:
                    if at >= len(delta):
                        raise CodecError("a copy ends too early")
                    if k < 4:
                        offset |= delta[at] << 8 * k
                    else:
                        size |= delta[at] << 8 * (k - 4)
                    at += 1
            ops.append(("copy", offset, size or 0x10000))
        elif flags:
            part = delta[at : at + flags]
            if len(part) < flags:
                raise CodecError("an insert ends too early")
            ops.append(("insert", part, flags))
            at += flags
        else:
            raise CodecError("instruction zero")
    return base_size, target_size, ops


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The target that instructions make from their base; every size and range is checked."""
    base_size, target_size, ops = parse_delta(delta)
    if base_size != len(base):
        raise CodecError(f"the base has {len(base)} bytes, not {base_size}")
    out = bytearray()
    for kind, a, n in ops:
        if kind == "copy":
            if a + n > len(base):
                raise CodecError("a copy leaves the base")
            out += base[a : a + n]
        else:
            out += a
    if len(out) != target_size:
        raise CodecError(f"{len(out)} bytes, not {target_size}")
    return bytes(out)


# rolling fingerprints

POLYNOMIAL, DEGREE, WIDTH = 0x80000009, 31, 16


def _reduced(value: int) -> int:
    while (n := value.bit_length()) > DEGREE:
        value ^= POLYNOMIAL << (n - 1 - DEGREE)
    return value


_SHIFT = [_reduced(k << DEGREE) for k in range(256)]


def fingerprint(window: bytes) -> int:
    """Rabin fingerprint: the bytes as a polynomial over two elements, modulo one of degree 31."""
    h = 0
    for byte in window:
        h = (h << 8 & 0x7FFFFFFF | byte) ^ _SHIFT[h >> 23]
    return h


#: What a byte adds at each place of a window: the fingerprint of a window is the sum of its bytes' over two elements.
_AT = np.array([[_reduced(k << 8 * (WIDTH - 1 - i)) for k in range(256)] for i in range(WIDTH)], np.uint32)


def window_fingerprints(data: bytes) -> np.ndarray:
    """Fingerprints of every window of 16 bytes, all at once."""
    n = len(data) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    x = np.frombuffer(data, np.uint8)
    out = _AT[0].take(x[:n])
    for i in range(1, WIDTH):
        out ^= _AT[i].take(x[i : n + i])
    return out


# dictionary deltas


def dictionary_delta(base: bytes, target: bytes, level: int = 3) -> bytes:
    """The target compressed with the base as a dictionary, its size in the header."""
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(base, zstandard.DICT_TYPE_RAWCONTENT) if len(base) >= 8 else None, write_content_size=True).compress(target)


def apply_dictionary_delta(base: bytes, delta: bytes) -> bytes:
    try:
        if zstandard.get_frame_parameters(delta).content_size == zstandard.CONTENTSIZE_UNKNOWN:
            raise CodecError("no content size")
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(base, zstandard.DICT_TYPE_RAWCONTENT) if len(base) >= 8 else None).decompress(delta)
    except zstandard.ZstdError as e:
        raise CodecError(str(e)) from e


# Arrow forms: null in, null out; null for malformed bytes


def _pairs(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return None
            try:
                return f(bytes(x), bytes(y))
            except CodecError:
                return None

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    return run


@F.pandas_udf(T.LongType())
def first_print_udf(data: pd.Series) -> pd.Series:
    """Fingerprint of the first window; null for what is shorter."""
    return pd.Series([fingerprint(bytes(x[:WIDTH])) if x is not None and len(x) >= WIDTH else None for x in data], dtype="Int64")


def rebuilds_udf(encode, apply):
    """Whether a pair's delta gives the target again. Made and applied in one worker, so no delta leaves it; null for null."""
    return F.pandas_udf(_pairs(lambda base, target: apply(base, encode(base, target)) == target), T.BooleanType())


def delta_size_udf(encode):
    """Length of a pair's delta, which stays in the worker; null for null."""
    return F.pandas_udf(_pairs(lambda base, target: len(encode(base, target))), T.IntegerType())


def _single(f):
    def run(a: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else f(bytes(x))
            except zlib.error:
                return None

        return pd.Series([one(x) for x in a], dtype=object)

    return run


deflate_udf = F.pandas_udf(_single(zlib.compress), T.BinaryType())
inflate_udf = F.pandas_udf(_single(zlib.decompress), T.BinaryType())
rabin_delta_udf = F.pandas_udf(_pairs(encode_rabin), T.BinaryType())
line_delta_udf = F.pandas_udf(_pairs(encode_lines), T.BinaryType())
apply_delta_udf = F.pandas_udf(_pairs(apply_delta), T.BinaryType())
dictionary_delta_udf = F.pandas_udf(_pairs(dictionary_delta), T.BinaryType())
apply_dictionary_delta_udf = F.pandas_udf(_pairs(apply_dictionary_delta), T.BinaryType())
shared_rate_udf = F.pandas_udf(_pairs(shared_rate), T.DoubleType())
rabin_rate_udf = F.pandas_udf(_pairs(rabin_rate), T.DoubleType())
rabin_sampled_rate_udf = F.pandas_udf(_pairs(rabin_sampled_rate), T.DoubleType())
