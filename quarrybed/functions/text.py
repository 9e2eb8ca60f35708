"""Paths, samples and similarity of payloads, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = (9, 10, 11, 12, 13, 32)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def path_name_hash(path) -> Column:
    """Hash of a path's last part that keeps names with one ending together.

    Over bytes but white space: h = (h >> 2) + (byte << 24), modulo 2^32. Works on the bytes
    of any UTF-8, through their hex digits.
    """
    name = F.hex(F.regexp_extract(_col(path), "([^/]*)$", 1).cast("binary"))
    codes = F.transform(F.filter(F.split(F.regexp_replace(name, "(..)", "$1,"), ","), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    codes = F.filter(codes, lambda c: ~c.isin(*SPACE))
    zero = F.lit(0).cast("long")
    return F.aggregate(codes, zero, lambda h, c: (F.shiftright(h, 2) + F.shiftleft(c, 24)).bitwiseAND(F.lit(0xFFFFFFFF)))


def parent_dir(path) -> Column:
    return F.regexp_extract(_col(path), "^(.*)/[^/]*$", 1)


def path_under(path, parent) -> Column:
    """Whether a path is ``parent`` or lies below it, part by part."""
    path, parent = _col(path), F.lit(parent) if isinstance(parent, str) else parent
    return (path == parent) | F.startswith(path, F.concat(F.regexp_replace(parent, "/+$", ""), F.lit("/")))


def under_any(path, parents: list[str]) -> Column:
    """Under one of the directories; no directories let everything pass."""
    test = F.lit(not parents)
    for p in parents:
        test = test | path_under(path, p)
    return test


def content_key(data) -> Column:
    """First eight bytes as hex, zero-filled: sorts as the bytes do."""
    return F.rpad(F.hex(F.substring(_col(data).cast("binary"), 1, 8)), 16, "0")


def head_tail_similar(a, b, sample: int = 64) -> Column:
    """Cheap prefilter: equal samples at the start and at the end of the shorter length."""
    a, b = _col(a).cast("binary"), _col(b).cast("binary")
    n = F.least(F.octet_length(a), F.octet_length(b))
    size = F.least(F.lit(sample), n)
    cut = lambda x, at: F.substring(x, at, size)
    return (cut(a, F.lit(1)) == cut(b, F.lit(1))) & (cut(a, n - size + 1) == cut(b, n - size + 1))


def sampled_rate(old, new, chunk: int = 64, step: int | None = None, floor: float = 0.5) -> Column:
    """Share of ``chunk``-byte samples, one each ``step`` bytes of the common length, that are equal.

    1 where both are empty, 0 where one is; shares below ``floor`` count as 0.
    """
    old, new = _col(old).cast("binary"), _col(new).cast("binary")
    step = step or chunk
    n, m = F.octet_length(old), F.octet_length(new)
    low, high = F.least(n, m), F.greatest(n, m)
    places = F.when(low > 0, F.sequence(F.lit(0), low - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    same = F.filter(places, lambda p: F.substring(old, p + 1, F.least(F.lit(chunk), low - p)) == F.substring(new, p + 1, F.least(F.lit(chunk), low - p)))
    hit = F.aggregate(same, F.lit(0), lambda s, p: s + F.least(F.lit(chunk), low - p))
    seen = F.aggregate(places, F.lit(0), lambda s, p: s + F.least(F.lit(chunk), low - p))
    rate = hit / F.greatest(seen + high - low, F.lit(1))
    return F.when(high == 0, F.lit(1.0)).when(low == 0, F.lit(0.0)).when(rate < floor, F.lit(0.0)).otherwise(rate)


def chunk_hashes(data, chunk: int = 64) -> Column:
    """64-bit hashes of a payload's whole chunks. Make it a column once, before payloads meet in pairs."""
    x = _col(data).cast("binary")
    n = F.floor(F.octet_length(x) / chunk).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.xxhash64(F.substring(x, k * chunk + 1, F.lit(chunk))))


def rate_bound(old_chunks, new_chunks, old_size, new_size, chunk: int = 64) -> Column:
    """What ``sampled_rate`` can be at most, from chunk hashes and sizes: the last chunk of the shorter one counts as equal."""
    n, m = _col(old_size), _col(new_size)
    same = F.aggregate(F.zip_with(_col(old_chunks), _col(new_chunks), lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise((same * chunk + F.least(n, m) % chunk) / F.greatest(n, m))


def stepped_rate(old, new) -> Column:
    """The sampled rate with a step that grows with the length."""
    n = F.greatest(F.octet_length(_col(old).cast("binary")), F.octet_length(_col(new).cast("binary")))
    rate = lambda step: sampled_rate(old, new, 16, step)
    return F.when(n < 4096, rate(16)).when(n < 65536, rate(128)).when(n < 1 << 20, rate(512)).otherwise(rate(1024))


def block_set(data, block: int = 16) -> Column:
    """The different aligned blocks of a payload, by 64-bit hashes. Make it a column once, before payloads meet in pairs."""
    x = _col(data).cast("binary")
    n = F.floor(F.octet_length(x) / block).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda k: F.xxhash64(F.substring(x, k * block + 1, F.lit(block)))))


def block_overlap(old_blocks, new_blocks) -> Column:
    """Share of the new payload's blocks that the old one has too; null without a block."""
    new = _col(new_blocks)
    return F.when(F.size(new) > 0, F.size(F.array_intersect(new, _col(old_blocks))) / F.size(new))


def line_count(text) -> Column:
    """Lines as an editor counts them: a last newline ends its line."""
    t = _col(text)
    return F.when(F.length(t) == 0, 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + F.when(F.endswith(t, F.lit("\n")), 0).otherwise(1))


def large_file_marker(path, old, new, limit: int = 10_000) -> Column:
    """The note that stands for a diff of files with too many lines; null below."""
    n = F.coalesce(line_count(old), F.lit(0)) + F.coalesce(line_count(new), F.lit(0))
    return F.when(n > limit, F.format_string("large file: %s has %d lines, limit %d", _col(path), n, F.lit(limit)))


def is_binary(old, new) -> Column:
    """Whether one side is not UTF-8."""
    return ~(F.coalesce(F.is_valid_utf8(_col(old).cast("string")), F.lit(True)) & F.coalesce(F.is_valid_utf8(_col(new).cast("string")), F.lit(True)))


def repo_path(url) -> Column:
    """Repository path of a request URL: up to the service part."""
    return F.regexp_extract(_col(url), r"^(?:[a-z]+://[^/]+)?/?(.*?)/?(?:info/refs|git-upload-pack|git-receive-pack)?(?:\?.*)?$", 1)


def service_of_query(url) -> Column:
    return F.regexp_extract(_col(url), r"[?&]service=git-(upload|receive)-pack", 1)


def ssh_command(command) -> Column:
    """(service, path) of a remote command line."""
    c = _col(command)
    return F.struct(F.regexp_extract(c, r"^\s*git-(upload|receive)-pack\b", 1).alias("service"), F.regexp_extract(c, r"^\s*\S+\s+['\"]?(.*?)['\"]?\s*$", 1).alias("path"))
