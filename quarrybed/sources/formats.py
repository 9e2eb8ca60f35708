"""Binary formats: packs, pack indexes, staging indexes and loose objects. Plain functions on bytes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions.codecs import CodecError, apply_delta, apply_dictionary_delta, read_distance, read_entry_header, write_distance, write_entry_header

COMMIT, TREE, BLOB, TAG, ZSTD_DELTA, OFFSET_DELTA, REF_DELTA = range(1, 8)
TYPE_NAMES = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
TYPE_CODES = {v: k for k, v in TYPE_NAMES.items()}
HASHES = {"sha1": hashlib.sha1, "sha256": hashlib.sha256}
ID_SIZE = {"sha1": 20, "sha256": 32}


class FormatError(CodecError):
    """A file that is not what it should be."""


def oid_of(kind: str, data: bytes, hash_kind: str = "sha1") -> str:
    return HASHES[hash_kind](b"%s %d\0" % (kind.encode(), len(data)) + data).hexdigest()


# packs


@dataclass
class PackEntry:
    seq: int
    offset: int
    next_offset: int
    type_bits: int
    declared_size: int
    base_offset: int | None
    base_oid: str | None
    payload: bytes | None
    crc32: int


def pack_header(data: bytes) -> int:
    """Number of objects; raises unless magic and version fit."""
    if len(data) < 12 or data[:4] != b"PACK":
        raise FormatError("no pack")
    version, count = struct.unpack_from(">II", data, 4)
    if version != 2:
        raise FormatError(f"pack version {version}")
    return count


def pack_trailer(data: bytes, hash_kind: str = "sha1") -> tuple[str, str]:
    """(checksum stored at the end, checksum of what precedes it)."""
    n = ID_SIZE[hash_kind]
    if len(data) < 12 + n:
        raise FormatError("the pack is cut short")
    return data[-n:].hex(), HASHES[hash_kind](memoryview(data)[:-n]).hexdigest()


def parse_entry(data: bytes, at: int, seq: int, hash_kind: str = "sha1", payload: bool = True, end: int | None = None, shift: int = 0) -> PackEntry:
    """One entry at an offset; its size is checked; ``payload`` False inflates and drops it.

    ``shift``: where ``data`` begins in the pack, if it is a part of one.
    """
    end = len(data) - ID_SIZE[hash_kind] if end is None else end
    start = at
    code, size, at = read_entry_header(data, at)
    base_offset = base_oid = None
    if code in (OFFSET_DELTA, ZSTD_DELTA):
        distance, at = read_distance(data, at)
        base_offset = start + shift - distance
        if base_offset < 12 or distance == 0:
            raise FormatError(f"the base of the entry at {start} is outside")
    elif code == REF_DELTA:
        n = ID_SIZE[hash_kind]
        base_oid, at = data[at : at + n].hex(), at + n
    elif code not in TYPE_NAMES:
        raise FormatError(f"type {code} at {start}")
    z = zlib.decompressobj()
    parts, got, view = [], 0, memoryview(data)
    try:
        while not z.eof:
            if at >= end:
                raise FormatError(f"the entry at {start} is cut short")
            chunk = view[at : min(end, at + 65536)]
            part = z.decompress(chunk)
            at += len(chunk) - len(z.unused_data)
            got += len(part)
            if got > size:
                break
            if payload:
                parts.append(part)
    except zlib.error as e:
        raise FormatError(f"the entry at {start}: {e}") from e
    if got != size:
        raise FormatError(f"the entry at {start} has {got} bytes or more, not {size}")
    return PackEntry(seq, start + shift, at + shift, code, size, base_offset, base_oid, b"".join(parts) if payload else None, zlib.crc32(view[start:at]))


def parse_pack(data: bytes, hash_kind: str = "sha1", payload: bool = True, verify: bool = True) -> Iterator[PackEntry]:
    """All entries in order; count, bases, end and (verify) checksum are checked."""
    count = pack_header(data)
    if verify:
        stored, computed = pack_trailer(data, hash_kind)
        if stored != computed:
            raise FormatError("the pack's checksum is wrong")
    at, starts, end = 12, set(), len(data) - ID_SIZE[hash_kind]
    for seq in range(count):
        e = parse_entry(data, at, seq, hash_kind, payload, end)
        if e.base_offset is not None and e.base_offset not in starts:
            raise FormatError(f"the base of the entry at {at} is no entry")
        starts.add(at)
        at = e.next_offset
        yield e
    if at != end:
        raise FormatError("bytes after the last entry")


def build_pack(data: bytes, hash_kind: str = "sha1", verify: bool = True) -> Iterator[tuple]:
    """(seq, offset, type code, base offset, base id, content, crc32, id, type, chain length) of a pack's entries in order.

    Id, type and chain length are None, and the content is the delta, where the base isn't
    before the entry in this pack. What nobody builds on is not kept.
    """
    users: Counter = Counter()
    for e in parse_pack(data, hash_kind, payload=False, verify=verify):
        users[e.base_offset if e.base_offset is not None else e.base_oid] += 1
    users.pop(None, None)
    held: dict = {}  # by offset or id: (content, type, chain length)
    for e in parse_pack(data, hash_kind, verify=False):
        content, kind, length, oid = e.payload, TYPE_NAMES.get(e.type_bits), 0, None
        if kind is None:
            key = e.base_offset if e.base_offset is not None else e.base_oid
            base = held.get(key)
            users[key] -= 1
            if base is not None:
                content, kind, length = (apply_dictionary_delta if e.type_bits == ZSTD_DELTA else apply_delta)(base[0], content), base[1], base[2] + 1
                if not users[key]:
                    del held[key]
        if kind is not None:
            oid = oid_of(kind, content, hash_kind)
            for key in (e.offset, oid):
                if users[key] > 0:
                    held[key] = (content, kind, length)
        yield e.seq, e.offset, e.type_bits, e.base_offset, e.base_oid, content, e.crc32, oid, kind, length if kind else None


def parse_range(data: bytes, shift: int, seq: int, offsets: list[int], stop: int, hash_kind: str = "sha1", payload: bool = True) -> Iterator[PackEntry]:
    """Entries of a part of a pack that begins at ``shift``, by the offsets that its index has; ``stop`` is where the next entry or the trailer begins."""
    for k, (at, after) in enumerate(zip(offsets, [*offsets[1:], stop])):
        e = parse_entry(data, at - shift, seq + k, hash_kind, payload, len(data), shift)
        if e.next_offset != after:
            raise FormatError(f"the entry at {at} ends at {e.next_offset}, but the index says {after}")
        yield e


def encode_entry(code: int, data: bytes, distance: int | None = None, base_oid: str | None = None, level: int = 6) -> bytes:
    """An entry as it stands in a pack."""
    head = write_entry_header(code, len(data))
    if code in (OFFSET_DELTA, ZSTD_DELTA):
        head += write_distance(distance)
    elif code == REF_DELTA:
        head += bytes.fromhex(base_oid)
    return head + zlib.compress(data, level)


def pack_head(count: int) -> bytes:
    return b"PACK" + struct.pack(">II", 2, count)


def pack_bytes(entries: list[bytes], hash_kind: str = "sha1") -> bytes:
    body = pack_head(len(entries)) + b"".join(entries)
    return body + HASHES[hash_kind](body).digest()


# pack indexes


def parse_pack_index(data: bytes, hash_kind: str = "sha1") -> tuple[list[tuple[str, int, int]], str]:
    """([(oid, crc32, offset)], the pack's checksum); magic, version, fan-out, order and checksum are checked."""
    n = ID_SIZE[hash_kind]
    if data[:4] != b"\xfftOc" or len(data) < 8 + 1024 + 2 * n:
        raise FormatError("no pack index")
    if struct.unpack_from(">I", data, 4) != (2,):
        raise FormatError("pack index version")
    if HASHES[hash_kind](data[:-n]).digest() != data[-n:]:
        raise FormatError("the index's checksum is wrong")
    fan = struct.unpack_from(">256I", data, 8)
    if any(a > b for a, b in zip(fan, fan[1:])):
        raise FormatError("the fan-out decreases")
    count, at = fan[255], 8 + 1024
    if len(data) < at + count * (n + 8) + 2 * n:
        raise FormatError("the index is cut short")
    ids = [data[at + k * n : at + (k + 1) * n] for k in range(count)]
    if any(a > b for a, b in zip(ids, ids[1:])) or any(fan[b] != bisect_left(ids, bytes((b + 1,))) for b in range(255)):
        raise FormatError("ids out of order")
    at += count * n
    crcs = struct.unpack_from(f">{count}I", data, at)
    small = struct.unpack_from(f">{count}I", data, at + 4 * count)
    large_at, large_end = at + 8 * count, len(data) - 2 * n
    rows = []
    for oid, crc, off in zip(ids, crcs, small):
        if off & 0x80000000:
            place = large_at + 8 * (off & 0x7FFFFFFF)
            if place + 8 > large_end:
                raise FormatError("a large offset is missing")
            (off,) = struct.unpack_from(">Q", data, place)
        rows.append((oid.hex(), crc, off))
    return rows, data[-2 * n : -n].hex()


def pack_index_bytes(rows: list[tuple[str, int, int]], pack_checksum: str, hash_kind: str = "sha1") -> bytes:
    """A version 2 index of (oid, crc32, offset) rows; offsets from 2^31 on go to the 64-bit table."""
    rows = sorted(rows)
    counts = [0] * 256
    for oid, *_ in rows:
        counts[int(oid[:2], 16)] += 1
    total, fan = 0, []
    for c in counts:
        total += c
        fan.append(total)
    small, large = [], []
    for *_, off in rows:
        if off >= 1 << 31:
            small.append(0x80000000 | len(large))
            large.append(off)
        else:
            small.append(off)
    body = b"\xfftOc" + struct.pack(">I256I", 2, *fan) + b"".join(bytes.fromhex(o) for o, *_ in rows)
    body += struct.pack(f">{len(rows)}I", *(c for _, c, _ in rows)) + struct.pack(f">{len(rows)}I", *small)
    body += struct.pack(f">{len(large)}Q", *large) + bytes.fromhex(pack_checksum)
    return body + HASHES[hash_kind](body).digest()


# staging indexes


@dataclass
class StageEntry:
    name: str
    oid: str
    stage: int = 0
    mode: int = 0o100644
    size: int = 0
    ctime_s: int = 0
    ctime_ns: int = 0
    mtime_s: int = 0
    mtime_ns: int = 0
    dev: int = 0
    ino: int = 0
    uid: int = 0
    gid: int = 0
    assume_valid: bool = False
    extended: bool = False


STAGE_FIELDS = tuple(StageEntry.__dataclass_fields__)


def parse_stage_index(data: bytes, hash_kind: str = "sha1") -> tuple[list[StageEntry], list[str]]:
    """(entries, extension tags); magic, version and checksum are checked."""
    n = ID_SIZE[hash_kind]
    if data[:4] != b"DIRC" or len(data) < 12 + n:
        raise FormatError("no staging index")
    version, count = struct.unpack_from(">II", data, 4)
    if version != 2:
        raise FormatError(f"staging index version {version}")
    if HASHES[hash_kind](data[:-n]).digest() != data[-n:]:
        raise FormatError("the staging index's checksum is wrong")
    at, end, out = 12, len(data) - n, []
    for _ in range(count):
        if at + 42 + n > end:
            raise FormatError("the staging index is cut short")
        cs, cn, ms, mn, dev, ino, mode, uid, gid, size = struct.unpack_from(">10I", data, at)
        oid = data[at + 40 : at + 40 + n].hex()
        (flags,) = struct.unpack_from(">H", data, at + 40 + n)
        start = at + 42 + n
        stop = data.index(b"\0", start) if flags & 0xFFF == 0xFFF else start + (flags & 0xFFF)
        name = data[start:stop].decode()
        out.append(StageEntry(name, oid, flags >> 12 & 3, mode, size, cs, cn, ms, mn, dev, ino, uid, gid, bool(flags >> 15), bool(flags >> 14 & 1)))
        length = stop - at
        at += (length + 8) // 8 * 8
    tags = []
    while at + 8 <= end:
        tags.append(data[at : at + 4].decode("latin-1"))
        at += 8 + struct.unpack_from(">I", data, at + 4)[0]
    return out, tags


def stage_index_bytes(entries: list[StageEntry], hash_kind: str = "sha1") -> bytes:
    """A version 2 staging index, by name and stage."""
    body = bytearray(b"DIRC" + struct.pack(">II", 2, len(entries)))
    for e in sorted(entries, key=lambda e: (e.name.encode(), e.stage)):
        name = e.name.encode()
        flags = e.assume_valid << 15 | e.extended << 14 | e.stage << 12 | min(len(name), 0xFFF)
        row = struct.pack(">10I", e.ctime_s, e.ctime_ns, e.mtime_s, e.mtime_ns, e.dev, e.ino, e.mode, e.uid, e.gid, e.size & 0xFFFFFFFF) + bytes.fromhex(e.oid) + struct.pack(">H", flags) + name
        body += row + b"\0" * ((len(row) + 8) // 8 * 8 - len(row))
    return bytes(body) + HASHES[hash_kind](body).digest()


# loose objects and trees


def parse_loose(data: bytes) -> tuple[str, bytes]:
    """(type, payload) of a deflated object with its header."""
    try:
        raw = zlib.decompress(data)
    except zlib.error as e:
        raise FormatError(str(e)) from e
    head, sep, payload = raw.partition(b"\0")
    kind, _, size = head.partition(b" ")
    if not sep or not size.isdigit() or int(size) != len(payload):
        raise FormatError("an object's header is wrong")
    return kind.decode("latin-1"), payload


def loose_bytes(kind: str, data: bytes) -> bytes:
    return zlib.compress(b"%s %d\0" % (kind.encode(), len(data)) + data)


def parse_tree(data: bytes, hash_kind: str = "sha1") -> list[tuple[str, str, str]]:
    """[(mode, oid, name)]; names that are not UTF-8 are read as GBK."""
    out, at, n = [], 0, ID_SIZE[hash_kind]
    while at < len(data):
        space, zero = data.find(b" ", at), data.find(b"\0", at)
        if space < 0 or zero < space or zero + 1 + n > len(data):
            raise FormatError("a tree item is cut short")
        raw = data[space + 1 : zero]
        try:
            name = raw.decode()
        except UnicodeDecodeError:
            name = raw.decode("gbk", "replace")
        out.append((data[at:space].decode("latin-1"), data[zero + 1 : zero + 1 + n].hex(), name))
        at = zero + 1 + n
    return out


def tree_bytes(items: list[tuple[str, str, str]]) -> bytes:
    """Items by name, directories as if their names ended in a slash."""
    order = sorted(items, key=lambda i: i[2].encode() + (b"/" if i[0].lstrip("0") == "40000" else b""))
    return b"".join(f"{mode} {name}".encode() + b"\0" + bytes.fromhex(oid) for mode, oid, name in order)


@dataclass
class PackBuilder:
    """Entries of a pack as they are added, with the rows of its index."""

    hash_kind: str = "sha1"
    parts: list[bytes] = field(default_factory=list)
    rows: list[tuple[str, int, int]] = field(default_factory=list)
    at: int = 12

    def add(self, oid: str, entry: bytes) -> int:
        start = self.at
        self.rows.append((oid, zlib.crc32(entry), start))
        self.parts.append(entry)
        self.at += len(entry)
        return start

    def finish(self) -> tuple[bytes, bytes]:
        """(pack, index)."""
        pack = pack_bytes(self.parts, self.hash_kind)
        return pack, pack_index_bytes(self.rows, pack[-ID_SIZE[self.hash_kind] :].hex(), self.hash_kind)
