"""Formats: round trips, known answers and damaged files. Packs are built by the plain functions here."""

import hashlib
import random
import struct
import tracemalloc
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrybed.functions import codecs, diffs
from quarrybed.sources import formats as fm


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_alignment_is_longest(a, b):
    runs = diffs.align(a, b)
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in runs)
    assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(runs, runs[1:]))
    assert sum(n for *_, n in runs) == lcs(a, b)


def test_line_operations_known_answer():
    assert diffs.line_operations("a\nb\nc\n", "a\nB\nc\nd\n") == [("equal", 1, 1, "a"), ("delete", 2, None, "b"), ("insert", None, 2, "B"), ("equal", 3, 3, "c"), ("insert", None, 4, "d")]


def apply_unified(old, diff):
    """An independent patcher."""
    src, out, at = old.split("\n")[:-1] if old else [], [], 0
    for line in diff.split("\n"):
        if line.startswith("@@"):
            start, n = (int(x) for x in line.split()[1][1:].split(","))
            first = start - 1 if n else start
            out += src[at:first]
            at = first
        elif line[:1] in (" ", "-", "+") and not line.startswith(("---", "+++")):
            if line[0] != "+":
                assert src[at] == line[1:]
                at += 1
            if line[0] != "-":
                out.append(line[1:])
    return "".join(x + "\n" for x in out + src[at:])


@settings(max_examples=60)
@given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=40))
def test_unified_diffs_apply(a, b):
    old, new = "".join(x + "\n" for x in a), "".join(x + "\n" for x in b)
    d = diffs.unified_diff("f", old, new)
    assert (d == "") == (old == new)
    if d:
        assert apply_unified(old, d) == new
        assert ("--- /dev/null" in d) == (not a) and ("+++ /dev/null" in d) == (not b)


def test_diff_notes():
    assert "Binary" in diffs.file_diff("f", b"\xff", b"x")
    assert diffs.file_diff("f", b"a\n" * 6000, b"b\n" * 6000).startswith("large file: f has 12000 lines")


@given(st.integers(0, 2**60))
def test_varints(n):
    assert codecs.read_size(codecs.write_size(n)) == (n, len(codecs.write_size(n)))
    assert codecs.read_distance(codecs.write_distance(n)) == (n, len(codecs.write_distance(n)))
    assert codecs.read_entry_header(codecs.write_entry_header(6, n)) == (6, n, len(codecs.write_entry_header(6, n)))


def test_varint_known_answer():
    assert len(codecs.write_distance(11013)) == 2


@settings(max_examples=80)
@given(st.binary(max_size=400), st.lists(st.tuples(st.integers(0, 400), st.binary(max_size=60)), max_size=4))
def test_deltas_round_trip(base, edits):
    base = base * 3
    target = bytearray(base)
    for at, data in edits:
        target[at : at + len(data) // 2] = data
    target = bytes(target)
    assert codecs.apply_delta(base, codecs.encode_rabin(base, target)) == target
    assert codecs.apply_delta(base, codecs.encode_lines(base, target)) == target
    assert codecs.apply_dictionary_delta(base, codecs.dictionary_delta(base, target)) == target


@given(st.binary(min_size=16, max_size=120))
def test_window_fingerprints(data):
    rolled = codecs.window_fingerprints(data).tolist()
    assert rolled == [codecs.fingerprint(data[k : k + 16]) for k in range(len(data) - 15)]
    h = int.from_bytes(data[:16], "big")
    while h.bit_length() > 31:
        h ^= codecs.POLYNOMIAL << (h.bit_length() - 32)
    assert rolled[0] == h


def test_rabin_index_thins_what_repeats_and_finds_what_is_alike():
    r = random.Random(3)
    base = bytes(r.choices(range(256), k=4000))
    assert len(codecs.RabinIndex(b"a" * 16 * 500).places) == 64 and len(codecs.RabinIndex(base).places) == 250
    target = b"new" + base[1000:3000] + b"more" * 5 + base[:700]
    delta = codecs.encode_rabin(base, target)
    assert codecs.apply_delta(base, delta) == target and len(delta) < 60
    assert codecs.rabin_rate(base, target) > 0.98 and codecs.rabin_rate(b"", b"") == 1 and codecs.rabin_rate(b"", b"x") == 0
    assert codecs.rabin_sampled_rate(base, base) == 1 and codecs.rabin_sampled_rate(base, base[5:]) == 0


def test_alignment_of_long_unlike_texts_is_cheap():
    """Two orders of 5,000 lines, and 5,000 lines with nothing in common."""
    a = [f"line {k}" for k in range(5000)]
    b = random.Random(1).sample(a, 5000)
    tracemalloc.start()
    runs = diffs.align(a, b)
    assert diffs.align(a, [x + "!" for x in a]) == []
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in runs) and sum(n for *_, n in runs) > 100


def test_delta_limits():
    r = random.Random(1)
    base = bytes(r.randrange(256) for _ in range(5000))
    assert codecs.encode_rabin(base, bytes(r.randrange(256) for _ in range(5000)), max_size=100) is None
    assert len(codecs.encode_rabin(base, base, max_size=100)) < 20
    big = base * 20
    assert codecs.apply_delta(big, codecs.encode_rabin(big, big[::-1] + big)) == big[::-1] + big
    assert codecs.cull(list(range(128)))[0] == 0 and codecs.cull(list(range(128)))[-1] == 126 and len(codecs.cull(list(range(128)))) == 64
    assert codecs.shared_rate(b"x", b"") is None and codecs.shared_rate(b"a\nb\n", b"a\nc\n") == 0.5


@pytest.mark.parametrize("delta", [b"", b"\x05", b"\x03\x03\x00", b"\x03\x03\x05ab", b"\x03\x05\x91", codecs.write_size(3) + codecs.write_size(9) + codecs.copy_op(0, 9), codecs.write_size(4) + codecs.write_size(1) + b"\x01a", codecs.write_size(3) + codecs.write_size(2) + b"\x01a"])
def test_malformed_deltas(delta):
    with pytest.raises(codecs.CodecError):
        codecs.apply_delta(b"abc", delta)


@given(st.binary(max_size=200), st.binary(max_size=200), st.integers(0, 180))
def test_common_length(a, b, i):
    x, y = a[:i] + b"same" * 20 + b, b"same" * 20 + a
    n = codecs.common_length(x, y, len(a[:i]), 0, 10_000)
    want = 0
    while len(a[:i]) + want < len(x) and want < len(y) and x[len(a[:i]) + want] == y[want]:
        want += 1
    assert n == want


def test_known_ids():
    assert fm.oid_of("blob", b"Hello, world!") == "5dd01c177f5d7d1be5346a5bc18a569a7410c2ef"
    assert fm.oid_of("blob", b"") == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    assert fm.oid_of("blob", b"Hello, world!", "sha256") == "178b5fbed164aee269fee7323badf7269cca0eed0875717b0d2d4f9819164c3f"
    tree = fm.tree_bytes([("100644", "17288789afffb273c8c394bc65e87d899b92897b", "hello-world")])
    assert fm.oid_of("tree", tree) == "cf99336fa61439a2f074c7e6de1c1a05579550e2"


def small_pack(kind="sha1"):
    one, two = b"x" * 100, b"x" * 100 + b"tail"
    b = fm.PackBuilder(kind)
    at = b.add(fm.oid_of("blob", one, kind), fm.encode_entry(fm.BLOB, one))
    b.add(fm.oid_of("blob", two, kind), fm.encode_entry(fm.OFFSET_DELTA, codecs.encode_rabin(one, two), b.at - at))
    return b.finish()


@pytest.mark.parametrize("kind", ["sha1", "sha256"])
def test_pack_and_index_round_trip(kind):
    pack, index = small_pack(kind)
    entries = list(fm.parse_pack(pack, kind))
    rows, checksum = fm.parse_pack_index(index, kind)
    assert checksum == fm.pack_trailer(pack, kind)[0] == fm.pack_trailer(pack, kind)[1]
    assert {(e.offset, e.crc32) for e in entries} == {(off, crc) for _, crc, off in rows}
    assert entries[1].base_offset == 12 and entries[0].next_offset == entries[1].offset
    assert [e.payload for e in fm.parse_pack(pack, kind, payload=False)] == [None, None]


def resum(body, kind="sha1"):
    return body + hashlib.new(kind, body).digest()


def test_damaged_packs():
    pack, _ = small_pack()
    body = pack[:-20]
    bad = {
        "magic": resum(b"KCAP" + body[4:]), "version": resum(body[:4] + struct.pack(">I", 3) + body[8:]), "short": pack[:30],
        "count": resum(body[:8] + struct.pack(">I", 3) + body[12:]), "trailer": body + b"\0" * 20, "trailing": resum(body + b"zz"),
        "type": resum(body[:12] + b"\x05" + body[13:]), "size": resum(body[:12] + bytes((body[12] ^ 1,)) + body[13:]),
        "base": fm.pack_bytes([fm.encode_entry(fm.BLOB, b"a"), fm.encode_entry(fm.OFFSET_DELTA, b"\1\1\1a", 3)]),
        "outside": fm.pack_bytes([fm.encode_entry(fm.OFFSET_DELTA, b"\1\1\1a", 500)]),
    }
    for name, data in bad.items():
        with pytest.raises(codecs.CodecError):
            list(fm.parse_pack(data))
            pytest.fail(name)


def test_index_with_large_offsets_and_damage():
    rows = [("%040x" % (k << 152), k, k if k % 2 else (1 << 33) + k) for k in range(200)]
    data = fm.pack_index_bytes(rows, "ab" * 20)
    assert fm.parse_pack_index(data) == (sorted(rows), "ab" * 20)
    for bad in (b"x" + data[1:], data[:-1] + b"\0", data[:100], resum(data[:8] + struct.pack(">I", 999) + data[12:-20])):
        with pytest.raises(fm.FormatError):
            fm.parse_pack_index(bad)


@settings(max_examples=30)
@given(st.lists(st.tuples(st.text(st.characters(exclude_characters="\0", exclude_categories=["Cs"]), min_size=1, max_size=20), st.integers(0, 3), st.booleans()), max_size=8, unique_by=lambda x: x[:2]))
def test_stage_index_round_trip(items):
    entries = [fm.StageEntry(name, "ab" * 20, stage, size=k, mtime_s=7, assume_valid=flag) for k, (name, stage, flag) in enumerate(items)]
    got, tags = fm.parse_stage_index(fm.stage_index_bytes(entries))
    assert got == sorted(entries, key=lambda e: (e.name.encode(), e.stage)) and tags == []


def test_stage_index_extensions_and_long_names():
    entry = fm.StageEntry("n" * 5000, "cd" * 20)
    body = fm.stage_index_bytes([entry])[:-20] + b"TREE" + struct.pack(">I", 3) + b"abc"
    assert fm.parse_stage_index(resum(body)) == ([entry], ["TREE"])
    with pytest.raises(fm.FormatError):
        fm.parse_stage_index(body + b"\0" * 20)


def test_loose_and_trees():
    assert fm.parse_loose(fm.loose_bytes("blob", b"abc")) == ("blob", b"abc")
    for bad in (b"nope", zlib.compress(b"blob 4\0abc"), zlib.compress(b"blob")):
        with pytest.raises(fm.FormatError):
            fm.parse_loose(bad)
    items = [("40000", "11" * 20, "a"), ("100644", "22" * 20, "a.txt"), ("100644", "33" * 20, "a0")]
    assert [n for *_, n in fm.parse_tree(fm.tree_bytes(items))] == ["a.txt", "a", "a0"]
    assert fm.parse_tree(b"100644 \xd6\xd0\0" + b"\1" * 20)[0][2] == "中"
    with pytest.raises(fm.FormatError):
        fm.parse_tree(b"100644 x\0abc")
