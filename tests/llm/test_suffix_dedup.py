import hashlib
import random

import numpy as np
import pytest

from quarrybed.llm import suffix_dedup as sd


def brute(rows, length):
    """rows: (id, text) in order of id; the contract read literally."""
    seen, out = set(), []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            w = data[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((key, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60, alphabet="abcdé "):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    passages = [word(r.randrange(30, 260)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(0, 5)):
            p = r.choice(passages)
            a = r.randrange(0, 40)
            parts += [word(r.randrange(0, 90)), p[a : len(p) - r.randrange(0, 40)]]
        texts.append("".join(parts))
    texts += ["a" * 500, "ab" * 300, "a" * 333, "", None, texts[0], texts[1] + "x", "é" * 90, "xyz" * 120 + texts[2]]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,hot", [(1, 20_000), (2, 20_000), (3, 4)])
def test_against_brute_force(spark, seed, hot, monkeypatch):
    rows = corpus(seed)
    if hot == 4:  # every gram met often is dealt out by window; buckets, flushes and collapses are many
        for name, value in (("FLUSH", 200), ("BUCKET", 50), ("SORT_HELD", 2000)):
            monkeypatch.setattr(sd, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, sd.suffix_dedup(df, hot=hot).collect()))
    assert got == brute(rows, 100)


def weak(data):
    return np.zeros(len(data) + 1, np.uint64)


def laid_out(rows):
    data = np.frombuffer(b"".join(t for _, t in rows), np.uint8)
    off = np.cumsum([0] + [len(t) for _, t in rows])
    zero = np.zeros(len(rows), np.int64)
    return data, off, (np.arange(len(rows)), zero, zero)


def removed(spans):
    gone = set()
    for d, a, z in zip(spans["doc"].tolist(), spans["start"].tolist(), spans["end"].tolist()):
        gone |= {(d, k) for k in range(a, z)}
    return gone


def test_collisions_are_verified():
    """With a hash under which all strings are equal, the answer is the same."""
    data, off, docs = laid_out([(k, (t or "").encode()) for k, t in corpus(4, 25)])
    units, ctx, begin = sd.contexts(data, off, docs)
    first, others = sd.collapse(units, ctx, begin, data)
    u = units[first][np.argsort(units["key"][first], kind="stable")]
    start = off[u["doc"]] + u["pos"]
    text = [data[p : p + w + 99].tobytes() for p, w in zip(start, u["nw"])]
    buf, cut = np.frombuffer(b"".join(text), np.uint8), np.cumsum([0] + [len(t) for t in text])
    good = sd.repeated_windows(u, buf, cut)
    assert good.any()
    assert (sd.repeated_windows(u, buf, cut, hashes=weak) == good).all()


@pytest.mark.parametrize("equal", [False, True])
def test_equal_hashes_never_remove_unlike_bytes(equal, monkeypatch):
    """Contexts that meet under one key and one hash are told apart by their bytes: in a map task and in the sort."""
    rows = [(k, (t or "").encode()) for k, t in corpus(6, 30)]
    data, off, docs = laid_out(rows)
    units, ctx, begin = sd.contexts(data, off, docs)
    if equal:
        ctx = np.zeros_like(ctx)
        monkeypatch.setattr(sd, "range_hashes", lambda h, a, b: np.zeros(len(a), np.uint64))
        monkeypatch.setattr(sd, "SORT_HELD", 3000)
    first, others = sd.collapse(units, ctx, begin, data)
    assert len(first) + len(others) == len(units)
    meeting, gone = sd.Meeting(), removed(sd.spans_of(units[others]))
    for part in np.array_split(np.sort(first), 7):
        text = b"".join(data[b : b + n + 99].tobytes() for b, n in zip(begin[part], units["nw"][part]))
        for spans in meeting.add(units[part], text):
            gone |= removed(spans)
    for spans in meeting.finish():
        gone |= removed(spans)
    want = {k: n for k, _, n, *_ in brute([(k, t.decode()) for k, t in rows], 100)}
    assert {k: sum(1 for d, _ in gone if d == k) for k in want} == want


def test_suffix_sort_orders_suffixes():
    r = random.Random(5)
    words = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 12))) for _ in range(300)]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    group = np.sort(np.array([r.randrange(5) for _ in words]))
    order = sd.Suffixes(data, start, end).sort(group)
    assert [(group[k], words[k]) for k in order] == sorted((g, w) for g, w in zip(group, words))


def test_edges(spark):
    kind = "doc_id long, text string, doc string, ta int, spans int, carried int, t int"
    assert sd.suffix_dedup(spark.createDataFrame([], kind)).count() == 0
    text = "".join(random.Random(9).choices("abcdefghijkl ", k=150))
    long = "".join(random.Random(8).choices("abcdefghijkl ", k=300_000))
    more = (1, 1, 1, 1)
    rows = [(5, text, "x", *more), (5, text, "x", *more), (None, None, None, None, None, None, None), (7, text, "", *more), (8, "", "", *more), (9, long, "", *more), (10, long + "x" * 200, "", *more)]
    got = {(r[0], r[1], r[2]) for r in sd.suffix_dedup(spark.createDataFrame(rows, kind)).collect()}
    again = brute([(9, long[-300:]), (10, long[-300:] + "x" * 200)], 100)[1][2] + 300_000 - 300
    assert got == {(5, 150, 0), (None, 0, 0), (7, 150, 150), (8, 0, 0), (9, 300_000, 0), (10, 300_200, again)}


def test_rows_without_distinct_ids_are_documents_of_their_own(spark):
    r = random.Random(3)
    word = lambda k: "".join(r.choices("abcdefghij", k=k))
    rows = [(None, word(150)) for _ in range(200)] + [(3, word(150)), (3, word(150))]
    got = sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 202 and {x["n_removed"] for x in got} == {0}
    shared = word(200)
    two = [(1, shared + word(50)), (1, word(50) + shared)]
    got = sd.suffix_dedup(spark.createDataFrame(two, "doc_id long, text string")).collect()
    assert sorted(x["n_removed"] for x in got) == [0, 200]


def test_blobs_round_trip():
    a = np.zeros(1000, sd.UNIT)
    r = np.random.default_rng(1)
    for n in a.dtype.names:
        a[n] = r.integers(0, 1000, 1000)
    assert (sd.from_blob(sd.to_blob(a), sd.UNIT) == a).all()
    assert len(sd.from_blob(sd.to_blob(a[:0]), sd.UNIT)) == 0


def test_hot_grams_count_different_contexts(spark):
    """A gram among ever new contexts is hot, however thinly they are spread; one that recurs with the same context is not."""
    r = random.Random(5)
    word = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    common, copied = word(100), word(150)
    rows = [(k, word(60) + common + word(60)) for k in range(120)] + [(1000 + k, copied) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(60)
    hot = sd.is_hot(sd.hot_grams(sd._keyed(df, "doc_id", "text", False), 100, 32, 80))

    def keys(text):
        zero = np.zeros(1, np.int64)
        return set(sd.contexts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), (zero, zero, zero))[0]["key"].tolist())

    found = lambda ks: {k for k in ks if hot(np.array([k], np.uint64))[0]}
    assert not found(keys(copied))
    alike = [keys(t) for k, t in rows[:120]]
    shared = {g for ks in alike for g in ks if sum(g in other for other in alike) >= 90}
    assert shared and shared <= found(set().union(*alike))
