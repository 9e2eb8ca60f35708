import random
import re

import numpy as np
import xxhash

from quarrybed.llm import simhash as sh
from quarrybed.llm.components import connected_components


def brute_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, radius):
    """points: (id, fingerprint) -> id -> smallest reachable id."""
    parent = list(range(len(points)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(points)):
        for b in range(a):
            if bin(points[a][1] ^ points[b][1]).count("1") <= radius:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(points):
        least[root(k)] = min(least.get(root(k), i), i)
    return {(i, least[root(k)]) for k, (i, _) in enumerate(points)}


def test_fingerprints():
    r = random.Random(1)
    texts = [" ".join(r.choice("Ab cde ÉF g") * 3 for _ in range(r.randrange(12))) for _ in range(60)] + ["", "\x0b\x0c", "a", "A\tb\nC", "x\x1cy z", "a b c d e"]
    assert [sh.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_manhattan_bounds_hamming_and_meets_in_a_cell():
    r = np.random.default_rng(2)
    a = r.integers(-(2**63), 2**63 - 1, 500)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 5), replace=False)) for _ in a], np.uint64).view(np.int64)
    b = a ^ flips
    low = sh._manhattan(sh._popcounts(a), sh._popcounts(b))
    assert (low <= np.bitwise_count(flips.view(np.uint64))).all()
    met = np.zeros(len(a), bool)
    for x, y in zip(sh.grid_cells(a, 4, 2), sh.grid_cells(b, 4, 2)):
        met |= x == y
    assert met.all()


def test_components_of_documents(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(300)]
        for _ in range(r.randrange(1, 9)):
            copy = base[:]
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(300)] = word()
            texts.append(" ".join(copy))
    texts += [None, "", " \n", texts[0], texts[0]]
    data = [(k * 3 + 1, t, 5, "x") for k, t in enumerate(texts)]
    r.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string, fp int, component string")
    got = sh.simhash_dedup(df)
    points = [(k, brute_fingerprint(t)) for k, t, *_ in data]
    assert {(x["doc_id"], x["fingerprint"]) for x in got.collect()} == {(k, f"{f:016x}") for k, f in points}
    assert {(x["doc_id"], x["component_id"]) for x in got.collect()} == brute_components(points, 4)


def test_large_cell_links_without_all_pairs(monkeypatch):
    r = np.random.default_rng(4)
    center = int(r.integers(0, 2**62))
    fps = np.unique(np.array([center ^ sum(1 << int(b) for b in r.choice(64, 2, replace=False)) for _ in range(400)], np.uint64)).view(np.int64)
    u, v = sh._cell_links(np.zeros(len(fps), np.int64), fps, 4)
    assert len(u) == len(fps) - 1  # a spanning tree
    parts = {int(f): int(f) for f in fps}

    def root(x):
        while parts[x] != x:
            x = parts[x]
        return x

    for a, b in zip(u.tolist(), v.tolist()):
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 4
        parts[root(a)] = root(b)
    assert len({root(int(f)) for f in fps}) == 1


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 502), (502, 501), (7, 7)]
    got = {(r["node"], r["component"]) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {n: c for n, c in got if n != c} == {k: 0 for k in range(1, 201)} | {501: 500, 502: 500}


def test_empty_and_null_ids(spark):
    kind = "doc_id long, text string"
    assert sh.simhash_dedup(spark.createDataFrame([], kind)).count() == 0
    got = sh.simhash_dedup(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "something else entirely now")], kind)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, 4), (4, 4), (None, None)}


def test_cells_grow_with_the_points(spark):
    assert [sh.spare_blocks(n, 4) for n in (0, 1 << 20, 1 << 25, 1 << 30, 1 << 33)] == [2, 2, 3, 4, 5]
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64))
    fps = sorted(set(np.concatenate((base, near)).view(np.int64).tolist()))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    within = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    for spare in (2, 3, 4):
        got = {tuple(sorted(r)) for r in sh.grid_join(df, 4, spare).collect()}
        assert got == within  # cells this small give all their pairs
