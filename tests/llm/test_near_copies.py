"""The pipeline's near copies against brute-force Jaccard similarity."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from quarrybed.llm import near_copies


def brute_shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows, radius=64):
    """rows: (id, text), ids distinct -> smallest ids of the groups linked by a similarity of 0.8 or more, of fingerprints within the radius."""
    sets, fps, group = [brute_shingles(t) for _, t in rows], [near_copies.fingerprint(t, 5) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * len(sets[a] | sets[b]) and bin(fps[a] ^ fps[b]).count("1") <= radius and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return {min(i for (i, _), g in zip(rows, group) if g == name) for name in set(group)}


def family(r, size, edits):
    """A text of 200 words and copies of it with up to so many words changed."""
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    out = [" ".join(base)]
    for _ in range(size - 1):
        copy = list(base)
        for k in r.sample(range(200), r.randrange(1, edits + 1)):
            copy[k] = f"x{r.randrange(5000)}"
        out.append(" ".join(copy))
    return out


def test_stage_keeps_what_brute_force_keeps(spark):
    r = random.Random(5)
    texts = [t for _ in range(25) for t in family(r, 4, 3)] + family(r, 40, 4) + ["", " ", "one two", "One  two"]
    r.shuffle(texts)
    rows = list(zip(r.sample(range(1000), len(texts)), texts))
    got = [x["doc_id"] for x in corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_kept(rows, 14)
    # by similarity alone one more row would go: its fingerprint is further than 14 bits from those of its group
    assert len(brute_kept(rows)) == 28 and len(set(got) - brute_kept(rows)) == 1


def test_close_fingerprints_alone_do_not_link(spark):
    r = random.Random(6)
    texts = [t for _ in range(30) for t in family(r, 3, 16)]
    rows = list(enumerate(texts))
    sets, fps = [brute_shingles(t) for t in texts], [near_copies.fingerprint(t, 5) for t in texts]
    false = [(a, b) for a in range(len(texts)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 14 and 5 * len(sets[a] & sets[b]) < 4 * len(sets[a] | sets[b])]
    assert false
    got = {x["doc_id"] for x in corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == brute_kept(rows, 14)


def test_cells_and_pairs_are_exact():
    r = np.random.default_rng(7)
    a = r.integers(-(2**63), 2**63 - 1, 300)
    b = a ^ np.array([sum(1 << int(k) for k in r.choice(64, r.integers(0, 15), replace=False)) for _ in a], np.uint64).view(np.int64)
    for spare in (2, 3):
        assert np.any([x == y for x, y in zip(near_copies.bit_cells(a, 14, spare), near_copies.bit_cells(b, 14, spare))], axis=0).all()


@pytest.mark.parametrize("n", [3, 300, 600])
def test_first_and_other_pairs_are_all_pairs(n):
    fp, node, size, marks = np.zeros(n, np.int64), np.arange(n), np.full(n, 9), np.zeros((n, near_copies.MARKS), np.int64)
    pairs = {(u, v) for label in (None, node) for us, vs in near_copies.cell_pairs(fp, node, size, label, marks, 14, False) for u, v in zip(us, vs) if u != v}
    assert len(pairs) == n * (n - 1) // 2


def test_repeated_and_null_ids(spark):
    same = " ".join(f"w{k}" for k in range(50))
    rows = [(None, same), (None, same), (3, same), (3, same), (2, same + " end"), (2, "other words"), (None, "new text"), (None, "new text")]
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(2, same + " end"), (2, "other words"), (None, "new text")], key=repr)


def test_sketches_differ_in_no_more_bits_than_sets():
    r = random.Random(8)
    for a, b in [(near_copies.shingles(x), near_copies.shingles(y)) for x, y in (family(r, 2, 20) for _ in range(50))] + [(set(), near_copies.shingles("a"))]:
        assert np.bitwise_count((near_copies.sketch(a) ^ near_copies.sketch(b)).view(np.uint64)).sum() <= len(a ^ b)


def test_the_nearest_by_sketch_come_before_all():
    r = np.random.default_rng(2)
    fp, node, size, marks = np.zeros(300, np.int64), np.arange(300), np.full(300, 500), np.zeros((300, near_copies.MARKS), np.int64)
    marks[:, 0] = [sum(1 << int(k) for k in r.choice(62, r.integers(0, 30), replace=False)) for _ in node]
    pairs = [(u, v) for us, vs in near_copies.cell_pairs(fp, node, size, node, marks, 14) for u, v in zip(us.tolist(), vs.tolist())]
    far = lambda u, v: bin(int(marks[u, 0]) ^ int(marks[v, 0])).count("1")
    assert sorted(v for _, v in pairs) == list(range(1, 300)) and all(far(u, v) == min(far(k, v) for k in range(v)) for u, v in pairs)


def test_candidates_come_from_the_popcount_embedding(monkeypatch):
    """Cells are the operator's, in bands of counts, and its Manhattan bound stands before the exact distance."""
    from quarrybed.llm import simhash

    r = np.random.default_rng(9)
    a, b = (r.integers(-(2**63), 2**63 - 1, 400) for _ in range(2))
    b[:200] = a[:200] ^ np.array([sum(1 << int(k) for k in r.choice(64, r.integers(0, 15), replace=False)) for _ in range(200)], np.uint64).view(np.int64)
    embedded = np.bitwise_count(simhash.ordered_bits(a) ^ simhash.ordered_bits(b))
    assert (embedded == simhash._manhattan(simhash._popcounts(a), simhash._popcounts(b))).all() and (embedded < np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))).any()
    size = r.integers(0, 3000, 400)
    other = np.array([r.integers(-(-4 * s // 5), 5 * s // 4 + 1) for s in size.tolist()])
    swapped = a ^ ((a ^ (a >> 1)) & 0x5555555555555555) * 3  # the bits of each segment change places: the embedding is the same
    for spare in (1, 2, 3):
        cells = near_copies.band_cells(a, size, 14, spare)
        for fps, sizes in ((b, other), (swapped, size)):
            own = fps is b and np.arange(400) < 200
            met = [set(x) & set(y) for x, y in zip(np.stack(cells, 1).tolist(), np.stack(near_copies.band_cells(fps, sizes, 14, spare), 1).tolist())]
            assert all(met[k] for k in range(400) if fps is swapped or own[k])
    used = []
    monkeypatch.setattr(near_copies, "ordered_bits", lambda x: used.append(len(x)) or simhash.ordered_bits(x))
    assert [(u.tolist(), v.tolist()) for u, v in near_copies.cell_pairs(np.array([5, 6]), np.array([1, 2]), np.array([9, 9]), None, None, 14)] == [([1], [2])] and used == [2]


def test_components_of_small_graphs_are_those_of_large_ones(spark):
    from quarrybed.llm.components import connected_components

    r = random.Random(10)
    edges = [(r.randrange(-500, 500), r.randrange(-500, 500)) for _ in range(400)] + [(k, k + 1) for k in r.sample(range(1000, 1300), 300)] + [(7, 7), (3000, 3000)]
    for part in (edges, edges[-2:], []):
        df = spark.createDataFrame(part, "u long, v long").repartition(5)
        one, many = (sorted(map(tuple, connected_components(df, small=n).collect())) for n in (1 << 19, 0))
        assert one == many and (not part or part is not edges or len(one) > 400)


def test_a_pair_is_one_cells():
    r = np.random.default_rng(11)
    a = r.integers(-(2**63), 2**63 - 1, 100)
    fps = np.stack((a, a ^ np.array([sum(1 << int(k) for k in r.choice(64, r.integers(0, 15), replace=False)) for _ in a], np.uint64).view(np.int64)))
    size = np.stack((s := r.integers(1, 3000, 100), s * 5 // 4))
    for spare in (1, 2):
        cells = [np.stack(near_copies.band_cells(fps[k], size[k], 14, spare)) for k in range(2)]
        for k in range(100):
            met = np.array(sorted(set(cells[0][:, k].tolist()) & set(cells[1][:, k].tolist())))
            tests = near_copies.first_met(met, np.full(len(met), fps[0, k]), np.full(len(met), size[0, k]), 14, spare)
            found = [len(u) for only in tests for u, _ in near_copies.cell_pairs(fps[:, k].copy(), np.arange(2), size[:, k].copy(), None, None, 14, only=only)]
            assert sum(found) == 1 and len(met) >= 1
