"""Language ID and quality: gradients, exact inference, held-out accuracy, edges."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrybed.llm import language_id as li
from quarrybed.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_network_gradients():
    net = li.Network(["a", "b", "c"], hidden=3, embed=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(60, 70, (6, 4)), np.array([0, 1, 2, 1])
    _, g = net.gradients(x, y)
    for k in net.p:
        for _ in range(5):
            at = tuple(int(r.integers(0, s)) for s in net.p[k].shape)
            at = (at[0], int(r.integers(60, 70))) if k == "emb" else at
            old = net.p[k][at]
            net.p[k][at] = old + 1e-3
            up = net.gradients(x, y)[0]
            net.p[k][at] = old - 1e-3
            down = net.gradients(x, y)[0]
            net.p[k][at] = old
            assert abs((up - down) / 2e-3 - g[k][at]) < 1e-4


def brute_probabilities(net, text, margin=li.MARGIN, segment=li.SEGMENT):
    """The network's equations read literally, position by position: probabilities of each byte."""
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, net.hidden
    soft = lambda x: x / (1 + abs(x))
    out = []
    for first in range(0, len(text), segment):
        lo, hi = max(0, first - margin), min(len(text), first + segment + margin)
        states = np.zeros((2, hi - lo, h))
        for d in (0, 1):
            w, b, state = p["w"][d], p["b"][d][:, 0], np.zeros(h)
            for k in range(hi - lo - 1, -1, -1) if d else range(hi - lo):
                x = p["emb"][:, text[lo + k]]
                z, r = ((1 + soft(w[g * h : (g + 1) * h] @ np.concatenate((state, x)) + b[g * h : (g + 1) * h])) / 2 for g in (0, 1))
                c = soft(w[2 * h :] @ np.concatenate((r * state, x)) + b[2 * h :])
                state = states[d, k] = z * state + (1 - z) * c
        for k in range(first - lo, min(first + segment, len(text)) - lo):
            e = np.exp(p["v"] @ np.concatenate((states[0, k], states[1, k])) + p["vb"][:, 0])
            out.append(e / e.sum())
    return np.array(out)


def test_pooling_covers_the_whole_text():
    net = li.Network(["a", "b", "c"])
    texts = [b"", b"abc", b"x" * 700, b"hello world " * 40, bytes(range(256)) * 3]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    got = net.pooled(data, off)
    for k, t in enumerate(texts):
        assert np.allclose(got[k], brute_probabilities(net, t).mean(axis=0) if t else 0, atol=1e-4)
    alone = net.pooled(data[3:703], np.array([0, 700]))
    assert np.allclose(alone[0], got[2], atol=1e-6)


def test_language_query_is_the_brute_force(spark):
    """Each row's label and score, against the network's equations over its whole text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.length("text")).limit(60).cache()
    long = spark.createDataFrame([(10**9, "le chat dort " * 400)], "doc_id long, text string")
    net = li.fit(spark.read.parquet(f"{SF}/documents.parquet"), rows=200)
    for r in li.identify(docs.select("doc_id", "text").unionByName(long), net).join(docs.select("doc_id", "text").unionByName(long), "doc_id").collect():
        if r["lang_pred"] == "und":
            assert not any(c.isalpha() for c in r["text"] or "") and r["score"] == 0
        else:
            mean = brute_probabilities(net, r["text"].encode()).mean(axis=0)
            assert abs(mean[net.labels.index(r["lang_pred"])] - r["score"]) < 1e-3 and mean.max() - r["score"] < 1e-3


def test_samples_are_whole_rows_within_bounds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts, names = li.training_texts(docs, "doc_id", "text", "lang", rows=50)
    whole = {r["text"].encode() for r in docs.collect() if r["text"]}
    assert len(texts) == len(names) == 50 and set(texts) <= whole
    assert sum(map(len, li.training_texts(docs, "doc_id", "text", "lang", n_bytes=20_000)[0])) <= 20_000
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    run, doc, x, n, y = q.training_lines(docs, labels, "doc_id", "text", lines=300)
    assert 0 < len(x) <= 300 and len(run) == len(doc) == len(n) == len(x) and len(y) == doc[-1] + 1
    many = docs.unionByName(docs).unionByName(docs)
    assert len(q.training_lines(many, labels, "doc_id", "text", lines=300)[1]) == len(x)


def test_language_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = li.fit(docs)
    out = li.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    kind = "doc_id long, text string, lang string, score int"
    odd = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 1), (3, "123 --- \n", None, 1), (4, "日本", "en", 1), (None, "the of and", None, 1), (4, "日本", "en", 1)], kind).withColumns({"id": F.lit(1), "t": F.lit("x"), "held_out": F.lit(9), "h": F.lit(2), "y": F.lit("z"), "n": F.lit(0)})
    got = {(r["doc_id"], r["lang_pred"] == "und", r["held_out"]) for r in li.identify(odd, net).collect()}
    assert {(d, u) for d, u, _ in got} == {(1, True), (2, True), (3, True), (4, False), (None, False)}
    assert {(d, h) for d, _, h in got} == {(d, d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d in (1, 2, 3, 4, None)}
    assert li.identify(odd.limit(0), net).count() == 0
    assert li.fit(odd.limit(0)) is None and {r["lang_pred"] for r in li.identify(odd, None).collect()} == {"und"}


def brute_marginals(e, a):
    n = len(e)
    weight = {y: np.exp(sum(e[k] * y[k] for k in range(n)) + sum(a[y[k], y[k + 1]] for k in range(n - 1))) for y in itertools.product((0, 1), repeat=n)}
    z = sum(weight.values())
    return [sum(w for y, w in weight.items() if y[k]) / z for k in range(n)]


def test_forward_backward_is_exact():
    r = np.random.default_rng(1)
    f = q.LineField(2)
    f.w, f.a = r.normal(size=2), r.normal(size=(2, 2))
    sizes = [3, 1, 6, 2]
    doc = np.repeat(np.arange(4), sizes)
    x = r.normal(size=(len(doc), 2))
    got = f.marginals(doc, x)
    for d in range(4):
        assert np.allclose(got[doc == d], brute_marginals(x[doc == d] @ f.w, f.a))


def test_hidden_labels_are_the_nearest_that_fit():
    """Expected labels against enumeration: shifted log-odds under which just the share asked for agrees."""
    r = np.random.default_rng(3)
    f = q.LineField(1)
    f.a = r.normal(size=(2, 2))
    run, doc = np.array([0, 0, 0, 1, 1, 2, 2]), np.array([0, 0, 0, 0, 0, 1, 1])
    e, weight, y = np.array([2.0, -1, 3, 1, -2, 9, 9]), np.array([3.0, 1, 2, 1, 1, 1, 1]), np.array([0, 1])
    got, pairs = f.expected_labels(run, doc, e, weight, y)
    assert np.allclose(got[5:], brute_marginals(e[5:], f.a))  # as it is
    bad = ((1 - got[:5]) * weight[:5]).sum() / weight[:5].sum()
    assert q.SPOKEN <= bad < q.SPOKEN + 0.01
    shifts = [s for s in np.linspace(0, 24, 4001) if np.allclose(np.concatenate((brute_marginals(e[:3] - s, f.a), brute_marginals(e[3:5] - s, f.a))), got[:5], atol=5e-3)]
    assert shifts and abs(pairs.sum() - 4) < 1e-9


def test_lines_and_features():
    texts = [b"", b"a\nb\n", b"\n\nx", b"one line", b"same line here and long enough\nsame line here and long enough"]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    doc, start, end = q.lines_of(data, off)
    got = [[data[s:e].tobytes() for d, s, e in zip(doc, start, end) if d == k] for k in range(len(texts))]
    assert got == [[b""], [b"a", b"b"], [b"", b"", b"x"], [b"one line"], texts[4].split(b"\n")]
    doc, n, x = q.line_features(data, off)
    assert x[-1, q.NAMES.index("seen")] == 1 and x[-2, q.NAMES.index("seen")] == 0


def test_quality_accuracy_and_edges(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    field = q.fit(docs, labels)
    out = q.score(docs, field).join(labels, "doc_id").where("held_out").collect()
    good = [r["predicted"] for r in out if r["quality"] == 1]
    bad = [r["predicted"] for r in out if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2
    kind = "doc_id long, text string, score int"
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "x\n" * 3000, 1), (3, "a" * 200_000, 1)], kind)
    got = {r["doc_id"]: r["score"] for r in q.score(odd, field).collect()}
    assert got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    empty = q.fit(docs.limit(0), labels)
    assert {r["score"] for r in q.score(odd, empty).collect()} == {0.5}
    assert q.score(odd.limit(0), field).count() == 0


def test_quality_query_is_the_brute_force(spark):
    """Each row's score is the length-weighted mean of its lines' marginals, found by enumeration."""
    r = np.random.default_rng(5)
    field = q.LineField(q.WIDTH)
    field.w, field.a = r.normal(size=q.WIDTH), r.normal(size=(2, 2))
    texts = {1: "", 2: "one line", 3: "a\n\nB | c\n123 123 123", 4: "x\n" * 6, 5: None, 6: "word " * 3000 + "\nend."}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for row in q.score(rows, field).collect():
        data = (texts[row["doc_id"]] or "").encode()
        doc, n, x = q.line_features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        p = brute_marginals(q.with_neighbours(doc, x) @ field.w, field.a)
        assert abs(row["score"] - np.average(p, weights=np.maximum(n, 1))) < 1e-6 and row["predicted"] == (row["score"] >= 0.3)


@pytest.mark.parametrize("n", [5])
def test_neighbours_stop_at_documents(n):
    x = np.arange(n * 2, dtype=np.float32).reshape(n, 2) + 1
    full = q.with_neighbours(np.array([0, 0, 1, 1, 1]), x)
    assert full[1, 4:6].tolist() == [0, 0] and full[2, 2:4].tolist() == [0, 0] and full[3, 2:4].tolist() == x[2].tolist()
