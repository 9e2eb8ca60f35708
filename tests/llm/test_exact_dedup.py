import hashlib

from pyspark.sql import functions as F

from quarrybed.llm import exact_dedup as ed
from quarrybed.llm.common import hot_join

KIND = "doc_id long, text string, h int, sha string, t string, kept int"


def rows(spark, data):
    return spark.createDataFrame([(k, t, 1, "x", "y", 2) for k, t in data], KIND)


def brute(data):
    out = []
    for k, t in data:
        same = [x for x, u in data if (u or "") == (t or "")]
        top = max((x for x in same if x is not None), default=None)
        out.append((k, top, len(same), k == top, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_against_brute_force(spark):
    data = [(k, f"text {k % 17}" * (k % 5)) for k in range(300)] + [(None, "text 1"), (None, "alone"), (900, None), (901, ""), (5, "twice"), (5, "twice"), (7, "x" * 300_000)]
    got = ed.exact_dedup(rows(spark, data), capacity=8).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert order(got) == order(brute(data))


def test_one_hot_group_and_empty_table(spark):
    data = [(k, "same") for k in range(2000)]
    got = ed.exact_dedup(rows(spark, data)).where("kept").collect()
    assert [(r["doc_id"], r["group_size"]) for r in got] == [(1999, 2000)]
    assert ed.exact_dedup(rows(spark, [])).count() == 0


def test_colliding_keys_are_chained(spark):
    """With one key for all texts, the chain still tells them apart by their bytes."""
    data = [(k, f"text {k % 7}") for k in range(50)]
    out = ed.exact_dedup(rows(spark, data), capacity=2, max_depth=4, key=lambda t: F.lit(42).cast("long") + F.length(t) * 0)
    assert {r["link"] for r in out.collect()} == set(range(1, 8))
    assert order(out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == order(brute(data))


def test_texts_meet_in_the_index_alone(spark):
    plan = ed.build_index(rows(spark, [(1, "a")])).table._jdf.queryExecution().toString()
    assert "Aggregate" not in plan


def test_rows_stay_by_row_not_by_id(spark):
    data = [(5, "AAA x"), (5, "BBB y"), (9, "BBB y"), (7, "CC"), (7, "CC"), (None, "null"), (None, "null"), (None, None), (3, "")]
    got = ed.without_copies(rows(spark, data))
    assert got.columns == ["doc_id", "text", "h", "sha", "t", "kept"]
    assert order((r["doc_id"], r["text"]) for r in got.collect()) == order([(5, "AAA x"), (9, "BBB y"), (7, "CC"), (None, "null"), (3, "")])
    assert ed.without_copies(rows(spark, [])).count() == 0


def test_hot_rows_meet_without_a_shuffle_of_theirs(spark):
    """A key with a third of all rows, joined apart from the others, gives the same rows."""
    left = spark.range(12_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = left.groupBy(F.col("k").alias("k0")).agg(F.count(F.lit(1)).alias("n")).where("k0 % 5 != 1")
    for how in ("inner", "left"):
        got = hot_join(left, right, [("k", "k0")], "n", 12_000, how)
        want = left.join(right, left.k == right.k0, how)
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_directory_doubles_and_splits():
    cells = {k: 3 for k in range(16)} | {5: 40}
    d = ed.Directory(10, 10).load(cells, 4)
    assert d.depth == 4 and len(d.slots) == 16 and d.overfull
    covered = [s for _, first, n in d.ranges() for s in range(first, first + n)]
    assert covered == list(range(16))
    for prefix, depth in set(d.slots):
        n = sum(c for k, c in cells.items() if k >> (4 - depth) == prefix)
        assert n <= 10 or depth == 4
    assert ed.Directory(1000, 10).load(cells, 4).depth == 0
