"""The pipeline's stages, each held against brute force on its own input; the registered queries."""

import os
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from test_near_copies import brute_kept
from test_suffix_dedup import brute

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    quality, exact, near, passages, packed = (f for _, f in corpus_pipeline.STAGES)
    one = quality(spark, docs, SF).cache()
    assert one.columns == columns and 0 < one.count() < docs.count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in one.collect()}
    assert sum(labels[k] for k in labels if k in kept) >= 0.95 * sum(labels.values())

    two = exact(spark, one, SF).cache()
    best = defaultdict(int)
    for r in one.collect():
        best[r["text"]] = max(best[r["text"]], r["doc_id"])
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == set(best.values())

    three = near(spark, two, SF).cache()
    assert three.columns == columns and {r["doc_id"] for r in three.collect()} == brute_kept([(r["doc_id"], r["text"]) for r in two.collect()], 14)

    four = passages(spark, three, SF).cache()
    rows = sorted((r["doc_id"], r["text"]) for r in three.collect())
    want = {k: (n, gone) for k, n, gone, *_ in brute(rows, 100)}
    got = {r["doc_id"]: r for r in four.collect()}
    assert four.columns == columns and set(got) == {k for k, (n, gone) in want.items() if n == 0 or gone < n}
    for k, text in rows:
        if k in got:
            n, gone = want[k]
            assert got[k]["n_chars"] == len(got[k]["text"])
            assert got[k]["text"] == text if gone == 0 else n - gone - 6 <= len(got[k]["text"].encode()) <= n - gone

    five = packed(spark, four, SF).collect()
    assert {r["doc_id"] for r in five} == set(got)


ODD = [(5, "AAA x"), (5, "BBB y"), (9, "BBB y"), (7, "CC"), (7, "CC"), (None, "null"), (None, "null"), (None, "other"), (None, None), (3, "")]


def test_stages_take_odd_tables(spark):
    """Rows that share an id, or have none, are kept or dropped as rows; clashing columns pass through."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, None, "s", len(t or "")) for k, t in ODD], kind)
    for name in ("id", "h", "sha", "t", "doc", "ta", "kept", "bucket", "near_node", "label", "score", "predicted", "carried", "row"):
        docs = docs.withColumn(name, F.lit("clash"))
    quality, exact, near, passages, packed = (f for _, f in corpus_pipeline.STAGES)
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    own = lambda data: sorted(data, key=repr)
    assert quality(spark, docs, SF).columns == docs.columns and set(rows(quality(spark, docs, SF))) <= set(ODD)
    once = rows(exact(spark, docs, SF))
    empty = [x for x in once if not x[1]]
    assert empty == [(3, "")] and own(x for x in once if x[1]) == own([(5, "AAA x"), (9, "BBB y"), (7, "CC"), (None, "null"), (None, "other")])
    assert exact(spark, docs, SF).columns == docs.columns
    left = rows(near(spark, docs, SF))
    assert near(spark, docs, SF).columns == docs.columns
    assert own(x for x in left if x[1]) == own([(5, "AAA x"), (5, "BBB y"), (7, "CC"), (None, "null"), (None, "other")]) and len(left) == 6
    assert rows(passages(spark, docs, SF)) == own(ODD) and passages(spark, docs, SF).columns == docs.columns
    tokens = packed(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in tokens if r["length"] == 1) == [(0, 1), (3, 1)] and len(tokens) == len(ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.queries() if n.startswith("op")))
def test_queries_and_their_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, SF)
    sql = __spark_entry__.oracle_sql().get(name)
    n = 0
    if sql:
        db = duckdb.connect()
        for t in ("documents", "pages", "conversations", "labels", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
        want = db.execute(sql).fetchall()
        order = [d[0] for d in db.description]
        assert sorted(order) == sorted(got.columns)
        rows = [tuple(r) for r in got.select(*order).collect()]
        assert sorted(rows, key=repr) == sorted(want, key=repr)
        n = len(rows)
    else:
        n = got.count()
    assert n >= (1 if "chat" in name else 50)
