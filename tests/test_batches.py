"""Python workers hold bounded batches, whatever the size of a table's texts."""

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from quarrybed.functions import codecs
from quarrybed.operators import chains
from quarrybed.plans import queries
from quarrybed.sources import formats as fm
from quarrybed.sources import readers

KEY, LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", 6 << 20


@pytest.fixture
def unbounded(spark):
    before = spark.conf.get(KEY)
    spark.conf.unset(KEY)
    yield
    spark.conf.set(KEY, before)


@F.pandas_udf(T.LongType())
def batch_bytes(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sum(len(x) for x in [*a, *b])] * len(a))


@pytest.fixture(scope="module")
def long_texts(tmp_path_factory):
    """160 documents and turns of 200,000 characters or so."""
    folder = tmp_path_factory.mktemp("long")
    text = [f"{k} " + "line of text\n" * 15_000 + "x" * k for k in range(160)]
    pq.write_table(pa.table({"doc_id": pa.array(range(160), pa.int64()), "text": text, "lang": ["en"] * 160, "source": ["s"] * 160}), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"conv_id": pa.array([0] * 160, pa.int64()), "turn": pa.array(range(160), pa.int64()), "role": ["user"] * 160, "text": text}), f"{folder}/conversations.parquet")
    return str(folder)


def test_nearest_texts_come_in_batches_of_few_bytes(spark, long_texts, unbounded):
    near = queries._nearest_texts(spark, long_texts)
    assert near.select(batch_bytes("b", "t").alias("n")).agg(F.max("n")).first()[0] <= LIMIT


@pytest.mark.parametrize("query", ["zstd_roundtrip", "rabin_roundtrip", "delta_roundtrip"])
def test_round_trips_take_one_worker(spark, query):
    """A delta is made and applied in one pass."""
    df = __spark_entry__.queries()[query](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert df.where("same").count() == df.count() > 100


def test_rebuilds_udf_of_nulls_and_malformed_deltas(spark):
    df = spark.createDataFrame([(b"abc", b"abcd"), (None, b"a"), (b"a", None)], "b binary, t binary")
    got = lambda encode, apply: [r[0] for r in df.select(codecs.rebuilds_udf(encode, apply)("b", "t")).collect()]
    assert got(codecs.encode_lines, codecs.apply_delta) == [True, None, None]
    assert got(lambda b, t: b"\1", codecs.apply_delta) == [None, None, None]
    assert got(lambda b, t: codecs.encode_lines(b, t + b"!"), codecs.apply_delta) == [False, None, None]


def test_turns_come_in_batches_of_few_bytes(spark, long_texts, unbounded):
    pairs = queries._turn_pairs(spark, long_texts)
    assert pairs.select(batch_bytes("old", "new").alias("n")).agg(F.max("n")).first()[0] <= LIMIT // 4
    rows = {r["path"]: r["old"] for r in queries.line_ops_applied(spark, long_texts).collect()}
    assert len(rows) == 159 and rows["0/2"] == "1 " + "line of text\n" * 15_000 + "x"


def test_entries_and_bases_come_in_batches_of_few_bytes(spark, tmp_path, long_texts, unbounded):
    """A pack's objects leave their task so, and reach the worker that applies deltas so."""
    objects = queries.document_blobs(spark, long_texts).select("oid", "obj_type", "data")
    readers.register(spark)
    objects.repartition(1).write.format("packfile").mode("append").option("window", "1").save(f"{tmp_path}/packs")
    with open(next(tmp_path.glob("packs/*.pack")), "rb") as f:
        data = f.read()
    whole = fm.pack_bytes([fm.encode_entry(fm.BLOB, bytes(r["data"])) for r in objects.limit(60).collect()])
    assert max(b.column("payload").nbytes for b in readers.pack_batches("p", whole)) <= LIMIT
    assert sum(b.num_rows for b in readers.pack_batches("p", data)) == 160
    spark.conf.unset(KEY)
    made = chains.rebuild(spark.read.format("packfile").load(f"{tmp_path}/packs"))
    assert made.select(batch_bytes("data", "data").alias("n")).agg(F.max("n")).first()[0] <= 2 * LIMIT and made.where("is_delta").count() > 100


def test_sizes_leave_the_deltas_in_the_worker(spark):
    df = spark.createDataFrame([(b"a\nb\n" * 50, b"a\nb\n" * 50 + b"c"), (b"", b""), (None, b"a")], "b binary, t binary")
    for encode, udf in ((codecs.encode_lines, codecs.line_delta_udf), (codecs.encode_rabin, codecs.rabin_delta_udf), (codecs.dictionary_delta, codecs.dictionary_delta_udf)):
        rows = df.select(codecs.delta_size_udf(encode)("b", "t").alias("n"), F.octet_length(udf("b", "t")).alias("m")).collect()
        assert all(r["n"] == r["m"] for r in rows) and rows[2]["n"] is None
    got = __spark_entry__.queries()["delta_sizes"](spark, "/root/testdata/sf0.001")
    assert "octet_length(" not in got._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[0] and dict(got.dtypes)["rabin"] == "int"
