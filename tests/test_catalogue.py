"""Every named query runs; where it has SQL, DuckDB gives the same rows."""

import duckdb
import pytest

from quarrybed import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    got = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        rows = got.collect()
        assert rows
        assert all(r["same"] for r in rows) if "same" in got.columns else True
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(sql).fetchall()
    order = [d[0] for d in db.description]
    assert sorted(order) == sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*order).collect()), key=repr) == sorted(want, key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 256
