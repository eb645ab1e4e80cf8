"""Every registered query of the engine against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from brindle.plans.catalogue import QUERIES
from brindle.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    assert got == sorted(duck.sql(f"select {','.join(columns)} from ({ORACLES[name]})").fetchall(), key=key)


@pytest.mark.parametrize("name", ["vec_batch_topk", "recall_at_k"])
def test_batches_take_every_hundredth_row(spark, name):
    sf = "/root/testdata/sf0.1"
    want = {str(r[0]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 100 = 0").select("vec_id").collect()}
    assert {r["query"] for r in QUERIES[name](spark, sf).select("query").distinct().collect()} == want and len(want) == 20


def test_half_is_indexed(spark):
    from brindle.plans import catalogue

    for sf, most in ((SF, 200), ("/root/testdata/sf0.1", 10000)):
        rows = catalogue.documents(spark, sf)
        half = catalogue._half(spark, sf, "documents", "doc_id")
        assert 0.4 * most <= rows.where(f"doc_id < {half}").count() <= 0.6 * most == 0.6 * rows.count()
