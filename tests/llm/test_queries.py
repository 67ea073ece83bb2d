"""Registered queries against their SQL and the pipeline against brute-force versions of its stages."""

import os

import duckdb
import pytest

import corpus_pipeline
from isohyet.llm.queries import QUERIES
from isohyet.llm.sql import SQL
from tests.llm.test_operators import brute_base, brute_hits, brute_sets

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, con, name):
    want = con.execute(SQL[name]).fetchdf()
    got = QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))


def test_pipeline_stages(spark, tmp_path):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs = read("documents")
    items = [(str(r["item_id"]), r["text"]) for r in read("benchmark").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        before, after = ({r["doc_id"]: r["text"] for r in x.select("doc_id", F_text(x)).collect()} for x in (docs, out))
        if name != "packing":
            assert out.columns == columns
        if name == "near_dedup":
            sets = dict(zip(before, brute_sets(before.values()), strict=True))
            kept = list(after)
            for i, a in enumerate(kept):
                for b in kept[:i]:
                    n = len(sets[a] & sets[b])
                    assert not n or 100 * n < corpus_pipeline.NEAR_PERCENT * len(sets[a] | sets[b])
        if name == "decontaminate":
            for i, t in before.items():
                n, hit, _ = brute_hits(t, items)
                assert (after.get(i) == t) == (not hit) and (i in after or hit > 0.5 * n)
        if name == "secrets":
            assert set(after) == set(before) and not any(brute_base(t) for t in after.values())
            assert all(after[i] == t for i, t in before.items() if not brute_base(t))
        docs = out
    assert set(docs.select("doc_id").distinct().toPandas()["doc_id"]) == set(before)


def F_text(df):
    from pyspark.sql import functions as F

    return F.col("text") if "text" in df.columns else F.lit(None).cast("string").alias("text")
