"""The queries that SQL can express agree with DuckDB on the smallest tables; all ten return whole tables."""

import duckdb
import pytest

from voxstrata.llm import oracles, queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    ours, theirs = queries.queries()[name](spark, sf_dir).toPandas(), con.execute(oracles.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    keys = sorted(ours.columns)
    a, b = (d[keys].sort_values(keys).reset_index(drop=True).astype(object).fillna("null") for d in (ours, theirs))
    assert len(a) == len(b) and (a == b).all().all()


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in oracles.ORACLES and n not in ("op3_token_counts", "op12_packing")])
def test_one_row_per_document(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got.count() == docs.count() and got.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()
