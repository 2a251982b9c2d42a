"""Every query with an oracle agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

from voxstrata.plans import catalog, oracles

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_query(spark, sf_dir, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(oracles.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    keys = sorted(ours.columns)
    a, b = (d[keys].sort_values(keys).reset_index(drop=True).astype(object) for d in (ours, theirs))
    assert len(a) == len(b) and (a == b).all().all()


@pytest.mark.parametrize("rows,thickness", [(range(1, 10), 10), (range(2, 9), 8), (range(4, 5), 2)])
def test_wall_thickness_beyond_radius_two(spark, tmp_path, rows, thickness):
    """One line item in each cell of a slab, as many rows thick."""
    found = [(z + 1, y / 100, x + 1.0) for z in range(7) for y in rows for x in range(50)]
    spark.createDataFrame(found, "l_linenumber int, l_discount double, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("wall_thickness", "wall_thickness_tiles"):
        assert con.execute(oracles.ORACLES[name]).fetchall() == [(thickness,)] == [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]


def test_entry(spark):
    import __spark_entry__ as entry

    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 60
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in oracles.ORACLES])
def test_query_without_oracle_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
