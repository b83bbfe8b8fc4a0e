"""Every query with SQL equals DuckDB on the smallest tables."""

import duckdb
import pytest

from agora_spark.plans import catalog, crawling, dating, linking, lookups, merging, projecting, running, serving, upkeep  # noqa: F401  they add their queries to the catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 5) if isinstance(v, float) or hasattr(v, "to_integral_value") else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalog.ORACLES:
        assert columns
        return
    cur = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in cur.fetchall()), key=str)
