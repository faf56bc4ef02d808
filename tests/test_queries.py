"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from docweir.plans.queries import ORACLES, QUERIES, flagship

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return None if v is None or v != v else round(v, 9) if isinstance(v, float) else v


def rows(values):
    return sorted((tuple(map(plain, r)) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    assert got
    if name in ORACLES:
        want = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
        assert got == rows(want)


def test_flagship(spark):
    assert sum(r.n for r in flagship(spark, SF_DIR).collect()) == sum(spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in ("documents", "pages"))


def test_entry_registers_all():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
