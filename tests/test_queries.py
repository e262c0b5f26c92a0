"""Every query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from tesseral.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def canonical(rows):
    return sorted(tuple("NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"select {listed} from ({registry.ORACLES[name]})").fetchall()
    assert canonical(tuple(r) for r in df.select(*columns).collect()) == canonical(want)


def test_entry_registers_every_query():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
