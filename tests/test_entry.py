import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import registry

SF = "/root/testdata/sf0.001"


def rows(table):
    def text(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return f"{x:.6f}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(text, r)) for r in table)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_match_their_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [[r[c] for c in columns] for r in df.select(*columns).collect()]
    if name in registry.ORACLES:
        rel = duck.sql(registry.ORACLES[name])
        at = [rel.columns.index(c) for c in columns]
        assert sorted(rel.columns) == columns
        assert rows([[float(v) if type(v).__name__ == "Decimal" else v for v in r] for r in got]) == rows([[r[k] for k in at] for r in rel.fetchall()])
    else:
        assert got and name in ("a05_spectrum", "a10_loudness", "v07_spectrum", "s08_template")  # these have tests of their own
