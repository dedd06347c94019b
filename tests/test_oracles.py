"""Every registered query with SQL gives the SQL's rows on the small tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = {n: s for m in entry._plans() for n, s in m.ORACLES.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def cell(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v):.5f}"
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cur = duck.execute(CORE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()]
    assert plain(tuple(r) for r in df.select(columns).collect()) == plain(want)
