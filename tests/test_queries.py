"""Every consolidation query that has SQL gives the rows of its SQL."""

import os

import duckdb
import pytest

from tagloom.plans import catalogue_of_queries as c

SF = "/root/testdata/sf0.001"


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    cells = [tuple("" if r[i] is None else f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(cells)


@pytest.mark.parametrize("name", sorted(c.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(c.ORACLE_SQL[name])
    want = _rows([d[0] for d in want.description], want.fetchall())
    got = c.QUERIES[name](spark, SF)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == want
