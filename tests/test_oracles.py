"""Every query that SQL can express gives the rows that DuckDB gives."""

import pytest

from sparkloom.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import DATA


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: round(float(x), 3) if isinstance(x, float) else str(x)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def test_oracles_belong_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, spark, duck):
    found = QUERIES[name](spark, DATA)
    expected = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(columns, expected.fetchall())
