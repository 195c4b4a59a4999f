"""Every core query against its SQL twin; the others must run and give a stable schema."""

import pytest

from tallyloom import queries as core
from tests.compare import connect, rows

Q, SQL = core.queries(), core.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(name, spark, data, duck):
    df = Q[name](spark, data)
    r = duck.execute(SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, df.collect()) == rows(cols, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(name, spark, data):
    df = Q[name](spark, data)
    assert df.columns and df.count() >= 0
