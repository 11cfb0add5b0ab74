"""Every registered query with oracle SQL against DuckDB."""

import pytest

import __spark_entry__ as entry
import oracle
from seatwise import fixtures as fx

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.fixture(scope="module", autouse=True)
def shared_seats(spark, sf_dir):
    """Build the derived seat table once for all queries of this module."""
    build, table = fx.seats, fx.seats(spark, sf_dir)
    fx.seats = lambda spark, sf_dir: table
    yield
    fx.seats = build


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert con.execute(f"SELECT count(*) FROM ({SQL[name].rstrip().rstrip(';')})").fetchone()[0] > 0
        assert oracle.compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0
