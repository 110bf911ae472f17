import pytest

from veritrail.plans import catalog

from .compare import DATA, connection, rows

SMALL = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_are_those_of_sql(spark, name):
    """And there are some: an agreement of empty tables says nothing."""
    got = rows(catalog.QUERIES[name](spark, SMALL).toPandas())
    assert got[1] and got == rows(connection(SMALL).sql(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.SQL.keys()))
def test_others_give_rows(spark, name):
    assert not catalog.QUERIES[name](spark, SMALL).isEmpty()
