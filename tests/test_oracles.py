"""Every core query with SQL gives the rows its SQL gives; the others run and have a schema."""

import pytest

from granaria.plans import catalog
from oracle import same

Q, S = catalog.queries(), catalog.sql()


@pytest.mark.parametrize("name", sorted(S))
def test_query_equals_sql(spark, sf, name):
    same(spark, sf, Q[name], S[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(S)))
def test_query_runs(spark, sf, name):
    df = Q[name](spark, sf)
    assert df.columns
    df.count()
