import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from granaria.llm import queries, sql  # noqa: E402
from oracle import same  # noqa: E402


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_equals_sql(spark, sf, name):
    same(spark, sf, queries.QUERIES[name], sql.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(sql.SQL)))
def test_query_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns
    df.count()
