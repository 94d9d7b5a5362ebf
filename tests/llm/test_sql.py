"""The operators' SQL on DuckDB."""

import pytest

from retensa.llm.catalog import ORACLE, QUERIES
from tools.oracle_check import canon

from ..conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, SF_SMALL).toPandas(), duck.execute(ORACLE[name]).df()
    assert canon(got) == canon(expected)
