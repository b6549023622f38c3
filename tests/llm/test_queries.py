import pytest

from scoreloom.llm import queries
from tests.compare import same

ORACLE = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, small, name):
    same(spark, small, queries.queries()[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(ORACLE)))
def test_runs(spark, small, name):
    assert queries.queries()[name](spark, small).count() > 0
