"""Every core query against its SQL."""

import pytest
from rows import rows_of

from estatelens import queries as core

ORACLES = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, duck, sf_dir):
    got = rows_of(core.queries()[name](spark, sf_dir).toPandas())
    assert got == rows_of(duck.execute(ORACLES[name]).df())


def test_all_queries_but_one_have_sql():
    assert set(core.queries()) - set(ORACLES) == {"network_find_hybrid"}
