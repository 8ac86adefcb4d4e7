"""Every query of the text operators runs, and those with a SQL twin agree with it."""

import pytest

from dossierflow.llm.queries import llm_queries
from tests.conftest import DATA, needs_data, same_rows


@needs_data
@pytest.mark.parametrize("name", sorted(llm_queries.plans))
def test_query(spark, duck, name):
    df = llm_queries.plans[name](spark, str(DATA))
    if name in llm_queries.sql:
        assert same_rows(df, duck, llm_queries.sql[name])
    else:
        assert df.count() == df.distinct().count() > 0
