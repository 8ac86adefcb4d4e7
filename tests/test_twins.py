"""Every core query with a SQL twin gives the same rows as the twin."""

import pytest

from dossierflow.plans.catalogue import registries
from tests.conftest import DATA, needs_data, same_rows

TWINS = {k: (r.plans[k], s) for r in registries() for k, s in r.sql.items()}
ALONE = {k: f for r in registries() for k, f in r.plans.items() if k not in r.sql}


@needs_data
@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    plan, sql = TWINS[name]
    assert same_rows(plan(spark, str(DATA)), duck, sql)


@needs_data
@pytest.mark.parametrize("name", sorted(ALONE))
def test_runs(spark, name):
    df = ALONE[name](spark, str(DATA))
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()
