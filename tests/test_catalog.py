"""Every registered query of the engine runs, and equals its SQL where it has one."""

import pytest
from compare import canonical, with_sql

from tessera.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, name):
    found = catalog.QUERIES[name](spark, data).toPandas()
    if name in catalog.ORACLES:
        assert canonical(found) == canonical(with_sql(catalog.ORACLES[name], data))
    else:
        assert len(found)
