"""Every query of the engine against its SQL, on the smallest tables; those without SQL give rows."""

from __future__ import annotations

import pytest

from loculus.plans import catalog
from tests.conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(name, spark, duck):
    same_rows(catalog.QUERIES[name](spark, SMALL).toPandas(), duck.sql(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(name, spark):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
