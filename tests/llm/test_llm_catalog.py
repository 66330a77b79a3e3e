"""Every training-data query against its SQL on the smallest tables."""

from __future__ import annotations

import oracle
import pytest
from conftest import SMALL
from kinvote.llm.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert oracle.compare(spark, con, QUERIES[name], SQL[name], SMALL) == ""
    else:
        assert QUERIES[name](spark, SMALL).count() > 0
