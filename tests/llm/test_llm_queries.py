"""The operators' queries against their SQL, on the smallest tables."""

from __future__ import annotations

import re

import pytest
from helpers import SMALL, same_rows

import __spark_entry__ as entry
from sylva.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(llm.QUERIES[name](spark, SMALL), duck, llm.ORACLE_SQL[name])


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in llm.QUERIES) == list(range(1, 11))
    assert set(llm.QUERIES) | {"pipeline"} <= set(entry.queries())
