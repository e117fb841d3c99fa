"""Every registered query of the trees against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from helpers import SMALL, same_rows

import __spark_entry__ as entry
from sylva.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(plans.QUERIES[name](spark, SMALL), duck, plans.ORACLE_SQL[name].replace("sf0.01/*", "sf0.001/*"))


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.QUERIES) <= set(entry.queries())


def test_scan_query_has_the_files_of_the_folder(spark):
    import os

    assert {r.path for r in plans.QUERIES["fs_scan"](spark, SMALL).collect()} == set(os.listdir(SMALL))
