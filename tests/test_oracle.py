"""Every registered query next to its checking SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tools.compare import compare


def test_contract(spark):
    names = entry.queries()
    assert len(names) > 150 and set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    good, note = compare(spark, name, SMALL)
    assert good, note
