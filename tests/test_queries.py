"""Every registered query against its SQL twin, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from compare import same  # noqa: E402
from riverbed.plans import registry  # noqa: E402

registry.load()
SF = "/root/testdata/sf0.001"
#: The smallest table has no text that states an amount; tests/test_rules.py has planted ones.
EMPTY = {"document_amounts"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.SQL:
        assert same(df, SF, registry.SQL[name]) is None
    else:
        assert df.count() > 0 or name in EMPTY


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["story", "heat", "participants", "editorial", "latest"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
