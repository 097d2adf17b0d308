"""Every query with SQL gives what DuckDB gives for it; the others run."""

import pytest

from cadenza.plans import registry
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    assert rows(registry.QUERIES[name](spark, sf_dir)) == rows(duck.sql(registry.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - {"wn26_pack_lines", "wn27_group_cues"}))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
