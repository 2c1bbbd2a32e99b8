"""A sample of the registered queries against DuckDB; checks.compare runs them all."""

import pytest

import __spark_entry__ as entry
from checks import compare

NAMES = ["ranked_findings", "repeated_sites", "map_selection", "trend_items", "program_labels", "lot_log", "dispersion_findings",
         "excluded_items", "formula_group_statistics", "inline_values", "stream_silent_lots", "stream_day_ingest", "findings_with_rules"]


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches(spark, sf, con, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert compare.difference(got, con.execute(entry.oracle_sql()[name]).df()) == ""


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert not entry.entry(spark).isEmpty()
