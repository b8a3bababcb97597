"""Registered queries against their SQL texts; LOGVARS_ALL_QUERIES=1 checks all of them."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import check_connection, difference

QUICK = [
    "recut_templates", "hole_positions", "align_params", "drift_templates", "variable_values", "variable_types", "same_value_groups",
    "contained_values", "containment_groups", "format_match", "format_cover", "induced_formats", "regex_template_adapter",
    "exact_clusters", "parameter_label_sheet", "marked_share", "annotator_agreement", "analysis_ready", "full_run",
]
NAMES = list(queries()) if os.environ.get("LOGVARS_ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con(sf):
    return check_connection(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    assert difference(spark, con, name, sf).startswith(("equal", "rows only"))


def test_entry(spark):
    assert entry(spark).count() > 0


def test_checks_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
