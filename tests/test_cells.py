"""Checks of cells read the orders once."""

import pytest

from folioflow.plans import registry


def _reads(spark, name):
    return registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_export_policy_reads_orders_once(spark):
    assert _reads(spark, "export_policy") == 1


@pytest.mark.parametrize("name", ["cell_contamination", "verified_cells", "cell_neighbours"])
def test_cells_read_orders_once(spark, name):
    assert _reads(spark, name) == 1
