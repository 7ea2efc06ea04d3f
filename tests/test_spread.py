"""Work on narrow rows runs in several tasks, though the rows lie in one small file."""

import pytest
from conftest import DATA

from larkspur.plans import registry


@pytest.mark.parametrize("name", ["j1_legacy_state", "k4_alert_records", "n1_nested_location", "n6_nested_facets"])
def test_tasks(spark, name):
    assert registry.queries()[name](spark, DATA).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
