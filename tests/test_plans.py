"""How queries over shredded documents run: nothing of a table's size is broadcast, and each document is parsed once."""

import pytest

from thicket.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["c14n_rows", "c14n_exclusive", "dtd_content_model", "xp_namespace_axis", "pretty_parts", "strip_space", "xp_id", "xml_roundtrip", "reader_events"])
def test_nodes_are_not_broadcast(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == (1 if name == "dtd_content_model" else 0)  # its four models
    assert "MapInArrow" not in plan
