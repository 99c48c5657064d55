import pytest

from lodestone.plans import registry
from lodestone.sources import graph_store


@pytest.mark.parametrize("name", ["load_states", "prune_by_kind"])
def test_a_load_broadcasts_none_of_its_tables(spark, monkeypatch, name):
    """A file's size says little of what a table of ids takes on the driver; only ends found to be few are broadcast, here none."""
    monkeypatch.setattr(graph_store, "FEW", (-1, 0), raising=False)
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    found = {r[0]: r[1:] for r in map(tuple, registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect())}
    bus.waitUntilEmpty()
    plans = [e.physicalPlanDescription() for e in (store.executionsList().apply(i) for i in range(before, store.executionsCount()))]
    assert found and len(plans) > 20 and any("SortMergeJoin" in p for p in plans)
    writes = [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p or "HashAggregate" in p]
    assert [p for p in writes if "BroadcastHashJoin" in p.split("Initial Plan")[0]] == []
