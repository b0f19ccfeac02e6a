"""The density of unusual places deals its pairs out by cell."""

from orbweave.operators import events
from orbweave.sources import fixtures as fx


def test_density_pairs_are_dealt_by_cell(spark, monkeypatch):
    plans, real = [], events.cut

    def cut(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return real(frame)

    monkeypatch.setattr(events, "cut", cut)
    events.unusual_locations(fx.observations(spark, "/root/testdata/sf0.001"), fx.scenes(spark, "/root/testdata/sf0.001"))
    joins = [line for p in plans for line in p.splitlines() if "Join" in line and "_cell#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
