"""Regions never bring cells to the driver: no join of a round is a broadcast."""

from orbweave.operators import lookalikes, raster


def test_rounds_do_not_broadcast(spark, monkeypatch):
    plans = []

    def seen(module):
        real = module.cut

        def cut(frame):
            plans.append(frame._jdf.queryExecution().executedPlan().toString())
            return real(frame)

        monkeypatch.setattr(module, "cut", cut)

    seen(raster), seen(lookalikes)
    cells = spark.createDataFrame([(r, c, float(r + c)) for r, c in [*((0, c) for c in range(4)), (2, 0), (3, 0)]], "row long, col long, s double")
    found = lookalikes.score_regions(cells, [], "s", cells["s"] >= 0)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sorted((r["n"], r["peak"]) for r in found.collect()) == [(2, 3.0), (4, 3.0)]
    assert sum("Join" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
