"""Pairs of tracks are counted where they meet: against plain sets, with scenes as bits and as arrays, and without a shuffle of pairs."""

import numpy as np
import pytest

from orbweave.operators import desk


def shown(seed: int, scenes: int) -> set:
    rng = np.random.default_rng(seed)
    return {(f"s{int(s):03d}", f"T{int(t)}") for s, t in zip(rng.integers(0, scenes, 160), rng.integers(0, 14, 160), strict=True)}


@pytest.mark.parametrize("words,scenes", [(16, 9), (16, 140), (0, 9)])
def test_pairs_are_those_of_plain_sets(spark, monkeypatch, words, scenes):
    monkeypatch.setattr(desk, "SCENE_WORDS", words)
    left, right = shown(1, scenes), shown(2, scenes)
    frame = lambda rows: spark.createDataFrame([*sorted(rows), (None, "T1")], "scene_id string, track_id string")
    both = lambda x, y: {s for s, t in left if t == x and (s, y) in right} | {s for s, t in left if t == y and (s, x) in right}
    want = sorted((x, y, s, len(both(x, y))) for s, x in left for r, y in right if r == s)
    assert sorted(tuple(r) for r in desk.pairs_seen_together(frame(left), frame(right)).collect()) == want
    of = lambda t: {s for s, x in left if x == t}
    names = sorted({t for _, t in left})
    want = sorted((x, y, min(of(x) & of(y)), len(of(x) & of(y))) for x in names for y in names if x < y and of(x) & of(y))
    assert sorted(tuple(r) for r in desk.pairs_seen_together(frame(left)).collect()) == want


def test_pairs_are_not_shuffled(spark):
    from orbweave.plans import registry

    for name in ("a14_pairs_seen_together", "j17_pairs_with_counts"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") and "Aggregate" not in plan[: plan.index("Join")] and "Repartition" not in plan[: plan.index("Join")], plan
