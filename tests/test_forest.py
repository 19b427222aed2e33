"""Spanning forests against components at every threshold."""

import random

from lotwise.operators import graph


def plain(nodes, edges, t):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b, w in edges:
            if w >= t:
                label[a] = label[b] = min(label[a], label[b])
    return label


def test_groups_at_any_threshold_are_cut_from_one_forest(spark):
    """With ties, lone nodes, a path and repeated weights."""
    rng = random.Random(5)
    nodes = list(range(40))
    edges = [(a, b, round(rng.random(), 1)) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.1]
    edges += [(a, a + 1, 0.5) for a in range(30, 36)]
    forest = graph.spanning_forest(spark.createDataFrame(edges, "a int, b int, w double"))
    rows = forest.collect()
    whole = plain(nodes, edges, 0.0)
    assert len(rows) == len(nodes) - len(set(whole.values())) and {tuple(r) for r in rows} <= set(edges)
    thresholds = [0.0, 0.3, 0.5, 0.95]
    got = graph.cut_forest(spark.createDataFrame([(n,) for n in nodes], "sensor_id int"), forest, thresholds).collect()
    assert len(got) == 4 * len(nodes)
    for t in thresholds:
        assert {r.sensor_id: r.cluster_id for r in got if r.threshold == t} == plain(nodes, edges, t)
    assert graph.spanning_forest(spark.createDataFrame([], "a int, b int, w double")).count() == 0
