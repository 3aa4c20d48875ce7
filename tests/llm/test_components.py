"""Components by union on the driver and by contraction are the same."""

import numpy as np

from karst.llm import components


def found(edges, few, monkeypatch):
    monkeypatch.setattr(components, "DRIVER_EDGES", few)
    rows = [(r.node, r.component) for r in components.connected_components(edges, "a", "b").collect()]
    assert len(rows) == len(set(rows))
    return dict(rows)


def test_same_components_either_way(spark, monkeypatch):
    """A long chain, cliques, a star, random edges, loops, repeats, nulls, ids at both ends of the range."""
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in zip(rng.permutation(300), np.roll(rng.permutation(300), 1))][:120]
    edges += [(1000 + i, 1001 + i) for i in range(200)] + [(2000 + i, 2000 + j) for i in range(9) for j in range(9)]
    edges += [(3000, 3001 + i) for i in range(50)] + [(5, 5), (4000, 4000), (None, 7), (8, None), (-(1 << 63), (1 << 63) - 1)]
    table = spark.createDataFrame([*edges, *edges[:20]], "a long, b long").repartition(5)
    union = found(table, 200_000, monkeypatch)
    assert union == found(table, 0, monkeypatch)
    assert {union[1000 + i] for i in range(201)} == {1000} and 4000 not in union and 8 not in union
    assert found(table.where("a > 5000"), 200_000, monkeypatch) == {}


def test_few_edges_need_no_rounds(spark, monkeypatch):
    frame, rounds = type(spark.range(1)), []
    plain = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, **b: rounds.append(1) or plain(self, *a, **b))
    chain = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in components.connected_components(chain, "a", "b").collect()} == {0}
    assert len(rounds) == 1
