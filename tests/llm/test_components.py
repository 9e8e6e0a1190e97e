import random

from logtide.llm import skew
from logtide.llm.components import connected_components


def test_hubs_chains_and_loops(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 3)
    monkeypatch.setattr(skew, "SMALL", 0)
    rng = random.Random(4)
    edges = [(500, k) for k in range(501, 560)] + [(k, k + 1) for k in range(600, 620)] + [(7, 7), (3, 500), (3, 500)] + [tuple(rng.sample(range(700, 800), 2)) for _ in range(60)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if k != 7}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
