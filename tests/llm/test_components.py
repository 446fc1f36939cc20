import random

from meridian.llm.components import connected_components


def test_random_graphs_and_a_path(spark):
    rnd = random.Random(5)
    links = [(rnd.randint(0, 200), rnd.randint(0, 200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, i) for i in range(5001, 5100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {x: find(x) for x in parent}
    assert len(found) == len(parent)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
