import random

from farmspark.llm.components import Forest, components


def brute(edges):
    forest = Forest()
    for a, b in edges:
        forest.link(a, b)
    return {x: forest.root(x) for e in edges for x in e if e[0] != e[1]}


def test_chains_stars_and_random_graphs(spark):
    rng = random.Random(2)
    chain = list(range(0, 400))
    rng.shuffle(chain)
    graphs = [
        [(a, b) for a, b in zip(chain, chain[1:])],
        [(5000, i) for i in range(1, 600)] + [(i, i + 1) for i in range(10_000, 10_030)],
        [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1800)],
        [(1, 1)], [(-5, 3), (3, -9), (1 << 62, -9)],
    ]
    for g in graphs:
        frame = spark.createDataFrame(g, "a long, b long").repartition(7)
        got = {r.node: r.component for r in components(frame).collect()}
        assert got == brute(g)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
