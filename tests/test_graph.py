import random

from brindle.operators.graph import connected_components


def brute(edges):
    root = {}
    for e in edges:
        for x in e:
            root.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            for x in (a, b):
                if root[x] != low:
                    root[x], changed = low, True
    return root


def test_random_graph_chain_and_hub(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7), (9999, 9999)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_staged_tables_are_discarded(spark):
    import os

    from brindle.operators import shared

    df = shared.stage(spark.range(5), "numbers")
    path = shared._staged[-1]
    assert df.count() == 5 and os.path.isdir(path)
    assert shared.discard(spark) >= 1 and not os.path.exists(path)
