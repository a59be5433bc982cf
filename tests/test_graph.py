"""Components of paths, hubs and scattered edges."""

import random

from vaultlens.operators import graph


def plain(edges):
    roots = {}

    def root(x):
        while roots.setdefault(x, x) != x:
            x = roots[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        roots[max(x, y)] = min(x, y)
    return {n: root(n) for n in list(roots) if root(n) != n}


def test_components(spark):
    rnd = random.Random(3)
    path = [(i, i + 1) for i in range(40)]
    hub = [(500, i) for i in range(501, 900)] + [(499, i) for i in range(860, 940)]
    loose = [(rnd.randrange(1_000, 1_400), rnd.randrange(1_000, 1_400)) for _ in range(180)]
    edges = path + hub + loose + [(7, 7), (5, 5)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == plain(edges)
    names = [(f"f{a:04d}", f"f{b:04d}") for a, b in hub + loose]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(names, "u string, v string")).collect()}
    assert got == plain(names)
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_stars_need_no_round(spark):
    edges = spark.createDataFrame([(i, 1) for i in range(2, 30)] + [(50, 40)], "u long, v long")
    assert graph._stars(edges) and not graph._stars(edges.union(spark.createDataFrame([(60, 50)], "u long, v long")))
