import random

from conftest import rows

from skein.operators import graph


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src int, dst int")


def nodes(spark, n):
    return spark.range(n).selectExpr("cast(id as int) as node")


def closure(pairs, n):
    reach = {i: {i} for i in range(n)}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            for i in range(n):
                if a in reach[i] and b not in reach[i]:
                    reach[i].add(b)
                    changed = True
    return reach


def test_components_and_reach(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(16)]
    reach = closure(pairs, 12)
    want = sorted((i, min(j for j in range(12) if j in reach[i] and i in reach[j])) for i in range(12))
    assert sorted(rows(graph.components(frame(spark, pairs), nodes(spark, 12)))) == want
    got = rows(graph.reachable(frame(spark, pairs), nodes(spark, 1)))
    assert {r[1] for r in got} == reach[0]


def test_metrics_heights_paths(spark):
    e = frame(spark, [(0, 1), (0, 2), (1, 2), (2, 3), (1, 2), (4, 5), (5, 4)])
    m = {r["node"]: r for r in graph.degree_metrics(nodes(spark, 7), e).collect()}
    assert (m[2]["fan_in"], m[2]["fan_out"], m[2]["instability"]) == (2, 1, 0.33) and m[6]["instability"] == 0.0
    assert sorted(rows(graph.levels(e, nodes(spark, 7))))[:4] == [(0, 3), (1, 2), (2, 1), (3, 0)]
    assert (4, None) in rows(graph.levels(e, nodes(spark, 7)))
    p = graph.simple_paths(e, nodes(spark, 1), nodes(spark, 4).where("node = 3"))
    assert sorted(r[0] for r in rows(p)) == [[0, 1, 2, 3], [0, 2, 3]]
    refs = {r["symbol"]: (r["calls"], r["called_by"]) for r in graph.references(e).collect()}
    assert refs[2] == ([3], [0, 1])
