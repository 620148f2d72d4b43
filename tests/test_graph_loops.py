"""Loops over graphs against plain Python: long chains, cycles, levels."""

import random

from graphweft.operators import topo
from graphweft.operators.traverse import ancestors


def test_ancestors_of_a_chain_of_a_thousand(spark):
    rows = [(i, i - 1) for i in range(1, 1001)]
    got = ancestors(spark.createDataFrame(rows, "id int, parent int")).where("id = 1000").collect()
    assert {(r["ancestor"], r["distance"]) for r in got} == {(i, 1000 - i) for i in range(1000)}


def test_cyclic_nodes_and_levels(spark):
    rng = random.Random(3)
    for n, m in ((30, 30), (40, 60), (12, 40)):
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
        reach = {i: {b for a, b in edges if a == i} for i in range(n)}
        while True:
            more = {i: reach[i].union(*(reach[j] for j in reach[i])) for i in reach}
            if more == reach:
                break
            reach = more
        frame = spark.createDataFrame(edges, "src int, dst int")
        assert {r["id"] for r in topo.cyclic_nodes(frame).collect()} == {i for i in reach if i in reach[i]}
        level = {}
        while True:
            now = {i: 1 + max([level[b] for a, b in edges if a == i], default=-1) for i in range(n) if i not in level and all(b in level for a, b in edges if a == i)}
            if not now:
                break
            level.update(now)
        got = topo.levels(spark.range(n).selectExpr("cast(id as int) id"), frame)
        assert {r["id"]: r["level"] for r in got.collect()} == level


def components(edges):
    """Strong components with a cycle, by a plain search each way."""
    ahead, behind = {}, {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
        behind.setdefault(b, set()).add(a)

    def reach(start, to):
        seen, todo = set(), list(to.get(start, ()))
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += to.get(x, ())
        return seen

    found = set()
    for n in {x for e in edges for x in e}:
        both = reach(n, ahead) & reach(n, behind)
        if n in both:
            found.add(frozenset(both))
    return found


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r["comp"], set()).add(r["id"])
    assert sum(map(len, out.values())) == len({r["id"] for r in rows}) == len(rows)
    return {frozenset(v) for v in out.values()}


def test_strong_components(spark):
    rng = random.Random(8)
    shapes = [
        sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(70)}),
        [(i, i + 1) for i in range(40)] + [(40, 20)] + [(20, 50), (50, 50), (60, 61), (61, 60)],  # a chain into a ring, a loop, a pair
        [(i, i // 2) for i in range(1, 64)] + [(100 + i, 100 + (i + 1) % 20) for i in range(20)] + [(105, 200), (200, 201), (201, 110), (7, 100)],
        [(i, i + 1) for i in range(30)] + [(i + 1, i) for i in range(10, 14)] + [(30, 31), (31, 32), (32, 30)],
        [(i, 3 * i + k) for i in range(20) for k in (1, 2, 3)] + [(40, 1)],
    ]
    for edges in shapes:
        assert grouped(topo.strong_components(spark.createDataFrame(edges, "src int, dst int")).collect()) == components(edges)


def test_long_rings_and_chains_take_few_rounds(spark):
    n = 2_000
    order = list(range(n))
    random.Random(1).shuffle(order)
    ring = [(order[i], order[(i + 1) % n]) for i in range(n)]
    chain = [(n + order[i], n + order[i + 1]) for i in range(n - 1)]
    got = topo.strong_components(spark.createDataFrame(ring + chain, "src int, dst int").repartition(8)).collect()
    assert {r["id"] for r in got} == set(range(n)) and len({r["comp"] for r in got}) == 1
    rail = [(i, i + 2) for i in range(400)] + [(i, i + 1) for i in range(0, 400, 2)] + [(400, 0), (401, 1)]  # a ladder closed to two rings
    got = topo.strong_components(spark.createDataFrame(rail, "src int, dst int")).collect()
    assert {r["id"] for r in got} == set(range(402)) and len({r["comp"] for r in got}) == 2
