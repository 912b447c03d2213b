"""Paths and pages of facts against plain searches."""

import random
from itertools import groupby

import pytest

from palmleaf.operators import kg, paths

EDGE = "src_id long, relation string, dst_id long, period string, source_citation string, confidence double"


@pytest.mark.parametrize("n_edges", [40, 120])
def test_paths_of_many_pairs(spark, n_edges):
    rnd = random.Random(n_edges)
    edges = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(n_edges)]
    pairs = [(rnd.randrange(44), rnd.randrange(44)) for _ in range(150)] + [(3, 3), (None, 1), (1, None), (99, 1)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def least(a, b, most=5):
        front, seen = {a: (a,)}, {a}
        for _ in range(most + 1):
            if b in front:
                return front[b]
            new = {}
            for node, way in front.items():
                for d in near.get(node, ()):
                    if d not in seen:
                        new[d] = min(new.get(d, way + (d,)), way + (d,))
            seen |= set(new)
            front = new
        return None

    want = {(a, b): least(a, b) for a, b in pairs if a is not None and b is not None}
    e = spark.createDataFrame(edges, "src_id long, dst_id long")
    got = paths.shortest_paths(e, spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {(r.a, r.b): tuple(r.path) for r in got} == {k: v for k, v in want.items() if v} and len(got) == len({(r.a, r.b) for r in got})
    assert all(r.hops == len(r.path) - 1 for r in got)
    assert paths.shortest_paths(e, spark.createDataFrame([], "a long, b long")).count() == 0


def test_pages_of_facts(spark):
    rnd = random.Random(5)
    edges = [(rnd.choice([0, 1, 2]), rnd.choice("RQ"), rnd.randrange(8), rnd.choice([None, "", "p"]), "s", 1.0) for _ in range(400)] + [(0, "R", 9, "", "s", 1.0)] * 30
    nodes = spark.createDataFrame([(k, f"n{k % 5}") for k in range(10)], "node_id long, name string")
    facts = [(s, 0, r, f"n{d % 5}", p) for s, r, d, p, _, _ in edges] + [(d, 1, r, f"n{s % 5}", p) for s, r, d, p, _, _ in edges]
    key = lambda f: (f[0], f[1], f[2], f[3], f[4] is not None, f[4] or "")
    want = [(n, i + 1, ["out", "in"][d], r, o, p) for n, g in groupby(sorted(facts, key=key), key=lambda f: f[0]) for i, (_, d, r, o, p) in enumerate(g) if 20 <= i < 40]
    got = kg.node_facts(nodes, spark.createDataFrame(edges, EDGE), nodes.unionByName(nodes), 2)
    order = lambda rows: sorted(rows, key=lambda r: (r[0], r[1]))
    assert order(map(tuple, got.collect())) == order(want)
    assert kg.node_facts(nodes, spark.createDataFrame([], EDGE), nodes).count() == 0
