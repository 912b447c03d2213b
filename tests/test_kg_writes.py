"""Graph writes in one batch against the same rows taken one after another."""

import random

import pytest

from palmleaf.operators import kg, pointers

NODE = "node_id long, name string, label string, aliases array<string>"
EDGE = "src_id long, relation string, dst_id long, period string, source_citation string, confidence double"


def one_by_one(nodes, rows):
    """Nodes as lists [name, label, aliases], in order of ids; who held an alias first has it."""
    out, holder = [[n, la, list(a)] for _, n, la, a in nodes], {}
    for k, (_, _, _, a) in enumerate(nodes):
        for x in a:
            holder.setdefault(x, k)
    for name, label, aliases in rows:
        at = next((k for k, n in enumerate(out) if n[0] == name), holder.get(name))
        if at is None:
            out.append([name, label, []])
            at = len(out) - 1
        for x in aliases or []:
            if x not in out[at][2]:
                out[at][2].append(x)
            holder.setdefault(x, at)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_upsert_in_order(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(25)]
    nodes = [(k, names[k], "King", rnd.sample(names, 2)) for k in range(4)]
    rows = [(rnd.choice(names), rnd.choice(["Monk", "Place"]), rnd.choice([None, [], rnd.sample(names, 2), rnd.sample(names, 1)])) for _ in range(40)]
    got = kg.upsert_nodes(spark.createDataFrame(nodes, NODE), spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, name string, label string, aliases array<string>"))
    got = got.collect()
    want = one_by_one(nodes, rows)
    assert sorted((r.name, r.label, list(r.aliases)) for r in got) == sorted((n, la, a) for n, la, a in want)
    assert len({r.node_id for r in got}) == len(got) and {r.node_id: r.name for r in got if r.node_id < 4} == {k: names[k] for k in range(4)}


def test_upsert_without_order(spark):
    none = spark.createDataFrame([], NODE)
    batch = [("alt", "Monk", ["z"]), ("new", "King", ["alt"]), ("z", "Place", None), (None, "King", ["q"]), ("new", "King", ["y"])]
    got = kg.upsert_nodes(none, spark.createDataFrame(batch, "name string, label string, aliases array<string>")).collect()
    assert [(r.node_id, r.name, r.label, sorted(r.aliases)) for r in got] == [(0, "new", "King", ["alt", "y", "z"])]
    assert kg.upsert_nodes(none, spark.createDataFrame([], "name string, label string, aliases array<string>")).count() == 0


def test_merge_chains(spark):
    nodes = spark.createDataFrame([(k, f"n{k}", "King", [f"a{k}"]) for k in range(8)], NODE)
    edges = [(0, "R", 1, "p", "s", 1.0), (2, "R", 5, "p", "s", 1.0), (5, "Q", 0, "", "", 1.0), (3, "R", 5, "own", "", 1.0), (6, "R", 7, "", "", 1.0), (4, "R", 4, "", "", 1.0)]
    merges = [(0, 1), (1, 2), (2, 3), (6, 6), (7, 99), (98, 3), (0, 2)]
    left, e = kg.merge_nodes(nodes, spark.createDataFrame(edges, EDGE), spark.createDataFrame(merges, "from_id long, to_id long"))
    assert {r.node_id: sorted(r.aliases) for r in left.collect()} == {3: ["a0", "a1", "a2", "a3", "n0", "n1", "n2"], 4: ["a4"], 5: ["a5"], 6: ["a6"], 7: ["a7"]}
    assert sorted((r.src_id, r.relation, r.dst_id, r.period) for r in e.collect()) == [(3, "R", 5, "own"), (4, "R", 4, ""), (5, "Q", 3, ""), (6, "R", 7, "")]
    with pytest.raises(ValueError, match="circle"):
        kg.merge_nodes(nodes, spark.createDataFrame(edges, EDGE), spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "from_id long, to_id long"))


def test_long_chain(spark):
    links = spark.range(300).selectExpr("id as f", "id + 1 as t")
    assert [tuple(r) for r in pointers.chain_ends(links).select("t").distinct().collect()] == [(300,)]
    assert pointers.chain_ends(links.limit(0)).count() == 0


def test_edge_changes(spark):
    edges = spark.createDataFrame([(0, "R", 1, "old", "src", 1.0), (0, "Q", 1, "there", "src", 1.0), (1, "R", 2, "old", "src", 1.0)], EDGE)
    change = "seq int, src_id long, relation string, dst_id long, new_relation string, period string, source_citation string"
    got = kg.update_edges(edges, spark.createDataFrame([(1, 0, "R", 1, None, None, "new"), (1, 1, "R", 2, "B", "x", None), (2, 1, "R", 2, None, "y", None)], change))
    assert sorted((r.src_id, r.relation, r.period, r.source_citation) for r in got.collect()) == [(0, "Q", "there", "src"), (0, "R", "old", "new"), (1, "R", "y", "src")]
    got = kg.update_edges(edges, spark.createDataFrame([(1, 0, "R", 1, "Q", "x", "x")], change).drop("seq"))
    assert sorted((r.src_id, r.relation, r.period) for r in got.collect()) == [(0, "Q", "there"), (1, "R", "old")]
