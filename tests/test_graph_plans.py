"""What graph operators do with many edges, read off their plans, and pages of facts both ways."""

import random

import pytest

from palmleaf.operators import kg
from palmleaf.plans import history
from palmleaf.shared import materialize

EDGE = "src_id long, relation string, dst_id long, period string, source_citation string, confidence double"
NODE = "node_id long, name string, label string, aliases array<string>"


@pytest.fixture(scope="module")
def graph(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(9), rnd.choice("RQ"), rnd.randrange(9), rnd.choice(["", "p"]), "s", 1.0) for _ in range(300)]
    nodes = [(k, f"n{k}", "King", [f"a{k}"]) for k in range(8)]
    return materialize(spark.createDataFrame(nodes, NODE), "test-nodes"), materialize(spark.createDataFrame(edges, EDGE), "test-edges"), edges


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_edges_are_dealt_before_they_are_sorted(spark, graph):
    nodes, edges, _ = graph
    text = plan(kg.merge_nodes(nodes, edges, spark.createDataFrame([(1, 2)], "from_id long, to_id long"))[1])
    assert text.index("partial_min_by") < text.index("Exchange hashpartitioning(src_id")  # the plan's top comes first


def test_upserts_look_into_edges(spark, graph):
    nodes, edges, rows = graph
    triples = [("n1", "R", "n2", "", ""), ("a1", "R", "n2", "", ""), ("n1", "NEW", "n2", "", ""), ("n1", "NEW", "n2", "", ""), ("n1", "R", "none", "", "")]
    after, status = kg.upsert_edges(edges, nodes, spark.createDataFrame(triples, "subject string, relation string, object string, period string, source string"))
    assert "LeftSemi" in plan(status)
    known = "duplicate" if any(r[:3] == (1, "R", 2) for r in rows) else "created"
    assert sorted(r.status for r in status.collect()) == sorted([known, known, "created", "created", "missing node"])
    assert after.count() == len(rows) + 1 + (known == "created")


def test_facts_of_entities_read_edges_once(spark, graph):
    nodes, edges, rows = graph
    out = kg.entity_facts(edges, nodes, spark.createDataFrame([("n1",), ("a1",), ("n3",), ("n3",), ("nobody",)], "name string"))
    assert plan(out).count("source_citation") == 0 and plan(out).count("palmleaf-test-edges") == 1
    want = [(e, f"n{s}", r, f"n{d}", p) for e, i in (("n1", 1), ("a1", 1), ("n3", 3), ("n3", 3)) for s, r, d, p, _, _ in rows if i in (s, d) and s < 8 and d < 8]
    assert sorted(map(tuple, out.collect())) == sorted(want)


@pytest.mark.parametrize("page", [1, 2, 4])
def test_pages_of_facts_both_ways(spark, graph, monkeypatch, page):
    nodes, edges, _ = graph
    cut = kg.node_facts(nodes, edges, nodes, page)
    assert "WindowGroupLimit" in plan(cut) and plan(cut).count("palmleaf-test-edges") == 1
    monkeypatch.setattr(kg, "LEADING_MOST", 0)
    ranged = kg.node_facts(nodes, edges, nodes, page)
    assert cut.schema.simpleString() == ranged.schema.simpleString()
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, ranged.collect()))


def test_facts_of_an_essay_are_dealt_once(spark):
    text = plan(history.format_facts(spark, "/root/testdata/sf0.001"))
    assert text.count("Exchange hashpartitioning(src_id") + text.count("Exchange hashpartitioning(essay_id") == 1


def test_names_come_by_hash_tables_at_any_size(spark, graph):
    nodes, edges, rows = graph
    out = kg.all_triples(edges, nodes)
    assert plan(out).count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan(out) and "BroadcastHashJoin" not in plan(out)
    assert sorted(map(tuple, out.select("subject", "relation", "object").collect())) == sorted((f"n{s}", r, f"n{d}") for s, r, d, *_ in rows if s < 8 and d < 8)
