"""The essay check from tags and graph to accuracy, and the fourth tier of tags."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from palmleaf.operators import claims

NODE = "node_id long, name string, label string, aliases array<string>"
EDGE = "src_id long, relation string, dst_id long, period string, source_citation string, confidence double"


def test_assess_essays(spark):
    nodes = spark.createDataFrame([(0, "Vijaya", "King", ["Vijay"]), (1, "Lanka", "Place", []), (2, "The Lion", "King", []), (3, "Kandy", "Place", []), (4, "Rama", "King", [])], NODE)
    edges = spark.createDataFrame([(0, "RULED", 1, "1", "", 1.0), (2, "BUILT", 3, "", "", 1.0), (0, "ALSO_KNOWN_AS", 2, "", "", 1.0)], EDGE)
    names = spark.createDataFrame([("Vijaya", "Vijaya"), ("Gemunu", "Gemunu"), ("Parakrama", "Parakrama"), ("Rama", "Rama")], "name string, canonical string")
    aliases = spark.createDataFrame([(1, "Gemunu", "Dutu")], "seq int, canonical string, alias string")
    static = spark.createDataFrame([("Dutu", "DEFEATED", "Elara", ""), ("Vijaya", "IGNORED", "x", "")], "subject string, relation string, object string, period string")
    texts = [
        ("a", "Once there was Gemunu. Then Vijaya came and Vijaya ruled. Vijaya built Kandy."),
        ("b", "Rama and Rama and Gemunu."),  # the most frequent has no facts
        ("c", "Of Parakramu only."),  # misspelt, and nothing is known
        ("d", "Nobody here."),
        ("e", None),
    ]
    essays = spark.createDataFrame(texts, "essay_id string, text string")
    tags = [("a", 2, "Vijaya", "PERSON_KING"), ("a", 1, "Vijaya", "LOCATION"), ("b", 0, "Gemunu", "PERSON_MONK"), ("b", 7, "Rama", "PERSON_KING")]
    tags = spark.createDataFrame(tags, "essay_id string, sent_no int, entity string, label string")
    claim = {"claim_text": "t", "claim_type": "FACTUAL", "verdict": "INCORRECT"}
    replies = [("a", 1, json.dumps({"claims": [claim]})), ("b", 1, None), ("d", 1, json.dumps({"claims": [claim]}))]
    replies = spark.createDataFrame(replies, "essay_id string, batch_no int, reply string")
    check = lambda **more: claims.assess_essays(essays, tags, names, nodes, edges, aliases, replies, static, "A-Za-z", (), **more)
    subjects, requests, _, accuracy = check()
    got = {r.essay_id: (r.subject, list(r.others)) for r in subjects.collect()}
    assert got == {"a": ("Vijaya", ["Vijaya", "Gemunu"]), "b": ("Gemunu", ["Gemunu", "Rama"]), "c": ("Parakrama", ["Parakrama"])}
    text = {r.essay_id: r.request for r in requests.collect()}
    assert all(f in text["a"] for f in ("Vijaya RULED Lanka (1)", "The Lion BUILT Kandy", "Vijaya ALSO_KNOWN_AS The Lion", "Dutu DEFEATED Elara")) and "IGNORED" not in text["a"]
    assert "(no facts)" in text["c"] and set(text) == {"a", "b", "c"}
    acc = {r.essay_id: (r.n_claims, r.n_incorrect, r.confidence) for r in accuracy.collect()}
    assert acc == {"a": (3, 1, "LOW"), "b": (1, 0, "INSUFFICIENT_KG"), "c": (1, 0, "INSUFFICIENT_KG"), "d": (0, 0, "INSUFFICIENT_KG"), "e": (0, 0, "INSUFFICIENT_KG")}
    # in one unit the tag's place is where its sentence stands, behind Gemunu
    assert {r.essay_id: list(r.others) for r in check(one_unit=True)[0].collect()}["a"] == ["Gemunu", "Vijaya"]


def test_tags_by_normal_form(spark):
    tags = spark.createDataFrame([("s", "Raja One", "PERSON_KING"), ("s", "Town", "LOCATION")], "sent_id string, entity string, label string")
    replies = spark.createDataFrame([("s", json.dumps([{"subject": "King Uno", "relation": "RULED", "object": "Town"}]))], "sent_id string, reply string")
    forms = spark.createDataFrame([("King Uno", "First"), ("Raja One", "First")], "surface string, canonical string")
    none = spark.createDataFrame([], "seq int, canonical string, alias string")
    got = claims.extract_relations(tags, replies, forms.where("canonical != ''"), none).collect()
    assert [(r.subject, r.object) for r in got] == [("First", "Town")]


@pytest.mark.parametrize("n_facts", [30, 80, 81, 300])
def test_facts_cut_an_entity_show_an_essay_the_same(spark, n_facts):
    rnd = random.Random(n_facts)
    relations = ["RULED", "BUILT", "LIKED", "ANSWERED", None]
    facts = [(e, f"s{rnd.randrange(9)}", rnd.choice(relations), f"o{rnd.randrange(40)}", rnd.choice([None, "", "1050"])) for e in ("x", "y", "z") for _ in range(n_facts if e != "z" else 10)]
    facts = spark.createDataFrame(facts, "entity string, subject string, relation string, object string, period string")
    entities = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "y"), (2, 1, "x"), (2, 2, "z"), (3, 0, "z"), (4, 0, "none")], "essay_id int, order int, entity string")
    seq = Window.partitionBy("essay_id").orderBy("order", "relation", "subject", "object")

    def shown(rows):
        pooled = claims.pool_facts(entities, rows).withColumn("seq", F.row_number().over(seq))
        return {r.essay_id: r.text for r in claims.format_facts(pooled).collect()}

    assert shown(facts) == shown(claims.leading_facts(facts))


@pytest.mark.parametrize("n_facts", [30, 80, 81, 300])
def test_lists_of_facts_show_an_essay_the_same(spark, n_facts):
    rnd = random.Random(n_facts)
    relations = ["RULED", "BUILT", "LIKED", "ANSWERED", None]
    facts = [(e, f"s{rnd.randrange(9)}", rnd.choice(relations), f"o{rnd.randrange(40)}", rnd.choice([None, "", "1050"])) for e in ("x", "y", "z") for _ in range(n_facts if e != "z" else 10)]
    facts = spark.createDataFrame(facts, "entity string, subject string, relation string, object string, period string")
    entities = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "y"), (2, 1, "x"), (2, 2, "z"), (3, 0, "z"), (4, 0, "none")], "essay_id int, order int, entity string")
    seq = Window.partitionBy("essay_id").orderBy("order", "relation", "subject", "object")
    pooled = claims.pool_facts(entities, facts).withColumn("seq", F.row_number().over(seq))
    texts = claims.essay_facts(entities, claims.fact_lists(facts))
    assert {r.essay_id: r.text for r in claims.format_facts(pooled).collect()} == {r.essay_id: r.text for r in texts.collect()}


def test_facts_of_essays_are_dealt_three_times_at_most(spark):
    """By entity, once for the lists and once for the essays that take them, then by essay."""
    facts = spark.range(100).selectExpr("concat('e', id % 7) as entity", "'s' as subject", "'R' as relation", "cast(id as string) as object", "'' as period")
    entities = spark.range(50).selectExpr("id as essay_id", "0 as order", "concat('e', id % 7) as entity")
    text = claims.essay_facts(entities, claims.fact_lists(facts))
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(entity") <= 2 and plan.count("Exchange hashpartitioning(essay_id") == 1 and plan.count("Exchange") <= 3, plan
