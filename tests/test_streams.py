"""Streams over small files."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palmleaf.operators import scoring
from palmleaf.streaming import store, streams

MARKERS, SIGNALS = {"contrast": ["but"], "addition": ["and"]}, (["first"], ["that"], ["end"])


def test_scores_equal_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = ["but this and that is the first of many lines in here\n\nand this is the end of it all, so to say", None, "", "short", "word " * 80]
    for i, text in enumerate(texts):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"essay_id": f"e{i}", "text": text}))
    vocabulary = spark.createDataFrame([("word",), ("lines",)], "token string")
    score = lambda e: scoring.batch_auto_score(e, vocabulary, ["so"], MARKERS, SIGNALS)
    rows = streams.read_essays(spark, str(tmp_path / "in"))
    streams.score_stream(rows, score, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()
    want = score(spark.read.schema("essay_id string, text string").json(str(tmp_path / "in"))).collect()
    order = lambda rows: sorted(rows, key=lambda r: r.essay_id)
    assert order(got) == order(want) and len(got) == 5 and {r.essay_id: r.reason for r in got}["e0"] is None


def test_graph_store(spark, tmp_path):
    columns = "subject string, relation string, object string, period string, source string, label string"
    triples = lambda *rows: spark.createDataFrame([(s, r, o, "", "s", "PERSON_KING") for s, r, o in rows], columns)
    graph = store.GraphStore(spark, str(tmp_path / "g"), 16)
    graph.merge(triples(*((f"n{i}", "R", f"n{i + 1}") for i in range(200))), 0)
    small = graph.merge(triples(("n3", "R", "n4"), ("n3", "Q", "new"), (None, "R", "x")), 1)
    assert len([w for w in small if w[1] == "nodes"]) == 1 and len([w for w in small if w[1] == "edges"]) == 1  # of 16 buckets each
    assert graph.merge(triples(("other", "R", "n4")), 1) == []  # a version that is there
    (tmp_path / "g" / "edges" / "b3-v2").mkdir(parents=True)  # left by a batch that was cut off
    (tmp_path / "g" / "edges" / "b3-v2" / "part-0.parquet").write_text("broken")
    graph.merge(triples(("new", "R", "n5"), ("n7", "R", "n7")), 2)
    nodes, edges = graph.read()
    assert nodes.count() == 202 and nodes.select("node_id").distinct().count() == 202 and nodes.select("name").distinct().count() == 202
    name = {r.node_id: r.name for r in nodes.collect()}
    got = {(name[e.src_id], e.relation, name[e.dst_id]) for e in edges.collect()}
    assert got == {(f"n{i}", "R", f"n{i + 1}") for i in range(200)} | {("n3", "Q", "new"), ("new", "R", "n5"), ("n7", "R", "n7")} and edges.count() == 203


def test_run_stats(spark, tmp_path):
    """A run that comes again, and one that comes behind the watermark, do not count."""
    start = datetime(2024, 1, 1)
    at = lambda minutes: start + timedelta(minutes=minutes)
    batches = [[(1, at(5), 2.0), (2, at(30), 4.0), (1, at(6), 2.0)], [(3, at(100), 1.0), (2, at(31), 4.0)], [(4, at(10), 9.0), (5, at(200), 1.0)], [(6, at(300), 1.0)]]
    kind = "run_id int, ts timestamp, score double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        runs = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        got = streams.run_to_end(streams.run_stats(runs), str(tmp_path / "out"), str(tmp_path / "log"))
    found = {r.start: (r.n_runs, r.mean) for r in got.select(F.date_format("start", "HH").alias("start"), "n_runs", "mean").collect()}
    assert found == {"00": (2, 3.0), "01": (1, 1.0), "03": (1, 1.0)}
