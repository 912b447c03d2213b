"""Streams over the given tables, run to their end into the shared folder, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palmleaf.operators import features, scoring
from palmleaf.plans import essays, extraction
from palmleaf.shared import scratch_dir, table
from palmleaf.streaming import store, streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/palmleaf-{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf: str, name: str):
    """One of the given tables as a stream of its files."""
    return spark.readStream.schema(table(spark, sf, name).schema).option("recursiveFileLookup", "true").parquet(f"{sf}/{name}.parquet")


@query("""
select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, count(*) as n_runs, sum(cast(round(value * 100) as bigint))::bigint as cents
from events group by all
having date_trunc('hour', any_value(ts)) + interval 1 hour <= (select max(ts) from events) - interval 10 minute""")
def stream_run_stats(spark, sf):
    """Runs an hour and their summed scores; the last windows stay open until the watermark passes them."""
    path = _fresh(spark, "run-stats")
    runs = _stream(spark, sf, "events").select(F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("score"))
    out = streams.run_to_end(streams.run_stats(runs), f"{path}/out", f"{path}/log")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n_runs", "total").withColumnRenamed("total", "cents")


@query(extraction.ORACLE["batch_scores"])
def stream_scores(spark, sf):
    """batch_scores, with the documents as a stream."""
    path = _fresh(spark, "scores")
    vocabulary = features.academic_vocabulary(essays.paragraph_table(spark, sf))
    score = lambda e: scoring.batch_auto_score(e, vocabulary, essays.INFORMAL, essays.MARKERS, essays.SIGNALS, essays.NEWLINE)
    rows = _stream(spark, sf, "documents").select(F.col("doc_id").alias("essay_id"), "text")
    streams.score_stream(rows, score, f"{path}/out", f"{path}/log").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("essay_id", "reason", "D2", "D3", "D4")


@query("""
with t as (select c_name as subject, 'LOCATED_IN' as relation, n_name as object from customer join nation on c_nationkey = n_nationkey),
n as (select distinct subject as name from t union select object from t)
select 'edge' as kind, subject, relation, object from t union all select 'node', name, '', '' from n""")
def stream_graph(spark, sf):
    """Customers and their nations as a stream of triples into the bucketed store."""
    path = _fresh(spark, "graph")
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("object"))
    rows = _stream(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    none = F.lit("")
    rows = rows.select(F.col("c_name").alias("subject"), F.lit("LOCATED_IN").alias("relation"), "object", none.alias("period"), none.alias("source"), F.lit("PERSON_KING").alias("label"))
    graph = store.GraphStore(spark, f"{path}/graph", 8)
    streams.upsert_stream(rows, graph.save(), f"{path}/log").awaitTermination()
    nodes, edges = graph.read()
    names = nodes.select("node_id", "name")
    a, b = names.toDF("src_id", "subject"), names.toDF("dst_id", "object")
    triples = edges.join(a, "src_id").join(b, "dst_id").select(F.lit("edge").alias("kind"), "subject", "relation", "object")
    return triples.unionByName(names.select(F.lit("node").alias("kind"), F.col("name").alias("subject"), none.alias("relation"), none.alias("object")))
