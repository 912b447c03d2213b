"""Structured Streaming forms of scoring, graph upserts and run statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(essays: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Essays (essay_id, text) of a stream scored as scoring.batch_auto_score scores a batch, whatever the size of its vocabulary.

    ``score`` makes the result of a micro-batch; it lies in its own folder ``batch=<id>`` under ``path``, so that one that comes again
    replaces itself. An essay's scores need no other essay, so batches give the rows that one batch of all would.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return essays.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_essays(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("essay_id string, text string").json(path)


def upsert_stream(triples: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Micro-batches of triples go to ``save(batch, batch_id)``, such as GraphStore.save(), which makes a repeated batch id do nothing."""
    return triples.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_stats(runs: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Runs, mean and total score a window (run_id, ts, score); repeated run_ids within the watermark and later rows are dropped."""
    once = runs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id"])
    return once.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("n_runs"), F.avg("score").alias("mean"), F.sum("score").alias("total")).select("w.start", "w.end", "n_runs", "mean", "total")


def run_to_end(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """A stream run over all that is there now, into Parquet under ``path``, and read back."""
    query = rows.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
