"""Run history as append-only Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.functions import text as T
from palmleaf.operators import scoring


def append(runs: DataFrame, path: str) -> None:
    """Runs (with run_id and ts) after those in the table."""
    runs.withColumn("run_date", F.to_date("ts")).write.mode("append").partitionBy("run_date").parquet(path)


def extraction_runs(runs: DataFrame) -> DataFrame:
    """Runs with the counts that follow from their arrays tags, raw_triples and triples; kg_saved is false unless given."""
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    saved = F.coalesce("kg_saved", F.lit(False)) if "kg_saved" in runs.columns else F.lit(False)
    return runs.withColumns({"n_entities": size("tags"), "n_raw_triples": size("raw_triples"), "n_triples": size("triples"), "kg_saved": saved})


def essay_check_runs(runs: DataFrame) -> DataFrame:
    """Runs with counts of their array claims (claim_type, verdict): all, factual, correct, incorrect."""
    of = lambda f: F.when(F.col("claims").isNull(), 0).otherwise(F.size(F.filter("claims", f))).cast("long")
    factual = lambda c: c["claim_type"] != "EDITORIAL"
    return runs.withColumns({"n_claims": of(lambda c: F.lit(True)), "n_factual": of(factual), "n_correct": of(lambda c: factual(c) & (c["verdict"] == "CORRECT")), "n_incorrect": of(lambda c: factual(c) & (c["verdict"] == "INCORRECT"))})


def combined_runs(scored: DataFrame, dimensions: tuple[str, ...] = ("D1", "D2", "D3", "D4")) -> DataFrame:
    """Scored essays with total, average and weakest, as they are stored."""
    d = {k: F.col(k) for k in dimensions}
    return scored.withColumns({"total": scoring.total(d), "average": scoring.average(d), "weakest": scoring.weakest(d)})


def extraction_stats(runs: DataFrame) -> DataFrame:
    """``(n_runs, n_saved, n_entities, n_triples)`` over all runs; zeros over none."""
    return runs.agg(F.count("*").alias("n_runs"), F.count_if("kg_saved").alias("n_saved"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_entities", "n_triples")))


def read_compat(spark: SparkSession, path: str) -> DataFrame:
    """All runs; columns of newer runs are null in older ones, and counts fall back to their older names."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    for new, old in (("total_factual_claims", "total_claims"), ("kg_gap_claims", "unverifiable_claims")):
        have = [c for c in (new, old) if c in df.columns]
        df = df.withColumn(new, F.coalesce(*have) if have else F.lit(None).cast("long"))
    return df


def mark_saved(runs: DataFrame, saved: DataFrame) -> DataFrame:
    """Runs with kg_saved set for those in ``saved`` (run_id)."""
    s = saved.select(F.col("run_id").alias("s")).distinct()
    return runs.join(s, F.col("run_id") == F.col("s"), "left").withColumn("kg_saved", F.coalesce("kg_saved", F.lit(False)) | F.col("s").isNotNull()).drop("s")


def recent(runs: DataFrame, n: int = 100, tie: str = "run_id") -> DataFrame:
    return runs.orderBy(F.desc("ts"), tie).limit(n)


def by_id(runs: DataFrame, run_id) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def summary(runs: DataFrame, score: str, count: str) -> DataFrame:
    """``(n_runs, mean, total)``: nulls are left out of the mean, sums over nothing are 0."""
    return runs.agg(F.count("*").alias("n_runs"), F.avg(score).alias("mean"), F.coalesce(F.sum(count), F.lit(0)).alias("total"))


def latest(runs: DataFrame, key: str, tie: str = "run_id") -> DataFrame:
    """Newest run of each key, with all its columns."""
    rest = [c for c in runs.columns if c != key]
    return runs.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", tie)).alias("r")).select(key, "r.*")


def search(runs: DataFrame, columns: list[str], term: str) -> DataFrame:
    """Runs that hold the term, whatever its case, in any column; with a preview of the first."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(term.lower())), F.lit(False))
    return runs.where(hit).withColumn("preview", T.preview(F.col(columns[0])))


def newest(runs: DataFrame, tie: str = "run_id") -> DataFrame:
    """The newest run of all, one row, or none."""
    return runs.orderBy(F.desc("ts"), F.desc(tie)).limit(1)


def export_payload(scored: DataFrame, id_col: str, body: Column, names: dict[str, str] | None = None) -> DataFrame:
    """``(slug, version, run_date, payload)``: one JSON text an essay, with the weakest dimension; keys of column scores are renamed by ``names``.

    scored has ts; version is its time, so that exports of one essay stand side by side.
    """
    scores = T.map_rename(F.col("scores"), names or {}) if "scores" in scored.columns else None
    parts = [body.alias("body"), *([scores.alias("scores")] if scores is not None else []), *([F.col("weakest").alias("weakest_area")] if "weakest" in scored.columns else [])]
    return scored.select(T.slug(F.col(id_col).cast("string")).alias("slug"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("version"), F.to_date("ts").alias("run_date"), F.to_json(F.struct(*parts)).alias("payload"))


def export_summary(scored: DataFrame, id_col: str, dimensions: tuple[str, ...], notes: dict[str, Column] | None = None) -> DataFrame:
    """``(id, summary)``: a readable text block an essay: its id, a line a dimension (a dash for none), total and weakest; behind a dimension's
    line those of its note (struct of strings, such as scoring's notes have), indented, where there are any."""
    lines = []
    for d in dimensions:
        lines.append(F.concat(F.lit(f"{d}: "), F.coalesce(F.col(d).cast("string"), F.lit("-"))))
        if notes and d in notes:
            part = lambda f: F.nullif(F.coalesce(notes[d][f], F.lit("")), F.lit(""))
            lines += [F.concat(F.lit(f"  {label}: "), part(f)) for f, label in (("what_wrong", "wrong"), ("how_to_improve", "better"))]
    d = {k: F.col(k) for k in dimensions}
    tail = [F.concat(F.lit("total: "), scoring.total(d).cast("string")), F.concat(F.lit("weakest: "), scoring.weakest(d))]
    return scored.select(F.col(id_col).alias("id"), F.concat_ws("\n", F.concat(F.lit("essay "), F.col(id_col).cast("string")), *lines, *tail).alias("summary"))
