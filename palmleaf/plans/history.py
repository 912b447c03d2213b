"""Queries on claims and run history, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.functions import text as T
from palmleaf.operators import claims, kg, runs
from palmleaf.plans import graph
from palmleaf.shared import table
from palmleaf.sources import io

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def claim_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Claims out of the labels: quality says the verdict, toxic what cannot be checked."""
    lab, doc = table(spark, sf, "labels"), table(spark, sf, "documents")
    verdict = F.when(F.col("toxic") == 1, "unverifiable").when(F.col("quality") == 1, "correct").otherwise("incorrect")
    kind = F.when(F.col("doc_id") % 7 == 0, "EDITORIAL").otherwise("FACTUAL")
    rows = doc.select("doc_id", "source").join(lab, "doc_id")
    return rows.select(F.col("source").alias("essay_id"), F.lit(1).alias("batch_no"), F.col("doc_id").alias("pos"), F.concat(F.lit("claim "), F.col("doc_id").cast("string")).alias("claim_text"), kind.alias("claim_type"), verdict.alias("verdict"), F.lit(None).cast("string").alias("unverifiable_reason"), F.lit(None).cast("string").alias("matched_fact"), F.lit("because").alias("explanation"), F.lit("fix").alias("feedback"))


CLAIMS = """with raw as (select source as essay_id, doc_id as pos, 'claim ' || doc_id::varchar as claim_text, case when doc_id % 7 = 0 then 'EDITORIAL' else 'FACTUAL' end as claim_type, case when toxic = 1 then 'UNVERIFIABLE' when quality = 1 then 'CORRECT' else 'INCORRECT' end as v from documents join labels using (doc_id)),
claims as (select essay_id, pos, claim_text, claim_type, case when claim_type = 'EDITORIAL' then 'UNVERIFIABLE' else v end as verdict, case when claim_type = 'EDITORIAL' then 'NOT_FACTUAL' when v = 'UNVERIFIABLE' then 'NOT_IN_KG' end as unverifiable_reason from raw)
"""
COUNTS = "count(claim_type) as n_claims, count(*) filter (claim_type = 'FACTUAL') as n_factual, count(*) filter (claim_type = 'FACTUAL' and verdict = 'CORRECT') as n_correct, count(*) filter (claim_type = 'FACTUAL' and verdict = 'INCORRECT') as n_incorrect, count(*) filter (claim_type = 'FACTUAL' and verdict = 'UNVERIFIABLE') as n_unverifiable, count(*) filter (unverifiable_reason = 'NOT_IN_KG') as n_kg_gap"


def normal_claims(spark, sf):
    return claims.normalize_claims(claim_rows(spark, sf))


def results(spark, sf):
    return claims.aggregate_accuracy(table(spark, sf, "documents").select(F.col("source").alias("essay_id")), normal_claims(spark, sf))


@query(CLAIMS + "select essay_id, pos, claim_type, verdict, unverifiable_reason from claims")
def normalized_claims(spark, sf):
    return normal_claims(spark, sf).select("essay_id", "pos", "claim_type", "verdict", "unverifiable_reason")


@query(CLAIMS + f", g as (select e.essay_id, {COUNTS} from (select distinct source as essay_id from documents) e left join claims using (essay_id) group by all) select *, round(n_correct * 100 / nullif(n_correct + n_incorrect, 0)::double, 1) as accuracy, coalesce(round((n_correct + n_incorrect)::double / nullif(n_factual, 0), 4), 0) as coverage, coalesce(round((n_correct + n_incorrect)::double / nullif(n_factual, 0), 4), 0) < 0.3 as low_coverage, case when n_correct + n_incorrect >= 5 then 'HIGH' when n_correct + n_incorrect >= 1 then 'LOW' else 'INSUFFICIENT_KG' end as confidence from g")
def accuracy_results(spark, sf):
    return results(spark, sf).drop("n_not_factual")


@query(CLAIMS + """
select e.essay_id, count(*) filter (unverifiable_reason = 'NOT_FACTUAL') as n_not_factual,
  coalesce(round(count(*) filter (claim_type = 'FACTUAL' and verdict in ('CORRECT', 'INCORRECT'))::double / nullif(count(*) filter (claim_type = 'FACTUAL'), 0), 4), 0) as coverage,
  coalesce(round(count(*) filter (claim_type = 'FACTUAL' and verdict in ('CORRECT', 'INCORRECT'))::double / nullif(count(*) filter (claim_type = 'FACTUAL'), 0), 4), 0) < 0.3 as low_coverage
from (select distinct source as essay_id from documents) e left join claims using (essay_id) group by all""")
def coverage_results(spark, sf):
    """What is left out of accuracy_results: claims that are no facts, coverage and its warning."""
    return results(spark, sf).select("essay_id", "n_not_factual", "coverage", "low_coverage")


@query(CLAIMS + f", g as (select essay_id, {COUNTS} from (select distinct source as essay_id from documents) e left join claims using (essay_id) group by all), a as (select essay_id, round(n_correct * 100 / nullif(n_correct + n_incorrect, 0)::double, 1) as x from g) select essay_id, cast(case when x is null then null when x >= 90 then 5 when x >= 75 then 4 when x >= 60 then 3 when x >= 40 then 2 else 1 end as int) as D1 from a")
def accuracy_band(spark, sf):
    return results(spark, sf).select("essay_id", T.accuracy_band(F.col("accuracy")).alias("D1"))


@query(CLAIMS + "select claim_text, count(*) as n, count(distinct essay_id) as n_essays from claims where unverifiable_reason = 'NOT_IN_KG' group by all")
def kg_gap_worklist(spark, sf):
    return claims.kg_gap_worklist(normal_claims(spark, sf))


@query(CLAIMS + "select essay_id, pos, 'fix' as correction from claims where verdict = 'INCORRECT'")
def corrections(spark, sf):
    return claims.corrections(normal_claims(spark, sf)).select("essay_id", "pos", "correction")


@query(CLAIMS + "select essay_id, pos, case when claim_type = 'EDITORIAL' then 'EDITORIAL' else verdict end as category, cast(row_number() over (partition by essay_id order by pos) as int) as number from claims where claim_type = 'EDITORIAL' or verdict = 'CORRECT'")
def claims_table(spark, sf):
    return claims.claims_table(normal_claims(spark, sf), ["EDITORIAL", "CORRECT"]).select("essay_id", "pos", "category", "number")


@query("select conv_id, count(*) as n, string_agg(coalesce(text, ''), chr(10) order by turn, coalesce(text, '')) as joined from conversations group by all")
def raw_log_concat(spark, sf):
    return claims.concat_in_order(table(spark, sf, "conversations"), "conv_id", "turn", "text")


@query(graph.SQL_GRAPH + ", f as (select src_id as essay_id, row_number() over (partition by src_id order by relation, object, period) as seq, count(*) over (partition by src_id) as n, * from named  ), r as (select *, row_number() over (partition by essay_id order by case when n > 80 then case relation when 'ALSO_KNOWN_AS' then 13 else 14 end else 0 end, seq) as rank from f) select essay_id, max(n) as n_facts, string_agg(rank::varchar || '. ' || subject || ' ' || relation || ' ' || object || case when period != '' then ' (' || period || ')' else '' end, chr(10) order by rank) as text from r where rank <= 80 group by all")
def format_facts(spark, sf):
    n, e = graph.graph(spark, sf)
    rows = kg.with_names(e, n)
    facts = rows.select(F.col("src_id").alias("essay_id"), "subject", "relation", "object", "period")
    facts = facts.selectExpr("*", "row_number() over (partition by essay_id order by relation, object, period) as seq")  # by the column that format_facts goes by: one shuffle for both
    return claims.format_facts(facts)


@query("select s.c_custkey as essay_id, n_name as subject, 'LOCATED_IN' as relation, r_name as object from customer s join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def pool_facts(spark, sf):
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    facts = nation.select(F.col("n_nationkey").alias("entity"), F.col("n_name").alias("subject"), F.lit("LOCATED_IN").alias("relation"), F.col("r_name").alias("object"), F.lit("").alias("period"))
    pairs = table(spark, sf, "customer").select(F.col("c_custkey").alias("essay_id"), F.col("c_nationkey").alias("entity"), F.explode(F.array(F.lit(1), F.lit(2))).alias("order"))
    return claims.pool_facts(pairs, facts).select("essay_id", "subject", "relation", "object")


def run_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("run_id"), "ts", "user_id", F.col("event_type").alias("source"), F.col("value").alias("score"), "props")


@query("select event_id as run_id, user_id, event_type as source from events order by ts desc, event_id limit 100")
def recent_runs(spark, sf):
    return runs.recent(run_rows(spark, sf)).select("run_id", "user_id", "source")


@query("select count(*) as n_runs, round(avg(value), 4) as mean, cast(coalesce(sum(user_id), 0) as bigint) as total from events")
def run_stats(spark, sf):
    return runs.summary(run_rows(spark, sf), "score", "user_id").select("n_runs", F.round("mean", 4).alias("mean"), F.col("total").cast("long").alias("total"))


@query("select user_id, event_id as run_id, event_type as source from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_run_per_user(spark, sf):
    return runs.latest(run_rows(spark, sf), "user_id").select("user_id", "run_id", "source")


@query("select event_id as run_id, event_type as source, event_type as preview from events where contains(lower(event_type), 'c')")
def search_runs(spark, sf):
    return runs.search(run_rows(spark, sf), ["source"], "C").select("run_id", "source", "preview")


@query("select event_id as run_id, event_id % 2 = 0 as kg_saved from events")
def mark_saved(spark, sf):
    r = run_rows(spark, sf)
    return runs.mark_saved(r.withColumn("kg_saved", F.lit(False)), r.where("run_id % 2 = 0")).select("run_id", "kg_saved")


@query("select event_id as run_id, props is null or not json_valid(props) as bad from events")
def parse_props(spark, sf):
    return io.parse_submissions(run_rows(spark, sf).select("run_id", "props"), "k int, tag string", [], "props").select("run_id", F.col("parsed").isNull().alias("bad"))


@query("select conv_id, turn, 1 as n, coalesce(text, '') as first from conversations")
def claim_reply_salvage(spark, sf):
    """Conversation texts as a reply cut off in the middle: the complete objects are kept."""
    text = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("claim_text"), F.lit("FACTUAL").alias("claim_type")))
    reply = F.concat(F.lit('```json\n{"claims": ['), text, F.lit(', {"claim_text": "cut'))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", reply.alias("reply"))
    return claims.parse_replies(rows, claims.CLAIM, "claims").select("conv_id", "turn", F.size("parsed").alias("n"), F.element_at("parsed", 1)["claim_text"].alias("first"))
