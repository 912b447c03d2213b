"""Corpus pipeline: language ID, near-duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns the next one's documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.llm import langid, mixing, packing, simhash, substring
from palmleaf.shared import materialize, table

#: Tokens of the mixture as a share of those there are; each document at most once.
SHARE, EPOCHS = 0.8, 1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles come from the labelled documents; lang becomes the prediction, and documents without one (no letter) go."""
    found = langid.identify(docs, langid.fit_profiles(docs)).where(F.col("lang_pred") != langid.NONE)
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at a similarity of 0.8 of 5-word shingles, the document of smallest id stays; a repeated row stays once."""
    groups = simhash.similar_groups(docs)
    first = groups.select(F.xxhash64("component_id").alias("_key"), F.col("component_id").alias("_first")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("doc_id").alias("_id"), F.xxhash64("text").alias("_text"))
    kept = rows.join(first.hint("merge"), (F.col("_id") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    once = kept.withColumn("_again", F.expr("row_number() over (partition by _id, doc_id, _text order by _id)")).where("_again = 1")
    return once.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that repeat go from the texts, and documents of nothing else with them."""
    out = substring.remove_repeats(docs)
    changed = F.col("n_removed") > 0
    out = out.where(~changed | (F.col("n_removed") < F.col("n_words")))
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    return out.select(*((text if c == "text" else F.when(changed, F.length("kept").cast("long")).otherwise(F.col(c)) if c == "n_chars" else F.col(c)).alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the production mixture."""
    out = mixing.mix(docs, F.expr(mixing.DOMAIN_SQL), mixing.WEIGHTS, SHARE, mixing.SEED, EPOCHS)
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids, sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_duplicates), ("substring_dedup", substring_dedup), ("mixture", mixture), ("packing", pack)]
ORACLE_SQL = None  # fingerprints, profiles and token ids have no SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
