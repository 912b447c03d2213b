"""Names: dictionaries over shuffled rows."""

from pyspark.sql import functions as F

from palmleaf.operators import names


def test_normal_names_of_shuffled_rows(spark):
    """Rows behind a shuffle, with partitions that merge differently in each branch of a plan: every row keeps its own name."""
    rows = spark.range(20_000).select("id", F.concat(F.lit("n"), "id", F.when(F.col("id") % 2 == 0, "ගේ").otherwise("")).alias("name"), F.repeat(F.lit("x"), F.lit(2000)).alias("payload"))
    rows = rows.repartition(64, "id")
    forms = spark.range(0, 20_000, 4).select(F.concat(F.lit("n"), "id").alias("surface"), F.concat(F.lit("C"), "id").alias("canonical"))
    right = F.when(F.col("id") % 4 == 0, F.concat(F.lit("C"), "id")).when(F.col("id") % 2 == 0, F.concat(F.lit("n"), "id", F.lit("ගේ"))).otherwise(F.concat(F.lit("n"), "id"))
    for size in ("200k", "64m"):
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
        got = names.normalize_entity(rows, forms)
        assert got.count() == 20_000 and got.where(F.col("normal") != right).count() == 0
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_name_dictionaries(spark):
    forms = spark.createDataFrame([("a", "A"), ("a", "B"), ("b රජු", "C"), (None, "N"), ("z", None)], "surface string, canonical string")
    rows = [(1, " a "), (2, "a"), (2, "a"), (3, None), (4, "b රජු"), (5, "aගේ"), (6, ""), (7, "z")]
    got = names.normalize_entity(spark.createDataFrame(rows, "id int, name string").withColumn("normal", F.lit("old")), forms)
    assert sorted((r.id, r.normal) for r in got.collect() if r.normal is not None) == [(1, "A"), (2, "A"), (2, "A"), (4, "C"), (5, "A"), (6, ""), (7, "z")]
    assert got.count() == 8 and names.normalize_entity(got.limit(0), forms).count() == 0
    aliases = spark.createDataFrame([(1, "Q", "A")], "seq int, canonical string, alias string")
    triples = spark.createDataFrame([("a", "R", " a "), ("x", "R", None)], "subject string, relation string, object string")
    assert sorted((r.subject, r.object) for r in names.canonical_ends(triples, forms, aliases).collect() if r.object) == [("Q", "Q")]
