"""Session helpers: the shared scratch folder and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors: ``spark.checkpoint.dir``; where that is unset, a new temporary one in local mode, as in tests; on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-palmleaf-")
    return _LOCAL[app]


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later uses neither recompute it nor lose it with an executor, and Spark knows its real size. The shuffle files of
    the write go with its end, for nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/palmleaf-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``g``, numbers from 0 in the order of ``order`` (columns), without one task seeing them all.

    Rows are dealt by ranges of the order, sorted and written; the sizes of the ranges, one for each shuffle partition, give the
    number at which each begins. Equal rows are told apart by where they were read, so a hot one is dealt too.
    """
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    order = [*order, F.col("_salt")]
    ranged = salted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).drop("_salt")
    ranged = materialize(ranged, "numbered")
    part = F.shiftright("_at", 33)
    starts, before = [], 0
    for p, n in sorted(map(tuple, ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())):
        starts.append((p, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "_p long, _before long")
    out = ranged.join(F.broadcast(starts), part == F.col("_p"))  # as many rows as shuffle partitions
    return out.withColumn("g", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_before", "_at")
