"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.shared import materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node on an edge; the component is its smallest node.

    Each round hangs every node's larger neighbours on its smallest neighbour, then does the same for the smaller ones.
    Minima are aggregated map-side and joined back, so a node with very many neighbours is never gathered into one task's
    memory. The edge table is written to the shared folder after each round; rounds grow with the logarithm of the size.
    Edges with a null end are ignored, self-loops give a component of one node, an empty table gives an empty result.
    """
    known = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    known = materialize(known.distinct(), "edges")  # read twice
    loops = known.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    now = known.where("u != v")
    before = _signature(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "k").hint("merge"), F.col("u") == F.col("k")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
