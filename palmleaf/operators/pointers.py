"""Chains of pointers, followed to their ends by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.shared import materialize


def chain_ends(links: DataFrame) -> DataFrame:
    """``(f, t)`` of links (f, t), where each f comes once: t is the last of the chain that begins at f.

    Each round doubles the way a pointer has gone, so chains of n links take log2(n) rounds, each written to the shared
    folder. Links that go in a circle have no end and are refused.
    """
    now = materialize(links.select("f", "t"), "links")
    longest = now.count()
    rounds = 0
    while True:
        on = now.select(F.col("f").alias("_at"), F.col("t").alias("_next"))
        stepped = now.join(on.hint("merge"), F.col("t") == F.col("_at"), "left")
        stepped = materialize(stepped.select("f", F.coalesce("_next", "t").alias("t"), F.col("_next").isNotNull().alias("more")), "links")
        if stepped.where("more").isEmpty():
            return stepped.select("f", "t")
        rounds += 1
        if 1 << (rounds - 1) >= longest:  # after so many rounds every chain has come to its end
            raise ValueError("links go in a circle: " + ", ".join(str(r["f"]) for r in stepped.where("more").limit(3).collect()))
        now = stepped.select("f", "t")
