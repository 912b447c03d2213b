"""Shortest undirected paths for a table of pairs, searched from both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.shared import materialize


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int = 5) -> DataFrame:
    """``(a, b, hops, path)``: for each different pair (a, b) that up to ``most`` edges (src_id, dst_id) join, a shortest path; of equal ones the smallest.

    Each round takes one step for every open pair, from that of its ends with fewer nodes in front; the fronts of all pairs are one
    table. Since every node within the steps of its side has been seen, a pair is done when its fronts first meet. A front keeps for each
    node the least way to it (from a), or from it (to b): at most ``most`` + 1 nodes; the least path is the least way to a
    meeting node and on. A node of one neighbour is on a path as its end only, so others do not step there: a hub's leaves are
    not dealt to every pair that comes by it. Pairs that are done leave. Pairs with a null end have no path; a node is joined to
    itself by no edge.
    """
    both = edges.select(F.col("src_id").alias("s"), F.col("dst_id").alias("d")).where("s != d")
    ways = materialize(both.unionByName(both.select(F.col("d").alias("s"), F.col("s").alias("d"))).distinct(), "ways")
    leaves = ways.groupBy("s").agg(F.count("*").alias("n")).where("n = 1").select(F.col("s").alias("leaf")).hint("merge")
    to_leaf = F.col("d") == F.col("leaf")
    through = materialize(ways.join(leaves, to_leaf, "left_anti"), "ways")
    ending = materialize(ways.join(leaves, to_leaf, "left_semi"), "ways")
    asked = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null").distinct()
    done = asked.where("a = b").select("a", "b", F.lit(0).alias("hops"), F.array("a").alias("path"))
    asked = materialize(asked.where("a != b"), "pairs")
    ends = F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("node")), F.struct(F.lit("b").alias("side"), F.col("b").alias("node")))
    front = asked.select("a", "b", F.explode(ends).alias("e")).select("a", "b", "e.side", "e.node", F.array("e.node").alias("way"))
    front = materialize(front, "fronts")
    seen = front.select("a", "b", "side", "node")
    for hop in range(1, most + 1):
        sizes = front.groupBy("a", "b").agg(F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"))
        # a side without nodes in front has nowhere to go: its pair has no path
        turn = sizes.where("n_a > 0 and n_b > 0").select(F.col("a").alias("p"), F.col("b").alias("q"), F.when(F.col("n_a") <= F.col("n_b"), "a").otherwise("b").alias("turn"))
        here = materialize(front.join(turn.hint("merge"), (F.col("a") == F.col("p")) & (F.col("b") == F.col("q"))).drop("p", "q"), "fronts")
        going, waiting = here.where("side = turn"), here.where("side != turn").drop("turn")
        goal = F.when(F.col("side") == "a", F.col("b")).otherwise(F.col("a"))
        step = going.join(through.hint("merge"), F.col("node") == F.col("s"))
        step = step.unionByName(going.join(ending.hint("merge"), (F.col("node") == F.col("s")) & (goal == F.col("d"))))
        way = F.when(F.col("side") == "a", F.concat("way", F.array("d"))).otherwise(F.concat(F.array("d"), "way"))
        step = step.select("a", "b", "side", F.col("d").alias("node"), way.alias("way")).groupBy("a", "b", "side", "node").agg(F.min("way").alias("way"))
        new = materialize(step.join(seen.hint("merge"), ["a", "b", "side", "node"], "left_anti"), "fronts")
        if new.isEmpty():
            break
        front = new.unionByName(waiting)
        by_side = front.groupBy("a", "b", "node").agg(F.max(F.when(F.col("side") == "a", F.col("way"))).alias("to"), F.max(F.when(F.col("side") == "b", F.col("way"))).alias("on"))
        met = by_side.where(F.col("to").isNotNull() & F.col("on").isNotNull())
        met = met.groupBy("a", "b").agg(F.min(F.concat("to", F.slice("on", 2, most + 1))).alias("path"))
        met = materialize(met.select("a", "b", F.lit(hop).alias("hops"), "path"), "paths")
        done = done.unionByName(met)
        gone = met.select("a", "b").hint("merge")
        front = materialize(front.join(gone, ["a", "b"], "left_anti"), "fronts")
        seen = materialize(seen.unionByName(new.select("a", "b", "side", "node")).join(gone, ["a", "b"], "left_anti"), "seen")
    return done
