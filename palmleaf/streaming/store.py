"""Knowledge graph as bucketed files that batches change a part of: copy-on-write under a manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.operators import kg
from palmleaf.shared import materialize

#: Tables of the store: what rows hold, and by which column they lie in buckets. keys has each name (p 0) and alias (p 1) of a node.
SCHEMAS = {
    "keys": ("k string, p int, node_id bigint", "k"),
    "nodes": ("node_id bigint, name string, label string, aliases array<string>", "node_id"),
    "edges": ("src_id bigint, relation string, dst_id bigint, period string, source_citation string, confidence double", "src_id"),
}
MANIFEST = "version bigint, name string, bucket int, next_id bigint"


class GraphStore:
    """Nodes and edges under ``path`` in ``buckets`` buckets a table.

    A batch reads the buckets of its names, of the nodes these lead to and of its subjects' edges, and writes new files for
    those only, in folders named by table, bucket and version. It is committed by one file of the manifest, which names them; what
    is not in the manifest is not there. A version that is committed already does nothing, one that was cut off is written anew.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _manifest(self) -> list:
        """Rows of the manifest: one for each bucket that a batch wrote."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect()
        except AnalysisException as e:  # only a store without batches is excused
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []

    def _bucket(self, column: str) -> F.Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, live: dict[tuple[str, int], int], buckets: set[int] | None = None) -> DataFrame:
        schema = SCHEMAS[name][0]
        paths = [f"{self.path}/{name}/b{b}-v{v}" for (n, b), v in sorted(live.items()) if n == name and b >= 0 and (buckets is None or b in buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _live(self, rows: list) -> dict[tuple[str, int], int]:
        live: dict[tuple[str, int], int] = {}
        for r in rows:
            live[r["name"], r["bucket"]] = max(r["version"], live.get((r["name"], r["bucket"]), -1))
        return live

    def read(self) -> tuple[DataFrame, DataFrame]:
        """All nodes and edges as of the last committed batch."""
        live = self._live(self._manifest())
        return self._read("nodes", live), self._read("edges", live)

    def _touched(self, rows: DataFrame, column: str) -> set[int]:
        return {r["b"] for r in rows.select(self._bucket(column).alias("b")).distinct().collect()}  # at most as many as buckets

    def _write(self, name: str, version: int, live: dict, changed: DataFrame, replaced: list[str]) -> list[tuple]:
        """Buckets of ``changed`` anew: their rows of before, without those that ``changed`` replaces by key, and its own."""
        column = SCHEMAS[name][1]
        buckets = self._touched(changed, column)
        old = self._read(name, live, buckets).join(changed.select(*replaced).distinct().hint("merge"), replaced, "left_anti")
        new = materialize(old.select(*changed.columns).unionByName(changed).withColumn("_bucket", self._bucket(column)), "buckets")
        for b in buckets:
            new.where(F.col("_bucket") == b).drop("_bucket").write.mode("overwrite").parquet(f"{self.path}/{name}/b{b}-v{version}")
        return [(version, name, b, None) for b in sorted(buckets)]

    def merge(self, batch: DataFrame, version: int) -> list[tuple]:
        """Triples (subject, relation, object, period, source, label) of one batch; returns what was written, nothing for a version that is there."""
        manifest = self._manifest()
        if any(r["version"] == version for r in manifest):
            return []
        live, next_id = self._live(manifest), max((r["next_id"] for r in manifest if r["next_id"] is not None), default=0)
        batch = materialize(batch.where("subject is not null and object is not null"), "batch")
        ends = batch.select(F.explode(F.array("subject", "object")).alias("k"), "label")
        names = materialize(ends.groupBy("k").agg(F.min("label").alias("label")), "batch-names")
        keys = self._read("keys", live, self._touched(names, "k"))
        ids = materialize(keys.join(names.select("k").hint("merge"), "k", "left_semi").select("node_id").distinct(), "batch-nodes")
        nodes = self._read("nodes", live, self._touched(ids, "node_id"))
        nodes = materialize(nodes.join(ids.hint("merge"), "node_id", "left_semi"), "known-nodes")
        incoming = names.select(F.col("k").alias("name"), F.expr(_label_sql("label")).alias("label"), F.array().cast("array<string>").alias("aliases"))
        after = materialize(kg.upsert_nodes(nodes, incoming.where("label is not null"), next_id), "new-nodes")
        fresh = after.join(ids.hint("merge"), "node_id", "left_anti")
        there = self._read("edges", live, self._touched(kg.find_node(batch, after, "subject").where("node_id is not null").select(F.col("node_id").alias("src_id")), "src_id"))
        edges, _ = kg.upsert_edges(there, after, batch.select("subject", "relation", "object", "period", "source"))
        added = materialize(edges.join(there.select(*kg.EDGE).distinct().hint("merge"), kg.EDGE, "left_anti"), "new-edges")
        new_keys = fresh.select(F.col("name").alias("k"), F.lit(0).alias("p"), "node_id").unionByName(fresh.select(F.explode("aliases").alias("k"), F.lit(1).alias("p"), "node_id"))
        wrote = self._write("keys", version, live, new_keys, ["k", "p", "node_id"]) + self._write("nodes", version, live, fresh, ["node_id"]) + self._write("edges", version, live, added, kg.EDGE)
        top = max(next_id, (fresh.agg(F.max("node_id")).first()[0] or -1) + 1)
        self.spark.createDataFrame([*wrote, (version, "", -1, top)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return wrote

    def save(self) -> Callable[[DataFrame, int], None]:
        """``merge`` for upsert_stream."""

        def run(batch: DataFrame, batch_id: int) -> None:
            self.merge(batch, batch_id)

        return run


def _label_sql(column: str) -> str:
    """Node label of an entity class; null for classes that are no nodes."""
    return "case " + " ".join(f"when {column} = '{k}' then '{v}'" for k, v in kg.LABEL_OF.items()) + " end"
