"""Knowledge graph as two tables: nodes(node_id, name, label, aliases) and edges(src_id, relation, dst_id, period, source_citation, confidence).

Writes return new frames and a table of what happened; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palmleaf.functions import text as T
from palmleaf.operators.components import connected_components
from palmleaf.operators.paths import shortest_paths
from palmleaf.operators.pointers import chain_ends
from palmleaf.operators.names import canonical_ends, canonical_entity
from palmleaf.shared import materialize, numbered

# Node labels, and the label of each entity class (dates are none).
NODE_LABELS = ("King", "Monk", "Person", "Place", "Monument", "Dynasty", "Battle", "Chronicle", "Relic", "Era", "Technology", "Animal")
LABEL_OF = {"PERSON_KING": "King", "PERSON_MONK": "Monk", "PERSON_OTHER": "Person", "LOCATION": "Place", "MONUMENT": "Monument", "DYNASTY": "Dynasty", "BATTLE_EVENT": "Battle", "CHRONICLE": "Chronicle", "RELIC": "Relic"}
EDGE = ["src_id", "relation", "dst_id"]
ALIAS = "ALSO_KNOWN_AS"
#: Places up to which Spark cuts a numbered group before it is dealt (spark.sql.optimizer.windowGroupLimitThreshold).
LEADING_MOST = 1000


def find_node(names: DataFrame, nodes: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with ``node_id``: by exact name, else by any alias (smallest id); null if unknown."""
    keys = nodes.select(F.col("name").alias("k"), F.lit(0).alias("p"), "node_id").unionByName(nodes.select(F.explode("aliases").alias("k"), F.lit(1).alias("p"), "node_id"))
    best = keys.groupBy("k").agg(F.min(F.struct("p", "node_id"))["node_id"].alias("node_id"))
    return names.join(best.hint("shuffle_hash"), F.col(name) == F.col("k"), "left").drop("k")


def upsert_nodes(nodes: DataFrame, incoming: DataFrame, next_id: int | None = None) -> DataFrame:
    """Nodes after (name, label, aliases) came in: known ones gain new aliases, others are added once with the next ids.

    The result is that of taking the rows one after another: a row goes to the node of its name, else to the one that had its
    name as an alias first (a node of before, the smallest id first; else the one to which the earliest row brought it), else
    it makes a node with its label. With a column ``seq`` rows come in its order (rows of one seq together, by name); without it
    those whose name is nobody's alias come first, then by name. A name that is an alias from an earlier row points to
    that row's name, which came earlier still, so pointers have no circles; they are followed by doubling. Rows without a name
    are left out. ``next_id``: the first new id, where ``nodes`` are only those that the rows can touch.
    """
    none = F.array().cast("array<string>")
    rows = incoming.where("name is not null").withColumn("aliases", F.coalesce("aliases", none))
    if "seq" in incoming.columns:
        rows = rows.select("name", "label", "aliases", F.struct(F.col("seq").cast("long").alias("a"), F.col("name").alias("b")).alias("turn"))
    else:
        other = rows.select(F.explode("aliases").alias("alias"), F.col("name").alias("by")).where("alias != by").select("alias").distinct()
        rows = rows.join(other.hint("merge"), F.col("name") == F.col("alias"), "left")
        rows = rows.select("name", "label", "aliases", F.struct(F.col("alias").isNotNull().cast("long").alias("a"), F.col("name").alias("b")).alias("turn"))
    rows = materialize(rows, "incoming-nodes")
    # a label at the first turn, ties to the least
    first = rows.groupBy("name").agg(F.min("turn").alias("first"), F.min(F.struct("turn", "label"))["label"].alias("label"))
    first = materialize(find_node(first, nodes), "first-turns")
    brought = rows.select(F.explode("aliases").alias("alias"), F.col("name").alias("holder"), "turn")
    brought = brought.groupBy("alias").agg(F.min(F.struct("turn", "holder")).alias("b"))  # who brings an alias first
    links = first.where("node_id is null").join(brought.hint("merge"), F.col("name") == F.col("alias")).where(F.col("b.turn") < F.col("first"))
    ends = chain_ends(links.select(F.col("name").alias("f"), F.col("b.holder").alias("t")))
    home = first.select(F.col("name").alias("n"), "node_id", "label").join(ends.hint("merge"), F.col("n") == F.col("f"), "left")
    home = home.select("n", "node_id", "label", F.coalesce("t", "n").alias("root"))
    of_root = home.select(F.col("n").alias("r"), F.col("node_id").alias("root_id"))
    home = materialize(home.join(of_root.hint("merge"), F.col("root") == F.col("r")).select("n", "root", "root_id", "label"), "homes")
    gain = rows.select("name", "turn", F.posexplode("aliases").alias("place", "alias")).join(home.hint("merge"), F.col("name") == F.col("n"))
    gain = gain.select(F.when(F.col("root_id").isNull(), F.col("root")).alias("g"), F.col("root_id").alias("g_id"), "alias", F.struct("turn", "place").alias("at"))
    gain = gain.where("alias is not null").groupBy("g", "g_id", "alias").agg(F.min("at").alias("at"))
    gain = gain.groupBy("g", "g_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("new"))
    gain = materialize(gain, "gained-aliases")
    old = nodes.join(gain.where("g_id is not null").hint("merge"), F.col("node_id") == F.col("g_id"), "left")
    old = old.select("node_id", "name", "label", F.array_union(F.coalesce("aliases", none), F.coalesce("new", none)).alias("aliases"))
    top = nodes.agg((F.coalesce(F.max("node_id"), F.lit(-1)) if next_id is None else F.lit(next_id - 1)).alias("top"))
    fresh = home.where("n = root and root_id is null").join(gain.where("g_id is null").select("g", "new").hint("merge"), F.col("n") == F.col("g"), "left")
    fresh = fresh.select(F.col("n").alias("name"), "label", F.coalesce("new", none).alias("aliases")).crossJoin(F.broadcast(top))  # one row
    fresh = materialize(fresh.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "new-nodes")
    sizes = fresh.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("first")).selectExpr("_p as p", "first", "sum(n) over (order by _p) - n as before")
    fresh = fresh.join(sizes, F.col("_p") == F.col("p")).select((F.col("top") + 1 + F.col("before") + F.col("_i") - F.col("first")).alias("node_id"), "name", "label", "aliases")
    return old.unionByName(fresh)


def upsert_edges(edges: DataFrame, nodes: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges after triples (subject, relation, object, period, source) came in, and each triple's ``status``: created, duplicate or missing node."""
    t = find_node(triples, nodes, "subject").withColumnRenamed("node_id", "src_id")
    t = materialize(find_node(t, nodes, "object").withColumnRenamed("node_id", "dst_id"), "triples")
    # only keys of the triples are made different, the edges are just looked into: they may be very many
    have = t.select(*EDGE).distinct().join(edges.select(*EDGE).hint("merge"), EDGE, "left_semi")
    have = have.select(*(F.col(c).alias(f"h_{c}") for c in EDGE))
    t = t.join(have.hint("merge"), (F.col("src_id") == F.col("h_src_id")) & (F.col("relation") == F.col("h_relation")) & (F.col("dst_id") == F.col("h_dst_id")), "left")
    status = F.when(F.col("src_id").isNull() | F.col("dst_id").isNull(), "missing node").when(F.col("h_src_id").isNotNull(), "duplicate").otherwise("created")
    t = t.withColumn("status", status)
    fresh = t.where("status = 'created'").groupBy(*EDGE).agg(F.min(F.struct(F.coalesce("period", F.lit("")).alias("period"), F.coalesce("source", F.lit("")).alias("source"))).alias("m"))
    fresh = fresh.select(*EDGE, F.col("m.period").alias("period"), F.col("m.source").alias("source_citation"), F.lit(1.0).alias("confidence"))
    return edges.unionByName(fresh), t.select("subject", "relation", "object", "status")


def save_extraction(nodes: DataFrame, edges: DataFrame, tags: DataFrame, triples: DataFrame, surface_forms: DataFrame | None = None, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tags (entity, label, aliases) become nodes, dates left out; then triples become edges.

    With lookup tables (both) names of tags and ends of triples are made canonical first, and a tagged form that differs from its canonical
    name becomes an alias. Returned: nodes, edges, and the status of each triple; save_counts sums them up.
    """
    known = F.create_map(*(F.lit(x) for kv in LABEL_OF.items() for x in kv))
    rows = tags.select(F.col("entity").alias("name"), F.try_element_at(known, F.col("label")).alias("label"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).where("label is not null and length(name) > 0")
    if surface_forms is not None and aliases is not None:
        rows = canonical_entity(rows, surface_forms, aliases).where("length(canonical) > 0")
        rows = rows.select(F.col("canonical").alias("name"), "label", F.array_except(F.array_union("aliases", F.array("name")), F.array("canonical")).alias("aliases"))
        triples = canonical_ends(triples, surface_forms, aliases)
    new = materialize(upsert_nodes(nodes, rows), "nodes")
    return (new, *upsert_edges(edges, new, triples))


def save_counts(before: DataFrame, after: DataFrame, status: DataFrame) -> DataFrame:
    """``(what, n)`` of a save: nodes created, and triples by status."""
    created = after.join(before.select("node_id").hint("merge"), "node_id", "left_anti").agg(F.lit("nodes created").alias("what"), F.count("*").alias("n"))
    return created.unionByName(status.groupBy(F.concat(F.lit("triples "), "status").alias("what")).agg(F.count("*").alias("n")))


def node_names(nodes: DataFrame) -> DataFrame:
    """``(name, label)`` of all nodes; a caller that shows them sorts."""
    return nodes.select("name", "label")


def focus(triples: DataFrame, name: str) -> DataFrame:
    """Triples whose subject or object is ``name``."""
    return triples.where((F.col("subject") == name) | (F.col("object") == name))


def with_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with subject, object and the labels of both ends; subjects come last, so what a caller does by src_id needs no other shuffle."""
    a = nodes.select(F.col("node_id").alias("src_id"), F.col("name").alias("subject"), F.col("label").alias("subject_label"))
    b = nodes.select(F.col("node_id").alias("dst_id"), F.col("name").alias("object"), F.col("label").alias("object_label"))
    return edges.join(b, "dst_id").join(a, "src_id")


def delete_edges(edges: DataFrame, nodes: DataFrame, wanted: DataFrame, by_alias: bool = False) -> DataFrame:
    """Edges without those named (subject, relation, object); ends by exact name, or by alias too."""
    look = nodes if by_alias else nodes.withColumn("aliases", F.array().cast("array<string>"))
    w = find_node(wanted, look, "subject").withColumnRenamed("node_id", "src_id")
    w = find_node(w, look, "object").withColumnRenamed("node_id", "dst_id").where("src_id is not null and dst_id is not null").select(*EDGE)
    return edges.join(w.hint("merge"), EDGE, "left_anti")


def update_edges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges after changes (src_id, relation, dst_id, new_relation, period, source_citation): where the new edge exists already, that one stays.

    A null new_relation, period or source_citation keeps what the edge has. Of several changes of one edge the one with the
    greatest ``seq`` counts, alone; without that column, or among equal ones, the greatest (new_relation, period,
    source_citation), nulls being least.
    """
    new = F.struct("new_relation", "period", "source_citation")
    order = F.struct("seq", new) if "seq" in changes.columns else new
    c = changes.groupBy(*(F.col(x).alias(f"c_{x}") for x in EDGE)).agg(F.max_by(new, order).alias("c"))
    same = [F.col(x) == F.col(f"c_{x}") for x in EDGE]
    j = edges.join(c.hint("merge"), same[0] & same[1] & same[2], "left")
    relation = F.coalesce("c.new_relation", "relation")
    moved = F.col("c_src_id").isNotNull() & (relation != F.col("relation"))
    rows = j.select("src_id", relation.alias("relation"), "dst_id", F.coalesce("c.period", "period").alias("period"), F.coalesce("c.source_citation", "source_citation").alias("source_citation"), "confidence", moved.cast("int").alias("moved"))
    best = rows.groupBy(*EDGE).agg(F.min_by(F.struct("period", "source_citation", "confidence"), F.struct("moved", "period", "source_citation")).alias("m"))
    return best.select(*EDGE, "m.*")


def update_labels(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with new labels (name, new_label); labels that are not allowed change nothing."""
    c = changes.where(F.col("new_label").isin(*NODE_LABELS)).groupBy(F.col("name").alias("c_name")).agg(F.min("new_label").alias("new_label"))
    return nodes.join(c, F.col("name") == F.col("c_name"), "left").select("node_id", "name", F.coalesce("new_label", "label").alias("label"), "aliases")


def merge_nodes(nodes: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after each from_id went into to_id: edges move, self-loops and duplicates go (the target's own edge stays), the old name and
    its aliases become aliases.

    Merges are one after another in effect: of a->b and b->c everything ends in c. Of several targets of a node the smallest
    counts; merges of a node into itself, and those with an end that is no node, do nothing; a circle is refused.
    """
    ids = nodes.select(F.col("node_id").alias("i"))
    m = merges.where("from_id != to_id").groupBy(F.col("from_id").alias("f")).agg(F.min("to_id").alias("t"))
    m = m.join(ids.hint("shuffle_hash"), F.col("f") == F.col("i"), "left_semi").join(ids.hint("shuffle_hash"), F.col("t") == F.col("i"), "left_semi")
    m = chain_ends(m)
    gain = m.join(nodes, F.col("f") == F.col("node_id")).select("t", F.explode(F.concat(F.array("name"), "aliases")).alias("alias")).where("alias is not null").distinct()
    gain = materialize(gain.groupBy("t").agg(F.array_sort(F.collect_list("alias")).alias("new")), "merged-names")
    left = nodes.join(m.select("f"), F.col("node_id") == F.col("f"), "left_anti").join(gain, F.col("node_id") == F.col("t"), "left")
    left = left.select("node_id", "name", "label", F.array_except(F.array_union("aliases", F.coalesce("new", F.array().cast("array<string>"))), F.array("name")).alias("aliases"))
    e = edges.join(m.select(F.col("f").alias("f1"), F.col("t").alias("t1")), F.col("src_id") == F.col("f1"), "left").join(m.select(F.col("f").alias("f2"), F.col("t").alias("t2")), F.col("dst_id") == F.col("f2"), "left")
    moved = F.col("f1").isNotNull() | F.col("f2").isNotNull()
    e = e.select(F.coalesce("t1", "src_id").alias("src_id"), "relation", F.coalesce("t2", "dst_id").alias("dst_id"), "period", "source_citation", "confidence", moved.cast("int").alias("moved")).where("moved = 0 or src_id != dst_id")
    # edges hardly meet before they are dealt, so they are dealt first: a task that makes edges does not sort them as well
    best = e.repartition(*EDGE).groupBy(*EDGE).agg(F.min_by(F.struct("period", "source_citation", "confidence"), F.struct("moved", "period", "source_citation")).alias("m"))
    return left, best.select(*EDGE, "m.*")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of ``gone`` (node_id)."""
    g = gone.select(F.col("node_id").alias("g")).distinct()
    return nodes.join(g, F.col("node_id") == F.col("g"), "left_anti"), edges.join(g, F.col("src_id") == F.col("g"), "left_anti").join(g, F.col("dst_id") == F.col("g"), "left_anti")


def edit_triples(nodes: DataFrame, edges: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manual edits (old_subject, old_relation, old_object, subject, relation, object, period): the old edge goes, ends are made, the new edge comes with source [manual]."""
    filled = (F.length(T.strip_ws(F.col("subject"))) > 0) & (F.length(T.strip_ws(F.col("object"))) > 0) & T.sanitize_relation(F.col("relation")).isNotNull()
    same = F.col("old_subject").eqNullSafe(F.col("subject")) & F.col("old_relation").eqNullSafe(F.col("relation")) & F.col("old_object").eqNullSafe(F.col("object"))
    checked = edits.withColumn("problem", F.when(~F.coalesce(filled, F.lit(False)), "missing field").when(same, "no change"))
    todo = materialize(checked.where("problem is null").withColumn("relation", T.sanitize_relation(F.col("relation"))), "edits")
    left = delete_edges(edges, nodes, todo.select(F.col("old_subject").alias("subject"), F.col("old_relation").alias("relation"), F.col("old_object").alias("object")).where("subject is not null"), by_alias=True)
    ends = todo.select(F.explode(F.array("subject", "object")).alias("name"), F.lit("Person").alias("label"), F.array().cast("array<string>").alias("aliases"))
    new = materialize(upsert_nodes(nodes, ends), "nodes")
    out, status = upsert_edges(left, new, todo.select("subject", "relation", "object", "period", F.lit("[manual]").alias("source")))
    return new, out, status.unionByName(checked.where("problem is not null").select("subject", "relation", "object", F.col("problem").alias("status")))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(kind, key, n)``: nodes of each label and edges of each relation."""
    a = nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("key")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("relation").alias("key")).agg(F.count("*").alias("n")))


def relation_types(edges: DataFrame) -> DataFrame:
    """``(relation)``, each once; a caller that shows them sorts."""
    return edges.select("relation").distinct()


def all_triples(edges: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """All edges by names and labels; nodes are held as hash tables of a partition at any size, for sorting all edges by both ends takes longer and more memory."""
    out = with_names(edges, nodes.hint("shuffle_hash")).select("subject", "subject_label", "relation", "object", "object_label", "period", "source_citation")
    return out if limit is None else out.orderBy("subject", "relation", "object", "period").limit(limit)


def also_known_as(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return with_names(edges.where(F.col("relation") == ALIAS), nodes).select("subject", "object")


def node_detail(nodes: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Nodes with sorted lists of outgoing and incoming facts: for the few nodes that are looked at (``names``: all nodes, for the other ends).

    A hub's facts become one row; for hubs, and for all nodes, there is node_facts, page by page.
    """
    own = nodes.select(F.col("node_id").alias("own"))
    touched = edges.join(own.hint("shuffle_hash"), (F.col("src_id") == F.col("own")), "left_semi").unionByName(edges.join(own.hint("shuffle_hash"), (F.col("dst_id") == F.col("own")), "left_semi")).distinct() if names is not None else edges
    # a list needs the names of its other ends only, for the nodes themselves join below
    other = (nodes if names is None else names).select(F.col("node_id").alias("far"), "name")
    listed = lambda own, far, to: touched.join(other, F.col(far) == F.col("far")).groupBy(F.col(own).alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("relation", "name", "period"))).alias(to))
    out, into = listed("src_id", "dst_id", "outgoing"), listed("dst_id", "src_id", "incoming")
    return nodes.join(out, "node_id", "left").join(into, "node_id", "left")


def node_facts(nodes: DataFrame, edges: DataFrame, asked: DataFrame, page: int = 1, rows: int = 20) -> DataFrame:
    """``(node_id, place, direction, relation, name, period)``: one page of the facts of each asked node (node_id), places counted from 1.

    Outgoing facts come first, then by relation, other name and period; a self-loop comes in both directions. Of pages that end within
    ``LEADING_MOST`` facts each task leaves a node's first ones before they are dealt by node, so a hub brings that many from each task.
    Of later pages facts are dealt by ranges of the order and numbered from the sizes of the ranges, so a hub lies in many tasks. No
    node's facts become one row or one group. Repeated edges are repeated facts, asked nodes without facts give no row.
    """
    wanted = materialize(asked.select(F.col("node_id").alias("own")).where("own is not null").distinct(), "asked")
    name = nodes.select(F.col("node_id").alias("other"), "name")
    end = lambda own, direction, far: F.struct(F.col(own).alias("node_id"), F.lit(direction).alias("direction"), F.col(far).alias("far"))
    both = F.array(end("src_id", "out", "dst_id"), end("dst_id", "in", "src_id"))
    facts = edges.select("relation", "period", F.explode(both).alias("e")).select("e.*", "relation", "period")  # one pass over the edges
    facts = facts.join(wanted, F.col("node_id") == F.col("own"), "left_semi")
    facts = facts.join(name, F.col("far") == F.col("other")).select("node_id", "direction", "relation", "name", "period")
    order, last = [F.col("direction").desc(), F.col("relation"), F.col("name"), F.col("period")], page * rows
    if last <= LEADING_MOST:
        placed = facts.withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy(*order))).where(F.col("r") <= last).withColumn("place", F.col("r").cast("long"))
        return placed.where(F.col("place") > last - rows).select("node_id", "place", "direction", "relation", "name", "period")
    placed = numbered(facts, [F.col("node_id"), *order])
    first = placed.groupBy(F.col("node_id").alias("n")).agg(F.min("g").alias("first"))
    placed = placed.join(first, F.col("node_id") == F.col("n")).withColumn("place", F.col("g") - F.col("first") + 1).drop("n", "g", "first")
    return placed.where(F.col("place").between(last - rows + 1, last)).select("node_id", "place", "direction", "relation", "name", "period")


def degrees(nodes: DataFrame, edges: DataFrame, loops_twice: bool = False) -> DataFrame:
    """``(node_id, name, degree)``; isolated nodes have 0; a self-loop counts once, or twice as in a multigraph."""
    ends = edges.select(F.col("src_id").alias("n")).unionByName(edges.where("true" if loops_twice else "src_id != dst_id").select(F.col("dst_id").alias("n")))
    deg = ends.groupBy("n").agg(F.count("*").alias("degree"))
    return nodes.join(deg, F.col("node_id") == F.col("n"), "left").select("node_id", "name", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def top_connected(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), "name").limit(n)


def degree_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges, True).withColumn("size", F.greatest(F.lit(12), F.least(F.lit(40), 12 + 4 * F.col("degree"))).cast("long"))


def filter_triples(triples: DataFrame, labels: list[str], relations: list[str]) -> DataFrame:
    ok = lambda c: F.col(c).isin(*labels) | F.col(c).isNull()
    return triples.where(ok("subject_label") & ok("object_label") & F.col("relation").isin(*relations))


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the largest weakly connected component; of equal ones that of the smallest node id."""
    comp = connected_components(edges.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")))
    comp = nodes.join(comp, F.col("node_id") == F.col("node"), "left").select("node_id", "name", F.coalesce("component", "node_id").alias("component"))
    comp = materialize(comp, "components")
    top = comp.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1).withColumnRenamed("component", "c")
    return comp.join(F.broadcast(top), F.col("component") == F.col("c"), "left_semi")


def neighbourhood(nodes: DataFrame, edges: DataFrame, needle: str) -> DataFrame:
    """Edges among the nodes whose search key holds ``needle`` and their neighbours in either direction."""
    hit = nodes.where(F.contains(T.search_key(F.col("name")), F.lit(needle.lower()))).select(F.col("node_id").alias("h"))
    near = edges.join(hit, F.col("src_id") == F.col("h")).select(F.col("dst_id").alias("h")).unionByName(edges.join(hit, F.col("dst_id") == F.col("h")).select(F.col("src_id").alias("h")))
    kept = materialize(hit.unionByName(near).distinct(), "neighbours")
    return edges.join(kept, F.col("src_id") == F.col("h"), "left_semi").join(kept, F.col("dst_id") == F.col("h"), "left_semi")


def name_search(triples: DataFrame, term: str) -> DataFrame:
    """``(name, first)``: subjects and objects that hold the term, by where they first come (column pos of triples)."""
    names = triples.select("pos", F.explode(F.array("subject", "object")).alias("name"))
    return names.where(F.contains(F.lower("name"), F.lit(term.lower()))).groupBy("name").agg(F.min("pos").alias("first"))


def relation_page(triples: DataFrame, subject_holds: str, page: int, rows: int = 20) -> DataFrame:
    """One page of a subject's triples, by relation, object and period."""
    kept = triples.where(F.contains(T.search_key(F.col("subject")), F.lit(subject_holds.lower())))
    ordered = kept.orderBy("relation", "subject", "object", "period").offset((page - 1) * rows).limit(rows)
    return ordered


def entity_facts(edges: DataFrame, nodes: DataFrame, names: DataFrame) -> DataFrame:
    """All triples that touch any of ``names`` (by name or alias), with the asked ``entity``."""
    ids = find_node(names, nodes).where("node_id is not null").select(F.col("name").alias("entity"), F.col("node_id").alias("i"))
    ids = materialize(ids, "asked")  # few or many: joins to it go by its real size
    one = ids.select(F.col("i").alias("k")).distinct()
    ends = F.when(F.col("src_id") == F.col("dst_id"), F.array("src_id")).otherwise(F.array("src_id", "dst_id"))
    # the ends that are asked for, from one pass over the edges; names join what is left
    touched = edges.withColumn("own", F.explode(ends)).join(one, F.col("own") == F.col("k"), "left_semi")
    both = with_names(touched, nodes).join(ids, F.col("own") == F.col("i"))
    return both.select("entity", "subject", "relation", "object", "period")


def facts_by_relation(triples: DataFrame, relation: str) -> DataFrame:
    """Triples of a relation; a caller that shows them sorts by period."""
    return triples.where(F.col("relation") == relation)


def dated_facts(triples: DataFrame) -> DataFrame:
    """Triples with a period; a caller that shows them sorts by it."""
    return triples.where(F.length("period") > 0)


def name_cluster(start: DataFrame, alias_edges: DataFrame, hops: int | None = 10) -> DataFrame:
    """``(start, node)``: nodes within ``hops`` undirected alias edges (src, dst) of each start (column start); None: all reachable."""
    if hops is None:
        comp = materialize(connected_components(alias_edges), "clusters")
        own = start.select("start").distinct().join(comp.hint("merge"), F.col("start") == F.col("node"), "left").select("start", F.coalesce("component", "start").alias("c"))
        members = own.join(comp.select(F.col("node").alias("m"), "component").hint("merge"), F.col("c") == F.col("component"), "left")
        return members.select("start", F.coalesce("m", "start").alias("node"))
    both = materialize(alias_edges.select("src", "dst").unionByName(alias_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct(), "aliases")
    front = materialize(start.select("start", F.col("start").alias("node")).distinct(), "frontier")
    before, seen = front.limit(0), front
    for _ in range(hops):
        # what a node of one hop leads to lies in that hop, the one before or the next: no more of what was seen has to be looked at
        known = front.unionByName(before)
        step = front.join(both.hint("merge"), F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        new = materialize(step.join(known.hint("merge"), ["start", "node"], "left_anti"), "frontier")
        if new.isEmpty():
            break
        before, front, seen = front, new, seen.unionByName(new)
    return seen.select("start", "node")


def facts_for_entities(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Distinct edges that touch any node of each cluster (start, node)."""
    a = edges.join(clusters, F.col("src_id") == F.col("node"))
    return a.unionByName(edges.join(clusters, F.col("dst_id") == F.col("node"))).select("start", "src_id", "relation", "dst_id", "period").distinct()


def shortest_path(edges: DataFrame, a: int, b: int, most: int = 5) -> DataFrame:
    """``(hops, path)`` of one pair, as shortest_paths; no row without a path."""
    pair = edges.sparkSession.createDataFrame([(a, b)], "a long, b long")
    return shortest_paths(edges, pair, most).select("hops", "path")
