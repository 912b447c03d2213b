"""Queries on the knowledge graph made of the order tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palmleaf.operators import kg, names, paths
from palmleaf.shared import materialize, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
STEP = 10**12
KINDS = {"region": ("r_regionkey", "r_name", "Place"), "nation": ("n_nationkey", "n_name", "Place"), "supplier": ("s_suppkey", "s_name", "Person"), "customer": ("c_custkey", "c_name", "King"), "part": ("p_partkey", "p_name", "Relic")}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = SQL_GRAPH + sql
        return f

    return add


def _node_sql() -> str:
    return " union all ".join(f"select {i * STEP} + {k} as node_id, {'upper(' + n + ')' if t == 'nation' else n} || {repr(' #') + ' || ' + k + '::varchar' if t == 'part' else repr('')} as name, '{lab}' as label from {t}" for i, (t, (k, n, lab)) in enumerate(KINDS.items()))


SQL_GRAPH = f"""with nodes as ({_node_sql()}), part_alias as (select p_partkey, lag(p_partkey) over (partition by p_brand, p_type, p_size order by p_partkey) as before from part),
edges as (select {STEP} + n_nationkey as src_id, 'LOCATED_IN' as relation, 0 + n_regionkey as dst_id, '' as period from nation union all select {2 * STEP} + s_suppkey, 'LOCATED_IN', {STEP} + s_nationkey, '' from supplier
 union all select {3 * STEP} + c_custkey, 'LOCATED_IN', {STEP} + c_nationkey, '' from customer union all select {2 * STEP} + l_suppkey, 'SUPPLIED', {4 * STEP} + l_partkey, min(year(l_shipdate))::varchar from lineitem group by l_suppkey, l_partkey
 union all select {3 * STEP} + o_custkey, 'ORDERED', {4 * STEP} + l_partkey, min(year(o_orderdate))::varchar from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_partkey
 union all select {4 * STEP} + before, 'ALSO_KNOWN_AS', {4 * STEP} + p_partkey, '' from part_alias where before is not null),
named as (select e.*, a.name as subject, a.label as subject_label, b.name as object, b.label as object_label from edges e join nodes a on a.node_id = src_id join nodes b on b.node_id = dst_id)
"""


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for i, (t, (k, n, label)) in enumerate(KINDS.items()):
        name = F.upper(n) if t == "nation" else F.concat(n, F.lit(" #"), F.col(k).cast("string")) if t == "part" else F.col(n)
        rows = table(spark, sf, t).select((F.lit(i * STEP) + F.col(k)).alias("node_id"), name.alias("name"), F.lit(label).alias("label"), F.array(F.lower(n)).alias("aliases"))
        out = rows if out is None else out.unionByName(rows)
    return out


def alias_edges(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("p_partkey").over(Window.partitionBy("p_brand", "p_type", "p_size").orderBy("p_partkey"))
    return table(spark, sf, "part").select(before.alias("before"), "p_partkey").where("before is not null").select((F.lit(4 * STEP) + F.col("before")).alias("src_id"), (F.lit(4 * STEP) + F.col("p_partkey")).alias("dst_id"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    def edge(src, relation, dst, period):
        return src.alias("src_id"), F.lit(relation).alias("relation"), dst.alias("dst_id"), period.alias("period")

    at = lambda i, c: F.lit(i * STEP) + F.col(c)
    line, orders, none = table(spark, sf, "lineitem"), table(spark, sf, "orders"), F.lit("")
    year = lambda c: F.min(F.year(c)).cast("string").alias("period")
    supplied = line.groupBy("l_suppkey", "l_partkey").agg(year("l_shipdate"))
    ordered = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(year("o_orderdate"))
    rows = [
        table(spark, sf, "nation").select(*edge(at(1, "n_nationkey"), "LOCATED_IN", F.col("n_regionkey").cast("long"), none)),
        table(spark, sf, "supplier").select(*edge(at(2, "s_suppkey"), "LOCATED_IN", at(1, "s_nationkey"), none)),
        table(spark, sf, "customer").select(*edge(at(3, "c_custkey"), "LOCATED_IN", at(1, "c_nationkey"), none)),
        supplied.select(*edge(at(2, "l_suppkey"), "SUPPLIED", at(4, "l_partkey"), F.col("period"))),
        ordered.select(*edge(at(3, "o_custkey"), "ORDERED", at(4, "l_partkey"), F.col("period"))),
        alias_edges(spark, sf).select("src_id", F.lit(kg.ALIAS).alias("relation"), "dst_id", none.alias("period")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumns({"source_citation": F.lit("tables"), "confidence": F.lit(1.0)})


def graph(spark, sf):
    return nodes(spark, sf), edges(spark, sf)


def triples(spark, sf):
    n, e = graph(spark, sf)
    return kg.all_triples(e, n)


@query("select 'node' as kind, label as key, count(*) as n from nodes group by all union all select 'edge', relation, count(*) from edges group by all")
def kg_stats(spark, sf):
    return kg.stats(*graph(spark, sf))


@query("select distinct relation from edges")
def relation_types(spark, sf):
    return kg.relation_types(edges(spark, sf))


@query("select subject, object from named where relation = 'ALSO_KNOWN_AS'")
def also_known_as(spark, sf):
    n, e = graph(spark, sf)
    return kg.also_known_as(e, n)


@query("select subject, subject_label, relation, object, object_label, period from named")
def all_triples(spark, sf):
    return triples(spark, sf).drop("source_citation")


DEGREES = ", deg as (select node_id, name, count(x) as degree from nodes left join (select src_id as x from edges union all select dst_id from edges where src_id != dst_id) on x = node_id group by all) "


@query(DEGREES + "select node_id, name, degree from deg order by degree desc, name limit 10")
def top_connected(spark, sf):
    return kg.top_connected(*graph(spark, sf))


@query(DEGREES + "select node_id, name, degree, greatest(12, least(40, 12 + 4 * degree)) as size from deg")
def node_degree_size(spark, sf):
    return kg.degree_size(*graph(spark, sf))


@query("select n.node_id, n.name, (select count(*) from edges where src_id = n.node_id) as n_out, (select count(*) from edges where dst_id = n.node_id) as n_in from nodes n")
def node_detail(spark, sf):
    d = kg.node_detail(*graph(spark, sf))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return d.select("node_id", "name", F.greatest(size("outgoing"), F.lit(0)).alias("n_out"), F.greatest(size("incoming"), F.lit(0)).alias("n_in"))


@query("select subject, relation, object, period from named where period != ''")
def dated_facts(spark, sf):
    return kg.dated_facts(triples(spark, sf)).select("subject", "relation", "object", "period")


@query("select subject, object, period from named where relation = 'SUPPLIED'")
def facts_by_relation(spark, sf):
    return kg.facts_by_relation(triples(spark, sf), "SUPPLIED").select("subject", "object", "period")


@query("select subject, relation, object, period from named where contains(lower(subject), 'supplier') order by relation, subject, object, period limit 20 offset 20")
def relation_browser_page(spark, sf):
    return kg.relation_page(triples(spark, sf), "supplier", 2).select("subject", "relation", "object", "period")


@query("select subject, relation, object from named where subject_label in ('Person', 'Place') and object_label in ('Person', 'Place') and relation in ('LOCATED_IN', 'SUPPLIED')")
def filter_triples(spark, sf):
    return kg.filter_triples(triples(spark, sf), ["Person", "Place"], ["LOCATED_IN", "SUPPLIED"]).select("subject", "relation", "object")


def neighbourhood_sql() -> str:
    """Only regions hold the term, so only the edges from their nations lie among hits and neighbours."""
    return f"select {STEP} + n_nationkey as src_id, 'LOCATED_IN' as relation, 0 + n_regionkey::bigint as dst_id from nation join region on n_regionkey = r_regionkey where contains(lower(r_name), 'asia')"


def neighbourhood(spark, sf):
    return kg.neighbourhood(*graph(spark, sf), "asia").select("src_id", "relation", "dst_id")


QUERIES["neighbourhood"], ORACLE["neighbourhood"] = neighbourhood, neighbourhood_sql()


@query("select name as entity, subject, relation, object, period from nodes join named on src_id = node_id or dst_id = node_id where label = 'Place'")
def entity_facts(spark, sf):
    n, e = graph(spark, sf)
    return kg.entity_facts(e, n, n.where(F.col("label") == "Place").select("name"))


@query(f"select {4 * STEP} + p_partkey as node, {4 * STEP} + min(p_partkey) over (partition by p_brand, p_type, p_size) as component from part qualify count(*) over (partition by p_brand, p_type, p_size) > 1")
def alias_components(spark, sf):
    return kg.connected_components(alias_edges(spark, sf), "src_id", "dst_id")


@query("select node_id, name from nodes n where exists (select 1 from edges where src_id = n.node_id or dst_id = n.node_id)")
def largest_component(spark, sf):
    return kg.largest_component(*graph(spark, sf)).select("node_id", "name")


@query(f", c as (select p_partkey, row_number() over (partition by p_brand, p_type, p_size order by p_partkey) as r, first_value(p_partkey) over (partition by p_brand, p_type, p_size order by p_partkey) as f from part) select {4 * STEP} + f as start, src_id, relation, dst_id, period from c join edges on src_id = {4 * STEP} + p_partkey or dst_id = {4 * STEP} + p_partkey where r <= 11 group by all")
def facts_for_entities(spark, sf):
    first = table(spark, sf, "part").groupBy("p_brand", "p_type", "p_size").agg(F.min("p_partkey").alias("k")).select((F.lit(4 * STEP) + F.col("k")).alias("start"))
    links = alias_edges(spark, sf).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    # clusters and edges are read twice
    return kg.facts_for_entities(materialize(edges(spark, sf), "edges"), materialize(kg.name_cluster(first, links), "clusters"))


@query(", n as (select * from nation where n_regionkey = (select min(n_regionkey) from nation) order by n_nationkey limit 2) select distinct cast(2 as int) as hops from n a join n b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def shortest_path(spark, sf):
    """Between two nations of one region: the path goes through it."""
    nation = table(spark, sf, "nation")
    a, b = [r["n_nationkey"] for r in nation.where(F.col("n_regionkey") == nation.agg(F.min("n_regionkey")).first()[0]).orderBy("n_nationkey").limit(2).collect()]
    return kg.shortest_path(edges(spark, sf), STEP + a, STEP + b).select("hops")


PAIRS = f"""
, s as (select {2 * STEP} + s_suppkey as b, {STEP} + s_nationkey as n, n_regionkey as r, s_suppkey from supplier join nation on s_nationkey = n_nationkey),
p as (select x.b as a, y.b as b, x.n as n, y.n as sn, x.r as r, y.r as sr from s x join s y on y.s_suppkey = x.s_suppkey + 1)
select a, b, case when n = sn then 2 else 4 end as hops, case when n = sn then a || ',' || n || ',' || b else a || ',' || n || ',' || r || ',' || sn || ',' || b end as path
from p where n = sn or r = sr"""


@query(PAIRS)
def shortest_paths(spark, sf):
    """From each supplier to the next, through nations and regions: two edges, four, or no path; nations are hubs that hold all their customers, too."""
    s = table(spark, sf, "supplier").select((F.lit(2 * STEP) + F.col("s_suppkey")).alias("a"))
    following = s.select(F.col("a").alias("b"))
    pairs = s.join(following.hint("merge"), F.col("a") + 1 == F.col("b"))
    out = paths.shortest_paths(edges(spark, sf).where("relation = 'LOCATED_IN'"), pairs)
    return out.select("a", "b", "hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query(f""", facts as (
  select src_id as node_id, 'out' as direction, relation, object as name, period from named
  union all select dst_id, 'in', relation, subject, period from named),
placed as (select *, row_number() over (partition by node_id order by direction desc, relation, name, period) as place from facts)
select node_id, place, direction, relation, name, period from placed where place between 21 and 40""")
def node_pages(spark, sf):
    """The second page of the facts of every node: nations hold all their customers, parts all their orders."""
    n, e = graph(spark, sf)
    return kg.node_facts(n, e, n, 2)


@query("select node_id, name, label, case when label = 'Person' then 2 else 1 end as n_aliases from nodes union all select null, 'brand new ' || r_name, 'Place', 1 from region")
def upsert_nodes(spark, sf):
    n = nodes(spark, sf)
    old = n.where("label = 'Person'").select("name", "label", F.array(F.concat(F.lit("alias of "), "name")).alias("aliases"))
    new = table(spark, sf, "region").select(F.concat(F.lit("brand new "), "r_name").alias("name"), F.lit("Place").alias("label"), F.array(F.lower("r_name")).alias("aliases"))
    out = kg.upsert_nodes(n, old.unionByName(new))
    return out.select(F.when(~F.startswith("name", F.lit("brand new ")), F.col("node_id")).alias("node_id"), "name", "label", F.size("aliases").alias("n_aliases"))


@query("select status, count(*) as n from (select 'duplicate' as status from named where relation = 'LOCATED_IN' union all select 'created' from named where relation = 'LOCATED_IN' union all select 'missing node' from nation) group by all")
def upsert_edges(spark, sf):
    n, e = graph(spark, sf)
    n = n.withColumn("aliases", F.array().cast("array<string>"))
    known = kg.with_names(e.where("relation = 'LOCATED_IN'"), n).select("subject", "relation", "object", "period", F.lit("x").alias("source"))
    missing = table(spark, sf, "nation").select(F.concat(F.lit("no "), "n_name").alias("subject"), F.lit("RULED").alias("relation"), F.col("n_name").alias("object"), F.lit("").alias("period"), F.lit("x").alias("source"))
    return kg.upsert_edges(e, n, known.unionByName(known.withColumn("relation", F.lit("RULED"))).unionByName(missing))[1].groupBy("status").agg(F.count("*").alias("n"))


@query("select src_id, relation, dst_id from edges where not (relation = 'LOCATED_IN' and src_id >= 3000000000000)")
def delete_edges(spark, sf):
    n, e = graph(spark, sf)
    gone = kg.with_names(e.where("relation = 'LOCATED_IN' and src_id >= 3000000000000"), n).select("subject", "relation", "object")
    return kg.delete_edges(e, n, gone).select("src_id", "relation", "dst_id")


@query("select src_id, case when relation = 'SUPPLIED' then 'BUILT' else relation end as relation, dst_id, case when relation = 'SUPPLIED' and dst_id % 2 = 0 then 'now' else period end as period from edges")
def update_edges(spark, sf):
    e = edges(spark, sf)
    change = e.where("relation = 'SUPPLIED'").select("src_id", "relation", "dst_id", F.lit("BUILT").alias("new_relation"), F.when(F.col("dst_id") % 2 == 0, "now").alias("period"), F.lit("edit").alias("source_citation"))
    return kg.update_edges(e, change).select("src_id", "relation", "dst_id", "period")


@query(f"select relation, count(*) as n from (select distinct case when src_id < {2 * STEP} and src_id >= {STEP} then {STEP} else src_id end as s, relation, case when dst_id < {2 * STEP} and dst_id >= {STEP} then {STEP} else dst_id end as d from edges) where s != d group by all")
def merge_nodes(spark, sf):
    n, e = graph(spark, sf)
    m = n.where(F.col("node_id").between(STEP + 1, 2 * STEP - 1)).select(F.col("node_id").alias("from_id"), F.lit(STEP).alias("to_id"))
    return kg.merge_nodes(n, e, m)[1].groupBy("relation").agg(F.count("*").alias("n"))


CHAINS = f""", homes as (
  select {2 * STEP} + s.s_suppkey as f, {2 * STEP} + min(e.s_suppkey) as t from supplier s join supplier e
  on e.s_suppkey >= s.s_suppkey and e.s_suppkey < s.s_suppkey + 4 and (e.s_suppkey % 4 = 3 or e.s_suppkey + 1 not in (select s_suppkey from supplier))
  group by s.s_suppkey),
moved as (
  select coalesce(a.t, src_id) as s, relation, coalesce(b.t, dst_id) as d, period,
    case when coalesce(a.t, src_id) != src_id or coalesce(b.t, dst_id) != dst_id then 1 else 0 end as m
  from edges left join homes a on a.f = src_id left join homes b on b.f = dst_id)
select s as src_id, relation, d as dst_id, first(period order by m, period) as period from moved where m = 0 or s != d group by s, relation, d"""


@query(CHAINS)
def merged_chains(spark, sf):
    """Suppliers in chains of four, each merged into the next: all edges end at the last of a chain."""
    n, e = graph(spark, sf)
    supplier = table(spark, sf, "supplier").select("s_suppkey")
    after = supplier.select((F.col("s_suppkey") - 1).alias("before"))
    links = supplier.where("s_suppkey % 4 != 3").join(after, F.col("s_suppkey") == F.col("before"))
    m = links.select((F.lit(2 * STEP) + F.col("s_suppkey")).alias("from_id"), (F.lit(2 * STEP + 1) + F.col("s_suppkey")).alias("to_id"))
    return kg.merge_nodes(n, e, m)[1].select("src_id", "relation", "dst_id", "period")


@query(f" select case when node_id < {5 * STEP} then node_id end as node_id, name, label, n_aliases from (select node_id, name, label, 1 + case when label = 'Place' and node_id < {STEP} then 2 else 0 end as n_aliases from nodes union all select {5 * STEP}, 'new of ' || r_name, 'Battle', 2 from region)")
def upserted_batch(spark, sf):
    """A batch that speaks of its own names: of each region a new node with an alias, then a row of that alias, and aliases for the region itself, once by its name and once by its alias."""
    n, region = nodes(spark, sf), table(spark, sf, "region")
    row = lambda seq, name, label, *aliases: F.struct(F.lit(seq).alias("seq"), name.alias("name"), F.lit(label).alias("label"), F.array(*aliases).cast("array<string>").alias("aliases"))
    name = F.col("r_name")
    word = lambda w: F.concat(F.lit(w), name)
    rows = [row(1, word("new of "), "Battle", word("other ")), row(2, word("other "), "Monk", word("third ")), row(3, name, "King", word("once ")), row(4, F.lower(name), "King", word("again "), word("once "))]
    batch = region.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    out = kg.upsert_nodes(n, batch)
    return out.select(F.when(~F.startswith("name", F.lit("new of ")), F.col("node_id")).alias("node_id"), "name", "label", F.size("aliases").cast("long").alias("n_aliases"))


@query(f"select relation, count(*) as n from edges where src_id < {3 * STEP} or src_id >= {4 * STEP} group by all")
def delete_nodes(spark, sf):
    n, e = graph(spark, sf)
    return kg.delete_nodes(n, e, n.where("label = 'King'").select("node_id"))[1].groupBy("relation").agg(F.count("*").alias("n"))


@query("select n.name, coalesce(first.name, n.name) as canonical from nodes n left join (select lower(name) as low, name from nodes where label = 'Place') first on first.low = n.name")
def resolve_names(spark, sf):
    n = nodes(spark, sf)
    al = n.where("label = 'Place'").select(F.col("node_id").alias("seq"), F.col("name").alias("canonical"), F.lower("name").alias("alias"))
    return names.resolve_to_canonical(n.select("name"), al)


@query("select relation, count(*) as n, max(case relation when 'LOCATED_IN' then 'LOCATED_IN' when 'SUPPLIED' then 'SERVED' end) as normal_relation from edges group by all")
def normalize_relation(spark, sf):
    syn = spark.sql("select 'supplied' as surface, 'SERVED' as relation")
    out = names.normalize_relation(edges(spark, sf), syn)
    return out.groupBy("relation").agg(F.count("*").alias("n"), F.max("normal_relation").alias("normal_relation"))
