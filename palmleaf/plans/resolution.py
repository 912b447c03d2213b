"""Queries on names, spans and labels, with their SQL: names of the order tables as entities, documents as texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.functions import text as T
from palmleaf.operators import features, kg, mentions, names
from palmleaf.plans import essays, graph
from palmleaf.shared import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer")


def by_third(*values: str) -> F.Column:
    """One of three endings by the customer's key."""
    return F.when(F.col("c_custkey") % 3 == 0, values[0]).when(F.col("c_custkey") % 3 == 1, values[1]).otherwise(values[2])


@query("select c_custkey, c_name as name from customer")
def suffix_stripped(spark, sf):
    """Case endings that were put behind the names."""
    return customers(spark, sf).select("c_custkey", T.strip_suffix(F.concat("c_name", by_third("ගේ", "ට", ""))).alias("name"))


@query("select c_custkey, c_name as name from customer")
def title_stripped(spark, sf):
    return customers(spark, sf).select("c_custkey", T.strip_title(F.concat("c_name", by_third(" රජ", " මහරජු", ""))).alias("name"))


@query("select c_custkey, nfc_normalize(c_name || 'e' || chr(769)) as name from customer")
def nfc_names(spark, sf):
    return customers(spark, sf).select("c_custkey", T.nfc(F.concat(F.lit(" "), "c_name", F.lit("é "))).alias("name"))


@query("select c_custkey, lower(c_name) as key from customer")
def search_keys(spark, sf):
    return customers(spark, sf).select("c_custkey", T.search_key(F.concat(F.lit("‍"), "c_name", F.lit("‌"))).alias("key"))


@query("select o_orderkey, case when o_orderkey % 2 = 0 then 2 else 0 end::bigint as n, case when o_orderkey % 2 = 0 then 'ක්‍රි.ව. ' || year(o_orderdate)::varchar end as first from orders")
def date_mentions(spark, sf):
    year = F.year("o_orderdate").cast("string")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("a ක්‍රි.ව. "), year, F.lit(" b ක්‍රි.පූ."), year)).otherwise(year)
    found = T.date_mentions(text)
    return table(spark, sf, "orders").select("o_orderkey", F.size(found).cast("long").alias("n"), F.try_element_at(found, F.lit(1)).alias("first"))


@query("select distinct o_orderpriority as priority, nullif(regexp_replace(replace(replace(upper(trim(o_orderpriority)), ' ', '_'), '-', '_'), '[^A-Z0-9_]', '', 'g'), '') as relation from orders")
def sanitized_relations(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), T.sanitize_relation(F.col("o_orderpriority")).alias("relation")).distinct()


@query("select c_custkey, left(rtrim(regexp_replace(c_name, '[^A-Za-z0-9_-]+', '-', 'g') || '-e', '-'), 24) as slug from customer")
def slugs(spark, sf):
    return customers(spark, sf).select("c_custkey", T.slug(F.concat("c_name", F.lit("#é!"))).alias("slug"))


@query("select doc_id, case when length(text) > 70 then left(text, 70) || '…' else text end as preview from documents")
def previews(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("select n_nationkey, '[' || n_name || '](Place) in [' || r_name || '](Region) in ' || n_name as marked from nation join region on n_regionkey = r_regionkey")
def annotated_spans(spark, sf):
    """The first span has right places, the second wrong ones, and a third begins inside the first."""
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = j.withColumn("text", F.concat("n_name", F.lit(" in "), "r_name", F.lit(" in "), "n_name"))
    e = lambda name, label, start, end: F.struct(name.alias("entity"), F.lit(label).alias("label"), start.cast("int").alias("start"), end.cast("int").alias("end"))
    n, r = F.col("n_name"), F.col("r_name")
    spans = F.array(e(n, "Place", F.lit(0), F.length(n)), e(r, "Region", F.lit(900), F.lit(901)), e(F.substring(n, 2, 2), "Part", F.lit(1), F.lit(3)))
    return j.select("n_nationkey", T.annotate_spans(F.col("text"), T.place_spans(F.col("text"), spans)).alias("marked"))


@query("select event_id, case when event_id % 4 < 2 then 'LOCATION' when event_id % 4 = 2 then 'DATE_ERA' end as label, 'x' || event_id::varchar as piece from events")
def clean_labels(spark, sf):
    tag = F.when(F.col("event_id") % 4 == 0, "B-LOCATION").when(F.col("event_id") % 4 == 1, "i-location").when(F.col("event_id") % 4 == 2, " DATE_ERA").otherwise("B-NOTHING")
    piece = F.concat(F.when(F.col("event_id") % 2 == 0, "##x").otherwise("▁x"), F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", T.clean_label(tag).alias("label"), T.clean_piece(piece).alias("piece"))


@query("select doc_id, 'Coherence,D9' as keys from labels")
def renamed_keys(spark, sf):
    m = T.map_rename(F.create_map(F.lit("D2"), F.col("quality"), F.lit("D9"), F.col("toxic")), {"D2": "Coherence"})
    return table(spark, sf, "labels").select("doc_id", F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"))


@query("select event_id, case when user_id % 8 between 1 and 5 and event_id % 5 != 0 then cast(user_id % 8 as int) end as D1 from events")
def clamped_d1(spark, sf):
    value = F.when(F.col("event_id") % 5 == 0, "none").otherwise((F.col("user_id") % 8).cast("string"))
    return table(spark, sf, "events").select("event_id", T.clamp_d1(value).alias("D1"))


def alias_table(spark, sf) -> DataFrame:
    """Nations as aliases of their regions."""
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("n_nationkey").cast("int").alias("seq"), F.col("r_name").alias("canonical"), F.col("n_name").alias("alias"))


@query("select r_name as canonical, string_agg(n_name, ',' order by n_nationkey) as alternates from nation join region on n_regionkey = r_regionkey group by all")
def aliases_for(spark, sf):
    return names.aliases_for(alias_table(spark, sf)).select("canonical", F.array_join("alternates", ",").alias("alternates"))


def surface_forms(spark, sf) -> DataFrame:
    """Every second customer has a canonical form."""
    return customers(spark, sf).where("c_custkey % 2 = 0").select(F.col("c_name").alias("surface"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("canonical"))


@query("select c_custkey, case when c_custkey % 2 = 0 and c_custkey % 3 != 2 then 'C' || c_custkey::varchar when c_custkey % 3 = 0 then c_name || ' රජු' when c_custkey % 3 = 1 then c_name || 'ගේ' else c_name || ' xx' end as normal from customer")
def normalized_entities(spark, sf):
    rows = customers(spark, sf).select("c_custkey", F.concat("c_name", by_third(" රජු", "ගේ", " xx")).alias("name"))
    return names.normalize_entity(rows, surface_forms(spark, sf)).select("c_custkey", "normal")


JOINED_NAMES = """
select o_orderkey, case when c_custkey % 2 = 0 and o_orderkey % 3 != 2 then 'C' || c_custkey::varchar
  when o_orderkey % 3 = 0 then c_name || ' රජු' when o_orderkey % 3 = 1 then c_name || 'ගේ' else c_name || ' xx' end as normal
from orders join customer on o_custkey = c_custkey"""


@query(JOINED_NAMES)
def joined_entities(spark, sf):
    """Names of orders' customers, a customer's name once in the dictionary however many orders have it: the rows come out of a shuffle."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rows = orders.join(customers(spark, sf).hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    ending = F.when(F.col("o_orderkey") % 3 == 0, " රජු").when(F.col("o_orderkey") % 3 == 1, "ගේ").otherwise(" xx")
    rows = rows.withColumn("name", F.concat("c_name", ending))
    return names.normalize_entity(rows, surface_forms(spark, sf)).select("o_orderkey", "normal")


@query("select c_custkey, case when c_custkey % 2 = 0 then 'C' || c_custkey::varchar when c_custkey % 3 = 0 then r_name else c_name end as canonical from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def canonical_entities(spark, sf):
    """Case ending off, then surface forms, then aliases (some customers are named by their nation, an alias of its region)."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    rows = customers(spark, sf).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when((F.col("c_custkey") % 2 == 1) & (F.col("c_custkey") % 3 == 0), F.col("n_name")).otherwise(F.col("c_name"))
    rows = rows.select("c_custkey", F.concat(name, by_third("", "ගේ", "ට"), F.lit(" ")).alias("name"))
    return names.canonical_entity(rows, surface_forms(spark, sf), alias_table(spark, sf)).select("c_custkey", "canonical")


@query("select c_custkey, case when c_custkey % 2 = 0 then 'C' || c_custkey::varchar else c_name end as subject, 'LOCATED_IN' as relation, n_name as object, '' as period from customer join nation on c_nationkey = n_nationkey where c_custkey % 5 != 0")
def normalized_triples(spark, sf):
    j = customers(spark, sf).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = j.select("c_custkey", F.col("c_name").alias("subject"), F.when(F.col("c_custkey") % 5 == 0, "unheard of").when(F.col("c_custkey") % 2 == 0, "lives in").otherwise("located_in").alias("relation"), F.col("n_name").alias("object"), F.lit(None).cast("string").alias("period"))
    synonyms = table(spark, sf, "region").limit(1).select(F.lit("Lives in").alias("surface"), F.lit("LOCATED_IN").alias("relation"))
    return names.normalize_triples(rows, surface_forms(spark, sf), synonyms).select("c_custkey", "subject", "relation", "object", "period")


@query("with s as (select 1 as p, n_nationkey as seq, n_name as name, 'N' || n_nationkey::varchar as c from nation union all select 2, c_custkey, c_name, 'C' || c_custkey::varchar from customer union all select 3, c_custkey, n_name, 'late' from customer join nation on c_nationkey = n_nationkey) select name as key, first(c order by p, seq) as canonical from s where c != 'C1' group by name")
def name_index(spark, sf):
    """Nations, then customers with a title, then nations again under another name; one customer is excluded."""
    c = customers(spark, sf)
    rows = table(spark, sf, "nation").select(F.lit(1).alias("priority"), F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("name"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("canonical"))
    rows = rows.unionByName(c.select(F.lit(2).alias("priority"), F.col("c_custkey").alias("seq"), F.concat("c_name", F.lit(" රජු")).alias("name"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("canonical")))
    late = c.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit(3).alias("priority"), F.col("c_custkey").alias("seq"), F.col("n_name").alias("name"), F.lit("late").alias("canonical"))
    out = names.name_index(rows.unionByName(late), c.where("c_custkey = 1").select(F.lit("C1").alias("canonical")))
    return out.where(~F.col("key").endswith(" රජු"))


@query("with g as (select p_partkey, p_name || ' #' || p_partkey::varchar as name, count(*) over w as n, lag(p_partkey) over o is null or lead(p_partkey) over o is null as is_end, p_brand, p_type, p_size from part window w as (partition by p_brand, p_type, p_size), o as (partition by p_brand, p_type, p_size order by p_partkey)) select name, first_value(name) over (partition by p_brand, p_type, p_size order by case when p_partkey % 2 = 0 then length(name) else 0 end desc, case when is_end then 1 else 2 end desc, name desc) as representative from g where n > 1")
def alias_representatives(spark, sf):
    part = table(spark, sf, "part").select((F.lit(4 * graph.STEP) + F.col("p_partkey")).alias("id"), F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_partkey") % 2 == 0).alias("known"))
    e = graph.alias_edges(spark, sf)
    e = e.join(part.select(F.col("id").alias("src_id"), F.col("name").alias("src")), "src_id").join(part.select(F.col("id").alias("dst_id"), F.col("name").alias("dst")), "dst_id")
    return names.alias_clusters(e.select("src", "dst"), part.where("known").select(F.col("name").alias("canonical")))


RUNS = "with runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+')) as w, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), 1) as k from documents), placed as (select doc_id, w, sum(length(w)) over (partition by doc_id order by k) - length(w) as start from runs), m as (select doc_id as text_id, upper(w) as canonical, cast(start as int) as start from placed where w in ('the', 'la', 'die', 'el'))"


@query(RUNS + " select * from m")
def mentions_exact(spark, sf):
    """Whole words of a short list in the documents."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    listed = spark.createDataFrame([(i, w, w.upper()) for i, w in enumerate(essays.INFORMAL)], "seq int, name string, canonical string")
    return names.find_mentions(texts, listed, "A-Za-z", ())


@query(RUNS + ", r as (select text_id as essay_id, canonical as name, count(*) as n, min(start) as first from m group by all) select essay_id, first(name order by case when name in ('THE', 'LA') then 0 else 1 end, n desc, first, name) as subject, string_agg(name, ',' order by first, n desc, name) as others from r group by all")
def essay_subjects(spark, sf):
    found = mentions_exact(spark, sf).select(F.col("text_id").alias("essay_id"), F.col("canonical").alias("name"), F.col("start").alias("at"))
    facts = table(spark, sf, "region").limit(1).select(F.explode(F.array(F.lit("THE"), F.lit("LA"))).alias("name"))
    return names.essay_subject(found, facts).select("essay_id", "subject", F.array_join("others", ",").alias("others"))


@query("with t as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) as token from documents where doc_id not in (select distinct doc_id from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from documents) where w = 'die')) select doc_id as text_id, token, 'XQZ' as canonical, 1.0::double as ratio from t where token = 'que'")
def mentions_fuzzy(spark, sf):
    """Tokens alike to a name, of texts without exact mentions; with ratio 1 only equal ones are."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    listed = spark.createDataFrame([("que", "XQZ")], "name string, canonical string")
    out = mentions.find_mentions_fuzzy(texts, listed, mentions_exact(spark, sf).where("canonical = 'DIE'"), 1.0, "[A-Za-z]+")
    return out.select("text_id", "token", "canonical", "ratio").distinct()


def benchmark_names(spark, sf) -> DataFrame:
    """Different words of five letters and more of the benchmark texts as names, in alphabetical order."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{5,})"), F.lit(1))).alias("name"))
    return words.distinct().select("name", F.upper("name").alias("canonical"), F.lit(0).alias("seq"))


@query("""
with known as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) as w from benchmark),
runs as (
  select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+')) as w,
    generate_subscripts(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), 1) as k from documents),
placed as (select doc_id, w, sum(length(w)) over (partition by doc_id order by k) - length(w) as start from runs)
select doc_id as text_id, upper(w) as canonical, cast(start as int) as start from placed where w in (select w from known)""")
def mentions_of_many(spark, sf):
    """Whole words of the documents that are among all words of the benchmark."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return mentions.find_mentions(texts, benchmark_names(spark, sf), "A-Za-z", ())


@query()
def mentions_misspelt(spark, sf):
    """Words at a ratio of 0.85 to a word of the benchmark, in documents that hold none exactly; tests hold the operator against all pairs."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return mentions.find_mentions_fuzzy(texts, benchmark_names(spark, sf), mentions_of_many(spark, sf), 0.85, "[A-Za-z]+")


@query("""
select n_nationkey as sent_id, unnest([n_name, n_name || 'ගේ', left(n_name, 3), 'the same ' || n_nationkey, 'x විසින් ' || n_name, 'zzz']) as candidate,
  unnest([n_name, n_name, n_name, n_name, n_name, null]) as entity, unnest([1, 2, 3, 4, 5, null]) as tier
from nation where length(n_name) > 3""")
def resolved_tags(spark, sf):
    n = table(spark, sf, "nation").where("length(n_name) > 3")
    forms = F.array(F.col("n_name"), F.concat("n_name", F.lit("ගේ")), F.left("n_name", F.lit(3)), F.concat(F.lit("the same "), F.col("n_nationkey").cast("string")), F.concat(F.lit("x විසින් "), "n_name"), F.lit("zzz"))
    candidates = n.select(F.col("n_nationkey").alias("sent_id"), F.explode(forms).alias("candidate"))
    surface = n.select(F.concat(F.lit("the same "), F.col("n_nationkey").cast("string")).alias("surface"), F.col("n_name").alias("canonical"))
    candidates = names.with_form(candidates, names.normal_forms(candidates, surface, ("candidate",)), "candidate", "normal")
    tags = n.select(F.col("n_nationkey").alias("sent_id"), F.col("n_name").alias("entity"), F.col("n_name").alias("normal"))
    return names.resolve_tiers(candidates, tags).drop("normal")


@query(graph.SQL_GRAPH + "select name, label from nodes")
def node_names(spark, sf):
    return kg.node_names(graph.nodes(spark, sf))


@query(graph.SQL_GRAPH + "select subject, relation, object, period from named where subject = 'ASIA' or object = 'ASIA'")
def focus(spark, sf):
    return kg.focus(graph.triples(spark, sf), "ASIA").select("subject", "relation", "object", "period")


@query(graph.SQL_GRAPH + "select node_id, name, case when node_id % 2 = 0 and label = 'King' then 'Monk' else label end as label from nodes")
def relabelled_nodes(spark, sf):
    n = graph.nodes(spark, sf)
    change = n.where("label = 'King'").select("name", F.when(F.col("node_id") % 2 == 0, "Monk").otherwise("No such label").alias("new_label"))
    return kg.update_labels(n, change).select("node_id", "name", "label")


@query(graph.SQL_GRAPH + "select src_id, relation, dst_id from edges where not (relation = 'LOCATED_IN' and src_id >= 3000000000000)")
def delete_edges_by_alias(spark, sf):
    """Edges named by the lower-cased names of their ends."""
    n, e = graph.graph(spark, sf)
    gone = kg.with_names(e.where("relation = 'LOCATED_IN' and src_id >= 3000000000000"), n).select(F.lower("subject").alias("subject"), "relation", F.lower("object").alias("object"))
    gone = gone.withColumn("object", F.upper("object"))
    return kg.delete_edges(e, n, gone, by_alias=True).select("src_id", "relation", "dst_id")


@query(graph.SQL_GRAPH + ", s as (select src_id, subject, object, src_id % 3 as k from named where relation = 'LOCATED_IN' and src_id >= 3000000000000) select case k when 0 then subject when 1 then subject else '' end as subject, case k when 0 then 'RULED' when 1 then 'LOCATED_IN' else 'RULED' end as relation, object, case k when 0 then 'created' when 1 then 'no change' else 'missing field' end as status from s")
def edited_triples(spark, sf):
    return edited(spark, sf)[2]


def edited(spark, sf):
    """Nodes, edges and statuses after edits of the customers' places."""
    n, e = graph.graph(spark, sf)
    n = n.withColumn("aliases", F.array().cast("array<string>"))
    old = kg.with_names(e.where("relation = 'LOCATED_IN' and src_id >= 3000000000000"), n)
    k = F.col("src_id") % 3
    edits = old.select(F.col("subject").alias("old_subject"), F.col("relation").alias("old_relation"), F.col("object").alias("old_object"), F.when(k == 2, "").otherwise(F.col("subject")).alias("subject"), F.when(k == 1, "LOCATED_IN").otherwise("RULED").alias("relation"), "object", F.lit("").alias("period"))
    return kg.edit_triples(n, e, edits)


@query(graph.SQL_GRAPH + """
, s as (select subject, object, src_id % 3 as k from named where relation = 'LOCATED_IN' and src_id >= 3000000000000)
select subject, relation, object, source_citation from (
  select subject, relation, object, 'tables' as source_citation, src_id from named) t
where not (relation = 'LOCATED_IN' and src_id >= 3000000000000 and src_id % 3 = 0)
union all select subject, 'RULED', object, '[manual]' from s where k = 0""")
def edited_edges(spark, sf):
    """The edges that edited_triples leaves, by the names of their ends."""
    n, e, _ = edited(spark, sf)
    return kg.with_names(e, n).select("subject", "relation", "object", "source_citation")


@query("""
select 'C' || c_custkey::varchar as subject, 'LOCATED_IN' as relation, r_name as object
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_custkey % 2 = 0""")
def saved_edges(spark, sf):
    """The edges that saved_extraction makes, by the names of their ends."""
    n, _, after, edges, _ = saved(spark, sf)
    return kg.with_names(edges, after).select("subject", "relation", "object")


@query("select 'nodes created' as what, (select count(*) from customer where c_custkey % 2 = 0) + (select count(distinct r_name) from region) as n union all select 'triples created', count(*) from customer where c_custkey % 2 = 0 union all select 'triples missing node', count(*) from customer where c_custkey % 2 = 1 and c_custkey % 5 != 0 union all select 'triples duplicate', count(*) from customer where false having count(*) > 0")
def saved_extraction(spark, sf):
    n, _, after, _, status = saved(spark, sf)
    return kg.save_counts(n, after, status)


def saved(spark, sf):
    """Customers and nations as tags over an empty graph: ends of triples become canonical names. Before, after and the statuses."""
    c = customers(spark, sf).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    none = F.array().cast("array<string>")
    tags = c.where("c_custkey % 2 = 0").select(F.concat("c_name", F.lit("ගේ")).alias("entity"), F.lit("PERSON_KING").alias("label"), none.alias("aliases"))
    places = table(spark, sf, "nation").select(F.col("n_name").alias("entity"), F.lit("LOCATION").alias("label"), none.alias("aliases"))
    dates = table(spark, sf, "nation").select(F.lit("1815").alias("entity"), F.lit("DATE_ERA").alias("label"), none.alias("aliases"))
    triples = c.where("c_custkey % 2 = 0 or c_custkey % 5 != 0").select(F.col("c_name").alias("subject"), F.lit("LOCATED_IN").alias("relation"), F.col("n_name").alias("object"), F.lit("").alias("period"), F.lit("s").alias("source"))
    n, e = (x.limit(0) for x in graph.graph(spark, sf))
    return n, e, *kg.save_extraction(n, e, tags.unionByName(places).unionByName(dates), triples, surface_forms(spark, sf), alias_table(spark, sf))


@query(graph.SQL_GRAPH + ", pos as (select *, src_id * 10 as p from named where relation = 'LOCATED_IN') select name, min(p) as first from (select subject as name, p from pos union all select object, p from pos) where contains(lower(name), 'a') group by all")
def searched_names(spark, sf):
    t = kg.with_names(graph.edges(spark, sf).where("relation = 'LOCATED_IN'"), graph.nodes(spark, sf))
    return kg.name_search(t.select((F.col("src_id") * 10).alias("pos"), "subject", "object"), "A")


@query(graph.SQL_GRAPH + f", c as (select p_partkey, first_value(p_partkey) over (partition by p_brand, p_type, p_size order by p_partkey) as f from part) select {4 * graph.STEP} + f as start, src_id, relation, dst_id, period from c join edges on src_id = {4 * graph.STEP} + p_partkey or dst_id = {4 * graph.STEP} + p_partkey group by all")
def facts_static_closure(spark, sf):
    """As facts_for_entities, over whole clusters however long."""
    first = table(spark, sf, "part").groupBy("p_brand", "p_type", "p_size").agg(F.min("p_partkey").alias("k")).select((F.lit(4 * graph.STEP) + F.col("k")).alias("start"))
    links = graph.alias_edges(spark, sf).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    return kg.facts_for_entities(graph.edges(spark, sf), kg.name_cluster(first, links, None))


@query("with t as (select doc_id, unnest(string_split(text, ' ')) as w from documents) select 'WORD' as label, count(*) as n from t where w != ''")
def span_counts(spark, sf):
    """Words as spans of one class; what goes on with a span has its own mark."""
    rows = table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("w")).where("w != ''").select(F.explode(F.array(F.lit("B-WORD"), F.lit("I-WORD"), F.lit("O"))).alias("tag"))
    return features.label_span_counts(rows)
