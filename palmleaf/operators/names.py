"""Name resolution through alias tables.

Alias tables: aliases(seq, canonical, alias), surface_forms(surface, canonical), relation_synonyms(surface, relation).
Lookup tables are joined as given; Spark broadcasts them where their size is known to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.functions import text as T
from palmleaf.operators import mentions
from palmleaf.operators.components import connected_components
from palmleaf.shared import materialize

# Endings that may follow a name, titles tried in a lookup, and the closed list of relations.
LOOKUP_SUFFIXES = (" රජු", " රාජ", " රාජා", " හිමි", " හාමුදුරුවෝ", " හාමුදුරුවන්", " හිමිණිය", " ආචාර්ය", "ගේ", "ෙහි")
CONTINUATIONS = (*T.TITLES, "ගේ", "ෙන්", "ෙහි", "ේදී", "හිදී", "ෙකු", "හු", "ට", "ේ", "ව", "න්")
SINHALA_CLASS = "඀-෿"
RELATIONAL_MARKERS = ("ගේ", "ගෙන්", "විසින්", "යටතේ")
ALLOWED_RELATIONS = ("RULED", "BUILT", "DEFEATED", "BELONGED_TO", "LOCATED_IN", "SON_OF", "CONVERTED", "ARRIVED_AT", "ORDAINED", "CAPITAL_OF", "BUILT_BY", "DEDICATED_TO", "RULED_BY", "DESCENDED_FROM", "FOUGHT_BY", "FOUGHT_AT", "WON_BY", "REMOVED_FROM", "APPOINTED_AS", "MARRIED", "BROTHER_OF", "SERVED")


def resolve_to_canonical(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with ``canonical``: a canonical name itself, else that of its alias (the highest seq wins), else the name."""
    keys = aliases.select(T.strip_ws(F.col("canonical")).alias("k"), T.strip_ws(F.col("canonical")).alias("v"), F.lit(1).alias("p"), F.lit(0).cast("long").alias("s"))
    other = aliases.select(F.col("alias").alias("k"), T.strip_ws(F.col("canonical")).alias("v"), F.lit(0).alias("p"), F.col("seq").cast("long").alias("s"))
    best = keys.unionByName(other).groupBy("k").agg(F.max_by("v", F.struct("p", "s", "v")).alias("v"))
    return names.join(best, F.col(name) == F.col("k"), "left").withColumn("canonical", F.coalesce("v", name)).drop("k", "v")


def aliases_for(aliases: DataFrame) -> DataFrame:
    """``(canonical, alternates)`` in order of seq."""
    return aliases.groupBy("canonical").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "alias"))), lambda x: x["alias"]).alias("alternates"))


def _looked_up(rows: DataFrame, surface_forms: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """``(name, normal)`` of rows (name, bare), each name once: bare itself among the surface forms, else without the first suffix that leaves one, else bare."""
    bare = F.col("bare")
    tries = [F.struct(F.lit(0).alias("p"), bare.alias("k"))]
    for i, s in enumerate(suffixes, 1):
        tries.append(F.when(bare.endswith(s), F.struct(F.lit(i).alias("p"), T.strip_ws(bare.substr(F.lit(1), F.length(bare) - F.lit(len(s)))).alias("k"))))
    each = rows.select("name", "bare", F.explode(F.array_compact(F.array(*tries))).alias("t"))
    forms = surface_forms.select(F.col("surface").alias("s"), F.col("canonical").alias("c")).where("c is not null")
    hits = each.join(forms.hint("shuffle_hash"), F.col("t.k") == F.col("s"), "left")
    best = F.min(F.when(F.col("c").isNotNull(), F.struct(F.col("t.p").alias("p"), "c")))["c"]
    return hits.groupBy("name").agg(F.coalesce(best, F.first("bare")).alias("normal"))


def _different(names: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each name of the columns once; a name that a third of all rows hold is one row from here on."""
    out = names.select(F.col(columns[0]).alias("name"))
    for c in columns[1:]:
        out = out.unionByName(names.select(F.col(c).alias("name")))
    return out.where("name is not null").distinct()


def normal_forms(names: DataFrame, surface_forms: DataFrame, columns: tuple[str, ...] = ("name",), suffixes: tuple[str, ...] = LOOKUP_SUFFIXES) -> DataFrame:
    """Dictionary ``(name, normal)`` of all different names of the columns, written once and of known size."""
    rows = _different(names, columns).withColumn("bare", T.strip_ws(F.col("name")))
    return materialize(_looked_up(rows, surface_forms, suffixes), "normal-forms")


def canonical_forms(names: DataFrame, surface_forms: DataFrame, aliases: DataFrame, columns: tuple[str, ...] = ("name",)) -> DataFrame:
    """Dictionary ``(name, canonical)``: composed and trimmed, without a case ending, looked up among surface forms, then among aliases."""
    rows = _different(names, columns).withColumn("bare", T.strip_suffix(T.nfc(F.col("name"))))
    out = resolve_to_canonical(_looked_up(rows, surface_forms, LOOKUP_SUFFIXES), aliases, "normal")
    return materialize(out.select("name", "canonical"), "canonical-forms")


def with_form(rows: DataFrame, forms: DataFrame, column: str, form: str) -> DataFrame:
    """``rows`` with the column ``form`` that the dictionary (name, form) has for ``column``; null for null. Rows are found by the name
    itself, so neither their order nor where they lie matters, and repeated rows stay."""
    found = forms.select(F.col("name").alias("_name"), F.col(form).alias("_form"))
    return rows.join(found, F.col(column) == F.col("_name"), "left").withColumn(form, F.col("_form")).drop("_name", "_form")


def normalize_entity(names: DataFrame, surface_forms: DataFrame, name: str = "name", suffixes: tuple[str, ...] = LOOKUP_SUFFIXES) -> DataFrame:
    """``names`` with ``normal``: looked up as it is, else without the first suffix that leaves a known name, else trimmed; a column
    ``normal`` of before is replaced. Null stays null and repeated rows stay; of several canonical names of a form the least is taken."""
    return with_form(names, normal_forms(names, surface_forms, (name,), suffixes), name, "normal")


def normalize_relation(rows: DataFrame, synonyms: DataFrame, relation: str = "relation", allowed: tuple[str, ...] = ALLOWED_RELATIONS) -> DataFrame:
    """``rows`` with ``normal_relation``: allowed in upper case, else by the lower-case synonym, else with spaces as underscores; null if unknown."""
    bare = T.strip_ws(F.col(relation))
    once = synonyms.groupBy(F.lower("surface").alias("s")).agg(F.min("relation").alias("r"))
    out = rows.withColumn("_low", F.lower(bare)).withColumn("_under", F.replace(F.lower(bare), F.lit(" "), F.lit("_")))
    out = out.join(once.select(F.col("s").alias("s1"), F.col("r").alias("r1")), F.col("_low") == F.col("s1"), "left")
    out = out.join(once.select(F.col("s").alias("s2"), F.col("r").alias("r2")), F.col("_under") == F.col("s2"), "left")
    up = F.upper(bare)
    return out.withColumn("normal_relation", F.coalesce(F.when(up.isin(*allowed), up), "r1", "r2")).drop("_low", "_under", "s1", "r1", "s2", "r2")


def normalize_triples(triples: DataFrame, surface_forms: DataFrame, synonyms: DataFrame, strict: bool = True) -> DataFrame:
    """Triples (subject, relation, object, period) with normal ends and relations; without an end, or (strict) with an unknown relation, they go."""
    forms = normal_forms(triples, surface_forms, ("subject", "object"))
    ends = triples
    for end in ("subject", "object"):
        ends = with_form(ends, forms, end, "normal").withColumn(end, F.col("normal")).drop("normal")
    rel = normalize_relation(ends, synonyms) if strict else ends.withColumn("normal_relation", T.sanitize_relation(F.col("relation")))
    rel = rel.withColumn("relation", F.col("normal_relation")).drop("normal_relation")
    return rel.where((F.length("subject") > 0) & (F.length("object") > 0) & F.col("relation").isNotNull()).withColumn("period", F.coalesce("period", F.lit("")))


def canonical_entity(names: DataFrame, surface_forms: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with ``canonical``, as canonical_forms has it. Null stays null; repeated rows stay."""
    return with_form(names, canonical_forms(names, surface_forms, aliases, (name,)), name, "canonical")


def canonical_ends(triples: DataFrame, surface_forms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Triples with canonical subjects and objects, from one dictionary of both."""
    forms = canonical_forms(triples, surface_forms, aliases, ("subject", "object"))
    for end in ("subject", "object"):
        triples = with_form(triples, forms, end, "canonical").withColumn(end, F.col("canonical")).drop("canonical")
    return triples


def name_index(sources: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """``(key, canonical)`` from (priority, seq, name, canonical): names and their title-stripped forms; the first registration wins."""
    rows = sources if excluded is None else sources.join(excluded.select(F.col("canonical").alias("x")), F.col("canonical") == F.col("x"), "left_anti")
    both = F.array_distinct(F.array(T.strip_ws(F.col("name")), T.strip_title(T.strip_ws(F.col("name")))))
    keys = rows.select("priority", "seq", T.strip_ws(F.col("canonical")).alias("canonical"), F.posexplode(both).alias("form", "key")).where(F.length("key") > 1)
    return keys.groupBy("key").agg(F.min_by("canonical", F.struct("priority", "seq", "form", "canonical")).alias("canonical"))


def alias_clusters(edges: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """``(name, representative)`` of names joined by alias edges (src, dst): the longest member among ``canonical``, else the one on most edges, ties to the greatest."""
    comp = connected_components(edges).withColumnRenamed("node", "name")
    degree = edges.select(F.col("src").alias("n")).unionByName(edges.select(F.col("dst").alias("n"))).groupBy("n").agg(F.count("*").alias("deg"))
    rows = comp.join(degree, F.col("name") == F.col("n"), "left")
    known = F.lit(0)
    if canonical is not None:
        rows = rows.join(canonical.select(F.col("canonical").alias("c")).distinct(), F.col("name") == F.col("c"), "left")
        known = F.when(F.col("c").isNotNull(), F.length("name")).otherwise(0)
    best = rows.groupBy("component").agg(F.max_by("name", F.struct(known.alias("k"), F.coalesce("deg", F.lit(0)).alias("d"), "name")).alias("representative"))
    return comp.join(best, "component").select("name", "representative")


def find_mentions(texts: DataFrame, names: DataFrame, script: str = SINHALA_CLASS, continuations: tuple[str, ...] = CONTINUATIONS) -> DataFrame:
    """``mentions.find_mentions`` with the endings that may follow a name."""
    return mentions.find_mentions(texts, names, script, continuations)


def resolve_tiers(candidates: DataFrame, tags: DataFrame, suffixes: tuple[str, ...] = T.CASE_SUFFIXES, markers: tuple[str, ...] = RELATIONAL_MARKERS) -> DataFrame:
    """``candidates`` (sent_id, candidate) with ``entity``: the tag of the sentence it stands for, or null.

    Tiers: the same; the tag and one case ending; a tag that begins with it; the same normal form (tags.normal, candidates.normal
    where both are given); a tag at its end behind a relational marker. Within a tier the longest tag, then by name.
    """
    c, e = F.col("candidate"), F.col("tag")
    extra = c.substr(F.length(e) + 1, F.length(c))
    lead = c.substr(F.lit(1), F.length(c) - F.length(e))
    tier = F.when(c == e, 1).when(c.startswith(e) & extra.isin(*suffixes), 2).when(e.startswith(c), 3)
    if "normal" in candidates.columns and "normal" in tags.columns:
        tier = tier.when(F.col("normal") == F.col("t_normal"), 4)
        tags = tags.withColumn("t_normal", F.col("normal")).drop("normal")
    tier = tier.when((F.length(c) > F.length(e)) & c.endswith(e) & T.contains_any(lead, list(markers)), 5)
    kept = ["s", "tag", *(["t_normal"] if "t_normal" in tags.columns else [])]
    tags = tags.withColumnRenamed("sent_id", "s").withColumnRenamed("entity", "tag").select(*kept).distinct()
    pairs = candidates.select("sent_id", "candidate", *(["normal"] if "t_normal" in kept else [])).distinct().join(tags.hint("merge"), F.col("sent_id") == F.col("s")).withColumn("tier", tier).where("tier is not null and length(tag) > 0")
    best = pairs.groupBy("sent_id", "candidate").agg(F.min_by("tag", F.struct("tier", -F.length("tag"), "tag")).alias("entity"), F.min("tier").alias("tier"))
    return candidates.join(best.hint("merge"), ["sent_id", "candidate"], "left")


def essay_subject(found: DataFrame, facts: DataFrame) -> DataFrame:
    """``(essay_id, subject, others)`` from found (essay_id, name, at): names by how often they come, then where first; the first
    that has facts (facts.name) is the subject, else the first. others: all names by first place."""
    ranked = found.groupBy("essay_id", "name").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    ranked = ranked.join(facts.select(F.col("name").alias("f")).distinct().hint("merge"), F.col("name") == F.col("f"), "left")
    order = F.struct(F.when(F.col("f").isNotNull(), 0).otherwise(1), -F.col("n"), "first", "name")
    names = F.transform(F.array_sort(F.collect_list(F.struct("first", (-F.col("n")).alias("m"), "name"))), lambda x: x["name"])
    return ranked.groupBy("essay_id").agg(F.min_by("name", order).alias("subject"), names.alias("others"))
