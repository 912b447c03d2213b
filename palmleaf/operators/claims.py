"""Extraction and claim grading around model replies, which are input tables.

claims: essay_id, batch_no, pos, claim_text, claim_type, verdict, unverifiable_reason, matched_fact, explanation, feedback.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palmleaf.functions import text as T
from palmleaf.operators import kg, mentions
from palmleaf.operators.names import CONTINUATIONS, SINHALA_CLASS, canonical_ends, essay_subject, normal_forms, resolve_tiers, with_form
from palmleaf.shared import materialize

# Relations that come first when facts are many, and limits of grading.
PRIORITY = ("BUILT", "DEFEATED", "RULED", "UNITED", "FATHER_OF", "MOTHER_OF", "SON_OF", "BROTHER_OF", "MARRIED", "WIFE_OF", "BORN_IN", "DIED_AT", "ALSO_KNOWN_AS")
FACTS_MOST, LOW_COVERAGE, HIGH_FROM = 80, 0.30, 5
TRIPLE = "array<struct<subject: string, relation: string, object: string, period: string>>"
CLAIM = "array<struct<claim_text: string, claim_type: string, verdict: string, unverifiable_reason: string, matched_fact: string, explanation: string, feedback: string>>"


def extraction_gate(tags: DataFrame) -> DataFrame:
    """``(sent_id, n)`` of sentences with two or more tags that are no dates."""
    return tags.where(F.col("label") != "DATE_ERA").groupBy("sent_id").agg(F.count("*").alias("n")).where("n >= 2")


def relation_rank() -> Column:
    """Place of ``relation`` among the priority relations; all others share the last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(r) for r in PRIORITY)), F.col("relation")), F.lit(0)), F.lit(len(PRIORITY) + 1))


def leading_facts(facts: DataFrame, most: int = FACTS_MOST) -> DataFrame:
    """Of each entity's facts (entity, subject, relation, object, period), each (subject, relation, object) once, the first ``most`` + 1
    by priority relation, then relation, subject and object.

    format_facts shows an essay nothing else: ``most`` facts of one entity that come before another of it do so in any essay,
    and ``most`` + 1 still tell that there are more. So facts are cut an entity, before essays multiply them.
    """
    # equal facts share a place, so tasks leave an entity's first places before facts are dealt, once and by entity alone
    place = F.dense_rank().over(Window.partitionBy("entity").orderBy(relation_rank(), "relation", "subject", "object"))
    first = facts.select("entity", "subject", "relation", "object", "period").withColumn("place", place).where(F.col("place") <= most + 1)
    once = first.groupBy("entity", "subject", "relation", "object").agg(F.min(F.struct("period")).alias("p"))
    return once.select("entity", "subject", "relation", "object", "p.period")


def fact_lists(facts: DataFrame, most: int = FACTS_MOST) -> DataFrame:
    """``(entity, facts)``: leading_facts of each entity as one array, by relation, subject and object; ``most`` + 1 at most."""
    fact = F.struct("relation", "subject", "object", relation_rank().alias("rank"), "period")
    return leading_facts(facts, most).groupBy("entity").agg(F.sort_array(F.collect_list(fact)).alias("facts"))


def essay_facts(entities: DataFrame, lists: DataFrame, most: int = FACTS_MOST) -> DataFrame:
    """format_facts of pool_facts from fact_lists, by order, relation, subject and object: essay_entities (essay_id, order, entity) take whole
    lists, so facts are dealt by essay once, and are pooled, cut and numbered within its row."""
    parts = lists.join(entities.hint("shuffle_hash"), "entity").groupBy("essay_id").agg(F.sort_array(F.collect_list(F.struct("order", "entity", "facts"))).alias("parts"))
    rows = parts.select("essay_id", F.flatten(F.col("parts.facts")).alias("all"))
    same = ("subject", "relation", "object")
    rows = rows.select("essay_id", F.sort_array(F.transform("all", lambda x, i: F.struct(*(x[c].alias(c) for c in same), i.alias("at"), x["rank"].alias("rank"), x["period"].alias("period")))).alias("all"))
    again = lambda x, before: reduce(lambda a, b: a & b, (x[c].eqNullSafe(before[c]) for c in same))
    rows = rows.select("essay_id", F.filter("all", lambda x, i: (i == 0) | ~again(x, F.get("all", i - 1))).alias("facts"))
    rows = rows.select("essay_id", F.size("facts").cast("long").alias("n_facts"), "facts")
    place = lambda x: F.struct(F.when(F.col("n_facts") > most, x["rank"]).otherwise(0).alias("rank"), x["at"].alias("at"), *(x[c].alias(c) for c in same), x["period"].alias("period"))
    rows = rows.select("essay_id", "n_facts", F.slice(F.sort_array(F.transform("facts", place)), 1, most).alias("facts"))
    period = lambda x: F.when(F.length(x["period"]) > 0, F.concat(F.lit(" ("), x["period"], F.lit(")"))).otherwise("")
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["subject"], F.lit(" "), x["relation"], F.lit(" "), x["object"], period(x))
    return rows.select("essay_id", "n_facts", F.concat_ws("\n", F.transform("facts", line)).alias("text"))


def format_facts(facts: DataFrame, most: int = FACTS_MOST) -> DataFrame:
    """``(essay_id, n_facts, text)``: numbered lines of each essay's facts (essay_id, seq, subject, relation, object, period); where there
    are more than ``most``, the first of them by priority relation, then seq; else by seq."""
    rows = facts.withColumn("n", F.count("*").over(Window.partitionBy("essay_id")))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("essay_id").orderBy(F.when(F.col("n") > most, relation_rank()).otherwise(0), "seq"))).where(F.col("rank") <= most)
    period = F.when(F.length("period") > 0, F.concat(F.lit(" ("), "period", F.lit(")"))).otherwise("")
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), "subject", F.lit(" "), "relation", F.lit(" "), "object", period)
    return rows.groupBy("essay_id").agg(F.max("n").alias("n_facts"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])).alias("text"))


def build_requests(batches: DataFrame, facts_text: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Request text of each sentence batch: subject and other names where given, facts, then numbered sentences, then which batch it is."""
    numbered = F.concat_ws("\n", F.transform("sentences", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)))
    j = batches.join(facts_text.select("essay_id", F.col("text").alias("facts")).hint("merge"), "essay_id", "left")
    who = [F.lit(None).cast("string")]
    if subjects is not None:
        s = subjects.select("essay_id", F.concat(F.lit("subject: "), "subject", F.when(F.size("others") > 1, F.concat(F.lit("; others: "), F.array_join(F.array_except("others", F.array("subject")), ", "))).otherwise("")).alias("who"))
        j, who = j.join(s.hint("merge"), "essay_id", "left"), [F.col("who")]
    return j.select("essay_id", "batch_no", F.concat_ws("\n\n", *who, F.coalesce("facts", F.lit("(no facts)")), numbered, F.format_string("batch %d of %d", "batch_no", "n_batches")).alias("request"))


def sentence_requests(sentences: DataFrame, tags: DataFrame) -> DataFrame:
    """``(sent_id, request)``: each sentence (sent_id, text) that passes the gate, with its tags in order of name; a sentence's tags are few."""
    listed = tags.groupBy("sent_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat("entity", F.lit(" ("), "label", F.lit(")")))), ", ").alias("tags"))
    j = sentences.join(extraction_gate(tags).select("sent_id").hint("merge"), "sent_id").join(listed.hint("merge"), "sent_id")
    return j.select("sent_id", F.concat_ws("\n", "text", "tags").alias("request"))


def _objects(reply: str | None, key: str | None) -> list[dict]:
    """All complete JSON objects of a reply, fences and a cut end notwithstanding."""
    body, out = re.sub(r"```(?:json)?", "", reply or ""), []
    decode, at = json.JSONDecoder().raw_decode, body.find("{")
    while at >= 0:
        try:
            got, end = decode(body, at)
        except ValueError:
            end = at + 1
            got = None
        if isinstance(got, dict):
            inner = got.get(key) if key else None
            out += [x for x in inner if isinstance(x, dict)] if isinstance(inner, list) else [got]
        at = body.find("{", end)
    return out


def parse_replies(replies: DataFrame, schema: str, key: str | None = None) -> DataFrame:
    """``replies`` (with column reply) with ``parsed``, an array of structs: every complete object of the reply.

    A list, a single object, an object that holds a list under ``key``, text around it and an end cut off are all read;
    a null or unreadable reply gives an empty array. Replies that are a list of objects and nothing else are read by Spark's own
    parser; only the others go to Python, which gives back the array itself.
    """
    names = re.findall(r"(\w+): string", schema)
    kind = pa.list_(pa.struct([(n, pa.string()) for n in names]))
    reply = F.col("reply")
    plain = F.from_json(reply, schema, {"mode": "PERMISSIVE"})
    # a whole list whose entries are all objects with fields of these: anything else may hold more than the parser sees
    clean = F.coalesce(reply.rlike(r"^\s*\[\s*\{") & F.json_array_length(reply).eqNullSafe(F.size(plain)) & F.forall(plain, lambda o: o.isNotNull() & F.coalesce(*(o[n] for n in names)).isNotNull()), F.lit(False))
    if key:
        clean = clean & ~F.contains(reply, F.lit(f'"{key}"'))

    @F.arrow_udf(schema)
    def salvaged(texts: pa.Array) -> pa.Array:
        text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        return pa.array([[{n: text(o.get(n)) for n in names} for o in _objects(r, key)] for r in texts.to_pylist()], kind)

    rows = replies.withColumn("_plain", F.when(clean, plain))
    rows = rows.withColumn("_salvaged", salvaged(F.when(F.col("_plain").isNull(), reply)))
    return rows.withColumn("parsed", F.coalesce("_plain", "_salvaged")).drop("_plain", "_salvaged")


def validate_triples(triples: DataFrame, dates: DataFrame) -> DataFrame:
    """Triples (sent_id, subject, relation, object, period) with ends of two characters or more, no end among the sentence's dates (sent_id, entity), and clean relations."""
    rows = triples.select("sent_id", T.strip_ws(F.col("subject")).alias("subject"), T.sanitize_relation(F.col("relation")).alias("relation"), T.strip_ws(F.col("object")).alias("object"), F.coalesce(T.strip_ws(F.col("period")), F.lit("")).alias("period"))
    rows = rows.where((F.length("subject") >= 2) & (F.length("object") >= 2) & F.col("relation").isNotNull())
    d = dates.select(F.col("sent_id").alias("s"), F.col("entity").alias("d")).distinct()
    for end in ("subject", "object"):
        rows = rows.join(d, (F.col("sent_id") == F.col("s")) & (F.col(end) == F.col("d")), "left_anti")
    return rows


def extract_relations(tags: DataFrame, replies: DataFrame, surface_forms: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(sent_id, subject, relation, object, period)`` from tags (sent_id, entity, label) and replies (sent_id, reply).

    Replies of sentences that pass the gate are parsed; ends that stand for a tag of their sentence, also by its normal form, become it, others stay as they are;
    then ends are made canonical, dates and bad relations go. Each triple of a sentence comes once.
    """
    open_ = replies.join(extraction_gate(tags).select("sent_id").hint("merge"), "sent_id", "left_semi")
    raw = parse_replies(open_, TRIPLE).select("sent_id", F.explode("parsed").alias("t")).select("sent_id", "t.*")
    raw = materialize(raw.where("subject is not null and object is not null"), "raw-triples")
    ends = raw.select("sent_id", F.col("subject").alias("candidate")).unionByName(raw.select("sent_id", F.col("object").alias("candidate"))).distinct()
    named = tags.where(F.col("label") != "DATE_ERA").select("sent_id", "entity")
    both = ends.select(F.col("candidate").alias("name")).unionByName(named.select(F.col("entity").alias("name")))
    forms = normal_forms(both, surface_forms)
    ends, named = with_form(ends, forms, "candidate", "normal"), with_form(named, forms, "entity", "normal")
    known = materialize(resolve_tiers(ends, named).select("sent_id", "candidate", "entity"), "ends")
    for end in ("subject", "object"):
        k = known.select(F.col("sent_id").alias("k_sent"), F.col("candidate").alias("k_end"), F.col("entity").alias("k_tag"))
        raw = raw.join(k.hint("merge"), (F.col("sent_id") == F.col("k_sent")) & (F.col(end) == F.col("k_end")), "left")
        raw = raw.withColumn(end, F.coalesce("k_tag", end)).drop("k_sent", "k_end", "k_tag")
    clean = validate_triples(raw, tags.where(F.col("label") == "DATE_ERA").select("sent_id", "entity"))
    return canonical_ends(clean, surface_forms, aliases).distinct()


def collect_triples(sentences: DataFrame, triples: DataFrame) -> DataFrame:
    """``(sent_id, source, subject, relation, object, period)``: triples with their sentence (sent_id, text) as source; a sentence without any gives
    one row of nulls, so that none is lost."""
    j = sentences.join(triples.withColumnRenamed("sent_id", "t_sent").hint("merge"), F.col("sent_id") == F.col("t_sent"), "left")
    return j.select("sent_id", F.col("text").alias("source"), "subject", "relation", "object", "period")


def essay_mentions(essays: DataFrame, tags: DataFrame, names: DataFrame, script: str = SINHALA_CLASS, continuations: tuple[str, ...] = CONTINUATIONS, one_unit: bool = False) -> DataFrame:
    """``(essay_id, name, at)``: every mention of a name (name, canonical) in the person tags of an essay's first five sentences and in its text.

    tags: (essay_id, sent_no from 0 among the claim sentences, entity, label). Texts without an exact mention are searched for misspelt
    ones. ``at`` of a tag is its sentence's number and of a text its place in characters; with ``one_unit`` a tag's place is that of
    its entity in the text, by the places at which its sentence and the entity in it first come. Different entities are searched once.
    """
    tagged = tags.where(F.col("label").isin("PERSON_KING", "PERSON_MONK") & (F.col("sent_no") < 5)).select("essay_id", "sent_no", "entity")
    tagged = materialize(tagged, "person-tags")

    def search(texts: DataFrame) -> DataFrame:
        exact = materialize(mentions.find_mentions(texts, names, script, continuations), "mentions")
        fuzzy = mentions.find_mentions_fuzzy(texts, names, exact, script=f"[{script}]+")
        return exact.unionByName(fuzzy.select("text_id", "canonical", "start"))

    of_tags = search(tagged.select(F.col("entity").alias("text_id"), F.col("entity").alias("text")).where("text is not null").distinct())
    hits = tagged.join(materialize(of_tags, "tag-mentions").hint("merge"), F.col("entity") == F.col("text_id"))
    at = F.col("sent_no").cast("int")
    if one_unit:
        parts = essays.select(F.col("essay_id").alias("e"), "text", T.claim_sentences(F.col("text")).alias("sentences"))
        hits = hits.join(parts.hint("merge"), F.col("essay_id") == F.col("e"))
        sentence = F.get("sentences", F.col("sent_no"))
        at = begins_in(sentence, F.col("text")) + begins_in(F.col("entity"), sentence)
    of_texts = search(essays.select(F.col("essay_id").alias("text_id"), "text"))
    return hits.select("essay_id", F.col("canonical").alias("name"), at.alias("at")).unionByName(of_texts.select(F.col("text_id").alias("essay_id"), F.col("canonical").alias("name"), F.col("start").alias("at")))


def begins_in(inner: Column, outer: Column) -> Column:
    """Place from 0 at which ``inner`` first stands in ``outer``; 0 where it does not, or either is null."""
    return F.coalesce(F.greatest(F.instr(outer, inner) - 1, F.lit(0)), F.lit(0))


def facts_of_entities(entities: DataFrame, nodes: DataFrame, edges: DataFrame, aliases: DataFrame, static: DataFrame | None = None, hops: int = 10, most: int = FACTS_MOST) -> DataFrame:
    """``(entity, facts)``, fact_lists of the facts that touch any node of the entity's name, its aliases (canonical, alias) or what up to
    ``hops`` alias edges join to these; static facts (subject, relation, object, period) of its names where the graph has none."""
    entities = entities.select("entity").where("entity is not null").distinct()
    other = aliases.select(F.col("canonical").alias("c"), "alias").where("alias is not null")
    seeds = entities.select("entity", F.col("entity").alias("name")).unionByName(entities.join(other, F.col("entity") == F.col("c")).select("entity", F.col("alias").alias("name")))
    seeds = materialize(seeds.distinct(), "seeds")
    starts = materialize(kg.find_node(seeds, nodes).where("node_id is not null").select("entity", F.col("node_id").alias("start")).distinct(), "starts")
    links = edges.where(F.col("relation") == kg.ALIAS).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    cluster = kg.name_cluster(starts.select("start").distinct(), links, hops)
    own = starts.join(cluster.hint("merge"), "start").select("entity", F.col("node").alias("node_id")).distinct()
    own = materialize(own.join(nodes.select("node_id", "name"), "node_id"), "clusters")
    # an edge gets its other end's name first and comes to the entity with it; of edges that lead to an entity only those go on
    rows = edges.select("src_id", "relation", "dst_id", "period")
    end = lambda frame, key, name, *more: frame.select(F.col("node_id").alias(key), F.col("name").alias(name), *more)
    out = rows.join(end(nodes, "dst_id", "object"), "dst_id").join(end(own, "src_id", "subject", "entity"), "src_id")
    into = rows.join(end(own, "dst_id", "object", "entity"), "dst_id").join(end(nodes, "src_id", "subject"), "src_id")
    columns = ("entity", "subject", "relation", "object", "period")
    lists = materialize(fact_lists(out.select(*columns).unionByName(into.select(*columns)), most), "fact-lists")
    if static is None:
        return lists
    kept = static.select("subject", "relation", "object", "period")
    of_names = kept.join(seeds.hint("merge"), F.col("subject") == F.col("name")).unionByName(kept.join(seeds.hint("merge"), F.col("object") == F.col("name")))
    rest = of_names.select(*columns).join(lists.select("entity").hint("merge"), "entity", "left_anti")
    return materialize(lists.unionByName(fact_lists(rest, most)), "fact-lists")


def assess_essays(essays: DataFrame, tags: DataFrame, names: DataFrame, nodes: DataFrame, edges: DataFrame, aliases: DataFrame, replies: DataFrame, static: DataFrame | None = None, script: str = SINHALA_CLASS, continuations: tuple[str, ...] = CONTINUATIONS, one_unit: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Subjects, requests, claims and accuracy of all essays (essay_id, text), from tags, names, the graph and replies alone.

    Mentions, facts of their name clusters with the static ones behind them, the subject of each essay, then check_essays.
    """
    found = materialize(essay_mentions(essays, tags, names, script, continuations, one_unit), "essay-mentions")
    lists = facts_of_entities(found.select(F.col("name").alias("entity")), nodes, edges, aliases, static)
    subjects = materialize(essay_subject(found, lists.select(F.col("entity").alias("name"))), "subjects")
    return (subjects, *_check(essays, subjects, lists, replies))


def check_essays(essays: DataFrame, subjects: DataFrame, facts: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests, claims and accuracy rows of all essays (essay_id, text) at once.

    subjects: (essay_id, subject, others) of essay_subject; facts: (entity, subject, relation, object, period); replies: (essay_id, batch_no,
    reply), null for a failed call. Essays without a subject have no requests and no claims, and an empty accuracy row.
    """
    return _check(essays, subjects, materialize(fact_lists(facts), "fact-lists"), replies)


def _check(essays: DataFrame, subjects: DataFrame, lists: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """check_essays from fact_lists."""
    known = subjects.where("subject is not null")
    text = essay_facts(known.select("essay_id", F.posexplode("others").alias("order", "entity")), lists)
    batches = T.batch_sentences(essays.join(known.select("essay_id").hint("merge"), "essay_id", "left_semi"))
    batches = materialize(batches, "batches")
    requests = build_requests(batches, text, known)
    got = parse_replies(replies.join(batches.select("essay_id", "batch_no").hint("merge"), ["essay_id", "batch_no"], "left_semi"), CLAIM, "claims")
    claims = got.select("essay_id", "batch_no", F.posexplode("parsed").alias("pos", "c")).select("essay_id", "batch_no", "pos", "c.*")
    claims = materialize(pad_claims(batches, normalize_claims(claims)), "claims")
    return requests, claims, aggregate_accuracy(essays, claims)


def normalize_claims(claims: DataFrame) -> DataFrame:
    """Claims with consistent type, verdict, reason and feedback."""
    kind = F.when(F.upper("claim_type") == "EDITORIAL", "EDITORIAL").otherwise("FACTUAL")
    verdict = F.when(F.upper("verdict").isin("CORRECT", "INCORRECT"), F.upper("verdict")).otherwise("UNVERIFIABLE")
    rows = claims.withColumn("claim_type", kind).withColumn("verdict", F.when(F.col("claim_type") == "EDITORIAL", "UNVERIFIABLE").otherwise(verdict))
    reason = F.when(F.col("claim_type") == "EDITORIAL", "NOT_FACTUAL").when(F.col("verdict") == "UNVERIFIABLE", F.when(F.upper("unverifiable_reason") == "NOT_FACTUAL", "NOT_FACTUAL").otherwise("NOT_IN_KG"))
    return rows.withColumn("unverifiable_reason", reason).withColumn("feedback", F.when(F.col("verdict") == "INCORRECT", F.col("feedback")))


def pad_claims(batches: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims, and for sentences without one (a short or failed reply) a factual, unverifiable claim without reason."""
    want = batches.select("essay_id", "batch_no", F.posexplode("sentences").alias("pos", "sentence"))
    have = claims.groupBy("essay_id", "batch_no").agg(F.count("*").alias("n"))
    short = want.join(have.hint("merge"), ["essay_id", "batch_no"], "left").where(F.col("pos") >= F.coalesce("n", F.lit(0)))
    pad = {"claim_text": F.col("sentence"), "claim_type": F.lit("FACTUAL"), "verdict": F.lit("UNVERIFIABLE")}
    return claims.unionByName(short.select(*(pad.get(c, F.col(c) if c in ("essay_id", "batch_no", "pos") else F.lit(None)).cast(t).alias(c) for c, t in claims.dtypes)))


def aggregate_accuracy(essays: DataFrame, claims: DataFrame) -> DataFrame:
    """One row an essay: counts, accuracy (percent of verifiable claims, 1 place, null without any), coverage, warning and confidence."""
    factual = F.col("claim_type") != "EDITORIAL"
    n = lambda c: F.count_if(c).cast("long")
    sums = claims.groupBy("essay_id").agg(
        F.count("*").alias("n_claims"), n(factual).alias("n_factual"), n(factual & (F.col("verdict") == "CORRECT")).alias("n_correct"), n(factual & (F.col("verdict") == "INCORRECT")).alias("n_incorrect"),
        n(factual & (F.col("verdict") == "UNVERIFIABLE")).alias("n_unverifiable"), n(F.col("unverifiable_reason") == "NOT_IN_KG").alias("n_kg_gap"), n(F.col("unverifiable_reason") == "NOT_FACTUAL").alias("n_not_factual"),
    )
    names = ("n_claims", "n_factual", "n_correct", "n_incorrect", "n_unverifiable", "n_kg_gap", "n_not_factual")
    rows = essays.select("essay_id").distinct().join(sums, "essay_id", "left").select("essay_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))
    seen = F.col("n_correct") + F.col("n_incorrect")
    rows = rows.withColumn("accuracy", F.round(F.col("n_correct") * 100 / F.nullif(seen, F.lit(0)), 1)).withColumn("coverage", F.coalesce(F.round(seen / F.nullif("n_factual", F.lit(0)), 4), F.lit(0.0)))
    confidence = F.when(seen >= HIGH_FROM, "HIGH").when(seen >= 1, "LOW").otherwise("INSUFFICIENT_KG")
    return rows.withColumn("low_coverage", F.col("coverage") < LOW_COVERAGE).withColumn("confidence", confidence)


def kg_gap_worklist(claims: DataFrame) -> DataFrame:
    """``(claim_text, n, n_essays)`` of claims the graph has nothing on."""
    return claims.where(F.col("unverifiable_reason") == "NOT_IN_KG").groupBy("claim_text").agg(F.count("*").alias("n"), F.countDistinct("essay_id").alias("n_essays"))


def corrections(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("verdict") == "INCORRECT").select("essay_id", "batch_no", "pos", "claim_text", F.coalesce(F.nullif("feedback", F.lit("")), "explanation").alias("correction"))


def claims_table(claims: DataFrame, categories: list[str]) -> DataFrame:
    """Claims of the shown categories, numbered within each essay."""
    rows = claims.withColumn("category", T.display_category(F.col("claim_type"), F.col("verdict"), F.col("unverifiable_reason"))).where(F.col("category").isin(*categories))
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("essay_id").orderBy("batch_no", "pos")))


def concat_in_order(rows: DataFrame, key: str, order: str, text: str, separator: str = "\n") -> DataFrame:
    """``(key, n, joined)``: texts of each key joined in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda x: x["t"])
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.concat_ws(separator, parts).alias("joined"))


def facts_with_fallback(primary: DataFrame, static: DataFrame) -> DataFrame:
    """Primary facts (entity, ...), and static ones of entities that have none."""
    return primary.unionByName(static.join(primary.select("entity").distinct().hint("merge"), "entity", "left_anti"))


def pool_facts(essay_entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of all entities of each essay, each (subject, relation, object) once, as the first entity (order) brings it."""
    j = essay_entities.join(facts.hint("merge"), "entity")
    best = j.groupBy("essay_id", "subject", "relation", "object").agg(F.min(F.struct("order", "entity", "period")).alias("m"))
    return best.select("essay_id", "subject", "relation", "object", F.col("m.period").alias("period"), F.col("m.order").alias("order"))
