"""Queries on documents as essays, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.functions import text as T
from palmleaf.operators import features, scoring
from palmleaf.shared import table

INFORMAL = ["the", "la", "die", "el"]
MARKERS = {"cause": ["for", "pour", "durch"], "contrast": ["but", "mais", "aber"], "addition": ["and", "et", "und"], "sequence": ["then", "puis", "dann"], "example": ["this", "ce", "dies"]}
INTRO, THESIS, CONCLUSION = ["the", "le", "die", "la"], ["that", "que", "dass"], ["is", "est", "ist", "es"]
NEWLINE = r"\n"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def essays(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumnRenamed("doc_id", "essay_id")


def paragraph_table(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, pos, para_id, text)``: one row a non-blank line of 20 characters or more."""
    rows = table(spark, sf, "documents").select("doc_id", T.paragraphs(F.col("text"), NEWLINE).alias("parts"))
    rows = rows.select("doc_id", F.posexplode_outer("parts").alias("pos", "text")).where("text is not null")  # outer, or parts are made twice
    return rows.select("doc_id", "pos", F.concat_ws("-", "doc_id", "pos").alias("para_id"), "text")


def _any(column: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


STRIP = lambda x: rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}]+')"
PARAS = f"list_filter(list_transform(string_split(text, chr(10)), lambda p: {STRIP('p')}), lambda p: length(p) > 20)"
SENTENCES = rf"list_filter(list_transform(string_split_regex(text, '[.!?।\n]'), lambda p: {STRIP('p')}), lambda p: length(p) > 10)"
CTE_TOKENS = f"tok as (select doc_id as essay_id, unnest({TOKENS}) as token from documents), tc as (select essay_id, token, count(*) as n from tok group by all)"
CTE_VOCAB = f"paras as (select doc_id, unnest({PARAS}) as text from documents), pn as (select doc_id, row_number() over () as pid, text from paras), vocab as (select token, count(*) as n_paragraphs from (select distinct pid, unnest({TOKENS}) as token from pn) where length(token) >= 4 group by token having count(*) >= 3)"
CTE_LEXICAL = f"""{CTE_TOKENS}, {CTE_VOCAB}, lex as (select d.doc_id as essay_id, coalesce(n_tokens, 0) as n_tokens, coalesce(n_types, 0) as n_types, coalesce(n_repeated, 0) as n_repeated, coalesce(n_academic, 0) as n_academic, coalesce(n_informal, 0) as n_informal
  from documents d left join (select essay_id, cast(sum(n) as bigint) as n_tokens, count(*) as n_types, count(*) filter (length(tc.token) >= 3 and n >= 5) as n_repeated,
    cast(coalesce(sum(n) filter (v.token is not null), 0) as bigint) as n_academic, cast(coalesce(sum(n) filter (tc.token in ({", ".join(repr(w) for w in INFORMAL)})), 0) as bigint) as n_informal
    from tc left join vocab v on v.token = tc.token group by essay_id) s on s.essay_id = d.doc_id)"""
CTE_MATTR = f"""mt as (select doc_id as essay_id, case when len(w) < 50 then len(list_distinct(w)) else list_sum(list_transform(range(1, len(w) - 48), lambda i: len(list_distinct(w[i:i + 49])))) end as distinct_sum,
  case when len(w) < 50 then len(w) else (len(w) - 49) * 50 end as window_words from (select doc_id, {TOKENS} as w from documents))"""
_R = lambda a, b: f"round(coalesce({a}::double / nullif({b}, 0), 0), 4)"
V = scoring.VOCABULARY
CTE_D3 = f"""{CTE_LEXICAL}, {CTE_MATTR}, d3 as (select essay_id, cast(greatest(1, least(5, round_even(4 * greatest(0.0::double, {V['mattr']}::double * least({_R('distinct_sum', 'window_words')} / {V['mattr_full']}::double, 1.0::double)
  + {V['academic']}::double * least({_R('n_academic', 'n_tokens')} / {V['academic_full']}::double, 1.0::double) + {V['repetition']}::double * greatest(0.0::double, 1 - {_R('n_repeated', 'n_types')} * 3) - least({_R('n_informal', 'n_tokens')} * 2, {V['informal_most']}::double)) + 1, 0))) as int) as D3 from lex join mt using (essay_id))"""
CTE_D2 = "d2 as (select doc_id as essay_id, cast(least(4, n_types) + 1 as int) as D2, n_types from (select doc_id, " + " + ".join(f"{_any('lower(text)', w)}::int" for w in MARKERS.values()) + " as n_types from documents))"
S = scoring.STRUCTURE
CTE_D4 = f"""st as (select doc_id as essay_id, len(p) as n_paragraphs, {_any("lower(coalesce(p[1], ''))", INTRO)} as has_intro, {_any("lower(coalesce(p[1], ''))", THESIS)} as has_thesis, {_any("lower(coalesce(p[-1], ''))", CONCLUSION)} as has_conclusion from (select doc_id, {PARAS} as p from documents)),
d4 as (select *, cast(greatest(1, least(5, round_even(4 * ({S['intro']}::double * has_intro::int + {S['thesis']}::double * has_thesis::int + {S['body']}::double * (case when n_paragraphs < 2 then 0.0::double when n_paragraphs = 2 then 0.5::double else least((n_paragraphs - 2) / 3.0::double, 1.0::double) end) + {S['conclusion']}::double * has_conclusion::int) + 1, 0))) as int) as D4 from st)"""
CTE_ALL = f"{CTE_D3}, {CTE_D2}, {CTE_D4}, sc as (select essay_id, D2, D3, D4 from d3 join d2 using (essay_id) join d4 using (essay_id))"


def lexical(spark: SparkSession, sf: str) -> DataFrame:
    return features.lexical_counts(essays(spark, sf), features.academic_vocabulary(paragraph_table(spark, sf)), INFORMAL)


SIGNALS = (INTRO, THESIS, CONCLUSION)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """``(essay_id, D2, D3, D4)`` of every document."""
    out = scoring.score_texts(essays(spark, sf), features.academic_vocabulary(paragraph_table(spark, sf)), INFORMAL, MARKERS, SIGNALS, NEWLINE)
    return out.select("essay_id", "D2", "D3", "D4")


@query(f"with {CTE_D3} select lang, D3 as score, count(*) as n from d3 join documents on doc_id = essay_id group by all")
def vocab_score_by_lang(spark, sf):
    return scored(spark, sf).join(essays(spark, sf).select("essay_id", "lang"), "essay_id").groupBy("lang", F.col("D3").alias("score")).agg(F.count("*").alias("n"))


@query(f"with {CTE_TOKENS} select essay_id, cast(sum(n) as bigint) as n_tokens, count(*) as n_types from tc group by all")
def token_stats(spark, sf):
    return features.token_stats(essays(spark, sf))


@query(f"with {CTE_MATTR} select essay_id, cast(distinct_sum as bigint) as distinct_sum, cast(window_words as bigint) as window_words from mt")
def mattr_numerator(spark, sf):
    return features.mattr(essays(spark, sf))


@query(f"with {CTE_TOKENS} select essay_id, token, n from tc where length(token) >= 3 and n >= 5")
def repeated_words(spark, sf):
    return features.words_again(essays(spark, sf))


@query(f"with {CTE_VOCAB} select token, n_paragraphs from vocab")
def academic_vocab(spark, sf):
    return features.academic_vocabulary(paragraph_table(spark, sf))


@query(f"with {CTE_LEXICAL} select * from lex")
def lexical_features(spark, sf):
    return lexical(spark, sf)


@query(f"with {CTE_D2} select essay_id, cast(n_types as bigint) as n_types, D2 from d2")
def coherence_score(spark, sf):
    n = F.size(features.discourse(F.lower("text"), MARKERS))
    return essays(spark, sf).select("essay_id", n.cast("long").alias("n_types"), scoring.coherence_score(n).alias("D2"))


@query(f"with {CTE_D4} select essay_id, n_paragraphs, has_intro, has_thesis, has_conclusion, D4 from d4")
def structure_score(spark, sf):
    s = essays(spark, sf).select("essay_id", features.structure(F.col("text"), INTRO, THESIS, CONCLUSION, NEWLINE).alias("s")).select("essay_id", "s.*")
    return s.select("essay_id", F.col("n_paragraphs").cast("long").alias("n_paragraphs"), "has_intro", "has_thesis", "has_conclusion", scoring.structure_score(F.col("n_paragraphs"), F.col("has_intro"), F.col("has_thesis"), F.col("has_conclusion")).alias("D4"))


@query(rf"with s as (select doc_id as essay_id, list_transform({SENTENCES}, lambda x: len(regexp_extract_all(lower(x), '[\p{{L}}]+'))) as z from documents) select essay_id, len(z) as n_sentences, cast(coalesce(list_sum(z), 0) as bigint) as sum_words, cast(coalesce(list_sum(list_transform(z, lambda x: x * x)), 0) as bigint) as sum_squares from s")
def sentence_variance(spark, sf):
    return features.sentence_variance(essays(spark, sf)).select("essay_id", F.col("n_sentences").cast("long").alias("n_sentences"), "sum_words", "sum_squares")


@query(f"with {CTE_ALL} select essay_id, D2, D3, D4, cast(D2 + D3 + D4 as int) as total, case when D2 <= D3 and D2 <= D4 then 'D2' when D3 <= D4 then 'D3' else 'D4' end as weakest from sc")
def essay_scores(spark, sf):
    d = {k: F.col(k) for k in ("D2", "D3", "D4")}
    return scored(spark, sf).select("essay_id", "D2", "D3", "D4", scoring.total(d).alias("total"), scoring.weakest(d).alias("weakest"))


@query(f"with {CTE_ALL} select dimension, score, count(*) as n from (select essay_id, 'D2' as dimension, D2 as score from sc union all select essay_id, 'D3', D3 from sc union all select essay_id, 'D4', D4 from sc) group by all")
def score_distribution(spark, sf):
    return scoring.score_distribution(scored(spark, sf), "essay_id", ("D2", "D3", "D4"))


@query(f"with {CTE_ALL}, notes as (select essay_id as id, 'D2' as dimension, D2 as score from sc union all select essay_id, 'D3', D3 from sc union all select essay_id, 'D4', D4 from sc), adv as (select * from notes where score < 5) select id, dimension, score, cast(row_number() over (partition by id order by score, dimension) as int) as rank from adv")
def recommendations(spark, sf):
    rows = scoring.long_scores(scored(spark, sf), "essay_id", ("D2", "D3", "D4")).withColumnRenamed("essay_id", "id").withColumn("advice", F.when(F.col("score") < 5, "improve").otherwise(""))
    return scoring.recommendations(rows, F.lit("D1")).select("id", "dimension", "score", "rank")


@query(f"with {CTE_D2} select essay_id, coalesce(case when quality = 1 then 5 when quality = 0 then 1 end, D2) as D2, l.doc_id is not null as reviewed from d2 left join labels l on l.doc_id = essay_id")
def review_overlay(spark, sf):
    reviews = table(spark, sf, "labels").select(F.col("doc_id").alias("essay_id"), F.when(F.col("quality") == 1, 5).when(F.col("quality") == 0, 1).alias("D2"))
    return scoring.review_overlay(coherence_score(spark, sf).select("essay_id", "D2"), reviews, "essay_id", ("D2",))


@query(f"with {CTE_D2}, p as (select D2 as a, 1 + 4 * quality as b from d2 join labels on doc_id = essay_id where quality is not null), o as (select count(*) as n, sum((a - b) * (a - b))::double as o from p), e as (select sum(x.n * y.n * (x.a - y.b) * (x.a - y.b))::double as e from (select a, count(*) as n from p group by a) x, (select b, count(*) as n from p group by b) y) select n, round(1 - o * n / nullif(e, 0), 6) as kappa from o, e")
def agreement_qwk(spark, sf):
    lab = table(spark, sf, "labels").where("quality is not null").select(F.col("doc_id").alias("essay_id"), (1 + 4 * F.col("quality")).alias("b"))
    out = scoring.weighted_kappa(coherence_score(spark, sf).select("essay_id", F.col("D2").alias("a")).join(lab, "essay_id"))
    return out.select("n", F.round("kappa", 6).alias("kappa"))


@query(rf"with b as (select doc_id as essay_id, {STRIP("coalesce(text, '')")} as t from documents) select essay_id, reason from (select essay_id, case when length(t) = 0 then 'blank' when length(t) < 30 then 'too short' when len(regexp_extract_all(lower(t), '[\p{{L}}]+')) = 0 then 'no script tokens' when len(string_split_regex(t, '\s+')) < 10 then 'too few words' end as reason from b) where reason is not null")
def rejected_essays(spark, sf):
    return features.gate(essays(spark, sf)).where("reason is not null").select("essay_id", "reason")


@query(rf"with c as (select doc_id as essay_id, list_filter(list_transform(string_split(regexp_replace(text, '([.。।])\s*', '\1' || chr(1), 'g'), chr(1)), lambda p: {STRIP('p')}), lambda p: length(p) > 0) as s from documents) select essay_id, cast(b as int) as batch_no, len(s[(b - 1) * 6 + 1:b * 6]) as n_sentences, cast(ceil(len(s) / 6.0) as int) as n_batches from (select essay_id, s, unnest(range(1, cast(ceil(len(s) / 6.0) as bigint) + 1)) as b from c)")
def claim_batches(spark, sf):
    return T.batch_sentences(essays(spark, sf)).select("essay_id", "batch_no", F.size("sentences").cast("long").alias("n_sentences"), "n_batches")


@query(f"with p as (select doc_id, unnest({PARAS}) as text, generate_subscripts({PARAS}, 1) - 1 as pos from documents) select doc_id, 'p_' || lpad(pos::varchar, greatest(4, length(pos::varchar))::int, '0') as passage_id, text[1:500] as passage from p where length(text) > 80")
def passages(spark, sf):
    return features.passages(paragraph_table(spark, sf))


@query(f"""with p as (select doc_id, unnest({PARAS}) as text, generate_subscripts({PARAS}, 1) - 1 as pos from documents), h as (select *, length(text) < 60 as head from p),
s as (select *, last_value(case when head then pos end ignore nulls) over w as start, last_value(case when head then text end ignore nulls) over w as heading from h window w as (partition by doc_id order by pos rows unbounded preceding)),
m as (select *, max(start) over (partition by doc_id, heading) as latest from s where heading is not null) select doc_id, heading, cast(pos as bigint) as pos, text[1:200] as fact from m where not head and start = latest and contains(text, ',')""")
def heading_sections(spark, sf):
    out = features.fact_sections(paragraph_table(spark, sf), F.length("text") < 60, F.regexp_extract_all("text", F.lit("(,)"), F.lit(1)))
    return out.withColumn("pos", F.col("pos").cast("long"))


@query(r"with w as (select distinct doc_id, string_split_regex(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), '\s+') as w from documents where text is not null), e as (select w, unnest(w) as word, generate_subscripts(w, 1) as i from w) select distinct 'named' as kind, w[i - 1] || ' ' || word as entity from e where word in ('the', 'la') and i > 1 union select distinct 'place', word from e where contains(word, 'ville') and length(word) > 6")
def entities(spark, sf):
    return features.extract_entities(table(spark, sf, "documents").where("text is not null"), ["the", "la"], ["ville"])


TYPES = ", ".join(f"case when {_any('lower(text)', w)} then '{t}' end" for t, w in MARKERS.items())


@query(f"select doc_id as essay_id, concat_ws(',', {TYPES}) as types from documents")
def discourse_types(spark, sf):
    return essays(spark, sf).select("essay_id", F.concat_ws(",", features.discourse(F.lower(F.coalesce("text", F.lit(""))), MARKERS)).alias("types"))


@query(f"with {CTE_D2}, p as (select D2 as a, 1 + 4 * quality as b from d2 join labels on doc_id = essay_id where quality is not null), r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from p) select count(*) as n, round(corr(ra::double, rb::double), 6) as spearman from r")
def agreement_spearman(spark, sf):
    lab = table(spark, sf, "labels").where("quality is not null").select(F.col("doc_id").alias("essay_id"), (1 + 4 * F.col("quality")).alias("b"))
    out = scoring.spearman(coherence_score(spark, sf).select("essay_id", F.col("D2").alias("a")).join(lab, "essay_id"))
    return out.select("n", F.round("spearman", 6).alias("spearman"))


#: Weights of the head by rule; no trained ones are given.
HEAD_IN, HEAD_UNITS = 64, 16
HEAD_HIDDEN = [[((h * 31 + i * 17) % 23 - 11) / 10 for i in range(HEAD_IN)] for h in range(HEAD_UNITS)]
HEAD_OUT = [[((k * 13 + h * 7) % 11 - 5) / 4 for h in range(HEAD_UNITS)] for k in range(3)]
_HEAD = lambda k: f"cast(greatest(1, least(5, round_even(4 / (1 + exp(-list_sum(list_transform(range(0, {HEAD_UNITS}), lambda h: (({k} * 13 + h * 7) % 11 - 5) / 4.0::double * u[h + 1])))) + 1, 0))) as int) as h{k}"


@query(f"""with {CTE_ALL}, units as (select vec_id, list_transform(range(0, {HEAD_UNITS}), lambda h: greatest(0.0::double, list_sum(list_transform(range(0, {HEAD_IN}), lambda i: ((h * 31 + i * 17) % 23 - 11) / 10.0::double * embedding[i + 1]::double)))) as u from embeddings where len(embedding) = {HEAD_IN}),
head as (select vec_id, {_HEAD(0)}, {_HEAD(1)}, {_HEAD(2)} from units), both_ as (select essay_id, coalesce(h0, D2) as D2, coalesce(h1, D3) as D3, coalesce(h2, D4) as D4, vec_id is not null as by_head from sc left join head on vec_id = essay_id)
select *, round((D2 + D3 + D4) / 3.0::double, 2) as average from both_""")
def embedding_head(spark, sf):
    """Scores of the head where a document has an embedding, by rule elsewhere."""
    head = scoring.embedding_head(table(spark, sf, "embeddings"), "vec_id", "embedding", HEAD_HIDDEN, HEAD_OUT).withColumnRenamed("vec_id", "essay_id")
    out = scoring.review_overlay(scored(spark, sf), head, "essay_id", ("D2", "D3", "D4")).withColumnRenamed("reviewed", "by_head")
    return out.withColumn("average", scoring.average({d: F.col(d) for d in ("D2", "D3", "D4")}))

