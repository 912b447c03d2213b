"""Dimension scores 1 to 5 and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palmleaf.functions import text as T
from palmleaf.operators import features

# Weights and thresholds of the dimension scores.
VOCABULARY = {"mattr": 0.35, "academic": 0.40, "repetition": 0.25, "mattr_full": 0.70, "academic_full": 0.15, "informal_most": 0.30}
STRUCTURE = {"intro": 0.25, "thesis": 0.25, "body": 0.30, "conclusion": 0.20}
DIMENSIONS = ("D1", "D2", "D3", "D4")


def coherence_score(n_types: Column) -> Column:
    """0 to 4 or more marker types give 1 to 5."""
    return F.least(n_types, F.lit(4)).cast("int") + 1


def _to_five(x: Column) -> Column:
    """bround(4x + 1) within 1 to 5: halves go to the even number."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.bround(x * 4 + 1).cast("int")))


def vocabulary_raw(mattr: Column, academic: Column, repeated: Column, informal: Column) -> Column:
    """Weighted vocabulary quality, 0 or more, from the four ratios rounded to 4 places."""
    w, r = VOCABULARY, lambda c: F.round(c, 4)
    good = w["mattr"] * F.least(r(mattr) / w["mattr_full"], F.lit(1.0)) + w["academic"] * F.least(r(academic) / w["academic_full"], F.lit(1.0)) + w["repetition"] * F.greatest(F.lit(0.0), 1 - r(repeated) * 3)
    return F.greatest(F.lit(0.0), good - F.least(r(informal) * 2, F.lit(w["informal_most"])))


def vocabulary_score(mattr: Column, academic: Column, repeated: Column, informal: Column) -> Column:
    return _to_five(vocabulary_raw(mattr, academic, repeated, informal))


def structure_score(n_paragraphs: Column, has_intro: Column, has_thesis: Column, has_conclusion: Column) -> Column:
    """Body counts 0, 0.5 at two paragraphs, (n - 2) / 3 above, 1 at most."""
    body = F.when(n_paragraphs < 2, F.lit(0.0)).when(n_paragraphs == 2, F.lit(0.5)).otherwise(F.least((n_paragraphs - 2) / F.lit(3.0), F.lit(1.0)))
    w = STRUCTURE
    return _to_five(w["intro"] * has_intro.cast("int") + w["thesis"] * has_thesis.cast("int") + w["body"] * body + w["conclusion"] * has_conclusion.cast("int"))


def ratio(a: str, b: str) -> Column:
    """a / b, 0 over nothing."""
    return F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))


def score_texts(essays: DataFrame, vocabulary: DataFrame, informal: list[str], markers: dict[str, list[str]], signals: tuple[list[str], list[str], list[str]], separator: str = r"\n\s*\n", script: str = T.LETTERS) -> DataFrame:
    """``(essay_id, n_tokens, D2, D3, D4)`` of every essay (ids are unique; a null text is empty); vocabulary has the column token.

    A text is split once; moving ratios and word counts are made of a batch of rows at a time, which holds its words against the most
    frequent ones of the vocabulary; only what is left of its different words meets the rest of the vocabulary in a join.
    """
    known = features.lexicon(vocabulary, informal)
    text = F.coalesce("text", F.lit(""))
    own = F.struct(coherence_score(F.size(features.discourse(F.col("low"), markers))).alias("D2"), features.structure_of(F.col("paras"), *signals).alias("s"))
    rows = features.words_of(essays, script, "text")
    rows = rows.select("essay_id", F.lower(text).alias("low"), T.paragraphs(text, separator).alias("paras"), "words")
    rows = rows.select("essay_id", own.alias("own"), "words").select("essay_id", "own.D2", "own.s.*", "words")
    rows = rows.withColumn("m", features.word_figures(F.col("words"), known=known))  # when texts are gone, so that they need not wait for Python
    out = features.meet_far(rows.select("essay_id", "D2", "n_paragraphs", "has_intro", "has_thesis", "has_conclusion", "m.*"), known)
    d3 = vocabulary_score(ratio("distinct_sum", "window_words"), ratio("n_academic", "n_tokens"), ratio("n_repeated", "n_types"), ratio("n_informal", "n_tokens"))
    d4 = structure_score(F.col("n_paragraphs"), F.col("has_intro"), F.col("has_thesis"), F.col("has_conclusion"))
    return out.select("essay_id", "n_tokens", "D2", d3.alias("D3"), d4.alias("D4"))


def batch_auto_score(essays: DataFrame, vocabulary: DataFrame, informal: list[str], markers: dict[str, list[str]], signals: tuple[list[str], list[str], list[str]], separator: str = r"\n\s*\n", script: str = T.LETTERS) -> DataFrame:
    """``(essay_id, reason, n_tokens, D2, D3, D4)``, every essay once: scores of those that can be scored, the reason of the others."""
    gated = features.gate(essays, script=script).select(F.col("essay_id").alias("_id"), "reason")
    scored = score_texts(essays, vocabulary, informal, markers, signals, separator, script)
    out = gated.join(scored.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("essay_id")))
    return out.select("essay_id", "reason", "n_tokens", *(F.when(F.col("reason").isNull(), F.col(d)).alias(d) for d in ("D2", "D3", "D4")))


def missing(parts: dict[str, Column]) -> Column:
    """Names of the parts that are false."""
    return F.array_compact(F.array(*(F.when(~c, F.lit(n)) for n, c in parts.items())))


def _present(scores: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(c.cast("int") for c in scores.values())))


def total(scores: dict[str, Column]) -> Column:
    """Sum of the scores that are not null."""
    return F.aggregate(_present(scores), F.lit(0), lambda a, x: a + x)


def average(scores: dict[str, Column]) -> Column:
    """Mean of the scores that are not null, 2 places; null without any."""
    return F.round(total(scores) / F.nullif(F.size(_present(scores)), F.lit(0)), 2)


def weakest(scores: dict[str, Column]) -> Column:
    """Name of the lowest of D2, D3 and D4, nulls and zeros left out, the first of equal ones; D2 without any."""
    kept = {k: v for k, v in scores.items() if k != "D1"}
    low = F.array_min(F.array_compact(F.array(*(F.when(v > 0, F.struct(v.cast("int").alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k"))) for i, (k, v) in enumerate(kept.items())))))
    return F.coalesce(low["k"], F.lit("D2"))


def summary_band(mean: Column) -> Column:
    return F.when(mean >= 4, "strong").when(mean >= 3, "fair").otherwise("weak")


def note(findings: list[tuple[Column, str, str]]) -> Column:
    """Struct what_wrong, how_to_improve: the texts of the findings that hold, joined by a bar; empty where none does."""
    pick = lambda k: F.concat_ws(" | ", *(F.when(f[0], F.lit(f[k])) for f in findings))
    return F.struct(pick(1).alias("what_wrong"), pick(2).alias("how_to_improve"))


def coherence_note(types: Column, all_types: list[str]) -> Column:
    """Note of D2: each kind of linking word that is absent."""
    return note([(~F.array_contains(types, t), f"{t}: none", f"link with {t}") for t in all_types])


def vocabulary_note(mattr: Column, academic: Column, n_informal: Column, n_repeated: Column) -> Column:
    """Note of D3."""
    return note([(mattr < 0.45, "words come again and again", "vary the words"), (academic < 0.05, "hardly any subject terms", "name things by subject terms"), (n_informal > 0, "colloquial words", "choose written forms"), (n_repeated > 0, "some words five times or more", "use other words for them")])


def structure_note(has_intro: Column, has_thesis: Column, n_paragraphs: Column, has_conclusion: Column) -> Column:
    """Note of D4."""
    return note([(~has_intro, "no opening", "open with the subject"), (~has_thesis, "no claim", "say early what is argued"), (n_paragraphs < 4, "short body", "give each argument a paragraph"), (~has_conclusion, "no close", "close with a summary")])


def accuracy_note(ok: Column, accuracy: Column, n_correct: Column, n_incorrect: Column, error: Column | None = None, claims: Column | None = None) -> Column:
    """Note of D1 from an accuracy row: the check failed (with its error, where given), was not made (null), found nothing to verify, or the counts;
    then the texts of wrong claims, where given (array)."""
    counted = F.format_string("%d correct, %d incorrect: %.1f%%", n_correct.cast("int"), n_incorrect.cast("int"), accuracy.cast("double"))
    failed = F.concat_ws(": ", F.lit("check failed"), error) if error is not None else F.lit("check failed")
    base = F.when(ok.isNull(), "not checked").when(~ok, failed).when(accuracy.isNull(), "nothing to verify").otherwise(counted)
    return base if claims is None else F.concat_ws(" | ", base, F.array_join(claims, " | "))


def long_scores(scored: DataFrame, id_col: str, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """``(id, dimension, score)``, one row a dimension."""
    rows = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("int").alias("score")) for d in dimensions))
    return scored.select(id_col, F.explode(rows).alias("r")).select(id_col, "r.*")


def score_distribution(scored: DataFrame, id_col: str, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """``(dimension, score, n)``; null scores are left out."""
    return long_scores(scored, id_col, dimensions).where("score is not null").groupBy("dimension", "score").agg(F.count("*").alias("n"))


def recommendations(notes: DataFrame, focus: Column) -> DataFrame:
    """``notes`` (id, dimension, score, advice) that have advice, with ``rank``: the focus dimension first, then by score, nulls last."""
    order = Window.partitionBy("id").orderBy(F.when(F.col("dimension") == focus, 0).otherwise(1), F.col("score").asc_nulls_last(), "dimension")
    return notes.where(F.length("advice") > 0).withColumn("rank", F.row_number().over(order))


def review_progress(rows: DataFrame) -> DataFrame:
    """``(n, n_reviewed, percent)`` of an overlay; 0 percent of nothing."""
    out = rows.agg(F.count("*").alias("n"), F.count_if("reviewed").alias("n_reviewed"))
    return out.withColumn("percent", F.coalesce(F.round(F.col("n_reviewed") * 100 / F.nullif("n", F.lit(0))), F.lit(0.0)).cast("int"))


def review_overlay(auto: DataFrame, reviews: DataFrame, id_col: str, dimensions: tuple[str, ...]) -> DataFrame:
    """Reviewed scores in place of automatic ones, with ``reviewed``; reviews: id and any of the dimensions, and annotator where given, which is kept then."""
    more = ["annotator"] if "annotator" in reviews.columns else []
    r = reviews.select(F.col(id_col).alias("_id"), *(F.col(d).alias(f"_{d}") for d in [*dimensions, *more]))
    out = auto.join(r, F.col(id_col) == F.col("_id"), "left")
    return out.select(id_col, *(F.coalesce(f"_{d}", d).alias(d) for d in dimensions), F.col("_id").isNotNull().alias("reviewed"), *(F.col(f"_{c}").alias(c) for c in more))


def weighted_kappa(pairs: DataFrame, a: str = "a", b: str = "b", levels: int = 5) -> DataFrame:
    """``(n, kappa)``: quadratic-weighted agreement of two scores 1 to ``levels``; null where nothing can disagree."""
    cells = pairs.where(F.col(a).between(1, levels) & F.col(b).between(1, levels)).groupBy(a, b).agg(F.count("*").alias("n"))
    row, col = cells.groupBy(F.col(a).alias("ra")).agg(F.sum("n").alias("rn")), cells.groupBy(F.col(b).alias("cb")).agg(F.sum("n").alias("cn"))
    expected = row.crossJoin(F.broadcast(col)).agg(F.sum(F.col("rn") * F.col("cn") * F.pow(F.col("ra") - F.col("cb"), 2)).alias("e"))  # levels x levels
    seen = cells.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col(a) - F.col(b), 2)).alias("o"))
    return seen.crossJoin(F.broadcast(expected)).select("n", (1 - F.col("o") * F.col("n") / F.nullif("e", F.lit(0.0))).alias("kappa"))


def agreement(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(n, pearson, mean_error)`` of two numeric columns."""
    return pairs.agg(F.count("*").alias("n"), F.corr(a, b).alias("pearson"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_error"))


def spearman(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(n, spearman)``: correlation of average ranks; null where a column has one value only.

    Ranks come from the counts of each value, so the columns should be scores of few levels. Pairs with a null are left out.
    """
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))

    def ranks(c: str) -> DataFrame:
        sizes = cells.groupBy(F.col(c).alias(f"v{c}")).agg(F.sum("n").alias("m"))
        return sizes.selectExpr(f"v{c}", f"sum(m) over (order by v{c}) - (m - 1) / 2.0D as r{c}")

    ranked = cells.join(ranks("a"), F.col("a") == F.col("va")).join(ranks("b"), F.col("b") == F.col("vb"))
    sums = ranked.selectExpr("n", "n * ra as x", "n * rb as y", "n * ra * ra as xx", "n * rb * rb as yy", "n * ra * rb as xy")
    sums = sums.agg(*(F.sum(c).alias(c) for c in sums.columns))
    spread = F.sqrt((F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("n") * F.col("yy") - F.col("y") * F.col("y")))
    return sums.select(F.coalesce("n", F.lit(0)).alias("n"), ((F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.nullif(spread, F.lit(0.0))).alias("spearman"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def embedding_head(vectors: DataFrame, id_col: str, embedding: str, hidden: list[list[float]], out: list[list[float]], dimensions: tuple[str, ...] = DIMENSIONS[1:]) -> DataFrame:
    """Scores by a two-layer head over stored embeddings: sigmoid(out . relu(hidden . x)) * 4 + 1, rounded, 1 to 5; one row of ``out`` a dimension.

    Embeddings that are null, of another length or with a null or non-finite component give no row.
    """
    matrix = lambda rows: F.array(*(F.array(*(F.lit(float(w)) for w in row)) for row in rows))
    whole = (F.size("_x") == len(hidden[0])) & F.forall("_x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    rows = vectors.select(id_col, F.col(embedding).cast("array<double>").alias("_x")).where(whole)
    rows = rows.select(id_col, F.transform(matrix(hidden), lambda w: F.greatest(F.lit(0.0), _dot(w, F.col("_x")))).alias("_units"))
    weights = (F.array(*(F.lit(float(w)) for w in row)) for row in out)
    return rows.select(id_col, *(_to_five(1 / (1 + F.exp(-_dot(w, F.col("_units"))))).alias(d) for d, w in zip(dimensions, weights)))
