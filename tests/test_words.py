"""Words counted within a row: the same as grouped ones, and no row or sort for each word."""

import random

import pytest
from pyspark.sql import functions as F

from palmleaf.operators import features, scoring

TEXTS = [(1, "the cat and the cat, the the the dog"), (1, "cat dog dog dog dog ville"), (2, None), (3, "x1y; z"), (4, "12 34"), (5, "dogs dogs dogs dogs dogs la la")]
VOCABULARY = [("cat",), ("dogs",)]


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_counts_equal_grouped_ones(spark):
    essays, known = spark.createDataFrame(TEXTS, "essay_id long, text string"), spark.createDataFrame(VOCABULARY, "token string")
    counts = features.token_counts(essays)
    assert rows(features.token_stats(essays)) == rows(counts.groupBy("essay_id").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_types")))
    assert rows(features.words_again(essays)) == rows(features.repeated_words(counts)) == [(1, 5, "dog"), (1, 5, "the"), (5, 5, "dogs")]
    assert rows(features.lexical_counts(essays, known, ["the", "la"])) == rows(features.lexical(essays, counts, known, ["the", "la"]))


def test_no_row_for_each_word(spark):
    essays = spark.createDataFrame([t for t in TEXTS if t[0] > 1], "essay_id long, text string")
    assert "Generate" not in plan(features.token_stats(essays))
    scored = scoring.score_texts(essays, spark.createDataFrame(VOCABULARY, "token string"), ["la"], {"a": ["and"]}, (["the"], ["that"], ["is"]))
    assert "SortAggregate" not in plan(scored)


def test_entities_within_a_row(spark):
    docs = spark.createDataFrame([("see the the Bbville ville villeX la",), ("the end",)], "text string")
    found = features.extract_entities(docs, ["the", "la"], ["ville"])
    assert rows(found) == [("Bbville", "place"), ("see the", "named"), ("the the", "named"), ("villeX la", "named")]
    assert "posexplode" not in plan(found)


@pytest.mark.parametrize("window,most", [(1, 1), (4, 7), (4, 500_000), (50, 30)])
def test_word_figures_equal_all_windows(spark, monkeypatch, window, most):
    """Few words at a time, so that rows are cut off between batches; a word of two letters is not repeated, whatever its characters."""
    monkeypatch.setattr(features, "WORDS_MOST", most)
    rnd = random.Random(window + most)
    lists = [[], None, ["a"], ["den"] * 5, ["දෙ"] * 9, ["ĳĳ"] * 6] + [[rnd.choice(["one", "two", "ab", "épée", "x"]) for _ in range(rnd.randrange(70))] for _ in range(40)]

    def want(words):
        w = words or []
        views = [w] if len(w) < window else [w[i : i + window] for i in range(len(w) - window + 1)]
        return sum(len(set(v)) for v in views), sum(map(len, views)), len(set(w)), sum(len(t) >= 3 and w.count(t) >= 5 for t in set(w))

    got = spark.createDataFrame(list(enumerate(lists)), "id long, words array<string>").repartition(2)
    got = got.select("id", features.word_figures(F.col("words"), window).alias("f")).collect()
    assert {r.id: tuple(r.f) for r in got} == {i: want(w) for i, w in enumerate(lists)}


def test_texts_are_scored_without_sorting_words_in_rows(spark):
    essays = spark.createDataFrame(TEXTS[2:], "essay_id long, text string")
    scored = scoring.score_texts(essays, spark.createDataFrame(VOCABULARY, "token string"), ["la"], {"a": ["and"]}, (["the"], ["that"], ["is"]))
    assert "sort_array" not in plan(scored)


def test_vocabulary_counts_paragraphs_without_a_row_for_each_word(spark, monkeypatch):
    monkeypatch.setattr(features, "WORDS_MOST", 5)
    texts = ["aaaa bbbb aaaa", "AAAA cc", "aaaa bbbb", None, "", "bbbb éééé dd", "éééé", "éééé éééé"]
    found = features.academic_vocabulary(spark.createDataFrame(list(enumerate(texts)), "para_id long, text string").repartition(2))
    assert rows(found) == [(3, "aaaa"), (3, "bbbb"), (3, "éééé")]
    assert "Generate" not in plan(found)


@pytest.mark.parametrize("near,counted", [(0, True), (2, True), (3, True), (1 << 17, True), (2, False)])
def test_near_and_far_words_of_a_vocabulary_count_alike(spark, monkeypatch, near, counted):
    """Few near words, so that some or all are met in the join; two-letter words of the vocabulary and of no text too."""
    monkeypatch.setattr(features, "NEAR_MOST", near)
    monkeypatch.setattr(features, "WORDS_MOST", 40)
    rnd = random.Random(near)
    names = ["one", "two", "ab", "épée", "x", "three", "four"]
    texts = [(i, " ".join(rnd.choice(names) for _ in range(rnd.randrange(60)))) for i in range(30)] + [(30, None), (31, "12"), (32, "x x x")]
    words = [("one", 900), ("ab", 40), ("épée", 40), ("four", 3), ("never", 3)]
    essays, known = spark.createDataFrame(texts, "essay_id long, text string").repartition(3), spark.createDataFrame(words, "token string, n_paragraphs long")
    known = known if counted else known.select("token")
    counts = features.token_counts(essays)
    assert rows(features.lexical_counts(essays, known, ["one", "x"])) == rows(features.lexical(essays, counts, known, ["one", "x"]))
    scored = scoring.score_texts(essays, known, ["one", "x"], {"a": ["two"]}, (["one"], ["ab"], ["x"]))
    want = features.lexical(essays, counts, known, ["one", "x"]).join(features.mattr(essays), "essay_id")
    score = scoring.vocabulary_score(scoring.ratio("distinct_sum", "window_words"), scoring.ratio("n_academic", "n_tokens"), scoring.ratio("n_repeated", "n_types"), scoring.ratio("n_informal", "n_tokens"))
    assert rows(scored.select("essay_id", "n_tokens", "D3")) == rows(want.select("essay_id", "n_tokens", score.alias("D3")))


def test_near_words_take_no_row_for_each_word(spark):
    essays, known = spark.createDataFrame(TEXTS[2:], "essay_id long, text string"), spark.createDataFrame(VOCABULARY, "token string")
    assert "Generate" not in plan(scoring.score_texts(essays, known, ["la"], {"a": ["and"]}, (["the"], ["that"], ["is"])))
    assert "Generate" not in plan(features.lexical_counts(essays, known, ["la"]))
