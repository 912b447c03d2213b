"""Lexical, coherence and structure features of essays: frames in, frames out, one row an essay unless said otherwise.

Lexicons are tables or lists that the caller gives. Essays have essay_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palmleaf.functions import text as T
from palmleaf.shared import materialize

WINDOW = 50
#: Words that are looked at in one go: a batch of rows may hold millions.
WORDS_MOST = 500_000
#: Words of a vocabulary that go to every task, the most frequent ones; texts meet the others in a join.
NEAR_MOST = 1 << 17
FIGURES = ("distinct_sum", "window_words", "n_types", "n_repeated")
LEXICAL = ("n_tokens", "n_academic", "n_informal")


def gate(essays: DataFrame, least_chars: int = 30, least_words: int = 10, script: str = T.LETTERS) -> DataFrame:
    """Essays with ``reason``: null if they can be scored, else why not."""
    bare = T.strip_ws(F.coalesce("text", F.lit("")))
    reason = F.when(F.length(bare) == 0, "blank").when(F.length(bare) < least_chars, "too short").when(F.size(T.tokens(bare, script)) == 0, "no script tokens").when(T.word_count(bare) < least_words, "too few words")
    return essays.withColumn("reason", reason)


def word_places(words: Column) -> Column:
    """Array of (w, i): the words of an array with their places, by word, then place; what follows is made of it within a row, without a shuffle."""
    return F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))


def run_starts(places: Column) -> Column:
    """Where in the column of word_places each different word begins, and at last its size."""
    starts = F.filter(F.transform(places, lambda x, k: F.when((k == 0) | (F.get(places, k - 1)["w"] != x["w"]), k)), lambda k: k.isNotNull())
    return F.array_append(starts, F.size(places))


def word_runs(places: Column, starts: Column) -> Column:
    """Array of (token, n, first), each different word once, from the columns of word_places and run_starts: columns, for an expression would be made again for each word."""
    run = lambda k, j: F.when(j < F.size(starts) - 1, F.struct(F.get(places, k)["w"].alias("token"), (F.get(starts, j + 1) - k).cast("long").alias("n"), F.get(places, k)["i"].alias("first")))
    return F.array_compact(F.transform(starts, run))


def _slices(lists: pa.Array) -> Iterator[pa.Array]:
    """Lists that WORDS_MOST words fill, one at least, in order."""
    ends, at = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(lists):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS_MOST, "right")))
        yield lists.slice(at, end - at)
        at = end


def _numbered(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Words of each list; of each word the list and the word's number; the different words and their letters."""
    n = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    named = lists.flatten().dictionary_encode()
    code = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    letters = pc.utf8_length(named.dictionary).to_numpy(zero_copy_only=False)
    return n, np.repeat(np.arange(len(n)), n), code, named.dictionary, letters


class Lexicon(NamedTuple):
    """A vocabulary (table ``words``, column v) as texts meet it: ``near`` words go to every task, ``far`` is the table of the others (None if
    there are none), of ``least`` letters or more."""

    words: DataFrame
    near: pa.Array
    far: DataFrame | None
    least: int
    informal: list[str]


def lexicon(vocabulary: DataFrame, informal: list[str]) -> Lexicon:
    """The vocabulary (token, and n_paragraphs where it is known) is written; NEAR_MOST words at most, those of most paragraphs, are near."""
    often = F.col("n_paragraphs") if "n_paragraphs" in vocabulary.columns else F.lit(1)
    words = vocabulary.where("token is not null").groupBy(F.col("token").alias("v")).agg(F.max(F.floor(F.log2(F.greatest(often, F.lit(1))) * 8)).alias("step"))
    words = materialize(words, "vocabulary")
    steps = sorted(map(tuple, words.groupBy("step").agg(F.count("*"), F.min(F.length("v"))).collect()), reverse=True)  # eight for each doubling
    sums = np.cumsum([n for _, n, _ in steps])
    k = int(np.searchsorted(sums, NEAR_MOST, "right"))  # as many steps as are near
    near = words.where(F.col("step") >= steps[k - 1][0]).select("v").toArrow().column("v").combine_chunks() if k else pa.array([], pa.string())
    if k == len(steps):
        return Lexicon(words, near, None, 0, informal)
    return Lexicon(words, near, words.where(F.col("step") < steps[k - 1][0]) if k else words, min(least for *_, least in steps[k:]), informal)


def word_figures(words: Column, window: int = WINDOW, times: int = 5, known: Lexicon | None = None) -> Column:
    """Struct (distinct_sum, window_words, n_types, n_repeated) of an array of words: distinct words of all windows of ``window`` words, and the
    words in them; different words, and those of them of three letters or more that come ``times`` times or more.

    With a lexicon also n_tokens, n_academic (near words only), n_informal, and far, an array of (token, n) of those words that can be far ones.

    A word counts as distinct once in each window that holds it, there by its first place, so at place i with the same word last at
    place p it counts in the windows that begin after p and hold i. Words are numbered and sorted a batch of rows, not a row, at a time.
    """

    meets = known is not None
    near_words, rest, least, informal = (known.near, known.far is not None, known.least, known.informal) if meets else (None, False, 0, [])  # a table cannot go to tasks

    def figures(lists: pa.Array) -> list[pa.Array]:
        n, row, code, names, letters = _numbered(lists)
        place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(row * max(len(letters), 1) + code, kind="stable")
        row, code, place = row[order], code[order], place[order]
        new = np.ones(len(code), bool)
        new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
        before = np.where(new, -1, np.roll(place, 1))
        first = np.maximum(np.maximum(before + 1, place - (window - 1)), 0)
        held = np.maximum(np.minimum(place, np.maximum(n - window, 0)[row]) - first + 1, 0)
        runs = np.flatnonzero(new)
        sizes = np.diff(np.append(runs, len(code))) if len(runs) else runs
        often = runs[(sizes >= times) & (letters[code[runs]] >= 3)]
        count = lambda rows, weights=None: np.bincount(rows, weights, len(n)).astype(np.int64)
        out = [count(row, held), np.where(n < window, n, (n - window + 1) * window), count(row[runs]), count(row[often])]
        if not meets:
            return [pa.array(c, pa.int64()) for c in out]
        among = lambda some: pc.is_in(names, value_set=pa.array(some, names.type)).to_numpy(zero_copy_only=False)
        near = among(near_words)
        out += [n, count(row[near[code]]), count(row[among(informal)[code]])]
        left = rest & ~near[code[runs]] & (letters[code[runs]] >= least)
        pairs = pa.StructArray.from_arrays([names.take(pa.array(code[runs][left])), pa.array(sizes[left], pa.int64())], ["token", "n"])
        ends = np.append(0, np.cumsum(count(row[runs][left]))).astype(np.int32)
        return [*(pa.array(c, pa.int64()) for c in out), pa.ListArray.from_arrays(pa.array(ends), pairs)]

    fields = [f"{c} long" for c in (*FIGURES, *LEXICAL * meets)] + ["far array<struct<token string, n long>>"] * meets

    @F.arrow_udf(", ".join(fields))
    def of_batch(lists: pa.Array) -> pa.Array:
        parts = [figures(x) for x in _slices(lists)] or [figures(lists)]
        return pa.StructArray.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], [f.split()[0] for f in fields])

    return of_batch(words)


def meet_far(rows: DataFrame, known: Lexicon) -> DataFrame:
    """``rows`` (essay_id, n_academic, far, and others; ids are unique), written first, with the far words of each added to n_academic; only these become rows."""
    if known.far is None:
        return rows.drop("far")
    rows = materialize(rows, "figures")
    pairs = rows.select("essay_id", F.explode_outer("far").alias("p")).where("p is not null").select("essay_id", "p.*")
    hits = pairs.join(known.far.hint("merge"), F.col("token") == F.col("v")).groupBy("essay_id").agg(F.sum("n").alias("n_academic"))
    own = [c for c in rows.columns if c not in ("essay_id", "n_academic", "far")]
    whole = rows.drop("far").unionByName(hits, allowMissingColumns=True)
    return whole.groupBy("essay_id").agg(F.sum("n_academic").alias("n_academic"), *(F.max(c).alias(c) for c in own))


def _with_places(essays: DataFrame, script: str, *columns: str) -> DataFrame:
    return essays.select("essay_id", *columns, word_places(T.tokens(F.coalesce("text", F.lit("")), script)).alias("places"))


def token_counts(essays: DataFrame, script: str = T.LETTERS) -> DataFrame:
    """``(essay_id, token, n, first)``: occurrences and first place of each token of each essay; texts of one id are taken together."""
    rows = _with_places(essays, script).withColumn("starts", run_starts(F.col("places")))
    rows = rows.select("essay_id", word_runs(F.col("places"), F.col("starts")).alias("runs"))
    # outer, for a plain explode gets a filter on the size of its array, which is made again for that below all columns here
    rows = rows.select("essay_id", F.explode_outer("runs").alias("r")).where("r is not null")
    return rows.groupBy("essay_id", "r.token").agg(F.sum("r.n").alias("n"), F.min("r.first").alias("first"))


def words_of(essays: DataFrame, script: str = T.LETTERS, *columns: str) -> DataFrame:
    """``(essay_id, words)`` and ``columns``: the words of each row as an array; a null text has none."""
    return essays.select("essay_id", *columns, T.tokens(F.coalesce("text", F.lit("")), script).alias("words"))


def again(words: Column, times: int = 5) -> Column:
    """From a sorted array the words of three letters or more from their ``times``-th place on: a word that comes n times is left n - times + 1 times."""
    return F.filter(words, lambda w, k: (k >= times - 1) & (F.get(words, k - (times - 1)) == w) & (F.length(w) >= 3))


def by_id(essays: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Essays whose id comes once, and those of ids that come again, None if there are none: only these need their words grouped by id, for words of one row are counted within it."""
    repeated = essays.groupBy(F.col("essay_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    repeated = materialize(repeated, "repeated-ids")
    if repeated.isEmpty():
        return essays, None
    same = F.col("essay_id").eqNullSafe(F.col("_id"))
    return essays.join(repeated, same, "left_anti"), essays.join(repeated, same, "left_semi")


def token_stats(essays: DataFrame, script: str = T.LETTERS) -> DataFrame:
    """``(essay_id, n_tokens, n_types)`` of essays with words; texts of one id are taken together."""
    once, more = by_id(essays)
    out = words_of(once, script).select("essay_id", F.size("words").cast("long").alias("n_tokens"), F.size(F.array_distinct("words")).cast("long").alias("n_types")).where("n_tokens > 0")
    return out if more is None else out.unionByName(token_counts(more, script).groupBy("essay_id").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_types")))


def words_again(essays: DataFrame, times: int = 5, script: str = T.LETTERS) -> DataFrame:
    """repeated_words of the essays themselves: only words that come ``times`` times become rows."""
    once, more = by_id(essays)
    rows = words_of(once, script).select("essay_id", F.sort_array("words").alias("words")).select("essay_id", again(F.col("words"), times).alias("words"))
    rows = rows.select("essay_id", F.explode_outer("words").alias("token")).where("token is not null")
    out = rows.groupBy("essay_id", "token").agg((F.count("*") + (times - 1)).alias("n"))
    return out if more is None else out.unionByName(repeated_words(token_counts(more, script), times))


def lexical_counts(essays: DataFrame, vocabulary: DataFrame, informal: list[str], script: str = T.LETTERS) -> DataFrame:
    """As lexical, of the essays themselves: words are counted within a row, and only what is left of its different words meets the far words of the vocabulary."""
    once, more = by_id(essays)
    known = lexicon(vocabulary, informal)
    names = ("n_tokens", "n_types", "n_repeated", "n_academic", "n_informal")
    rows = words_of(once, script).select("essay_id", word_figures(F.col("words"), known=known).alias("m"))
    out = meet_far(rows.select("essay_id", *(f"m.{c}" for c in (*names, "far"))), known).select("essay_id", *names)
    return out if more is None else out.unionByName(lexical(more, token_counts(more, script), known.words.select(F.col("v").alias("token")), informal))


def lexical(essays: DataFrame, counts: DataFrame, vocabulary: DataFrame, informal: list[str]) -> DataFrame:
    """``(essay_id, n_tokens, n_types, n_repeated, n_academic, n_informal)``; vocabulary has the column token."""
    known = vocabulary.select(F.col("token").alias("v")).distinct()
    marked = counts.join(known.hint("shuffle_hash"), F.col("token") == F.col("v"), "left")
    sums = marked.groupBy("essay_id").agg(
        F.sum("n").alias("n_tokens"), F.count("*").alias("n_types"), F.count_if((F.length("token") >= 3) & (F.col("n") >= 5)).alias("n_repeated"),
        F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("n_academic"), F.sum(F.when(F.col("token").isin(*informal), F.col("n")).otherwise(0)).alias("n_informal"),
    )
    names = ("n_tokens", "n_types", "n_repeated", "n_academic", "n_informal")
    return essays.select("essay_id").join(sums, "essay_id", "left").select("essay_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))


def repeated_words(counts: DataFrame, times: int = 5) -> DataFrame:
    """``(essay_id, token, n)`` of tokens of three letters or more that occur ``times`` times or more."""
    return counts.where((F.length("token") >= 3) & (F.col("n") >= times)).select("essay_id", "token", "n")


def mattr(essays: DataFrame, window: int = WINDOW, script: str = T.LETTERS) -> DataFrame:
    """``(essay_id, distinct_sum, window_words)``; their ratio is the moving type-token ratio. Texts shorter than a window give their plain
    type-token ratio. One row a row of essays."""
    return words_of(essays, script).select("essay_id", word_figures(F.col("words"), window).alias("m")).select("essay_id", "m.distinct_sum", "m.window_words")


def discourse(text: Column, markers: dict[str, list[str]]) -> Column:
    """Array of the marker types of which some phrase is in the text, in the order given."""
    return F.array_compact(F.array(*(F.when(T.contains_any(text, p), F.lit(t)) for t, p in markers.items())))


def structure(text: Column, intro: list[str], thesis: list[str], conclusion: list[str], separator: str = r"\n\s*\n") -> Column:
    """Struct n_paragraphs, has_intro, has_thesis, has_conclusion."""
    return structure_of(T.paragraphs(text, separator), intro, thesis, conclusion)


def structure_of(paras: Column, intro: list[str], thesis: list[str], conclusion: list[str]) -> Column:
    """structure from the column of paragraphs, which an expression would make again for each field."""
    first, last = F.lower(F.coalesce(F.try_element_at(paras, F.lit(1)), F.lit(""))), F.lower(F.coalesce(F.try_element_at(paras, F.lit(-1)), F.lit("")))
    return F.struct(F.size(paras).alias("n_paragraphs"), T.contains_any(first, intro).alias("has_intro"), T.contains_any(first, thesis).alias("has_thesis"), T.contains_any(last, conclusion).alias("has_conclusion"))


def sentence_variance(essays: DataFrame, script: str = T.LETTERS) -> DataFrame:
    """``(essay_id, n_sentences, sum_words, sum_squares, variance)`` of words a sentence; population variance, 0 below two sentences."""
    sizes = F.transform(T.sentences(F.coalesce("text", F.lit(""))), lambda s: F.size(T.tokens(s, script)).cast("long"))
    rows = essays.select("essay_id", sizes.alias("sizes"))
    total = lambda f: F.aggregate("sizes", F.lit(0).cast("long"), f)
    rows = rows.select("essay_id", F.size("sizes").alias("n_sentences"), total(lambda a, x: a + x).alias("sum_words"), total(lambda a, x: a + x * x).alias("sum_squares"))
    mean = F.col("sum_words") / F.nullif("n_sentences", F.lit(0))
    return rows.withColumn("variance", F.when(F.col("n_sentences") < 2, F.lit(0.0)).otherwise(F.col("sum_squares") / F.nullif("n_sentences", F.lit(0)) - mean * mean))


def academic_vocabulary(paragraphs: DataFrame, least_paragraphs: int = 3, least_length: int = 4, script: str = T.LETTERS) -> DataFrame:
    """``(token, n_paragraphs)`` of tokens in that many paragraphs or more; paragraphs has para_id and text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in (x for batch in batches for x in _slices(batch.column(0))):
            _, row, code, names, letters = _numbered(lists)
            long = letters[code] >= least_length
            each = np.sort(row[long] * len(letters) + code[long])
            each = each[np.append(True, each[1:] != each[:-1])] if len(each) else each  # a word once a paragraph
            n = np.bincount(each % max(len(letters), 1), minlength=len(letters))
            yield pa.RecordBatch.from_arrays([names.filter(pa.array(n > 0)), pa.array(n[n > 0], pa.int64())], ["token", "n"])

    # words are counted a batch of paragraphs at a time, so that a batch's different words, not all words, become rows
    counts = paragraphs.select(T.tokens(F.col("text"), script).alias("words")).mapInArrow(counted, "token string, n long")
    return counts.groupBy("token").agg(F.sum("n").alias("n_paragraphs")).where(F.col("n_paragraphs") >= least_paragraphs)


def extract_entities(docs: DataFrame, after: list[str], inside: list[str]) -> DataFrame:
    """Distinct ``(kind, entity)``: the word before and a word of ``after``; words that hold one of ``inside`` and are longer by two."""
    words = docs.select(F.split(T.strip_ws(F.col("text")), r"\s+").alias("w"))
    named = lambda x, i: F.when(x.isin(*after) & (i > 0), F.struct(F.lit("named").alias("kind"), F.concat_ws(" ", F.get("w", i - 1), x).alias("entity")))
    holds = lambda x: reduce(lambda a, m: a | (F.contains(x, F.lit(m)) & (F.length(x) > len(m) + 1)), inside, F.lit(False))
    place = F.transform(F.filter("w", holds), lambda x: F.struct(F.lit("place").alias("kind"), x.alias("entity")))
    # picked within the row, so that no array of words goes with each word
    found = words.select(F.array_distinct(F.concat(F.array_compact(F.transform("w", named)), place)).alias("found"))
    return found.select(F.explode_outer("found").alias("e")).where("e is not null").select("e.*").distinct()


def fact_sections(paragraphs: DataFrame, is_heading: Column, dates: Column, cut: int = 200) -> DataFrame:
    """``(doc_id, heading, pos, fact)``: paragraphs with dates under the last heading before them; of a heading that comes
    again in a document only the last section counts. paragraphs has doc_id, pos, text."""
    ordered = Window.partitionBy("doc_id").orderBy("pos")
    rows = paragraphs.withColumn("is_heading", is_heading).withColumn("start", F.last(F.when(F.col("is_heading"), F.col("pos")), True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("heading", F.last(F.when(F.col("is_heading"), T.strip_ws(F.col("text"))), True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where("heading is not null").withColumn("latest", F.max("start").over(Window.partitionBy("doc_id", "heading")))
    return rows.where(~F.col("is_heading") & (F.col("start") == F.col("latest")) & (F.size(dates) > 0)).select("doc_id", "heading", "pos", F.left("text", F.lit(cut)).alias("fact"))


def passages(paragraphs: DataFrame, prefix: str = "p", longer_than: int = 80, cut: int = 500) -> DataFrame:
    """``(doc_id, passage_id, passage)`` of paragraphs longer than ``longer_than``; ids hold the zero-padded position."""
    return paragraphs.where(F.length("text") > longer_than).select("doc_id", F.format_string(f"{prefix}_%04d", F.col("pos").cast("int")).alias("passage_id"), F.left("text", F.lit(cut)).alias("passage"))


def label_span_counts(tags: DataFrame) -> DataFrame:
    """``(label, n)``: spans (B- tags) of each class in a table of one token a row with column tag."""
    return tags.where(F.startswith("tag", F.lit("B-"))).groupBy(F.substring("tag", 3, 100).alias("label")).agg(F.count("*").alias("n"))


def type_token_ratio(essays: DataFrame, script: str = T.LETTERS) -> DataFrame:
    """``(essay_id, ttr)``: different words of all, 4 places; 0 without words."""
    words = T.tokens(F.coalesce("text", F.lit("")), script)
    return essays.select("essay_id", F.coalesce(F.round(F.size(F.array_distinct(words)) / F.nullif(F.size(words), F.lit(0)), 4), F.lit(0.0)).alias("ttr"))


def word_samples(counts: DataFrame, vocabulary: DataFrame, most: int = 20) -> DataFrame:
    """``(essay_id, sample)``: the first ``most`` different words of each essay that are in ``vocabulary`` (token), in order; counts as of token_counts."""
    known = vocabulary.select(F.col("token").alias("v")).distinct()
    rows = counts.join(known.hint("shuffle_hash"), F.col("token") == F.col("v"), "left_semi")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("essay_id").orderBy("first"))).where(F.col("rank") <= most)
    return rows.groupBy("essay_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("sample"))


def extract_features(essays: DataFrame, vocabulary: DataFrame, informal: list[str], markers: dict[str, list[str]], signals: tuple[list[str], list[str], list[str]], separator: str = r"\n\s*\n") -> DataFrame:
    """One row an essay (ids are unique): counts of lexical, the ratios mattr, academic_density, informal_ratio and repeated_ratio (4 places),
    discourse types, n_paragraphs and the flags of structure, and the sentence variance. signals: intro, thesis, conclusion."""
    ratio = lambda a, b: F.coalesce(F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 4), F.lit(0.0))
    out = lexical_counts(essays, vocabulary, informal).join(mattr(essays).hint("merge"), "essay_id").join(sentence_variance(essays).hint("merge"), "essay_id")
    own = essays.select("essay_id", discourse(F.lower(F.coalesce("text", F.lit(""))), markers).alias("types"), structure(F.coalesce("text", F.lit("")), *signals, separator).alias("s"))
    out = out.join(own.select("essay_id", "types", "s.*").hint("merge"), "essay_id")
    return out.withColumns({"mattr": ratio("distinct_sum", "window_words"), "academic_density": ratio("n_academic", "n_tokens"), "informal_ratio": ratio("n_informal", "n_tokens"), "repeated_ratio": ratio("n_repeated", "n_types")})
