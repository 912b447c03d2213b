"""Licence scan by a positional index of rare words, with DataFrame functions only.

Every licence notice has a mandatory key phrase. One pass over all texts counts in how many of them each word of the notices
stands; from that come inverse document frequencies. The index then holds, for each phrase, its rarest word, and each text's
words are looked up in it: these are its rarest licence words. A posting there gives the place at which the notice would
begin, the key phrase is verified word for word at that place, and the rarest words of the whole notice are looked for at their
places relative to it: the share of their weight that is found is the score. Everything happens within a text's row: nothing
is shuffled but the counts, of which there is one for each word of the notices.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rarest words of a notice that are compared, and the share of their weight that gives the label.
RARE, MATCH = 6, 0.5
#: What stands between words.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The phrases that always count, each with its label.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
# Label, usual notice and mandatory key phrase of common licences.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights cc0", "waived all copyright and related"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)


@dataclass(frozen=True)
class Notice:
    """A notice as words, and the place of its key phrase among them."""

    label: str
    words: tuple[str, ...]
    key_at: int
    key: tuple[str, ...]

    @classmethod
    def of(cls, label: str, text: str, key: str) -> Notice:
        words, part = tuple(text.split()), tuple(key.split())
        for at in range(len(words) - len(part) + 1):
            if words[at : at + len(part)] == part:
                return cls(label, words, at, part)
        raise ValueError(f"the key phrase of {label} is not in its notice")


def words_of(text: Column) -> Column:
    """Words of a text in order, A-Z in lower case; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), "")


def word_weights(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """Inverse document frequency over all of ``docs``, in thousandths, of each word of ``vocabulary``; at least 1."""
    known = F.array(*map(F.lit, vocabulary))
    total = F.lit("").alias("word")  # stands for the number of documents: no word is empty
    each = docs.select(F.explode(F.array_append(F.array_intersect(words_of(F.col(text)), known), total)).alias("word"))
    counts = {r["word"]: r["count"] for r in each.groupBy("word").count().collect()}  # one row for each word of the notices
    n = counts.get("", 0)
    return {w: round(1000 * math.log((n + 1) / (counts.get(w, 0) + 1))) + 1 for w in vocabulary}


def _rarest(words: tuple[str, ...], weights: dict[str, int], k: int) -> list[tuple[str, int]]:
    """The ``k`` words of most weight, ties in alphabetical order, each with its first place."""
    return [(w, words.index(w)) for w in sorted(set(words), key=lambda w: (-weights[w], w))[:k]]


def scan_licenses(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES, notices: tuple[tuple[str, str, str], ...] = NOTICES, text: str = "text") -> DataFrame:
    """``docs`` with ``licenses``: n_words, places (arrays of first words) of each phrase's label, and ``shares`` of notices by label.

    A null text is empty; an empty one has no words, no places and no shares. Repeated rows each get their result. ``docs`` has no
    columns named licenses, _words or _hits, and each phrase has a label of its own. A phrase or notice that stands several times gives all its places, and the best share.
    """
    base = [Notice.of(label, phrase, phrase) for label, phrase in phrases]
    listed = [Notice.of(*x) for x in notices]
    weights = word_weights(docs, sorted({w for n in base + listed for w in n.words}), text)
    anchors = {n: _rarest(n.key, weights, 1)[0] for n in base + listed}
    index = sorted({word for word, _ in anchors.values()})
    found = F.transform(F.col("_words"), lambda w, i: F.when(w.isin(*index), F.struct(w.alias("w"), i.alias("i"))))
    rows = docs.withColumn("_words", words_of(F.col(text))).withColumn("_hits", F.filter(found, lambda h: h.isNotNull()))

    def starts(n: Notice) -> Column:
        """First words (of the notice, in or before the text) of the places where the key phrase stands."""
        word, at = anchors[n]
        at += n.key_at
        begun = F.transform(F.filter("_hits", lambda h: h["w"] == word), lambda h: h["i"] - F.lit(at))
        key = F.array(*map(F.lit, n.key))
        return F.filter(begun, lambda d: F.when(d + n.key_at >= 0, F.slice("_words", d + n.key_at + 1, len(n.key)) == key).otherwise(F.lit(False)))

    def share(n: Notice) -> Column:
        """Best share of the rare words' weight that stands at its place relative to a key phrase; null without one."""
        rare = _rarest(n.words, weights, RARE)
        total = sum(weights[w] for w, _ in rare)

        def at(d: Column) -> Column:
            return reduce(lambda a, x: a + F.when(F.get("_words", d + x[1]) == x[0], weights[x[0]]).otherwise(0), rare, F.lit(0)) / F.lit(total)

        return F.array_max(F.transform(starts(n), at))

    nothing = "n_words int, phrases map<string,array<int>>, shares array<struct<label:string,share:double>>"
    places = F.map_from_arrays(F.array(*(F.lit(n.label) for n in base)), F.array(*(starts(n) for n in base)))
    shares = F.filter(F.array(*(F.struct(F.lit(n.label).alias("label"), share(n).alias("share")) for n in listed)), lambda s: s["share"].isNotNull())
    licenses = F.struct(F.size("_words").alias("n_words"), F.when(F.size("_hits") > 0, places).alias("phrases"), F.when(F.size("_hits") > 0, shares).alias("shares"))
    return rows.withColumn("licenses", licenses.cast(f"struct<{nothing.replace(' ', ':').replace(',:', ',')}>")).drop("_words", "_hits")


def license_report(docs: DataFrame) -> DataFrame:
    """Words, base places and labels of every document, with the labels and the score that notices add."""
    rows = scan_licenses(docs.select("doc_id", "text"))
    at = F.coalesce(F.flatten(F.map_values("licenses.phrases")), F.array().cast("array<int>"))
    base = F.coalesce(F.filter(F.map_keys("licenses.phrases"), lambda k: F.size(F.col("licenses.phrases")[k]) > 0), F.array().cast("array<string>"))
    shares = F.coalesce("licenses.shares", F.array().cast("array<struct<label:string,share:double>>"))
    more = F.transform(F.filter(shares, lambda s: s["share"] >= MATCH), lambda s: s["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", F.col("licenses.n_words").cast("long").alias("n_words"), F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.coalesce(F.array_max(F.transform(shares, lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def license_sql() -> str:
    """The same in DuckDB, over rows of words."""
    rows = [(i, label, text, key, phrase) for i, (label, text, key, phrase) in enumerate([(lb, p, p, True) for lb, p in PHRASES] + [(*n, False) for n in NOTICES])]
    values = ", ".join(f"({i}, '{label}', string_split('{text}', ' '), {Notice.of(label, text, key).key_at}, {len(key.split())}, {str(phrase).lower()})" for i, label, text, key, phrase in rows)
    return f"""
    with texts as (
      select row_number() over () as r, doc_id,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAKS}'), lambda w: w <> '') as words
      from documents),
    placed as (select r, unnest(words) as word, generate_subscripts(words, 1) - 1 as i from texts),
    notices(t, label, words, key_at, key_size, phrase) as (values {values}),
    parts as (select t, unnest(words) as word, generate_subscripts(words, 1) - 1 as p from notices),
    counts as (select word, count(distinct r) as df from placed where word in (select word from parts) group by word),
    weights as (
      select word, cast(round(1000 * ln(((select count(*) from texts) + 1) / (coalesce(df, 0) + 1))) as bigint) + 1 as weight
      from (select distinct word from parts) left join counts using (word)),
    rare as (
      select t, word, p, weight from (select t, word, min(p) as p from parts group by t, word) join weights using (word)
      qualify row_number() over (partition by t order by weight desc, word) <= {RARE}),
    starts as (
      select r, t, i - p as d from placed join parts using (word) join notices using (t)
      where p >= key_at and p < key_at + key_size group by r, t, i - p, key_size having count(*) = key_size),
    scored as (
      select starts.r, t, d, sum(case when placed.word is null then 0 else weight end) / sum(weight) as share
      from starts join rare using (t) left join placed on placed.r = starts.r and placed.i = d + p and placed.word = rare.word group by starts.r, t, d),
    based as (
      select r, count(*) as n_base, min(d) as first_word, max(d) as last_word, list(distinct label) as base
      from starts join notices using (t) where phrase group by r),
    more as (
      select r, max(share) as score, list(distinct label) filter (share >= {MATCH}) as added
      from scored join notices using (t) where not phrase group by r)
    select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
      coalesce(array_to_string(list_sort(base), ','), '') as base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(added, [])))), ','), '') as labels,
      coalesce(score, 0)::double as score
    from texts left join based using (r) left join more using (r)"""
