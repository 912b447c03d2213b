"""Column builders for text: splitting, cleaning, labels. Nulls in give nulls out unless said otherwise."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LETTERS, SINHALA = r"[\p{L}]+", r"[඀-෿]+"

# Grammatical case endings and honorifics of names, in the order in which they are tried.
CASE_SUFFIXES = ("ෙකු", "ෙන්", "ෙහි", "ේදී", "හිදී", "ගේ", "ේ", "ට", "හු")
TITLES = ("හාමුදුරුවන්", "හාමුදුරුවෝ", "කුමාරයා", "හිමිණිය", "මහරජු", "මහරජ", "කුමරු", "දේවිය", "රැජින", "රාජා", "රාජ", "රජු", "රජ", "හිමි")
ENTITY_LABELS = ("PERSON_KING", "PERSON_MONK", "PERSON_OTHER", "LOCATION", "MONUMENT", "DYNASTY", "BATTLE_EVENT", "DATE_ERA", "CHRONICLE", "RELIC")
SCORE_BANDS = ((90, 5), (75, 4), (60, 3), (40, 2))


def strip_ws(c: Column) -> Column:
    """Without leading and trailing white space of any kind (trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(text: Column, script: str = LETTERS) -> Column:
    """Lower-cased maximal runs of a script class."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({script})"), F.lit(1))


def _pieces(text: Column, pattern: str, longer_than: int) -> Column:
    # most parts begin and end without white space, for which a pattern would read them whole
    bare = lambda p: F.when(F.concat(F.left(p, F.lit(1)), F.right(p, F.lit(1))).rlike(r"(?U)\s"), strip_ws(p)).otherwise(p)
    return F.filter(F.transform(F.split(text, pattern), bare), lambda p: F.length(p) > longer_than)


def sentences(text: Column, longer_than: int = 10) -> Column:
    """Parts between . ! ? danda or newline, trimmed, longer than ``longer_than`` characters."""
    return _pieces(text, r"[.!?।\n]", longer_than)


def paragraphs(text: Column, separator: str = r"\n\s*\n", longer_than: int = 20) -> Column:
    """Parts between blank lines (or another separator), trimmed, longer than ``longer_than`` characters."""
    return _pieces(text, separator, longer_than)


def claim_sentences(text: Column) -> Column:
    """Split after . or danda or ideographic stop, swallowing white space behind; blank parts go, no length filter."""
    return F.filter(F.transform(F.split(text, r"(?<=[.।。])\s*"), strip_ws), lambda p: F.length(p) > 0)


def batch_sentences(essays: DataFrame, text_col: str = "text", id_col: str = "essay_id", n: int = 6) -> DataFrame:
    """One row per batch of up to ``n`` consecutive claim sentences: essay_id, batch_no from 1, sentences, n_batches."""
    parts = claim_sentences(F.col(text_col))
    rows = essays.select(F.col(id_col).alias("essay_id"), parts.alias("parts"))  # split once a text, before rows are made of it
    rows = rows.select("essay_id", "parts", F.ceil(F.size("parts") / F.lit(n)).cast("int").alias("n_batches"))
    numbers = F.when(F.col("n_batches") > 0, F.sequence(F.lit(1), "n_batches")).otherwise(F.array().cast("array<int>"))
    rows = rows.select("essay_id", "parts", "n_batches", F.explode(numbers).alias("batch_no"))
    return rows.select("essay_id", "batch_no", F.slice("parts", (F.col("batch_no") - 1) * n + 1, F.lit(n)).alias("sentences"), "n_batches")


def word_count(text: Column) -> Column:
    """White-space separated words; 0 for blank texts."""
    bare = strip_ws(text)
    return F.when(F.length(bare) == 0, F.lit(0)).otherwise(F.size(F.split(bare, r"\s+")))


@F.pandas_udf(StringType())
def nfc(names: pd.Series) -> pd.Series:
    """Canonical composition, trimmed; used once, where names come in."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFC", s).strip())


def strip_suffix(name: Column, suffixes: tuple[str, ...] = CASE_SUFFIXES, stem: int = 2) -> Column:
    """Without the first of ``suffixes`` that leaves ``stem`` characters or more."""
    out = name
    for s in reversed(suffixes):
        fits = name.endswith(s) & (F.length(name) - F.lit(len(s)) >= stem)
        out = F.when(fits, name.substr(F.lit(1), F.length(name) - F.lit(len(s)))).otherwise(out)
    return out


def strip_title(name: Column, titles: tuple[str, ...] = TITLES) -> Column:
    """Without its longest title, once, trimmed; a stem of two characters or more stays."""
    return strip_ws(strip_suffix(name, tuple(sorted(titles, key=len, reverse=True))))


def search_key(name: Column) -> Column:
    """Lower-cased, without zero-width joiners."""
    return F.lower(F.translate(name, "‌‍", ""))


def contains_any(text: Column, phrases: list[str]) -> Column:
    """True if any phrase is a substring; false without phrases."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases), F.lit(False))


def date_mentions(text: Column, pattern: str = r"(ක්‍රි\.(?:පූ|ව)\.\s*\d+)") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def sanitize_relation(relation: Column) -> Column:
    """UPPER_SNAKE of A-Z, 0-9 and _; null if nothing is left."""
    joined = F.regexp_replace(F.upper(strip_ws(relation)), r"[ \-]", "_")
    return F.nullif(F.regexp_replace(joined, "[^A-Z0-9_]", ""), F.lit(""))


@F.pandas_udf(StringType())
def nfkd(names: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return names.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def slug(name: Column, default: str = "essay") -> Column:
    """Up to 24 characters of A-Z a-z 0-9 _ - after nfkd, others as -; the default if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(nfkd(F.coalesce(name, F.lit(""))), "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.when(bare == "", F.lit(default)).otherwise(F.left(bare, F.lit(24)))


def preview(text: Column, n: int = 70) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def place_spans(text: Column, entities: Column) -> Column:
    """Spans (start, end, label) of ``entities`` (entity, label, start, end): by their places where those hold the entity, else where it
    first occurs; one that does not occur is left out."""

    def place(e: Column) -> Column:
        given = text.substr(e["start"] + 1, e["end"] - e["start"]) == e["entity"]
        first = F.instr(text, e["entity"]) - 1
        return F.when(F.coalesce(given, F.lit(False)), F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"))).when(
            (first >= 0) & (F.length(e["entity"]) > 0), F.struct(first.alias("start"), (first + F.length(e["entity"])).alias("end"), e["label"].alias("label"))
        )

    return F.array_compact(F.transform(entities, place))


def annotate_spans(text: Column, spans: Column) -> Column:
    """Text with [span](label) for each span (start, end, label; 0-based), by start; a span that begins inside an earlier one is skipped."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        plain = text.substr(acc["at"] + 1, s["start"] - acc["at"])
        marked = F.concat(acc["out"], plain, F.lit("["), text.substr(s["start"] + 1, s["end"] - s["start"]), F.lit("]("), s["label"], F.lit(")"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), marked.alias("out"))).otherwise(acc)

    return F.aggregate(F.array_sort(spans), start, add, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))))


def clean_label(label: Column) -> Column:
    """Entity class of a BIO tag; null if it is none of the known ones."""
    bare = F.upper(F.regexp_replace(strip_ws(label), "^[BIbi]-", ""))
    return F.when(bare.isin(*ENTITY_LABELS), bare)


def clean_piece(piece: Column) -> Column:
    """A tagged piece of a word without the mark of its tokenizer."""
    return strip_ws(F.regexp_replace(piece, "^(##|\u2581)", ""))


def map_rename(m: Column, names: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.transform_keys(m, lambda k, v: F.coalesce(F.try_element_at(known, k), k))


def clamp_d1(value: Column) -> Column:
    """Whole score 1 to 5, else null."""
    n = value.try_cast("int")
    return F.when(n.between(1, 5), n)


def display_category(claim_type: Column, verdict: Column, reason: Column) -> Column:
    """What a claim is shown as."""
    return F.when(claim_type == "EDITORIAL", "EDITORIAL").when(verdict.isin("CORRECT", "INCORRECT"), verdict).when(reason == "NOT_IN_KG", "NOT_IN_KG").otherwise("ERROR")


def accuracy_band(accuracy: Column) -> Column:
    """Score 1 to 5 of a percentage; null for null."""
    out = F.when(accuracy.isNull(), None)
    for least, band in SCORE_BANDS:
        out = out.when(accuracy >= least, band)
    return out.otherwise(1)
