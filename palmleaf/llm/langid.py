"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent character n-grams of words, most frequent first. A document goes to the
language whose profile is nearest by out-of-place distance: the sum, over the document's n-grams, of how far each stands
from its place in the language's list, or the length of that list if it is not there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.workers import give_back, lean

#: Longest n-gram, length of a profile, and labelled documents a language's profile is fitted on, in expectation.
LONGEST, PROFILE, FIT_DOCS = 3, 400, 1500
#: Characters counted at a time.
SLICE = 1 << 20
NONE = "und"
#: Stands for a word border; codes of grams of different lengths never meet, for no code point in them is 0.
BORDER = 1

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once a process."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a whole text, lower-cased; anything but letters is a word border.

    A code holds up to three code points of 21 bits; a gram may begin or end with a border, but is never one alone and
    never has one inside.
    """
    found, counts = [], []
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    tail = np.array([BORDER])  # the last two places before a slice, so that each gram counts once, where it ends
    for at in range(0, len(points), SLICE):
        new = points[at : at + SLICE].astype(np.int64)
        new[~_letters()[new]] = BORDER
        p = np.concatenate([tail, new, [BORDER]] if at + SLICE >= len(points) else [tail, new])
        p = p[np.r_[True, (p[1:] != BORDER) | (p[:-1] != BORDER)]]  # runs of borders are one
        two = (p[:-1] << 21) | p[1:]
        ends = np.arange(len(tail), len(p))
        triples = ends[ends >= 2]
        triples = triples[p[triples - 1] != BORDER]
        codes = [p[ends][p[ends] != BORDER], two[ends - 1], (two[triples - 2] << 21) | p[triples]]
        c, n = np.unique(np.concatenate(codes), return_counts=True)
        found.append(c)
        counts.append(n)
        tail = p[-2:]
    if not found:
        return np.array([], np.int64), np.array([], np.int64)
    if len(found) == 1:
        return found[0], counts[0]
    c, place = np.unique(np.concatenate(found), return_inverse=True)
    return c, np.bincount(place, np.concatenate(counts)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """Codes of the ``most`` most frequent n-grams, most frequent first, ties by code."""
    if len(codes) > most:
        floor = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= floor
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:most]


def out_of_place(document: np.ndarray, profile: np.ndarray, order: np.ndarray) -> int:
    """Distance of a ranked document from a profile; ``order`` sorts the profile's codes."""
    if not len(profile):
        return PROFILE * len(document)
    at = np.searchsorted(profile, document, sorter=order).clip(max=len(profile) - 1)
    rank = order[at]
    same = profile[rank] == document
    return int(np.where(same, np.abs(rank - np.arange(len(document))), PROFILE).sum())


def fit_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Profile of each language from rows with a text and a label.

    Fitted on a sample of FIT_DOCS rows a language in expectation, by hash of the text (all rows where there are fewer);
    its n-grams are counted on the executors and only PROFILE codes a language come to the driver. Nulls are left out.
    """
    labelled = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, FIT_DOCS / n) * (1 << 30)))))
    sample = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("lang")])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lang in b.column("lang").unique():
                rows = b.filter(pc.equal(b.column("lang"), lang))
                codes, counts = zip(*(gram_counts(t.as_py()) for t in rows.column("text")))
                c, place = np.unique(np.concatenate(codes), return_inverse=True)
                n = np.bincount(place, np.concatenate(counts), len(c)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(c)), pa.array(c), pa.array(n)], ["lang", "code", "n"])

    grams = sample.mapInArrow(lean(count), "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = grams.selectExpr("lang", "code", "row_number() over (partition by lang order by n desc, code) as rank").where(F.col("rank") <= PROFILE)
    profiles: dict[str, list] = {k: [] for k in sizes}
    for r in top.orderBy("lang", "rank").collect():
        profiles[r["lang"]].append(r["code"])
    return profiles


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of any columns of those names.

    score is 1 at distance 0 and 0 at the largest distance. Texts that are null or have no letter, and all texts when
    there is no profile, get ``und`` and score 0. Ties go to the first language by name. An empty table gives no rows.
    """
    names = sorted(profiles)
    lists = [np.array(profiles[k], np.int64) for k in names]
    orders = [np.argsort(x, kind="stable") for x in lists]
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def predict(text: str | None) -> tuple[str, float]:
        own = ranked(*gram_counts(text)) if text and names else ()
        if not len(own):
            return NONE, 0.0
        far = [out_of_place(own, x, o) for x, o in zip(lists, orders)]
        best = int(np.argmin(far))
        return names[best], 1.0 - far[best] / (PROFILE * len(own))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def found(texts: pa.Array) -> pa.Array:
        got = [predict(t.as_py()) for t in texts]
        give_back()
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang_pred", "score"])

    # only the text goes to Python; the other columns stay where they are
    out = docs.select(*kept, found(F.col(text_col)).alias("_found"))
    return out.select(*kept, F.col("_found.lang_pred").alias("lang_pred"), F.col("_found.score").alias("score"))


def held_out(id_column: str = "doc_id") -> Column:
    """Documents never learned from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document, profiles learned from those not held out."""
    profiles = fit_profiles(docs.where(~held_out()))
    slim = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(slim, profiles).select("doc_id", "held_out", "lang_pred", "score")
