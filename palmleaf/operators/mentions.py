"""Mentions of names in texts: exact ones by an automaton, misspelt ones by an index of q-grams. Names are a table (name, canonical, and seq where given)."""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palmleaf.functions import text as T
from palmleaf.shared import materialize

#: Characters of names in one automaton: it takes about 50 bytes for each, and goes to every executor once.
CHARS_MOST = 1_000_000
#: Rows that a Python worker makes before it hands them on: a batch holds thousands of texts, each with as many mentions or tokens as words.
ROWS_MOST = 20_000
PLACE = [pa.field("canonical", pa.string()), pa.field("start", pa.int32())]
TOKEN = [pa.field("token", pa.string()), pa.field("start", pa.int32())]
HIT = [pa.field("size", pa.int32()), pa.field("seq", pa.int64()), pa.field("name", pa.string()), pa.field("start", pa.int32()), pa.field("canonical", pa.string())]
_LOADED: dict = {}


def _known(names: DataFrame) -> DataFrame:
    """``(name, canonical, seq)``, each name once as its smallest seq (else its least canonical) has it; written, so its size is known."""
    seq = F.col("seq").cast("long") if "seq" in names.columns else F.lit(0).cast("long")
    rows = names.where("name is not null and name != ''").select("name", "canonical", seq.alias("seq"))
    best = rows.groupBy("name").agg(F.min(F.struct("seq", "canonical")).alias("b"))
    return materialize(best.select("name", "b.canonical", "b.seq"), "names")


def _automaton(names: DataFrame) -> bytes | None:
    """An automaton of all ``names``, built and packed by one task; the caller has bounded their characters."""

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for b in it:
            for name, canonical, seq in zip(*(c.to_pylist() for c in b.columns)):
                found.add_word(name, (len(name), seq, name, canonical))
        if len(found):
            found.make_automaton()
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["packed"])

    row = names.select("name", "canonical", "seq").coalesce(1).mapInArrow(build, "packed binary").first()
    return bytes(row["packed"]) if row else None


def _unpacked(key: str, shared):
    """The automaton of a broadcast, unpacked once a Python worker."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = pickle.loads(shared.value)
    return _LOADED[key]


def in_pieces(batches: Iterator[pa.RecordBatch], made: Callable, fields: list[pa.Field], most: int = ROWS_MOST) -> Iterator[pa.RecordBatch]:
    """Rows (key, *row) of ``fields`` for each row that ``made`` gives of a batch's second column (not of nulls); keys are the first column.

    Values are taken from a batch one by one and rows go on ``most`` at a time, so a worker never holds what a whole batch gives.
    """
    columns: list[list] = [[] for _ in range(len(fields) + 1)]
    for b in batches:
        types = [b.schema.field(0).type, *(f.type for f in fields)]
        names = [b.schema.field(0).name, *(f.name for f in fields)]
        for key, value in zip(*b.columns):
            if not value.is_valid:
                continue
            known = key.as_py()
            for row in made(value.as_py()):
                for held, v in zip(columns, (known, *row)):
                    held.append(v)
                if len(columns[0]) >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
                    columns = [[] for _ in types]
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            columns = [[] for _ in types]


def _apart(hits: list[tuple]) -> list[tuple[str, int]]:
    """(canonical, start) of hits (length, seq, name, start, canonical) that do not overlap: longest first, then by seq, name and place."""
    starts, ends, out = [], [], []
    for size, _, _, at, canonical in sorted(hits, key=lambda h: (-h[0], h[1], h[2], h[3])):
        k = bisect_left(starts, at)
        if (k == 0 or ends[k - 1] <= at) and (k == len(starts) or at + size <= starts[k]):
            starts.insert(k, at)
            ends.insert(k, at + size)
            out.append((canonical, at))
    return out


def find_mentions(texts: DataFrame, names: DataFrame, script: str = "඀-෿", continuations: tuple[str, ...] = (), chars_most: int = CHARS_MOST) -> DataFrame:
    """``(text_id, canonical, start)``: all non-overlapping mentions of ``names`` in texts (text_id, text), places counted in the composed (NFC) text.

    Longest names first, then by seq; a mention begins outside a run of the script and ends outside one or before one of
    ``continuations``; a hit that fails this covers nothing. The names make automata of ``chars_most`` characters at most, each built
    by one task and broadcast, and each passes over the texts once. With one automaton mentions are set apart where the text
    is read; with more, hits of a text meet by the row's own number. Null texts, null and empty names give nothing.
    """
    spark, kind = texts.sparkSession, dict(texts.dtypes)["text_id"]
    known = _known(names)
    total = known.agg(F.sum(F.length("name"))).first()[0] or 0
    shards = max(1, math.ceil(total / chars_most))
    inside = re.compile(f"[{script}]")

    def clean(text: str, at: int, end: int) -> bool:
        begins = at == 0 or not inside.match(text[at - 1])
        return begins and (end == len(text) or not inside.match(text[end]) or text.startswith(continuations, end))

    def hits(found, text: str) -> list[tuple]:
        text = unicodedata.normalize("NFC", text)
        return [(size, seq, name, last + 1 - size, canonical) for last, (size, seq, name, canonical) in found.iter(text) if clean(text, last + 1 - size, last + 1)]

    if shards == 1:
        packed = _automaton(known)
        if packed is None:
            return spark.createDataFrame([], f"text_id {kind}, canonical string, start int")
        shared, key = spark.sparkContext.broadcast(packed), uuid.uuid4().hex

        def run(it):
            found = _unpacked(key, shared)
            return in_pieces(it, lambda t: _apart(hits(found, t)), PLACE)

        return texts.select("text_id", "text").mapInArrow(run, f"text_id {kind}, canonical string, start int")

    rows = materialize(texts.where("text is not null").select("text_id", "text", F.monotonically_increasing_id().alias("row")), "texts")
    hit = "row long, size int, seq long, name string, start int, canonical string"
    parts = None
    for shard in range(shards):
        packed = _automaton(known.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == shard))
        if packed is None:
            continue
        shared, key = spark.sparkContext.broadcast(packed), uuid.uuid4().hex

        def one(it, shared=shared, key=key):
            found = _unpacked(key, shared)
            return in_pieces(it, lambda t: hits(found, t), HIT)

        part = materialize(rows.select("row", "text").mapInArrow(one, hit), "hits")
        shared.unpersist()
        parts = part if parts is None else parts.unionByName(part)
    each = parts.groupBy("row").agg(F.collect_list(F.struct("size", "seq", "name", "start", "canonical")).alias("hits"))  # of one text

    def apart(it):
        return in_pieces(it, lambda hs: _apart([tuple(h[f.name] for f in HIT) for h in hs]), PLACE)

    found = each.mapInArrow(apart, "row long, canonical string, start int")
    return rows.select("row", "text_id").join(found.hint("merge"), "row").select("text_id", "canonical", "start")


def token_places(texts: DataFrame, script: str = T.SINHALA) -> DataFrame:
    """``(text_id, token, start)``: each run of the script in the composed texts and its place."""
    kind, token = dict(texts.dtypes)["text_id"], re.compile(script)

    def run(it):
        return in_pieces(it, lambda t: ((m[0], m.start()) for m in token.finditer(unicodedata.normalize("NFC", t))), TOKEN)

    return texts.select("text_id", "text").mapInArrow(run, f"text_id {kind}, token string, start int")


def shared_grams(total: Column | int, ratio: float, q: int):
    """Least number of q-grams that two strings of ``total`` characters together share if their matching-block ratio is ``ratio`` or more.

    The blocks hold M >= ratio * total / 2 characters of each, and between two blocks at least one character of one string
    matches nothing, so there are at most 1 + total - 2 M of them; a block of n characters has n - q + 1 grams.
    """
    if isinstance(total, int):
        return math.ceil(ratio * total / 2 - 1e-9) - (q - 1) * (1 + math.floor((1 - ratio) * total + 1e-9))
    return F.ceil(ratio * total / 2 - 1e-9) - (q - 1) * (1 + F.floor((1 - ratio) * total + 1e-9))


def gram_size(ratio: float, longest: int) -> int:
    """2 where different strings of this ratio must share pairs of characters, else 1."""
    shortest = math.ceil(2 / max(1 - ratio, 1e-9) - 1e-9)  # two different strings of fewer characters together cannot reach the ratio
    return 2 if all(shared_grams(t, ratio, 2) > 0 for t in range(max(shortest, 2), 2 * longest + 2)) else 1


def _grams(name: Column, q: int) -> Column:
    """Grams of a string, the n-th of equal ones with its n, so that sets of them are compared as bags."""
    bare = F.when(F.length(name) >= q, F.transform(F.sequence(F.lit(1), F.length(name) - q + 1), lambda i: F.substr(name, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    numbered = lambda held: F.transform(held, lambda g, i: F.concat(g, F.lit("\0"), F.size(F.filter(F.slice(held, F.lit(1), i), lambda h: h == g)).cast("string")))
    return F.transform(F.array(bare), numbered)[0]  # an array of one, so that the grams are cut once a string, not once for each of them


def alike(tokens: DataFrame, names: DataFrame, ratio: float) -> DataFrame:
    """``(token, name, canonical, seq, ratio)`` of all pairs of tokens and names (name, canonical, seq) whose matching-block ratio is ``ratio`` or more.

    Both sides' grams are ordered by how rare they are among names. Two strings that share c of n grams share one of the first
    n - c + 1 of each, so only those are joined; pairs whose lengths or whole gram bags cannot reach the ratio are dropped, and the
    rest are verified. No pair is lost for any ratio above 0.
    """
    longest = names.agg(F.max(F.length("name"))).first()[0] or 0
    if not longest or tokens.isEmpty():  # without tokens no index of the names is built
        return names.sparkSession.createDataFrame([], "token string, name string, canonical string, seq long, ratio double")
    q = gram_size(ratio, longest)
    low, high = lambda n: F.ceil(n * ratio / (2 - ratio) - 1e-9), lambda n: F.floor(n * (2 - ratio) / ratio + 1e-9)
    tokens = tokens.where((F.length("token") > 0) & (low(F.length("token")) <= longest)).select("token").distinct()
    counts = names.select(F.explode(_grams(F.col("name"), q)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    counts = materialize(counts, "gram-counts")

    def first_grams(rows: DataFrame, column: str) -> DataFrame:
        size = F.length(column)
        grams = _grams(F.col(column), q)
        least = F.array_min(F.transform(F.sequence(F.greatest(low(size), F.lit(1)), F.greatest(high(size), F.lit(1))), lambda m: shared_grams(size + m, ratio, q)))
        each = rows.select(column, F.greatest(least, F.lit(1)).alias("least"), F.size(grams).alias("all"), F.explode(grams).alias("g"))
        each = each.join(counts.hint("merge"), "g", "left")
        rank = F.row_number().over(Window.partitionBy(column).orderBy(F.coalesce("n", F.lit(0)), "g"))  # of one string
        return each.withColumn("rank", rank).where(F.col("rank") <= F.col("all") - F.col("least") + 1).select(column, "g")

    a = materialize(first_grams(tokens, "token").where(F.col("g").isNotNull()), "token-grams")
    b = materialize(first_grams(names.select("name"), "name"), "name-grams")
    shorter, total = F.least(F.length("token"), F.length("name")), F.length("token") + F.length("name")
    pairs = a.join(b.hint("merge"), "g").where(2 * shorter >= ratio * total - 1e-9).select("token", "name")
    pairs = pairs.distinct().where(F.size(F.array_intersect(_grams(F.col("token"), q), _grams(F.col("name"), q))) >= shared_grams(total, ratio, q))
    same = tokens.join(names.select("name").hint("merge"), F.col("token") == F.col("name")).select("token", "name")  # also those too short for grams
    pairs = materialize(pairs.unionByName(same).distinct(), "alike")

    def run(it):
        for pdf in it:
            got = [SequenceMatcher(None, t, n).ratio() for t, n in zip(pdf["token"], pdf["name"])]
            out = pd.DataFrame({"token": pdf["token"], "name": pdf["name"], "ratio": got})
            yield out[out["ratio"] >= ratio]

    verified = materialize(pairs.mapInPandas(run, "token string, name string, ratio double"), "verified")
    return verified.join(names.hint("merge"), "name").select("token", "name", "canonical", "seq", "ratio")


def find_mentions_fuzzy(texts: DataFrame, names: DataFrame, exact: DataFrame, ratio: float = 0.85, script: str = T.SINHALA) -> DataFrame:
    """``(text_id, token, start, canonical, ratio)`` for texts without exact mentions: each token's best name by matching-block ratio, of equal ones
    the first by seq, then by name; one row for each place of the token."""
    known = _known(names)
    rest = texts.join(exact.select("text_id").distinct().hint("merge"), "text_id", "left_anti")
    each = materialize(token_places(rest, script), "tokens")
    found = alike(each.select("token"), known, ratio)
    best = found.groupBy("token").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "seq", "name", "canonical")).alias("b"))
    best = best.select(F.col("token").alias("t"), "b.canonical", (-F.col("b.r")).alias("ratio"))
    return each.join(best.hint("merge"), F.col("token") == F.col("t")).drop("t")
