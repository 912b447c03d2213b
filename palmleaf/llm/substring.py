"""Substring deduplication by FM-indexes over shards of what may repeat.

Every window of words has an anchor: the gram of least hash in it (the last of equal ones). Windows that follow each other
and share their anchor's place make a segment, so each window of a document lies in exactly one segment, and equal windows
have equal anchors. Segments whose anchor stands at one place only cannot repeat; the others are counted where they are
equal, and each different one moves once, with its weight, to the shard of its anchor. A shard builds an FM-index of its
segments, streams them through it, and reports the windows that weigh two or more.

An anchor with very many different segments (the edge of a passage that many documents quote) is taken apart: the windows of
its different segments are halved by their place around it, each half is keyed by all the words that its windows share, and
halves whose key still has very many different ones are halved again. A single window is its own key, so this ends after
five rounds; no shard gathers such an anchor, and each round makes two rows a segment at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from palmleaf.llm.fmindex import FMIndex
from palmleaf.llm.workers import lean, slices
from palmleaf.shared import materialize

WINDOW, GRAM = 35, 10
REACH = WINDOW - GRAM
#: Different segments of one anchor that a shard takes whole, and words of the shards a task indexes at a time.
ANCHOR_MOST, SHARD_WORDS = 1000, 100_000
#: Words of a run of segments that moves as one piece.
RUN_WORDS = 256
_MEMBERS = pa.list_(pa.struct([("anchor", pa.int64()), ("segment", pa.int64()), ("first", pa.int32()), ("size", pa.int32()), ("shift", pa.int32())]))
#: Words hashed at a time.
SLICE = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOW = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Hashes of any run of words in a list, from sums of word hashes times powers of an odd base."""

    def __init__(self, words: list[bytes]):
        own = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
        n = len(own)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE, np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(own * power[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values from a position on."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def segments(lengths: np.ndarray, hashes: WordHashes) -> tuple[np.ndarray, ...]:
    """Segments of documents of ``lengths`` words that follow each other in a list: first word, end, place and hash of the anchor."""
    n = int(lengths.sum())
    if n < WINDOW:
        return *(np.array([], np.int64) for _ in range(3)), np.array([], np.uint64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(n - GRAM + 1)
    gram = hashes.of(at, at + GRAM)
    # half of each hash, and after it the place, so that the last of equal ones is least: this depends on the words of a window alone
    least = _slide((gram & ~_LOW) | (_LOW - at.astype(np.uint64)), REACH + 1)
    window = np.flatnonzero(doc[: len(least)] == doc[WINDOW - 1 :])  # not across documents
    owner = (_LOW - (least[window] & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.array([], np.int64)
    last = np.append(first[1:], len(owner)) - 1
    return window[first], window[last] + WINDOW, owner[first], gram[owner[first]]


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Runs of documents, as words, of about SLICE words."""
    first, docs, size = 0, [], 0
    for i, t in enumerate(texts):
        words = (t.as_py() or b"").split()
        docs.append(words)
        size += len(words)
        if size >= SLICE:
            yield first, docs
            first, docs, size = i + 1, [], 0
    if docs:
        yield first, docs


def _find_segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(it, 2000):
        for first, docs in _parts(b.column("text").cast(pa.large_binary())):
            lengths = np.fromiter(map(len, docs), np.int64, len(docs))
            hashes = WordHashes([w for d in docs for w in d])
            lo, hi, at, gram = segments(lengths, hashes)
            ends = np.cumsum(lengths)
            doc = np.searchsorted(ends, lo, side="right")
            segment = hashes.of(lo, hi) + _mix((at - lo).astype(np.uint64))
            rows, start = pa.array(first + doc), lo - (ends - lengths)[doc]
            ints = (pa.array(x.astype(np.int32)) for x in (start, hi - lo, at - lo))
            yield pa.RecordBatch.from_arrays([b.column("k1").take(rows), b.column("k2").take(rows), pa.array(gram.view(np.int64)), pa.array(segment.view(np.int64)), *ints], ["k1", "k2", "anchor", "segment", "start", "size", "tag"])


def _cut_segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the segments asked for of a document.

    Segments that follow each other and whose anchors each have one kind of segment, as in a copied text, go as one piece.
    ``members`` are the segments in a piece: anchor, segment, first word in the piece, words, first word in the segment.
    """
    for b in slices(it, 2000):
        out: list[tuple] = []
        for text, asked in zip(b.column("text").cast(pa.large_binary()), b.column("asked")):
            words = (text.as_py() or b"").split()
            runs: list[list[dict]] = []
            for a in sorted(asked.as_py(), key=lambda a: a["start"]):
                r = runs[-1] if runs else None
                follows = r and a["alone"] and r[-1]["alone"] and a["n"] == r[-1]["n"] and a["start"] == r[-1]["start"] + r[-1]["size"] - WINDOW + 1 and a["start"] - r[0]["start"] < RUN_WORDS
                if follows:
                    r.append(a)
                else:
                    runs.append([a])
            for r in runs:
                first, end = r[0]["start"], r[-1]["start"] + r[-1]["size"]
                members = [{"anchor": a["anchor"], "segment": a["segment"], "first": a["start"] - first, "size": a["size"], "shift": 0} for a in r]
                out.append((r[0]["anchor"], r[0]["segment"], r[0]["n"], r[0]["kinds"], r[0]["tag"], b" ".join(words[first:end]), members))
        for k in range(0, len(out), 5000):
            cols = list(zip(*out[k : k + 5000]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), _MEMBERS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["anchor", "segment", "n", "kinds", "tag", "words", "members"])


def _halve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both halves of the windows of a segment that start ``near`` to ``far`` words before its anchor, each with the words it holds.

    The key of a half is the hash of the words that all windows at such places share. ``shift`` is where the words begin
    in the segment, ``tag`` the place of the anchor in them.
    """
    names = ["anchor", "segment", "n", "shift", "tag", "near", "far", "words", "key", "part"]
    for b in slices(it, 2000):
        out: list[tuple] = []
        for r in b.select(names[:8]).to_pylist():
            words, middle = r["words"].split(), (r["near"] + r["far"]) // 2
            hashes = WordHashes(words)
            for p, q in ((r["near"], middle), (middle + 1, r["far"])):
                lo, hi = max(0, r["tag"] - q), min(len(words), r["tag"] - p + WINDOW)
                if p <= q and hi - lo >= WINDOW:
                    core, part = hashes.of(np.array([r["tag"] - p, lo]), np.array([r["tag"] - q + WINDOW, hi])) + _mix(np.array([p * WINDOW + q + 1, r["tag"] - lo]).astype(np.uint64))
                    out.append((r["anchor"], r["segment"], r["n"], r["shift"] + lo, r["tag"] - lo, p, q, b" ".join(words[lo:hi]), int(core.view(np.int64)), int(part.view(np.int64))))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), *(pa.int32(),) * 4, pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def shard_report(n: np.ndarray, pieces: list[list[bytes]]) -> np.ndarray:
    """(pieces, words) flags of the words of each piece that repeated windows cover; ``n``: how often a piece occurs."""
    symbol = pd.factorize(np.array([w for s in pieces for w in s], object))[0].astype(np.int64) + 1
    sequences = np.split(symbol, np.cumsum(list(map(len, pieces)))[:-1])
    windows = FMIndex(sequences, n, WINDOW).repeated_windows(sequences, WINDOW)
    upto = np.cumsum(np.pad(windows, ((0, 0), (WINDOW, 64))), axis=1, dtype=np.int32)
    return upto[:, WINDOW:] > upto[:, :-WINDOW]


def _report(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by anchor; whole anchors make a shard."""
    held: list[pd.DataFrame] = []

    def done() -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        covered = shard_report(rows["n"].to_numpy(), [w.split() for w in rows["words"]])
        members = [(k, *(m[c] for c in ("anchor", "segment", "first", "size", "shift"))) for k, ms in enumerate(rows["members"]) for m in ms]
        row, anchor, segment, first, size, shift = (np.array(x, np.int64) for x in zip(*members))
        place = np.arange(64) - shift[:, None]
        bits = covered[row[:, None], np.clip(first[:, None] + place, 0, covered.shape[1] - 1)] & (place >= 0) & (place < size[:, None])
        cover = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
        return pd.DataFrame({"anchor": anchor, "segment": segment, "cover": cover})[cover != 0]

    tail = None
    for pdf in it:
        pdf = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
        if not len(pdf):
            continue
        key, words = pdf["shard"].to_numpy(), np.cumsum(np.fromiter(map(len, pdf["words"]), np.int64, len(pdf)) // 6)
        last = 0
        for c in (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist():
            grown = int(words[c - 1] - (words[last - 1] if last else 0))
            if grown >= SHARD_WORDS:
                held.append(pdf.iloc[last:c])
                yield done()
                held, last = [], c
        tail = pdf.iloc[last:]
    if tail is not None:
        held.append(tail)
        yield done()


def _wide_parts(pieces: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Of the segments of anchors with over ANCHOR_MOST kinds: pieces (shard, n, words, members) of halves that a shard can
    take whole, and ``(shard, part, anchor, segment, shift)``, which segments a part stands for; None, None without such anchors."""
    wide = materialize(pieces.where(F.col("kinds") > ANCHOR_MOST).select("anchor", "segment", "n", F.lit(0).alias("shift"), "tag", F.lit(0).alias("near"), F.lit(REACH).alias("far"), "words"), "wide")
    if wide.isEmpty():
        return None, None
    own, names = "anchor bigint, segment bigint, n bigint, shift int, tag int, near int, far int, words binary", ["anchor", "segment", "n", "shift", "tag", "near", "far", "words"]
    ready, stands = None, None
    while wide is not None:
        halves = materialize(wide.mapInArrow(lean(_halve), f"{own}, key bigint, part bigint"), "halves")
        parts = materialize(halves.groupBy("key", "part").agg(F.sum("n").alias("n"), F.min("words").alias("words")), "parts")
        kinds = materialize(parts.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1").withColumnRenamed("key", "k"), "part-kinds")
        taken = parts.join(kinds.where(F.col("kinds") <= ANCHOR_MOST).hint("merge"), F.col("key") == F.col("k"))
        member = F.struct(F.col("key").alias("anchor"), F.col("part").alias("segment"), F.lit(0).alias("first"), F.regexp_count(F.col("words").cast("string"), F.lit("[^ ]+")).alias("size"), F.lit(0).alias("shift"))
        taken = taken.select(F.col("key").alias("shard"), "n", "words", F.array(member).alias("members"))
        which = halves.select("key", "part", "anchor", "segment", "shift")
        ready = taken if ready is None else ready.unionByName(taken)
        stands = which if stands is None else stands.unionByName(which)
        left = kinds.where(F.col("kinds") > ANCHOR_MOST).select("k")
        wide = None if left.isEmpty() else halves.join(left.hint("merge"), F.col("key") == F.col("k")).select(*names)
    return ready, stands


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(k1, k2, cover)`` of documents with repeated windows: cover lists (start, mask) pairs, bit i of a mask standing for
    word start + i. k1 and k2 are xxhash64 of id and text; rows of equal id and text are told apart only in counting."""
    texts = docs.select(F.xxhash64(id_col).alias("k1"), F.xxhash64(text_col).alias("k2"), F.col(text_col).alias("text")).where("text is not null")
    found = materialize(texts.mapInArrow(lean(_find_segments), "k1 bigint, k2 bigint, anchor bigint, segment bigint, start int, size int, tag int"), "segments")
    # written out, so that a join on an anchor that very many documents hold can be split where it is skewed
    twice = materialize(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor").alias("a")), "repeated-anchors")
    found = materialize(found.join(twice.hint("merge"), F.col("anchor") == F.col("a")).drop("a"), "repeated-segments")
    different = materialize(found.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "start", "size", "tag")).alias("one")), "different-segments")
    kinds = materialize(different.groupBy("anchor").agg(F.count("*").alias("kinds")).withColumnRenamed("anchor", "a"), "kinds")
    asked = different.join(kinds.hint("merge"), F.col("anchor") == F.col("a"))
    ask = F.struct("anchor", "segment", "n", "kinds", "one.start", "one.size", "one.tag", (F.col("kinds") == 1).alias("alone"))
    asked = asked.groupBy(F.col("one.k1").alias("q1"), F.col("one.k2").alias("q2")).agg(F.collect_list(ask).alias("asked"))
    cut = texts.join(asked.hint("merge"), (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2")))
    cut = cut.withColumn("again", F.expr("row_number() over (partition by k1, k2 order by k1)")).where("again = 1")  # a repeated row
    pieces = cut.select("text", "asked").mapInArrow(lean(_cut_segments), "anchor bigint, segment bigint, n bigint, kinds bigint, tag int, words binary, members array<struct<anchor: bigint, segment: bigint, first: int, size: int, shift: int>>")
    pieces = materialize(pieces, "pieces")
    ready = pieces.where(F.col("kinds") <= ANCHOR_MOST).select(F.col("anchor").alias("shard"), "n", "words", "members")
    more, stands = _wide_parts(pieces)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def covers_of(rows: DataFrame) -> DataFrame:
        rows = rows.repartition(parts, "shard").sortWithinPartitions("shard")
        return materialize(rows.mapInPandas(lean(_report), "anchor bigint, segment bigint, cover bigint"), "covers")

    covers = covers_of(ready).select(F.col("anchor").alias("c_anchor"), F.col("segment").alias("c_segment"), F.lit(0).alias("shift"), "cover")
    if more is not None:
        part = covers_of(more).withColumnsRenamed({"anchor": "p_key", "segment": "p_part"})
        part = stands.join(part.hint("merge"), (F.col("key") == F.col("p_key")) & (F.col("part") == F.col("p_part")))
        covers = covers.unionByName(part.select(F.col("anchor").alias("c_anchor"), F.col("segment").alias("c_segment"), "shift", "cover"))
        covers = materialize(covers, "all-covers")
    around = found.select("k1", "k2", "anchor", "segment", "start").join(covers.hint("merge"), (F.col("anchor") == F.col("c_anchor")) & (F.col("segment") == F.col("c_segment")))
    return around.groupBy("k1", "k2").agg(F.collect_set(F.struct((F.col("start") + F.col("shift")).alias("start"), "cover")).alias("cover"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept`` (the words that stay, joined by one space), ``n_words`` and ``n_removed`` in place of any such columns.

    A word goes if a window of WINDOW words covers it whose sequence also starts elsewhere in ``docs``, in the same document
    or a copy of it included. Null texts have no words; repeated rows are documents of their own; other columns are carried
    along. An empty table gives no rows.
    """
    added = ("kept", "n_words", "n_removed")
    names = [c for c in docs.columns if c not in added]
    cover = repeated_words(docs, id_col, text_col).withColumnsRenamed({"k1": "_c1", "k2": "_c2", "cover": "_cover"})
    keyed = docs.select(*names).join(cover.hint("merge"), (F.xxhash64(id_col) == F.col("_c1")) & (F.xxhash64(text_col) == F.col("_c2")), "left")

    @F.arrow_udf("struct<kept: string, n_words: bigint, n_removed: bigint>")
    def without(texts: pa.Array, covers: pa.Array) -> pa.Array:
        out: list[tuple] = []
        for text, marks in zip(texts.cast(pa.large_binary()), covers):
            words = (text.as_py() or b"").split()
            gone = np.zeros(len(words) + 64, bool)
            if marks.is_valid:
                start, mask = (np.asarray(marks.values.field(k)) for k in (0, 1))
                row, bit = np.nonzero(np.unpackbits(mask.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                gone[start[row] + bit] = True
                out.append((b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode(), len(words), int(gone.sum())))
            else:
                out.append((b" ".join(words).decode(), len(words), 0))
        kept, n, removed = zip(*out) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], list(added))

    out = keyed.select(*names, without(F.col(text_col), F.col("_cover")).alias("_out"))
    return out.select(*names, *(F.col(f"_out.{c}").alias(c) for c in added))


def substring_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every document."""
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
