"""Packing token sequences by best-fit decreasing.

Documents are tokenized once, in Arrow batches, and cut into full windows and one remainder. How remainders share
windows depends only on how many there are of each length, so best-fit decreasing is planned on that histogram (one
count per length, never more than the window), with a segment tree over remaining capacities that finds the tightest
open window; equal windows are handled together. Each remainder finds its place by its rank among those of its length.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.workers import lean
from palmleaf.shared import materialize

WINDOW = 1024
END_ID = 0
#: Characters of a long text that are encoded at a time, so that lists of ids stay short.
BLOCK = 1 << 16
#: Least number of cells by which equal pieces are ranked, and pieces that a cell should hold at most.
RANK_CELLS, CELL_ROWS = 64, 100_000
#: A space between two non-spaces always starts a new pre-token, so ids of such parts simply follow each other.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """``text`` in blocks of ``size`` characters and as many more as it takes to the next place where it may be cut."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encoder(ranks_path: str, pattern: str, added: dict[str, int]):
    """Text to ids as little-endian unsigned 32-bit bytes; the ids that the JSON vocabulary gives.

    added: its added tokens, which are cut out of a text first, wherever they stand, the longest of those that begin at one
    place; what lies between them is encoded by itself.
    """
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("palmleaf", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def raw(text: str) -> bytes:
        return np.array(encode(text), "<u4").tobytes()

    def plain(text: str) -> bytes:
        return b"".join(map(raw, blocks(text)))

    if not added:
        return plain
    apart = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")
    whole = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}

    def ids(text: str) -> bytes:
        return b"".join(whole[x] if k % 2 else plain(x) for k, x in enumerate(apart.split(text)))

    return ids


def added_tokens(json_path: str) -> dict[str, int]:
    """Added tokens of a JSON vocabulary and their ids; those that are more than a string to be found are refused."""
    with open(json_path, encoding="utf-8") as f:
        listed = json.load(f)["added_tokens"]
    odd = [t["content"] for t in listed if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if odd:
        raise ValueError(f"added tokens with rules of their own: {odd}")
    return {t["content"]: t["id"] for t in listed}


def token_pieces(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, end_id: int = END_ID, added: dict[str, int] | None = None) -> DataFrame:
    """``(doc_id, start, length, doc_tokens, ids)``: each document's ids and an end id, cut into full windows and a rest.

    ids is binary, little-endian unsigned 32 bits. A null text is empty: its only piece is the end id; null and repeated
    ids are documents of their own. ranks_path, pattern and added (added tokens) name the vocabulary; by default the public
    byte-level one, looked up on the executor.
    """
    end = np.array([end_id], "<u4").tobytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers as public

        own = added if added is not None else {} if ranks_path else added_tokens(public.path("byte_bpe_50k.json"))
        encode = encoder(ranks_path or public.path("byte_bpe_50k.tiktoken"), pattern or public.PATTERN, own)
        for b in it:
            for at in range(0, b.num_rows, 500):
                keys, out = b.column(0).slice(at, 500), []
                for i, text in enumerate(b.column(1).slice(at, 500)):
                    ids = encode(text.as_py() or "") + end
                    n = len(ids) // 4
                    out += [(i, s, min(window, n - s), n, ids[4 * s : 4 * (s + window)]) for s in range(0, n, window)]
                rows, start, length, total, ids = zip(*out)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(batches), f"doc_id {key}, start bigint, length bigint, doc_tokens bigint, ids binary")


class Capacities:
    """Segment tree over remaining capacities 0 to ``top``: which have open windows, and the tightest that is enough."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.some = [False] * (2 * self.leaves)

    def set(self, capacity: int, some: bool) -> None:
        at = capacity + self.leaves
        self.some[at] = some
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """Smallest capacity of ``need`` or more that has an open window."""
        at = need + self.leaves
        if self.some[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


@dataclass(frozen=True)
class Placement:
    """Remainders of ``length`` with ranks from ``rank`` on: ``each`` to a window, in ``windows`` windows from ``first`` on, at ``offset``."""

    length: int
    rank: int
    count: int
    first: int
    offset: int
    each: int


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> tuple[list[Placement], int]:
    """Placements of ``counts[length]`` remainders, longest first, each in the tightest window that holds it, and the number of windows.

    Open windows with the same remaining capacity are runs (first window, number of windows); one step fills as many
    windows of a run as there are remainders for, as placing them one by one would.
    """
    tree, open_, out, used = Capacities(window), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                first, windows, capacity = used, -(-left // (window // length)), window
                used += windows
            else:
                first, windows = open_[capacity].pop()
                if not open_[capacity]:
                    tree.set(capacity, False)
            each = capacity // length
            full = min(windows, left // each)
            if full:
                out.append(Placement(length, rank, full * each, first, window - capacity, each))
                _open(open_, tree, capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < windows:
                if left and left < each:
                    out.append(Placement(length, rank, left, first + full, window - capacity, left))
                    _open(open_, tree, capacity - left * length, first + full, 1)
                    full, left = full + 1, 0
                if full < windows:
                    _open(open_, tree, capacity, first + full, windows - full)
    return out, used


def _open(open_: dict, tree: Capacities, capacity: int, first: int, windows: int) -> None:
    if capacity:
        open_.setdefault(capacity, []).append((first, windows))
        tree.set(capacity, True)


def assign_sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (doc_id, start, length and any columns but the two added) with ``sequence_id`` and ``offset``.

    Full windows are sequences of their own, after those of the remainders. A sequence's pieces leave no gap from offset
    0 on; all but its end is filled. Ranks run over cells of a length, so a length that very many pieces share is never
    one task's work. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    most = pieces.groupBy("length").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    cells = min(4096, max(RANK_CELLS, -(-most // CELL_ROWS)))
    cut = pieces.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "start"), F.lit(cells)).cast("int"))
    sizes = materialize(cut.groupBy("length", "_cell").agg(F.count("*").alias("n")), "lengths")  # at most window * cells rows
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed, used = best_fit_decreasing({k: v for k, v in counts.items() if k < window}, window)
    rows = [(p.length, p.rank, p.count, p.first, p.offset, p.each) for p in placed]
    if counts.get(window):
        rows.append((window, 0, counts[window], used, 0, 1))
    plan = spark.createDataFrame(rows, "p_length bigint, p_rank bigint, p_count bigint, p_first bigint, p_offset bigint, p_each bigint")
    before = sizes.selectExpr("length as b_length", "_cell as b_cell", "sum(n) over (partition by length order by _cell) - n as before")
    ranked = cut.selectExpr("*", "row_number() over (partition by length, _cell order by doc_id, start) - 1 as _within")
    ranked = ranked.join(before if cells > RANK_CELLS else F.broadcast(before), (F.col("length") == F.col("b_length")) & (F.col("_cell") == F.col("b_cell")))
    ranked = ranked.withColumn("_rank", F.col("before") + F.col("_within"))
    found = ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("p_rank")) & (F.col("_rank") < F.col("p_rank") + F.col("p_count")))
    sequence = F.col("p_first") + F.expr("(_rank - p_rank) div p_each")
    offset = F.col("p_offset") + F.expr("(_rank - p_rank) % p_each") * F.col("length")
    return found.select(*pieces.columns, sequence.alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its ids (binary), sequence and offset; see token_pieces and assign_sequences."""
    return assign_sequences(materialize(token_pieces(docs, window, id_col, text_col), "pieces"), window)


def packing_report(docs: DataFrame) -> DataFrame:
    """Digest of the packing: the ids of a piece as their CRC-32, taken before pieces are moved."""
    pieces = token_pieces(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return assign_sequences(materialize(pieces, "pieces"))
