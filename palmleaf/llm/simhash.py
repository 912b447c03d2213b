"""SimHash near-duplicate groups.

Fingerprints are made in Arrow batches. Distinct fingerprints meet in buckets of equal bits; inside a bucket, bit planes
stored vertically are compared with carry-save counters and a block is abandoned once every distance exceeds the radius.
Only spanning links leave a bucket, never all its pairs.

Two plans of buckets: EXACT (64 bits, radius 3: two of five bit blocks, which three differing bits always leave
untouched, so no link is lost) and similar_plan (256 bits for a shingle similarity of 0.8: seeded samples of 16 bits or
more). Groups by the latter are candidates only: similar_groups links what has the similarity itself, by the sets of
shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from palmleaf.llm.workers import lean, slices
from palmleaf.operators.components import connected_components
from palmleaf.shared import materialize

SEED = 42
#: Distinct fingerprints of a bucket that one task compares; larger buckets are dealt out as pairs of chunks.
CHUNK = 2048
#: Values of a block that are compared together.
PACK = 512
#: Rows up to which a bucket is small: its pairs go side by side with those of other small buckets, so many to a block.
SMALL, LANES = 64, 1 << 14
#: Texts of a proposed group that one task verifies; larger groups are dealt out as pairs of chunks.
VERIFY_CHUNK = 512


@dataclass(frozen=True)
class Plan:
    """``bits`` of a fingerprint, shingle ``width`` in words, ``radius`` in bits, and the bit positions of each bucket key."""

    bits: int
    width: int
    radius: int
    keys: tuple[tuple[int, ...], ...]


_BLOCKS = [range(0, 13), range(13, 26), range(26, 39), range(39, 52), range(52, 64)]
EXACT = Plan(64, 3, 3, tuple((*a, *b) for a, b in combinations(_BLOCKS, 2)))


def similar_plan(n: int = 0, similarity: float = 0.8, width: int = 5, bits: int = 256, found: float = 0.993) -> Plan:
    """Plan for ``n`` texts, those whose sets of word shingles have a Jaccard ``similarity`` or more being near.

    Two sets of Jaccard s have cosine 2s / (1 + s); the angle gives the expected share of differing bits. The radius is
    that number and three standard deviations. Keys have 16 bits, and more where a bucket would hold over 64 texts by
    chance; there are so many tables that radius and keys together find a pair with probability ``found`` (found_chance).
    """
    share = differing_share(similarity)
    radius = round(bits * share + 3 * np.sqrt(bits * share * (1 - share)))
    key_bits = min(40, max(16, (n // 64).bit_length()))
    tables = 8
    while _found(bits, radius, key_bits, tables, share) < found:
        tables += 1 + tables // 32
    draw = np.random.default_rng(SEED)
    return Plan(bits, width, radius, tuple(tuple(sorted(map(int, draw.choice(bits, key_bits, replace=False)))) for _ in range(tables)))


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two sets at a Jaccard ``similarity``."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _found(bits: int, radius: int, key_bits: int, tables: int, share: float) -> float:
    total = 0.0
    for k in range(radius + 1):
        same = comb(bits - k, key_bits) / comb(bits, key_bits)
        total += comb(bits, k) * share**k * (1 - share) ** (bits - k) * (1 - (1 - same) ** tables)
    return total


def found_chance(plan: Plan, similarity: float) -> float:
    """Probability that a pair at ``similarity`` lies within the radius and shares a key in some table, with independent bits."""
    return _found(plan.bits, plan.radius, len(plan.keys[0]), len(plan.keys), differing_share(similarity))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; all words are one where there are fewer than ``width``. A-Z count as a-z."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        grams, n = iter([b" ".join(words)]), 1
    else:
        grams, n = map(b" ".join, zip(*(words[i:] for i in range(width)))), len(words) - width + 1
    return np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)


def fingerprint(text: bytes | None, width: int = 3, bits: int = 64) -> bytes:
    """SimHash of the word shingles of a text, big-endian; zeros without words. A-Z count as a-z.

    The first 64 bits come from XXH64 with seed 42, each further 64 from a remixing of that hash.
    """
    hashes = shingles(text, width)
    n = len(hashes)
    if not n:
        return bytes(bits // 8)
    out = b""
    for word in range(bits // 64):
        if word:
            hashes = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(29)
        counts = np.zeros(64, np.int64)
        for i in range(0, n, 16384):
            counts += np.unpackbits(hashes[i : i + 16384].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out += np.packbits(counts * 2 > n).tobytes()
    return out


def fingerprints(docs: DataFrame, plan: Plan = EXACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: one row per input row, the fingerprint as binary."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            texts = b.column(1).cast(pa.large_binary())
            fp = pa.array([fingerprint(t.as_py(), plan.width, plan.bits) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(batches), f"doc_id {key}, fp binary")


def as_matrix(fps: pa.Array) -> np.ndarray:
    """(n, bits / 64) words of binary fingerprints."""
    joined = np.frombuffer(b"".join(fps.to_pylist()), ">u8").astype(np.uint64)
    return joined.reshape(len(fps), -1)


def as_bits(values: np.ndarray) -> np.ndarray:
    """(n, bits) of 0 and 1, the most significant bit first."""
    return np.unpackbits(values.astype(">u8").view(np.uint8).reshape(len(values), -1), axis=1)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(bits, ceil(n / 64)) words: plane b holds bit b of every value, one value a bit."""
    bits = as_bits(values)
    padded = np.zeros((bits.shape[1], -(-len(values) // 64) * 64), np.uint8)
    padded[:, : len(values)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def within_radius(queries: np.ndarray, planes: np.ndarray, radius: int, own: bool = False) -> np.ndarray:
    """(queries, words) bit masks of the values at ``radius`` or fewer differing bits.

    Carry-save counters add one plane of differences to all distances of a block at a time; the carry out of the top
    counter marks distances that are past the radius, and the block is abandoned when that is all of them. own: query k is
    value k itself, which is left out.
    """
    bits, levels = as_bits(queries).astype(np.uint64), int(radius).bit_length()
    counters = np.zeros((levels, len(queries), planes.shape[1]), np.uint64)
    past = np.zeros(counters.shape[1:], np.uint64)
    if own:
        each = np.arange(len(queries))
        past[each, each >> 6] = np.uint64(1) << (each & 63).astype(np.uint64)
    start = (1 << levels) - 1 - radius  # so that the carry leaves the top counter just past the radius
    for k in range(levels):
        if start >> k & 1:
            counters[k] = ~np.uint64(0)
    for b in range(len(planes)):
        carry = planes[b][None, :] ^ (np.uint64(0) - bits[:, b])[:, None]
        for k in range(levels):
            held = counters[k] & carry
            counters[k] ^= carry
            carry = held
        past |= carry
        if b % 8 == 7 and (past == ~np.uint64(0)).all():
            break
    return ~past


def near_pairs(values: np.ndarray, radius: int) -> np.ndarray:
    """(n, n / 64) bit masks of the other values within the radius of each; blocks of PACK values are compared, and abandoned, by themselves."""
    n, planes, step = len(values), bit_planes(values), PACK // 64
    near = np.zeros((n, planes.shape[1]), np.uint64)
    for i in range(0, n, PACK):
        for j in range(0, planes.shape[1], step):
            near[i : i + PACK, j : j + step] = within_radius(values[i : i + PACK], planes[:, j : j + step], radius, i == 64 * j)
    if n % 64:
        near[:, -1] &= np.uint64((1 << n % 64) - 1)
    return near


def spanning_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and, for each, the first row of its component within ``values``; first rows themselves are left out."""
    n, near = len(values), near_pairs(values, radius)
    busy = np.flatnonzero(near.any(axis=1))
    label = np.arange(n)
    while len(busy):
        new = label.copy()
        for i in range(0, len(busy), PACK):
            rows = busy[i : i + PACK]
            mask = np.unpackbits(near[rows].view(np.uint8), axis=1, count=n, bitorder="little").astype(bool)
            new[rows] = np.minimum(label[rows], np.where(mask, label[None, :], n).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def lanes_within(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs (one a lane) differ in ``radius`` or fewer bits: planes of differences, one bit a pair, go into carry-save
    counters; a block of LANES pairs is abandoned once all are past the radius."""
    out, levels = np.zeros(len(left), bool), int(radius).bit_length()
    start = (1 << levels) - 1 - radius
    for at in range(0, len(left), LANES):
        planes = bit_planes(left[at : at + LANES] ^ right[at : at + LANES])
        counters = np.zeros((levels, planes.shape[1]), np.uint64)
        counters[[k for k in range(levels) if start >> k & 1]] = ~np.uint64(0)
        past = np.zeros(planes.shape[1], np.uint64)
        n = min(LANES, len(left) - at)
        if n % 64:
            past[-1] = ~np.uint64((1 << n % 64) - 1)
        for b, carry in enumerate(planes):
            for k in range(levels):
                held = counters[k] & carry
                counters[k] ^= carry
                carry = held
            past |= carry
            if b % 8 == 7 and (past == ~np.uint64(0)).all():
                break
        out[at : at + n] = np.unpackbits((~past).view(np.uint8), count=n, bitorder="little").astype(bool)
    return out


def small_bucket_links(values: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As spanning_links, for buckets of ``sizes`` values that follow each other; only values of one bucket are compared."""
    bucket, each = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values))
    pairs = [each[:-d][bucket[d:] == bucket[:-d]] for d in range(1, int(sizes.max()))]
    a = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
    b = a + np.repeat(np.arange(1, len(pairs) + 1), list(map(len, pairs)))
    near = lanes_within(values[a], values[b], radius)
    a, b, label = a[near], b[near], each.copy()
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != each)
    return own, label[own]


def _compare_buckets(radius: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket. Small buckets are compared side by side, a large one by itself."""

        def batch(fps: pa.Array, own: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([fps.take(pa.array(own)), fps.take(pa.array(first))], ["src", "dst"])

        def small() -> pa.RecordBatch:
            fps = pa.concat_arrays(held)
            return batch(fps, *small_bucket_links(as_matrix(fps), np.array(sizes), radius))

        held, sizes, pairs, key, rows = [], [], 0, None, []
        for b in _ended(it):
            keys = b.column(0).to_numpy(zero_copy_only=False) if b is not None else np.zeros(1, np.int64)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if rows and (b is None or keys[lo] != key):
                    n = sum(map(len, rows))
                    if n > SMALL:
                        fps = pa.concat_arrays(rows)
                        yield batch(fps, *spanning_links(as_matrix(fps), radius))
                    elif n > 1:
                        held, pairs = held + rows, pairs + n * (n - 1) // 2
                        sizes.append(n)
                        if pairs >= LANES:
                            yield small()
                            held, sizes, pairs = [], [], 0
                    rows = []
                if b is not None:
                    key = keys[lo]
                    rows.append(b.column(1).slice(lo, hi - lo))
        if held:
            yield small()

    return run


def _ended(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and None behind the last one."""
    yield from it
    yield None


def _bucket_keys(plan: Plan):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows == 0:
                continue
            bits = as_bits(as_matrix(b.column(0)))
            for number, places in enumerate(plan.keys):
                key = bits[:, places].astype(np.int64) @ (np.int64(1) << np.arange(len(places), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key + (number << 41)), b.column(0)], ["bucket", "fp"])

    return run


def fingerprint_links(fps: DataFrame, plan: Plan = EXACT) -> DataFrame:
    """Spanning links ``(src, dst)`` between distinct fingerprints (column ``fp``) within the radius of the plan.

    A bucket of more than CHUNK fingerprints is cut by hash into c chunks and compared as c (c + 1) / 2 pairs of chunks
    in as many tasks, so no bucket is gathered whole.
    """
    rows = fps.select("fp").mapInArrow(lean(_bucket_keys(plan)), "bucket bigint, fp binary")
    large = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    large = large.select(F.col("bucket").alias("b"), F.ceil(F.col("n") / F.lit(CHUNK // 2)).cast("int").alias("chunks"))
    large = materialize(large, "large-buckets")  # written, so that Spark knows its size and broadcasts it only if that is small
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("long")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.least(chunk, o.cast("long")) * F.lit(1 << 20) + F.greatest(chunk, o.cast("long")))
    pairs = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
    dealt = rows.join(large, F.col("bucket") == F.col("b"), "left").select("bucket", "fp", F.explode(pairs).alias("pair"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select(F.xxhash64("bucket", "pair").alias("key"), "fp").repartition(n, "key").sortWithinPartitions("key", "fp")  # the first of a component is its least, so links of many buckets are the same
    found = dealt.mapInArrow(lean(_compare_buckets(plan.radius)), "src binary, dst binary")
    # a fingerprint has one link a bucket at most; its others hang on the least of them, and then most are the same
    near = found.groupBy("src").agg(F.collect_set("dst").alias("others")).withColumn("least", F.array_min("others"))
    hung = F.concat(F.array("src"), F.array_except("others", F.array("least")))
    return near.select(F.explode(hung).alias("src"), F.col("least").alias("dst")).distinct()


def near_duplicate_groups(docs: DataFrame, plan: Plan = EXACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: documents linked by fingerprints within the radius of the plan.

    component_id is the smallest doc_id reachable. Null and empty texts have fingerprint 0 and are linked like any
    other; rows repeated with one doc_id stay repeated; a null doc_id is no candidate for component_id (a group of null
    ids only has a null component); an empty table gives no rows. Columns other than the two named are not read.
    """
    marks = materialize(fingerprints(docs, plan, id_col, text_col), "fingerprints")
    distinct = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(distinct, plan))
    named = distinct.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left")
    named = materialize(named.select("fp", "first_id", F.coalesce("component", "fp").alias("root")), "roots")
    low = named.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "r")
    classes = named.join(low.hint("merge"), F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return marks.join(classes.hint("merge"), F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def jaccard_links(sets: list[np.ndarray], similarity: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and, for each, an earlier row of its component by links of ``similarity`` or more (of different sides only, where
    given). ``sets`` hold distinct values; two empty ones are equal."""
    n, sizes = len(sets), np.array(list(map(len, sets)))
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner, first = np.repeat(np.arange(n), sizes), np.concatenate([[0], np.cumsum(sizes)])
    by_place = owner[np.argsort(place, kind="stable")]
    ends = np.cumsum(np.bincount(place)) if len(place) else np.zeros(0, np.int64)
    starts = ends - np.bincount(place) if len(place) else ends
    label = np.arange(n)
    for i in range(n):
        own = place[first[i] : first[i + 1]]
        shared = np.zeros(n, np.int64)
        for at in range(0, len(own), 1024):
            lists = [by_place[starts[x] : ends[x]] for x in own[at : at + 1024]]
            shared += np.bincount(np.concatenate(lists), minlength=n)
        union = sizes[i] + sizes - shared
        near = shared >= similarity * union - 1e-9
        if side is not None:
            near &= side != side[i]
        near[i] = True
        known = np.unique(label[near])
        if len(known) > 1:
            label[np.isin(label, known)] = known[0]
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def _verify(similarity: float):
    def links(b: pa.RecordBatch) -> pa.RecordBatch:
        side = b.column("side").to_numpy(zero_copy_only=False) if b.column("crossing")[0].as_py() else None
        own, first = jaccard_links([np.frombuffer(x.as_py(), np.uint64) for x in b.column("shingles")], similarity, side)
        return pa.RecordBatch.from_arrays([b.column("node").take(pa.array(own)), b.column("node").take(pa.array(first))], ["src", "dst"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit."""
        rows: list[pa.RecordBatch] = []
        key = None
        for b in it:
            of = b.column("unit").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if rows and of[lo] != key:
                    yield links(pa.concat_batches(rows))
                    rows = []
                key = of[lo]
                rows.append(b.slice(lo, hi - lo))
        if rows:
            yield links(pa.concat_batches(rows))

    return run


def similar_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, component_id)``: documents linked by a Jaccard ``similarity`` or more of their sets of word shingles.

    Fingerprints only propose groups. Inside a proposed group every pair of distinct texts is verified on the whole sets (of
    64-bit hashes of shingles); a group of over VERIFY_CHUNK texts is dealt out as pairs of chunks. Ids, nulls and repeats are as
    in near_duplicate_groups.
    """
    plan = similar_plan(docs.count(), similarity, width)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("node", F.unhex(F.md5("text")))
    marks = fingerprints(texts.select(F.struct("doc_id", "node").alias("row"), "text"), plan, "row")
    marks = materialize(marks.select("doc_id.doc_id", "doc_id.node", "fp"), "marks")
    nodes = materialize(marks.groupBy("node", "fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    proposed = connected_components(fingerprint_links(nodes.select("fp").distinct(), plan))
    named = nodes.join(proposed.withColumnRenamed("node", "f").hint("merge"), F.col("fp") == F.col("f"), "left")
    named = materialize(named.select(F.col("node").alias("n"), "first_id", F.coalesce("component", "fp").alias("root")), "proposed")
    groups = named.groupBy("root").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("root", "r")
    open_ = named.join(groups.hint("merge"), F.col("root") == F.col("r")).select("n", "first_id", "root", F.when(F.col("size") > VERIFY_CHUNK, F.ceil(F.col("size") / F.lit(VERIFY_CHUNK // 2))).otherwise(1).cast("int").alias("chunks"))
    asked = texts.join(open_.hint("merge"), (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("root", "node", "chunks", "text")

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            held = [np.unique(shingles(t.as_py(), width)).tobytes() for t in b.column(3).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(held, pa.binary())], ["root", "node", "chunks", "shingles"])

    known = asked.mapInArrow(lean(sets), "root binary, node binary, chunks int, shingles binary").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("chunk", o).alias("a"), F.greatest("chunk", o).alias("b")))
    dealt = known.withColumn("pair", F.explode(pair))
    dealt = dealt.select(F.xxhash64("root", "pair").alias("unit"), "node", "shingles", (F.col("pair.a") != F.col("pair.b")).alias("crossing"), (F.col("chunk") == F.col("pair.a")).alias("side"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = dealt.repartition(parts, "unit").sortWithinPartitions("unit", "node").mapInArrow(lean(_verify(similarity)), "src binary, dst binary")
    roots = connected_components(links).withColumnRenamed("node", "m")
    linked = named.join(roots.hint("merge"), F.col("n") == F.col("m"), "left")
    linked = materialize(linked.select("n", "first_id", F.coalesce("component", "n").alias("root")), "similar")
    low = linked.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "r")
    classes = linked.join(low.hint("merge"), F.col("root") == F.col("r")).select("n", "component_id")
    return marks.join(classes.hint("merge"), F.col("node") == F.col("n")).select("doc_id", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """Digest of near_duplicate_groups by the exact plan: fingerprint as 16 hex digits."""
    return near_duplicate_groups(docs).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
