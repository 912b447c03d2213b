"""Embedding near-duplicates by spherical-cap filters.

Directions form structured random product codes: in each of several sets the space, turned at random, is cut into halves,
and a direction takes one of the codes of the first half and one of that code's partners in the second. List decoding
finds all directions whose cap holds a vector by bounding what the second half can add. Sets are added until the measured miss is small enough. Vectors meet on shared directions and every link is verified by its exact cosine. A pair counts
in the first direction it shares, so link counts are exact for all pairs that meet, and only sums and spanning links
leave a direction's bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from math import ceil, cos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.vectors import as_rows, cosine_pairs, dimension, is_vector, unit
from palmleaf.operators.components import connected_components
from palmleaf.shared import materialize

#: Vectors that a direction should hold by chance, and the largest share of all vectors it may hold.
BUCKET, SHARE_MOST = 64, 0.01
#: Vectors of a bucket that one task compares; larger buckets are dealt out as pairs of chunks.
CHUNK = 2048
SLACK = 1e-6
#: Directions of one code set that a pair is expected to share, drawn pairs on which its miss is measured, and what part of
#: a cap's vectors a pair's second vector must at least be in for caps to be of use.
SHARED, PAIRS, RARE = 2.0, 4096, 20
#: Partners of a first code, so that directions have little in common; more where there would be over CODES codes a half.
PARTNERS, CODES = 4, 4096
#: Sums of block scores that are held at once while decoding.
CELLS = 1 << 21


def angle_tail(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles from 0 to pi, and the probability that a random direction of ``dim`` components is as near to a given one."""
    angle = np.linspace(0, pi, 100_001)
    if dim < 2:
        return angle, np.where(angle < pi, 0.5, 1.0)
    height = np.sin(angle) ** (dim - 2)
    below = np.concatenate([[0.0], np.cumsum((height[1:] + height[:-1]) / 2)])
    return angle, below / below[-1]


def cap_law(dim: int, cosine: float, share: float) -> tuple[float, float]:
    """The inner product that a random vector has with a direction with probability ``share``, and the probability that
    both vectors of a pair at ``cosine`` reach it: by integration over the sphere."""
    if share >= 1:
        return -2.0, 1.0
    angle, below = angle_tail(dim)
    if dim < 2:
        return 0.5, 0.5 if cosine > -1 else 0.0
    edge = float(np.interp(share, below, angle))
    least, across = cos(edge), sqrt(max(1 - cosine**2, 1e-18))
    inside = np.linspace(0, edge, 4001)
    # of the second vector, what is orthogonal to the first has a random direction of one component less
    other_angle, other = angle_tail(dim - 1)
    need = (least - cosine * np.cos(inside)) / (across * np.maximum(np.sin(inside), 1e-18))
    other = np.where(np.abs(need) <= 1, np.interp(np.arccos(np.clip(need, -1, 1)), other_angle, other), need < -1)
    at = np.interp(inside, angle, below)
    return least, float((np.diff(at) * (other[1:] + other[:-1]) / 2).sum())


@dataclass(frozen=True)
class Caps:
    """``sets`` code sets over vectors of ``dim`` components: each a turn, ``each`` codes of both halves and ``places`` partners that
    a first code has among the second ones; ``least`` is the least inner product of a direction's cap.

    Codes are drawn from ``seed`` and the number of their set wherever they are needed, and partners follow from a start and
    a step of each first code, so that these six numbers are all that tasks are sent, however many directions there are.
    """

    dim: int
    each: int
    places: int
    least: float
    sets: int
    seed: int = 11

    @classmethod
    def fit(cls, n: int, dim: int, cosine: float, miss: float = 1e-7, seed: int = 11) -> Caps:
        """Caps for ``n`` vectors of ``dim`` components, and enough sets that a pair at ``cosine`` shares no direction
        with probability ``miss`` only.

        The share of vectors in a cap is BUCKET / n (SHARE_MOST at most, but more where a pair would hardly ever share
        one). Codes of a half are at least as many as a code's partners, so that no direction stands twice. Directions of
        one set are not independent, so the miss of each set is measured, on drawn pairs at exactly ``cosine`` decoded with
        its codes, and bounded from above. Sets are turned independently, so that for any one pair the misses of sets
        multiply.
        """
        share = min(SHARE_MOST, BUCKET / max(n, 1))
        least, both = cap_law(dim, cosine, share)
        while both < share / RARE:
            share = min(1.0, 2 * share)
            least, both = cap_law(dim, cosine, share)
        directions = SHARED / both
        each = max(min(ceil(directions / PARTNERS), CODES), ceil(sqrt(directions)))
        pairs, sets, left = np.random.default_rng(seed + 1), 0, 1.0
        found = cls(dim, each, ceil(directions / each), least, 0, seed)
        while left > miss:
            left *= found.missed(sets, cosine, pairs)
            sets += 1
        return replace(found, sets=sets)

    @property
    def size(self) -> int:
        """Directions of all sets."""
        return self.sets * self.each * self.places

    @cached_property
    def _drawn(self) -> dict[int, tuple[np.ndarray, ...]]:
        return {}

    def codes(self, number: int) -> tuple[np.ndarray, ...]:
        """Turn, codes of both halves, and the start and step of each first code's partners, of one set; steps have no
        factor in common with the number of codes, so that a code's partners differ."""
        if number not in self._drawn:
            draw, dim, each = np.random.default_rng([self.seed, number]), self.dim, self.each
            turn = np.linalg.qr(draw.standard_normal((dim, dim)))[0] * draw.choice([-1.0, 1.0], dim)
            halves = [unit(draw.standard_normal((each, k))) * sqrt(k / dim) if k else np.zeros((each, 0)) for k in (dim - dim // 2, dim // 2)]
            steps = np.flatnonzero(np.gcd(np.arange(each + 1), each) == 1)
            self._drawn[number] = (turn, *halves, draw.integers(0, each, each), draw.choice(steps, each))
        return self._drawn[number]

    def missed(self, number: int, cosine: float, draw: np.random.Generator, pairs: int = PAIRS) -> float:
        """Upper bound (three standard deviations) of the probability that a pair at ``cosine`` shares no direction of one set."""
        lost = 0
        for at in range(0, pairs, 256):
            n = min(256, pairs - at)
            x, y = pairs_at(cosine, n, self.dim, draw)
            a, b = (np.stack(self._decode_set(v, number), axis=1) for v in (x, y))
            both = np.concatenate([a, b])
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            lost += n - len(np.unique(both[1:][(both[1:] == both[:-1]).all(axis=1), 0]))
        return min(1.0, (lost + 3 * sqrt(lost) + 3) / pairs)

    def decode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of all caps that hold a row, by row and direction; directions are numbered through all sets."""
        found = [self._decode_set(rows, number) for number in range(self.sets)]
        row, direction = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(row, kind="stable")  # within a row and set they are found in order already
        return row[order], direction[order]

    def _decode_set(self, rows: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
        turn, first, second, start, stride = self.codes(number)
        turned, cut, step, parts = rows @ turn, first.shape[1], max(1, CELLS // self.places), []
        left, right = turned[:, :cut] @ first.T, turned[:, cut:] @ second.T
        row, code = np.nonzero(left >= self.least - right.max(axis=1, keepdims=True))
        place = np.arange(self.places)
        for i in range(0, len(row), step):
            r, c = row[i : i + step], code[i : i + step]
            partner = (start[c][:, None] + stride[c][:, None] * place) % self.each
            at, p = np.nonzero(left[r, c][:, None] + right[r[:, None], partner] >= self.least)
            parts.append((r[at], (number * self.each + c[at]) * self.places + p))
        found = zip(*parts) if parts else (([row], [code]))
        return tuple(np.concatenate(x) for x in found)  # type: ignore[return-value]


def pairs_at(cosine: float, n: int, dim: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``n`` random pairs of unit vectors at exactly ``cosine`` (equal ones where there is but one component)."""
    x, y = unit(draw.standard_normal((n, dim))), draw.standard_normal((n, dim))
    if dim < 2:
        return x, x
    y = unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    return x, cosine * x + sqrt(max(0.0, 1 - cosine**2)) * y


def _decoded(c: Caps, dim: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                row, direction = c.decode(unit(as_rows(part.column("embedding"), dim)))
                place = np.arange(len(row)) - np.searchsorted(row, row)  # directions of a row stand in order; each goes with those before it
                start = np.cumsum(place) - place
                before = direction[np.repeat(np.arange(len(row)) - place - start, place) + np.arange(place.sum())]
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, place.sum()), pa.int32()), pa.array(before.astype(np.int32 if c.size < 1 << 31 else np.int64)))
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(direction), part.column("key").take(rows), part.column("n").take(rows), part.column("embedding").take(rows), lists], ["direction", "key", "n", "embedding", "earlier"])

    return run


def _verified(cosine: float, dim: int):
    def links(b: pa.RecordBatch) -> pa.RecordBatch:
        """Sums of links and a spanning star of each component, of one bucket or one pair of its chunks."""
        crossing = b.column("crossing")[0].as_py()
        x = as_rows(b.column("embedding"), dim)
        key, n, side = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "side"))
        u = unit(x)
        near = np.zeros((len(x), len(x)), bool)
        for i in range(0, len(x), 512):
            sims = u[i : i + 512] @ u.T
            near[i : i + 512] = sims >= cosine + SLACK
            row, col = np.nonzero(np.abs(sims - cosine) < SLACK)
            near[i + row, col] = cosine_pairs(x[i + row], x[col]) >= cosine
        np.fill_diagonal(near, False)
        if crossing:
            near &= side[:, None] != side[None, :]
        busy = np.flatnonzero(near.any(axis=1))
        near, key, n = near[np.ix_(busy, busy)], key[busy], n[busy]
        # pairs that met in an earlier direction have been counted there
        earlier = [b.column("earlier")[int(i)].values.to_numpy().astype(np.int64) for i in busy]
        known, place = np.unique(np.concatenate(earlier) if earlier else np.array([], np.int64), return_inverse=True)
        member = np.zeros((len(busy), len(known)), np.float32)
        member[np.repeat(np.arange(len(busy)), list(map(len, earlier))), place] = 1
        added = np.zeros(len(busy), np.int64)
        label = np.arange(len(busy))
        for i in range(0, len(busy), 512):
            new = near[i : i + 512] & (member[i : i + 512] @ member.T == 0)
            added[i : i + 512] = new @ n
        while len(busy):
            low = np.minimum(label, np.where(near, label[None, :], len(busy)).min(axis=1))
            low = np.minimum(low, low[low])
            if (low == label).all():
                break
            label = low
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(added), pa.array(key[label])], ["key", "added", "root"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit."""
        rows: list[pa.RecordBatch] = []
        unit_of = None
        for b in it:
            of = b.column("unit").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if rows and of[lo] != unit_of:
                    if sum(map(len, rows)) > 1:
                        yield links(pa.concat_batches(rows))
                    rows = []
                unit_of = of[lo]
                rows.append(b.slice(lo, hi - lo))
        if sum(map(len, rows)) > 1:
            yield links(pa.concat_batches(rows))

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = 0.9, dim: int | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``embeddings`` (vec_id, embedding; others not read).

    n_links: other rows at ``cosine`` or more; component_id: smallest vec_id reachable by links, itself included; kept:
    the two ids are equal. Equal vectors are compared once. Vectors that are null, zero, of another length than most, or
    hold a null or non-finite component have no links. A null vec_id counts as a link but is no candidate for
    component_id; kept is then false. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    dim = dim or dimension(embeddings, "embedding")
    rows = embeddings.select("vec_id", F.when(is_vector("embedding", dim), F.col("embedding")).alias("embedding"))
    distinct = rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    distinct = materialize(distinct.select(F.monotonically_increasing_id().alias("key"), "first_id", "n", "embedding"), "distinct-vectors")
    caps = Caps.fit(distinct.count(), max(dim, 1), cosine)
    caps = Caps(caps.dim, caps.each, caps.places, caps.least, caps.sets, caps.seed)  # without the codes drawn here; tasks draw their own
    kind = dict(distinct.dtypes)["embedding"]
    met = distinct.select("key", "n", "embedding").mapInArrow(_decoded(caps, dim), f"direction bigint, key bigint, n bigint, embedding {kind}, earlier array<{'int' if caps.size < 1 << 31 else 'bigint'}>")
    met = materialize(met, "directions")
    large = met.groupBy("direction").agg(F.count("*").alias("rows")).where(F.col("rows") > CHUNK)
    large = large.select(F.col("direction").alias("d"), F.ceil(F.col("rows") / F.lit(CHUNK // 2)).cast("int").alias("chunks"))
    large = materialize(large, "large-directions")  # mostly few or none, and then Spark broadcasts them
    chunk = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
    one = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(chunk, o).alias("a"), F.greatest(chunk, o).alias("b")))
    dealt = met.join(large, F.col("direction") == F.col("d"), "left").withColumn("chunk", F.coalesce(chunk, F.lit(0)))
    dealt = dealt.select("direction", "key", "n", "embedding", "earlier", "chunk", F.explode(F.when(F.col("chunks").isNull(), F.array(one)).otherwise(pair)).alias("pair"))
    dealt = dealt.select(F.xxhash64("direction", "pair").alias("unit"), "key", "n", "embedding", "earlier", (F.col("pair.a") != F.col("pair.b")).alias("crossing"), (F.col("chunk") == F.col("pair.a")).alias("side"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(_verified(cosine, dim), "key bigint, added bigint, root bigint")
    found = materialize(found, "links")
    sums = found.groupBy("key").agg(F.sum("added").alias("added")).withColumnRenamed("key", "k")
    roots = connected_components(found.where("key != root").select(F.col("key").alias("src"), F.col("root").alias("dst")))
    named = distinct.join(sums.hint("merge"), F.col("key") == F.col("k"), "left").join(roots.hint("merge"), F.col("key") == F.col("node"), "left")
    named = materialize(named.select("embedding", "first_id", (F.coalesce("added", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "key").alias("root")), "vector-roots")
    low = named.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "r")
    classes = named.join(low.hint("merge"), F.col("root") == F.col("r")).select(F.col("embedding").alias("e"), "n_links", "component_id")
    out = rows.join(classes.hint("merge"), F.col("embedding") == F.col("e"), "left")
    component = F.when(F.col("e").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
