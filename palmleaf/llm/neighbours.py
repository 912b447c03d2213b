"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a bounded sample; they and a neighbour graph over them are broadcast (CENTROIDS_MOST rows at most).
Every vector is filed under its nearest centroid and, if it lies near a boundary, under a few more. A query walks the
graph to its nearest centroids, keeps those whose distance is within a ratio of the best, and reads their lists. That
ratio is not a constant: it is measured on trial queries compared with every vector, so that recall holds at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.vectors import as_rows, cosine_pairs, dimension, is_vector, unit
from palmleaf.shared import materialize

#: Expected number of sampled vectors, and bounds of the broadcast index: centroids, and neighbours of each in the graph.
SAMPLE, CENTROIDS_MOST, DEGREE = 65_536, 8_192, 24
#: Expected number of trial queries, on which the ratio of a query's lists is measured.
TRIALS = 512
#: A distance to the best centroid counts as this much at least, so that a ratio of it means something.
NEAREST = 1e-3
#: Vectors of a list, and queries of a list, that one task compares; larger lists are cut.
LIST_CHUNK, QUERY_CHUNK = 16_384, 4_096
#: Nearest lists that a query reads first if those within the ratio hold too few vectors, and by which factor that grows.
WIDER = 16


@dataclass(frozen=True)
class Settings:
    """list_size: vectors a centroid stands for. copies, copy_ratio: most lists of a vector, and how much farther than the
    nearest centroid the others may be. recall: share of the trial queries' true neighbours that the lists of a query
    must hold; however many lists that takes are read. beam: least width of the graph walk."""

    list_size: int = 128
    copies: int = 4
    copy_ratio: float = 1.12
    recall: float = 0.97
    beam: int = 32


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """``lists`` unit centroids: halving at the median along a group's main direction, then Lloyd rounds that charge a
    centroid for the vectors it already has."""
    parts, rng = [np.arange(len(sample))], np.random.default_rng(seed)
    while len(parts) < lists:
        parts.sort(key=len)
        part = parts.pop()
        if len(part) < 2:
            parts.append(part)
            break
        x = sample[part] - sample[part].mean(axis=0)
        way = rng.standard_normal(x.shape[1])
        for _ in range(4):
            way = x.T @ (x @ way)
            way /= np.linalg.norm(way) or 1.0
        order = np.argsort(x @ way, kind="stable")
        parts += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    means = np.stack([sample[p].mean(axis=0) for p in parts])
    charge = np.zeros(len(parts))
    for _ in range(4):
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
        own = np.concatenate([(sample[i : i + 4096] @ means.T - charge).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sizes = np.bincount(own, minlength=len(means))
        charge += 0.02 * (sizes / sizes.mean() - 1).clip(-1, 1)
        sums = np.zeros_like(means)
        np.add.at(sums, own, sample)
        means = np.where(sizes[:, None] > 0, sums, means)
    return (means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def reach(sims: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from their cosines."""
    return np.sqrt(np.maximum(2 - 2 * sims, 0))


@dataclass(frozen=True)
class CentroidGraph:
    """Unit centroids, their nearest others, and the nodes from which walks start."""

    points: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray) -> CentroidGraph:
        n = len(points)
        near = np.zeros((n, min(DEGREE, n - 1)), np.int32)
        for i in range(0, n, 1024):
            sims = points[i : i + 1024] @ points.T
            sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -2
            near[i : i + 1024] = np.argsort(-sims, axis=1)[:, : near.shape[1]]
        # a few far links, so that a walk can leave a cluster
        far = np.random.default_rng(5).integers(0, n, (n, 8)).astype(np.int32)
        return cls(points, np.hstack([near, far]), np.linspace(0, n - 1, min(n, 32)).astype(np.int32))

    def nearest(self, rows: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(n, beam) centroids by best-first walks of all rows at once, nearest first, and their cosines (-2: none)."""
        n, rows = len(rows), rows.astype(np.float32)
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -2, np.float32)
        seen_by = np.zeros((n, len(self.points)), bool)
        start = self.entries[: beam]
        ids[:, : len(start)], sims[:, : len(start)] = start, rows @ self.points[start].T
        seen_by[:, start] = True
        done = np.zeros((n, beam), bool)
        every = np.arange(n)
        width = min(beam, max(4, beam // 24))  # open nodes of a walk that are followed at once
        while True:
            open_ = np.where(done | (ids < 0), -3, sims)
            pick = np.argpartition(-open_, min(width, beam - 1), axis=1)[:, :width]  # the best open nodes of each walk
            live = np.take_along_axis(open_, pick, 1) > -3
            if not live.any():
                break
            np.put_along_axis(done, pick, True, 1)
            new = np.where(live[:, :, None], self.links[np.take_along_axis(ids, pick, 1)], -1).reshape(n, -1)
            fresh = (new >= 0) & ~seen_by[every[:, None], new]
            # a node that two of them link to counts once
            order = np.argsort(new, axis=1, kind="stable")
            twice = np.zeros_like(fresh)
            ordered = np.take_along_axis(new, order, 1)
            np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            fresh &= ~twice
            row, col = np.nonzero(fresh)
            node = new[row, col]
            seen_by[row, node] = True
            found = np.full(new.shape, -2, np.float32)
            found[row, col] = np.einsum("ij,ij->i", rows[row], self.points[node])
            new = np.where(fresh, new, -1)
            all_sims, all_ids, all_done = np.hstack([sims, found]), np.hstack([ids, new]), np.hstack([done, ~fresh])
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims, ids, done = (np.take_along_axis(x, keep, 1) for x in (all_sims, all_ids, all_done))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def within(self, rows: np.ndarray, most: int | None, ratio: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) pairs: the nearest centroid of each row, and those whose distance is at most ``ratio`` times as
        large: all that a walk of ``beam`` finds, or ``most`` of them, no one nearer to a chosen one than to the row."""
        if beam < len(self.points):
            ids, sims = self.nearest(rows, beam)
        else:  # all of them, walks or not
            sims = rows.astype(np.float32) @ self.points.T
            ids = np.argsort(-sims, axis=1, kind="stable").astype(np.int32)
            sims = np.take_along_axis(sims, ids, 1)
        away = reach(sims)
        ok = (ids >= 0) & (away <= np.maximum(away[:, :1], NEAREST) * ratio)
        if most is None:
            return tuple(x.astype(np.int32) for x in (np.nonzero(ok)[0], ids[ok]))  # type: ignore[return-value]
        chosen = np.zeros_like(ok)
        chosen[:, 0] = ids[:, 0] >= 0
        for k in range(1, ids.shape[1]):
            test = ok[:, k] & (chosen.sum(axis=1) < most)
            if not test.any():
                continue
            between = np.einsum("ikd,id->ik", self.points[ids[:, :k]], self.points[ids[:, k]])
            chosen[:, k] = test & ~(chosen[:, :k] & (between > sims[:, k : k + 1])).any(axis=1)
        return np.nonzero(chosen)[0].astype(np.int32), ids[chosen]


def _file_under(graph, most: int | None, ratio: float, beam: int, dim: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = CentroidGraph(*graph.value)
        for b in it:
            step = max(64, min(1024, (1 << 18) // beam))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                row, lists = g.within(unit(as_rows(part.column(1), dim)), most, ratio, min(beam, len(g.points)))
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(lists)], ["vec_id", "embedding", "list"])

    return run


def _nearest_of_all(trials, k: int, dim: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ``k`` vectors of a partition that are nearest to each trial query."""
        ids, queries = trials.value
        best = np.full((len(ids), k), -3.0)
        named, rows = np.full((len(ids), k), -1, np.int64), np.zeros((len(ids), k, dim), np.float32)
        for b in it:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                vid, v = part.column(0).to_numpy(), unit(as_rows(part.column(1), dim))
                sims = queries @ v.T
                sims[ids[:, None] == vid[None, :]] = -3
                near = np.argpartition(-sims, min(k, len(vid)) - 1, axis=1)[:, :k]
                both = np.hstack([best, np.take_along_axis(sims, near, 1)])
                keep = np.argsort(-both, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(both, keep, 1)
                named = np.take_along_axis(np.hstack([named, vid[near]]), keep, 1)
                rows = np.take_along_axis(np.hstack([rows, v[near].astype(np.float32)]), keep[:, :, None], 1)
        trial, place = np.nonzero(best > -3)
        held = pa.FixedSizeListArray.from_arrays(pa.array(rows[trial, place].ravel()), dim).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(trial), pa.array(named[trial, place]), pa.array(best[trial, place]), held], ["trial", "vec_id", "score", "vector"])

    return run


def fitted_probes(vectors: DataFrame, queries: DataFrame, built: CentroidGraph, k: int, dim: int, settings: Settings) -> tuple[float, int]:
    """(ratio, beam): the least ratio of distances whose lists hold ``settings.recall`` of the ``k`` true neighbours of trial
    queries, and a walk wide enough to find all lists within it.

    Trial queries (TRIALS in expectation, each row drawn for itself) are broadcast and compared with every vector, where that lies;
    k vectors a query leave a partition. The driver gets TRIALS x k vectors.
    """
    spark, s = vectors.sparkSession, settings
    share = min(1.0, TRIALS / max(1, queries.count()))
    drawn = queries.where(F.rand(13) < share).toArrow()
    if not drawn.num_rows:
        drawn = queries.limit(1).toArrow()
    if not drawn.num_rows:
        return 1.0, s.beam
    trials = unit(as_rows(drawn.column(1).combine_chunks(), dim))
    sent = spark.sparkContext.broadcast((drawn.column(0).to_numpy(), trials))
    found = vectors.mapInArrow(_nearest_of_all(sent, k, dim), "trial bigint, vec_id bigint, score double, vector array<float>")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by trial order by score desc, vec_id)")).where(F.col("rank") <= k)
    true = ranked.select("trial", "vector").toArrow()
    if not true.num_rows:
        return 1.0, s.beam
    away = reach((trials @ built.points.T).astype(np.float64))
    away /= np.maximum(away.min(axis=1, keepdims=True), NEAREST)
    row, lists = built.within(unit(as_rows(true.column(1).combine_chunks(), dim)), s.copies, s.copy_ratio, min(s.beam, 24, len(built.points)))
    needed = np.full(true.num_rows, np.inf)
    np.minimum.at(needed, row, away[true.column(0).to_numpy()[row], lists])
    ratio = max(1.0, float(np.quantile(needed, s.recall, method="higher"))) + 1e-6
    lists_read = int((away <= ratio).sum(axis=1).max())
    return ratio, min(len(built.points), max(s.beam, lists_read + lists_read // 2))


def _best(k: int, dim: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        """The ``k`` nearest of one chunk of a list to each of a chunk of queries."""
        out: list[tuple] = []
        if len(queries) and len(vectors):
            vectors = vectors.sort_values("vec_id", kind="stable")
            v, vid = np.stack(vectors["embedding"]).astype(np.float64), vectors["vec_id"].to_numpy(np.int64)
            named, first, number = np.unique(vid, return_index=True, return_inverse=True)  # rows repeated with one id
            q, qid = np.stack(queries["embedding"]).astype(np.float64), queries["query_id"].to_numpy(np.int64)
            units = unit(v).T
            for i in range(0, len(q), 256):
                sims = unit(q[i : i + 256]) @ units
                sims[qid[i : i + 256, None] == vid[None, :]] = -3
                last = max(0, len(named) - k)
                floor = np.partition(np.maximum.reduceat(sims, first, axis=1), last, axis=1)[:, last]
                row, col = np.nonzero(sims >= np.maximum(floor, -2)[:, None] - 1e-9)  # what ties with the last one, too
                score = cosine_pairs(q[i + row], v[col])
                order = np.lexsort((vid[col], -score, row))
                row, col, score = row[order], col[order], score[order]
                once = np.sort(np.unique(row * len(named) + number[col], return_index=True)[1])
                row, col, score = row[once], col[once], score[once]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                row, col, score = (x[rank < k] for x in (row, col, score))
                out.append((qid[i + row], vid[col], score))
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.array([], np.int64), np.array([], np.int64), np.array([], float)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), parts)))

    return run


def _read_lists(asked: DataFrame, filed: DataFrame, k: int, dim: int) -> DataFrame:
    """``(query_id, vec_id, score)``, each pair once: the ``k`` nearest of each list to each query (query_id, embedding, list) that reads it."""
    # cut long lists, and lists that many queries read; one row a list, CENTROIDS_MOST at most
    cuts = filed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(LIST_CHUNK)).cast("int").alias("v_cuts"))
    cuts = cuts.join(asked.groupBy("list").agg(F.ceil(F.count("*") / F.lit(QUERY_CHUNK)).cast("int").alias("q_cuts")).hint("merge"), "list")
    cuts = materialize(cuts.withColumnRenamed("list", "l"), "cuts")
    steps = lambda most: F.explode(F.sequence(F.lit(0), F.col(most) - 1))
    left = asked.join(F.broadcast(cuts), F.col("list") == F.col("l")).select("list", "query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.col("q_cuts")).cast("int").alias("q_cut"), steps("v_cuts").alias("v_cut"))
    right = filed.join(F.broadcast(cuts), F.col("list") == F.col("l")).select("list", "vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.col("v_cuts")).cast("int").alias("v_cut"), steps("q_cuts").alias("q_cut"))
    unit_of = ["list", "q_cut", "v_cut"]
    found = left.groupBy(*unit_of).cogroup(right.groupBy(*unit_of)).applyInPandas(_best(k, dim), "query_id bigint, vec_id bigint, score double")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, settings: Settings = Settings(), dim: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``k`` nearest vectors found by cosine, its own id left out.

    Both frames have vec_id and embedding; other columns are not read. Vectors that are null, zero, of another length
    than most, or hold a null or non-finite component take no part, nor do null ids. Of rows repeated with one vec_id,
    the nearest counts. Ties go to the smaller vec_id. Fewer than k rows where there are fewer candidates; no vectors or
    no queries give no rows. The index holds every vector; only its centroids are fitted on a sample (of SAMPLE vectors
    in expectation, each row drawn for itself), and the ratio by which a query selects lists on trial queries (fitted_probes).
    """
    spark = vectors.sparkSession
    dim = dim or dimension(vectors, "embedding")
    usable = lambda df: df.where(F.col("vec_id").isNotNull() & is_vector("embedding", dim)).select(F.col("vec_id").cast("long"), "embedding")
    vectors, queries = usable(vectors), usable(queries).select(F.col("vec_id").alias("vec_id"), "embedding")
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sampled = vectors.where(F.rand(11) < min(1.0, SAMPLE / n)).orderBy("vec_id").select("embedding").toArrow()
    if not sampled.num_rows:
        sampled = vectors.limit(1).select("embedding").toArrow()
    sample = unit(as_rows(sampled.column(0).combine_chunks(), dim))
    built = CentroidGraph.build(balanced_centroids(sample, int(np.clip(n // settings.list_size, 1, CENTROIDS_MOST))))
    graph = spark.sparkContext.broadcast((built.points, built.links, built.entries))
    kind = dict(vectors.dtypes)["embedding"]
    schema = f"vec_id bigint, embedding {kind}, list int"
    s = settings
    filed = materialize(vectors.mapInArrow(_file_under(graph, s.copies, s.copy_ratio, min(s.beam, 24), dim), schema), "postings")
    ratio, beam = fitted_probes(vectors, queries, built, k, dim, s)
    asked = queries.mapInArrow(_file_under(graph, None, ratio, beam, dim), schema)
    asked = materialize(asked.withColumnRenamed("vec_id", "query_id"), "probes")
    once = materialize(_read_lists(asked, filed, k, dim), "found")
    wide = WIDER
    while True:  # queries whose lists hold fewer than k vectors read their next lists, all of them if need be
        full = once.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
        short = materialize(queries.join(full.hint("merge"), "vec_id", "left_anti"), "short")
        if short.isEmpty():
            break
        wide = min(wide, len(built.points))
        more = short.mapInArrow(_file_under(graph, None, float("inf"), wide, dim), schema).withColumnRenamed("vec_id", "query_id")
        more = _read_lists(materialize(more, "probes"), filed, k, dim)
        once = materialize(once.unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
        if wide == len(built.points):
            break
        wide *= WIDER
    ranked = once.selectExpr("query_id", "cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


def neighbours_report(embeddings: DataFrame) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50."""
    return nearest_neighbours(embeddings, embeddings.where(F.col("vec_id") % 50 == 0))
