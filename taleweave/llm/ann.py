"""Approximate nearest neighbours with balanced posting lists.

Equal vectors are one entry of the index (with their k + 1 smallest ids, which
is all that any answer can need).  Centroids are fitted on a bounded sample by
repeated balanced splits; every vector of the table is then posted to its
nearest centroid and, if it lies near a boundary, to further centroids within a
distance ratio, unless a closer chosen centroid is nearer to that one than the
vector is.  Centroids are searched by a best-first walk on a graph of near
centroids held in memory.  A query visits the lists whose centroids are within a
distance ratio of its nearest; lists larger than a segment are split, so no task
meets more than a segment at a time.  Distances are exact, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.llm.scratch import written

SAMPLE = 20_000  # vectors on which centroids are fitted
PER_LIST = 48  # sampled or counted vectors a list is planned for
MAX_LISTS = 4096
COPIES = 6  # most lists that hold one vector
BOUNDARY_RATIO = 1.15
PROBES = 96  # most lists that a query visits
PROBE_RATIO = 1.35
SEGMENT = 4096
NEIGHBOURS = 24  # of a centroid in the graph
BEAM = 128


def balanced_centroids(sample: np.ndarray, n_lists: int, seed: int = 1) -> np.ndarray:
    """Centres of ``n_lists`` parts of nearly equal size: halves by the median along a two-means axis, refined at the end."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(sample))]
    while len(parts) < n_lists:
        parts.sort(key=len)
        own = parts.pop()
        if len(own) < 2:
            parts.append(own)
            break
        x = sample[own]
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(4):
            side = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
            if side.all() or not side.any():
                break
            a, b = x[side].mean(0), x[~side].mean(0)
        order = np.argsort(x @ (b - a), kind="stable")
        parts += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    centres = np.array([sample[p].mean(0) for p in parts])
    for _ in range(3):  # assignments without balance move the centres to where vectors are
        near = np.argmin((centres**2).sum(1)[None, :] - 2 * sample @ centres.T, axis=1)
        filled = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(filled[:, None] > 0, sums / np.maximum(filled, 1)[:, None], centres)
    return np.unique(centres, axis=0)


class CentroidGraph:
    """Near centroids of every centroid, walked best first for many queries at once."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        n = len(centres)
        k = min(NEIGHBOURS, max(n - 1, 0))
        d = (centres**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * centres @ centres.T
        np.fill_diagonal(d, np.inf)
        half = k // 2
        near = np.argsort(d, axis=1, kind="stable")[:, : k - half]
        rng = np.random.default_rng(7)
        # a few far links keep the graph in one piece
        self.links = np.concatenate([near, rng.integers(0, n, (n, half))], axis=1) if n > 1 else np.zeros((1, 0), np.int64)
        self.pivots = np.unique(np.linspace(0, n - 1, min(n, max(16, int(np.sqrt(n))))).astype(int))

    def search(self, queries: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances), nearest first, of each query."""
        n, q = len(self.centres), len(queries)
        beam = min(n, max(BEAM, want))
        out_i, out_d = np.empty((q, min(want, n)), np.int64), np.empty((q, min(want, n)))
        for first in range(0, q, 256):
            x = queries[first : first + 256]
            m = len(x)
            rows = np.arange(m)[:, None]
            seen = np.zeros((m, n), dtype=bool)
            done = np.zeros((m, n), dtype=bool)
            dist = np.full((m, n), np.inf)
            dist[:, self.pivots] = ((x[:, None, :] - self.centres[self.pivots][None]) ** 2).sum(2)
            seen[:, self.pivots] = True
            for _ in range(n):
                top = np.argpartition(dist, beam - 1, axis=1)[:, :beam] if beam < n else np.broadcast_to(np.arange(n), (m, n))
                open_ = np.where(done[rows, top] | ~seen[rows, top], np.inf, dist[rows, top])
                step = np.argsort(open_, axis=1)[:, :8]
                live = np.take_along_axis(open_, step, 1) < np.inf
                if not live.any():
                    break
                expand = np.take_along_axis(top, step, 1)
                r = np.broadcast_to(rows, expand.shape)[live]
                c = expand[live]
                done[r, c] = True
                r2, c2 = np.repeat(r, self.links.shape[1]), self.links[c].ravel()
                new = ~seen[r2, c2]
                r2, c2 = r2[new], c2[new]
                seen[r2, c2] = True
                dist[r2, c2] = ((x[r2] - self.centres[c2]) ** 2).sum(1)
            order = np.argsort(dist, axis=1, kind="stable")[:, : out_i.shape[1]]
            out_i[first : first + m], out_d[first : first + m] = order, np.take_along_axis(dist, order, 1)
        return out_i, out_d


def _postings(graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): the nearest list of each vector and those across near boundaries."""
    near, d = graph.search(x, COPIES * 2)
    rows, lists = [np.arange(len(x))], [near[:, 0]]
    chosen = np.zeros_like(near, dtype=bool)
    chosen[:, 0] = np.isfinite(d[:, 0])
    for j in range(1, near.shape[1]):
        ok = (d[:, j] <= BOUNDARY_RATIO**2 * d[:, 0]) & (chosen.sum(1) < COPIES)
        for i in range(j):
            # a chosen list that lies closer to this one than the vector covers its boundary
            apart = ((graph.centres[near[:, i]] - graph.centres[near[:, j]]) ** 2).sum(1)
            ok &= ~(chosen[:, i] & (apart < 0.25 * d[:, j]))
        chosen[:, j] = ok
        rows.append(np.flatnonzero(ok))
        lists.append(near[ok, j])
    return np.concatenate(rows), np.concatenate(lists)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def usable(vector: Column, dims: Column | None = None) -> Column:
    """Not null, not zero, all components finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", n_lists: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest other rows found, ties to the smaller id.

    Null, zero and non-finite vectors take no part, nor do rows without an id,
    nor vectors whose length isn't the most frequent one (the longer of two as
    frequent).  Rows with the same id are one candidate, the one with the
    smallest vector.  With fewer than ``k`` other rows all are returned; an
    empty table gives no rows.  ``is_query`` is a condition on the id column.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL").where(usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    out_type = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return rows.sparkSession.createDataFrame([], out_type)
    rows = written(rows.where(F.size("v") == sizes["size"]).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    smallest = F.slice(F.array_sort(F.collect_set("id")), 1, k + 1)
    # groups of equal vectors shrink to k + 1 ids in two steps, so that no task gathers a large group
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    entries = rows.groupBy("v", part.alias("part")).agg(smallest.alias("ids")).groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    entries = written(entries.withColumn("entry", F.element_at("ids", 1)), "entries")
    total = entries.count()
    n_lists = n_lists or int(min(MAX_LISTS, max(1, total // PER_LIST)))
    sample = entries.orderBy(F.xxhash64("entry")).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()  # at most SAMPLE vectors
    graph = CentroidGraph(balanced_centroids(_matrix(sample), min(n_lists, len(sample))))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, of = _postings(graph, _matrix(batch["v"]))
                yield pa.RecordBatch.from_arrays([pa.array(of), *(batch[c].take(pa.array(row)) for c in ("entry", "v", "ids"))], ["list", "entry", "v", "ids"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, d = graph.search(_matrix(batch["v"]), PROBES)
                ok = np.isfinite(d) & (d <= PROBE_RATIO**2 * np.maximum(d[:, :1], np.finfo(float).tiny))
                ok[:, :4] = np.isfinite(d[:, :4])  # never fewer than four lists
                row, j = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(near[row, j]), *(batch[c].take(pa.array(row)) for c in ("entry", "v"))], ["list", "query", "v"])

    postings = written(entries.mapInArrow(post, "list long, entry long, v array<double>, ids array<long>"), "postings")
    parts = postings.groupBy("list").agg(F.ceil(F.count("*") / SEGMENT).cast("long").alias("parts"))
    held = postings.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts"))).drop("parts")
    asked = rows.where(is_query).withColumnRenamed("id", "query_id")
    queries = asked.groupBy("v").agg(F.min("query_id").alias("entry"))
    routed = queries.select("entry", "v").mapInArrow(route, "list long, query long, v array<double>")
    routed = routed.join(parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def scan(lists: pa.Table, asking: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "score": [], "ids": []}
        if lists.num_rows and asking.num_rows:
            x, ids = _matrix(lists["v"].combine_chunks()), lists["ids"].to_pylist()
            first = np.array([i[0] for i in ids])
            for query, v in zip(asking["query"].to_pylist(), asking["v"].to_pylist(), strict=True):
                d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
                # the query's own entry may be among them: one more than asked for
                for i in np.lexsort((first, d))[: k + 1].tolist():
                    out["query"].append(query)
                    out["score"].append(float(d[i]))
                    out["ids"].append(ids[i])
        return pa.table(out, schema=pa.schema([("query", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))]))

    hits = held.groupBy("list", "part").cogroup(routed.groupBy("list", "part")).applyInArrow(scan, "query long, score double, ids array<long>")
    hits = hits.select("query", "score", F.explode("ids").alias("vec_id")).distinct()
    best = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("nth") <= k + 1)
    # every row with the query's vector has the same list, but for itself
    same = asked.join(queries.withColumnRenamed("entry", "query"), "v").select("query_id", "query")
    answers = same.join(best, "query").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return answers.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
