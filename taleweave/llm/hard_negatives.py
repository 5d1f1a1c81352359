"""Hard negatives by a search of norm buckets.

Rows are sorted by the norm of their quantised vectors and cut into buckets of
nearly equal size.  By Cauchy-Schwarz no row of a bucket scores more against an
anchor than the anchor's norm times the bucket's largest norm, so buckets are
visited in falling order of norm, in rounds that grow geometrically, and an
anchor meets only those buckets of a round whose bound reaches what it still
needs: the score of its running k-th hit, and for a window also its lower limit.
The first search finds each anchor's positives, the second the best rows of
other labels inside the window below each positive's score.

An anchor block and a bucket are one product of two matrices in one task, with
labels told apart inside it, so neither a frequent label nor a frequent vector
gathers anywhere; of a task's scores at most k an anchor (and window) go on.
Scores are exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.llm.scratch import written

BUCKET_ROWS = 2048  # candidates in one task
BLOCK_ROWS = 1024  # anchors in one task
GROWTH = 4  # of the number of buckets from round to round
STRIP = 128  # anchors of which a task holds the scores at a time
SLACK = 1 + 1e-9  # of bounds, against rounding
NONE = -(2**63)  # below every score
#: Components are held within this, so that sums of 1024 products fit a long.
LARGEST = 2**26


def quantised(vector: Column, steps: int) -> Column:
    """floor(steps * x) of every component, as integers within LARGEST."""
    most = F.lit(float(LARGEST))
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x * steps, most), -most)).cast("int"))


def usable_rows(vectors: DataFrame, steps: int, id_col: str, vector_col: str, label_col: str, flip: Column | None, n_labels: int) -> DataFrame:
    """(id, label, v, norm2): rows that take part, one an id, with noisy labels and quantised vectors."""
    v = F.col("x")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(F.coalesce(~bad, F.lit(False)) & (F.size("x") > 0))
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size("x") == (sizes["size"] if sizes else 0))
    rows = rows.select("id", "label", quantised(v, steps).alias("v")).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    if flip is not None:
        rows = rows.withColumn("label", F.when(flip, (F.col("label") + 1) % n_labels).otherwise(F.col("label")))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x))


def norm_buckets(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``rows`` with their bucket, 0 the one of the largest norms; (bucket, max_norm) of every bucket; the number of buckets."""
    n = max(1, -(-rows.count() // BUCKET_ROWS))
    # equal vectors go apart by id, so a frequent one fills no bucket beyond its size
    dealt = written(rows.repartitionByRange(n, F.desc("norm2"), F.col("id")).withColumn("bucket", F.spark_partition_id()), "norm-buckets")
    tops = written(dealt.groupBy("bucket").agg(F.sqrt(F.max("norm2").cast("double")).alias("max_norm")), "norm-tops")
    return dealt, tops, (tops.agg(F.max("bucket")).first()[0] or 0) + 1


def _scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all sums are below 2**53, which BLAS computes fastest, else in longs."""
    if a.size and c.size and float(np.abs(a).max()) * float(np.abs(c).max()) * a.shape[1] >= 2**53:
        return a.astype(np.int64) @ c.T.astype(np.int64)
    return (a.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _best(scores: np.ndarray, allowed: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` largest allowed scores of at least ``least``; equal ones go by column."""
    masked = np.where(allowed, scores, NONE)
    if masked.shape[1] > k:
        least = np.maximum(least, np.partition(masked, masked.shape[1] - k, axis=1)[:, -k])
    row, col = np.nonzero(allowed & (masked >= least[:, None]))
    order = np.lexsort((col, -masked[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)  # where each row's hits begin
    keep = np.arange(len(row)) - first < k
    return row[keep], col[keep]


HIT = "anchor long, window long, bucket int, id long, score long"


def _visit(k: int, same: bool):
    """A task's work: a block of anchors against one bucket; an anchor has a row for each of its windows."""

    def visit(asking: pa.Table, held: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if asking.num_rows and held.num_rows:
            held = held.sort_by("id")
            asking = asking.sort_by([("anchor", "ascending"), ("window", "ascending")])
            c, c_id, c_label = _matrix(held["v"]), held["id"].to_numpy(), held["label"].to_numpy()
            anchor, label = asking["anchor"].to_numpy(), asking["label"].to_numpy()
            window, lower, upper, least = (asking[x].to_numpy() for x in ("window", "lower", "upper", "least"))
            firsts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            of = np.cumsum(np.r_[True, anchor[1:] != anchor[:-1]]) - 1  # a window's anchor among the distinct ones
            a = _matrix(asking["v"].take(pa.array(firsts)))
            for start in range(0, len(firsts), STRIP):
                s = _scores(a[start : start + STRIP], c)
                own = np.flatnonzero((of >= start) & (of < start + STRIP))
                for first in range(0, len(own), STRIP):
                    w = own[first : first + STRIP]
                    score = s[of[w] - start]
                    alike = c_label[None, :] == label[w][:, None]
                    ok = alike & (c_id[None, :] != anchor[w][:, None]) if same else ~alike & (score >= lower[w][:, None]) & (score <= upper[w][:, None])
                    row, col = _best(score, ok, least[w], k)
                    for have, x in zip(out, (anchor[w][row], window[w][row], c_id[col], score[row, col]), strict=True):
                        have.append(x)
        anchors, windows, ids, scores = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
        bucket = np.full(len(ids), held["bucket"][0].as_py() if held.num_rows else 0, np.int32)
        return pa.table({"anchor": anchors, "window": windows, "bucket": bucket, "id": ids, "score": scores})

    return visit


def _top(hits: DataFrame, k: int) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))
    return hits.withColumn("nth", best).where(F.col("nth") <= k)


def search(asked: DataFrame, dealt: DataFrame, tops: DataFrame, n_buckets: int, k: int, same: bool) -> DataFrame:
    """(anchor, window, id, score, nth): the ``k`` best rows of every window of ``asked``.

    ``asked`` has anchor, block, label, v, norm, window, lower and upper (its limits; NONE and any for ``same``).
    """
    best: DataFrame | None = None
    first, width = 0, 1
    while first < n_buckets:
        last = min(first + width, n_buckets)
        least = F.lit(NONE).cast("long")
        live = asked
        if best is not None:
            # what a window still needs: the score of its running k-th hit, once it has k
            kth = best.where(F.col("nth") == k).select("anchor", "window", F.col("score").alias("kth"))
            live = live.join(kth, ["anchor", "window"], "left")
            least = F.coalesce("kth", F.lit(NONE))
        # a window's lower limit rules buckets out like a score does
        need = F.greatest(least, F.col("lower")).cast("double")
        live = live.select("anchor", "block", "label", "v", "norm", "window", "lower", "upper", least.alias("least"), need.alias("need"), F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("bucket"))
        live = live.join(tops, "bucket").where(F.col("norm") * F.col("max_norm") * SLACK >= F.col("need"))
        live = live.select("anchor", "block", "label", "v", "window", "lower", "upper", "least", "bucket")
        meet = live.select("bucket", F.col("block").alias("against")).distinct()
        held = dealt.where(F.col("bucket").between(first, last - 1)).join(meet, "bucket")
        hits = live.groupBy("bucket", "block").cogroup(held.select("id", "label", "v", "bucket", "against").groupBy("bucket", "against")).applyInArrow(_visit(k, same), HIT)
        # a window's hits shrink by parts of the buckets before they meet
        part = Window.partitionBy("anchor", "window", F.col("bucket") % 64).orderBy(F.desc("score"), "id")
        hits = hits.withColumn("nth", F.row_number().over(part)).where(F.col("nth") <= k).select("anchor", "window", "id", "score")
        if best is not None:
            hits = hits.unionByName(best.select("anchor", "window", "id", "score"))
        best = written(_top(hits, k), "norm-best")
        first, width = last, width * GROWTH
    return best


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    flip: Column | None = None,
    n_positives: int = 5,
    n_negatives: int = 5,
    low: int = 80,
    high: int = 100,
    steps: int = 256,
    n_labels: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every anchor and positive.

    ``is_anchor`` and ``flip`` (rows whose label moves to the next one, modulo
    ``n_labels``) are conditions on the column ``id``.  Components become
    floor(steps * x), held within 2**26 either way; a score is the integer inner
    product with the anchor; higher scores come first, ties by smaller id.  An
    anchor's positives are its first ``n_positives`` other rows of the same label;
    a pair's negatives are the first ``n_negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.  With
    fewer, all of them; so a negative positive_score has no negatives where
    low < high.

    Null labels, null or empty vectors and vectors with null or non-finite
    components take no part, nor do rows without an id and vectors whose length
    isn't the most frequent (the longer of two as frequent).  Of rows with one id
    the one with the smallest label, then vector, stands.  Zero vectors take part.
    An empty table gives no rows; other columns are ignored.
    """
    rows = written(usable_rows(vectors, steps, id_col, vector_col, label_col, flip, n_labels), "quantised")
    dealt, tops, n_buckets = norm_buckets(rows)
    asked = rows.where(is_anchor)
    n_blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    asked = asked.select(F.col("id").alias("anchor"), block.alias("block"), "label", "v", F.sqrt(F.col("norm2").cast("double")).alias("norm"))
    none = F.lit(NONE).cast("long")
    positives = search(asked.withColumns({"window": none, "lower": none, "upper": none}), dealt, tops, n_buckets, n_positives, same=True)
    positives = positives.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("window"))
    # positives of one score share a window, which goes by that score
    hundredths = F.col("window").cast("decimal(20,0)")
    limits = positives.select("anchor", "window", F.ceil(hundredths * low / 100).cast("long").alias("lower"), F.floor(hundredths * high / 100).cast("long").alias("upper")).distinct().where("lower <= upper")
    negatives = search(asked.join(limits, "anchor"), dealt, tops, n_buckets, n_negatives, same=False)
    return positives.join(negatives, ["anchor", "window"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("nth").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("window").alias("positive_score"), F.col("score").alias("negative_score")
    )
