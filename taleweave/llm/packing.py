"""Best-fit packing by bin completion on the histogram of lengths.

Every text is tokenised once and cut into pieces.  Only the counts of the
lengths (at most ``capacity`` numbers, whatever the input) go to the driver,
where bin completion works on whole groups of equal bins: around the largest
remaining length it takes an undominated filling, of least waste first, as often
as the counts allow, and leaves a path whose waste rules out a better packing.
Best-fit decreasing gives the first incumbent; the search stops at the lower
bound, or after ``max_nodes`` fillings with the best packing found; STEPS items tried
without a filling count as one of them, so its work is bounded.
The plan is a list of bin patterns, from which every piece finds its sequence
by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taleweave.llm import kernels
from taleweave.llm.frames import join_on
from taleweave.llm.scratch import written
from taleweave.llm.tokens import default_path, encoder

SUB_ROWS = 8192  # pieces in one sort
MAX_NODES = 3000  # fillings taken by the search; its choice points hold some 16 KB each
STEPS = 5000  # items tried without a filling that count as one

Filling = tuple[tuple[int, int], ...]  # ((length, how many), ...)
SEARCHED: Filling = ((0, 0),)  # none yet
Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many), ...), times


def token_pieces(docs: DataFrame, capacity: int, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; longer documents are cut from their end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), tokens.encode(batch["text"]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                at, k = 0, len(ids) % capacity or capacity
                piece = 0
                while at < len(ids):
                    rows.append((doc_id, piece, at, k, zlib.crc32(ids[at : at + k].tobytes())))
                    at, k, piece = at + k, capacity, piece + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            del batch
            kernels.give_back()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that no packing can save: by volume, and by items over half a bin with what must lie beside them."""
    sizes = np.arange(len(counts))
    best = -(-int((counts * sizes).sum()) // capacity)
    for small in range(0, capacity // 2 + 1, max(1, capacity // 64)):
        lone = int(counts[capacity - small + 1 :].sum())
        half = counts[capacity // 2 + 1 : capacity - small + 1]
        at = sizes[capacity // 2 + 1 : capacity - small + 1]
        middle = slice(small, capacity // 2 + 1)
        volume = int((counts[middle] * sizes[middle]).sum())
        room = int((half * (capacity - at)).sum())
        best = max(best, lone + int(half.sum()) + max(0, -(-(volume - room) // capacity)))
    return best


def _smeared(bits: int, width: int) -> int:
    """All numbers from x to x + width, for every x of a set kept as bits."""
    reach = 0
    while reach < width:
        step = min(reach + 1, width - reach)
        bits |= bits << step
        reach += step
    return bits


def fillings(counts: np.ndarray, room: int, most_waste: int) -> Iterator[Filling]:
    """All undominated fillings of ``room``, least waste first, larger items first; worked out as they are asked for.

    Items that could give way to a larger one are left as soon as they are met: the
    items that are still to come are smaller, so they can't use that one up.  SEARCHED
    stands for STEPS items that were tried without a filling.
    """
    lens = [x for x in np.flatnonzero(counts[: room + 1]).tolist() if x]
    many = [min(int(counts[x]), room // x) for x in lens]
    free = sum(1 << x for x in lens)
    reach, mask = [1], (1 << room + 1) - 1  # sums of the first k lengths, as bits
    for x, n in zip(lens, many, strict=True):
        bits, step = reach[-1], 1
        while n:
            step = min(step, n)
            bits |= bits << x * step & mask
            n, step = n - step, 2 * step
        reach.append(bits)
    tried = 0

    def exact(k: int, total: int, taken: Filling, left: int, one: int, more: int, waste: int) -> Iterator[Filling]:
        nonlocal tried
        if not total:
            if not (waste and _smeared(2, waste - 1) & left):  # no room for another item
                tried = 0
                yield taken
            return
        for i in range(min(k, bisect_right(lens, total)) - 1, -1, -1):
            if not reach[i + 1] >> total & 1:
                return
            tried += 1
            if tried >= STEPS:
                tried = 0
                yield SEARCHED
            x, sums, several = lens[i], [], more
            single = one | 1 << x
            if waste and _smeared(1 << x + 1, waste - 1) & left & ~(1 << x):  # a slightly larger one is left
                continue
            for n in range(1, min(many[i], total // x) + 1):  # of n, n - 1, ... items
                several |= (several | (single if n > 1 else one)) << x
                rest = left & ~(1 << x) if n == counts[x] else left
                if _smeared(several, waste) & rest:
                    break
                sums.append((n, rest, several))
            for n, rest, several in reversed(sums):
                if reach[i] >> total - n * x & 1:
                    yield from exact(i, total - n * x, (*taken, (x, n)), rest, single, several, waste)

    for waste in range(min(most_waste, room) + 1):
        if reach[-1] >> room - waste & 1:
            yield from exact(len(lens), room - waste, (), free, 0, 0, waste)


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit on groups of equal bins: the largest length goes to the fullest bins that have room."""
    bins: dict[int, list[list]] = {}
    for x in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[x])
        while n:
            free = min((f for f in bins if f >= x), default=None)
            if free is None:
                per = capacity // x
                groups = [([x] * per, n // per)] if n >= per else []
                if n % per:
                    groups.append(([x] * (n % per), 1))
                for items, times in groups:
                    bins.setdefault(capacity - sum(items), []).append([items, times])
                break
            group = bins[free].pop()
            if not bins[free]:
                del bins[free]
            per = free // x
            if n >= per:
                times = min(group[1], n // per)
                items = group[0] + [x] * per
            else:
                times, items = 1, group[0] + [x] * n
            if group[1] > times:
                bins.setdefault(free, []).append([group[0], group[1] - times])
            bins.setdefault(capacity - sum(items), []).append([items, times])
            n -= times * (len(items) - len(group[0]))
    return [(tuple((x, items.count(x)) for x in dict.fromkeys(items)), times) for groups in bins.values() for items, times in groups]


def plan_bins(lengths: dict[int, int], capacity: int, max_nodes: int = MAX_NODES) -> list[Pattern]:
    """Patterns of bins that hold every counted length.

    The search takes choice points by the number of times that their path has
    left the first filling, then the earliest first, and keeps all of them.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for x, n in lengths.items():
        counts[x] = n
    best = best_fit_decreasing(counts.copy(), capacity)
    fewest = sum(t for _, t in best)
    bound, total = lower_bound(counts, capacity), int((counts * np.arange(capacity + 1)).sum())
    # (strayed, depth, number, lengths left, path of patterns, waste, bins, top, fillings still to be tried)
    open_: list[tuple] = []
    nodes = 0

    def spare(waste: int) -> int:  # what further bins may waste if fewer bins than the best are to come out
        return (fewest - 1) * capacity - total - waste

    def choices(now: np.ndarray, waste: int) -> tuple[int, Iterator[Filling]]:
        top = int(np.flatnonzero(now)[-1])
        rest = now.copy()
        rest[top] -= 1
        return top, fillings(rest, capacity - top, spare(waste))

    if fewest > bound and total:
        heappush(open_, (0, 0, 0, counts, None, 0, 0, *choices(counts, 0)))
    while open_ and nodes < max_nodes and fewest > bound:
        strayed, depth, _, now, path, waste, bins, top, left = heappop(open_)
        while nodes < max_nodes:
            filling = next(left, None)
            if filling is None:
                break
            nodes += 1
            heappush(open_, (strayed + 1, depth, nodes, now, path, waste, bins, top, left))
            if filling is SEARCHED:  # other choice points go first
                break
            items: dict[int, int] = {top: 1}
            for x, n in filling:
                items[x] = items.get(x, 0) + n
            lost = capacity - sum(x * n for x, n in items.items())
            if lost > spare(waste):
                break
            times = min(int(now[x]) // n for x, n in items.items())
            times = min(times, spare(waste) // lost) if lost else times
            now = now.copy()
            for x, n in items.items():
                now[x] -= n * times
            path, waste, bins, depth = (path, (tuple(items.items()), times)), waste + lost * times, bins + times, depth + 1
            if not now.any():
                if bins < fewest:
                    fewest, best = bins, []
                    while path:
                        path, pattern = path
                        best.append(pattern)
                break
            top, left = choices(now, waste)
    return best


def plan_rows(plan: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, how many to a sequence, offset) from patterns."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for items, times in plan:
        offset = 0
        for x, n in items:
            first = used.get(x, 0)
            used[x] = first + n * times
            rows.append((x, first, used[x], sequence, n, offset))
            offset += n * x
        sequence += times
    return rows


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone.  Only documents of more than
    ``capacity`` tokens are cut; their first piece may be shorter.  Repeated
    rows, and rows with a null id, are documents of their own.  Ties go to the
    smaller id.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, capacity, tokenizer_path or default_path(), end_id, id_col, text_col), "pieces")
    n_subs = pieces.count() // SUB_ROWS + 1
    pieces = pieces.withColumn("sub", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_subs)))
    per_sub = pieces.groupBy("length", "sub").agg(F.count("*").alias("n"))
    counts = per_sub.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    rows = plan_rows(plan_bins({r["length"]: r["n"] for r in counts}, capacity))
    places = spark.createDataFrame(rows, "length long, first long, end long, seq0 long, per long, offset0 long")
    before = Window.partitionBy("length").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_sub.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    order = Window.partitionBy("length", "sub").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = join_on(pieces.withColumn("nth", F.row_number().over(order) - 1), starts, ["length", "sub"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("nth"))
    # a few rows for each length: bounded by the capacity, not by the input
    placed = ranked.join(F.broadcast(places), "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    step = F.col("rank") - F.col("first")
    return placed.select(
        F.col("doc_id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("seq0") + F.floor(step / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + step % F.col("per") * F.col("length")).cast("long").alias("offset"),
    )
