"""Consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

Every shard owns ``vnodes`` pseudo-random points of a 32-bit ring; a key belongs
to the first point at or after its own position.  A shard takes keys of its own
arcs, in ring order, up to its capacity; keys that overflow continue clockwise
to the next point whose shard has room.  Capacities add up to the number of
rows and differ by at most one, so shard sizes do too, and only overflowing
keys leave the shard of their arc.

What is settled on the driver is bounded by ``n_shards * vnodes`` (one count an
arc in, at most a few intervals an arc out).  Rows get their places from their
rank within the arc, which comes from counts of fixed sub-buckets, so that no
task ever sorts more than one sub-bucket of one arc.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RING_BITS = 32
CELL_BITS = 20  # a cell of the lookup table spans 2**20 positions: 4096 cells
SUB_BUCKETS = 64


def ring_points(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node in ring order."""
    points = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=4).digest(), "big")
            points.setdefault(at, shard)
    return sorted(points.items())


def capacities(n_rows: int, n_shards: int) -> list[int]:
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def place_arcs(points: list[tuple[int, int]], counts: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Intervals (arc, first rank, end rank, shard, first slot) that place all rows of all arcs."""
    room, filled, plan, over = list(room), [0] * len(room), [], []

    def put(arc: int, start: int, n: int, shard: int) -> None:
        plan.append((arc, start, start + n, shard, filled[shard]))
        filled[shard] += n
        room[shard] -= n

    for arc, (_, shard) in enumerate(points):
        n = counts.get(arc, 0)
        own = min(n, room[shard])
        if own:
            put(arc, 0, own, shard)
        if n > own:
            over.append((arc, own, n))
    for arc, start, n in over:
        step = arc
        while start < n:
            step += 1
            shard = points[step % len(points)][1]
            if room[shard]:
                take = min(room[shard], n - start)
                put(arc, start, take, shard)
                start += take
    return plan


def shard_documents(docs: DataFrame, n_shards: int = 8, vnodes: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus one; a null text has size 1 and the
    checksum of no bytes.  Null ids share one ring position.  Repeated rows are
    rows of their own.  An empty table gives no rows.  Other columns of the
    input are ignored, whatever their names.  Law ``rows`` holds: counts of
    shards differ by at most one; slots run from 0 without gaps.
    """
    spark = docs.sparkSession
    points = ring_points(n_shards, vnodes)
    cells = []
    low = 0
    for arc, (at, _) in enumerate([*points, (2**RING_BITS - 1, 0)]):
        arc %= len(points)  # past the last point the ring begins anew
        for cell in range(low >> CELL_BITS, (at >> CELL_BITS) + 1):
            cells.append((cell, arc, low, at))
        low = at + 1
    lookup = spark.createDataFrame(cells, "cell long, arc int, low long, high long")

    def on_ring(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("pos", F.pmod(F.xxhash64("key"), F.lit(2**RING_BITS)))
        rows = rows.withColumn("cell", F.shiftright("pos", CELL_BITS)).withColumn("sub", F.pmod(F.xxhash64(F.lit("sub"), "key"), F.lit(SUB_BUCKETS)))
        inside = (F.col("pos") >= F.col("low")) & (F.col("pos") <= F.col("high"))
        # at most 4096 + n_shards * vnodes rows, whatever the input
        return rows.join(F.broadcast(lookup), "cell").where(inside).drop("cell", "low", "high")

    per_sub = on_ring(docs.select(F.col(id_col).alias("key"))).groupBy("arc", "sub").agg(F.count("*").alias("n"))
    per_sub = per_sub.collect()  # at most n_shards * vnodes * SUB_BUCKETS rows
    counts: dict[int, int] = {}
    starts = []
    for arc, sub, n in sorted(map(tuple, per_sub)):
        starts.append((arc, sub, counts.get(arc, 0)))
        counts[arc] = counts.get(arc, 0) + n
    plan = place_arcs(points, counts, capacities(sum(counts.values()), n_shards))
    start_of = spark.createDataFrame(starts, "arc int, sub long, start long")
    plan_of = spark.createDataFrame(plan, "arc int, first long, end long, shard int, slot0 long")

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = on_ring(docs.select(F.col(id_col).alias("key"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    in_sub = Window.partitionBy("arc", "sub").orderBy("pos", "key", "text_crc32", "size")
    ranked = rows.withColumn("nth", F.row_number().over(in_sub) - 1).join(F.broadcast(start_of), ["arc", "sub"])
    ranked = ranked.withColumn("rank", F.col("start") + F.col("nth")).drop("start", "nth")
    placed = ranked.join(F.broadcast(plan_of), "arc").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return placed.select(
        F.col("key").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
