"""Neighborhoods, shortest paths and induced edges by frontier loops.

Every level is one join of the frontier with the open edges and one anti-join
with what was seen.  Levels are checkpointed in the folder of ``spark.checkpoint.dir``,
so a lost executor costs a reread and the
plan stays as long as one level.
"""

from __future__ import annotations

import tempfile
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.functions.ordinals import with_ord
from taleweave.functions.scalars import edge_key
from taleweave.operators.view import ViewState, relation_open

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where none is set on one machine (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="taleweave-graph-"))
    return _OWN[0]


def cut_lineage(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the cluster's folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint()
    # columns of its own: a plan with a checkpoint twice would else meet what Spark knows of the columns before
    return out.select(*[F.col(f"`{c}`").alias(c) for c in out.columns])


def adjacency(rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both directions of every relation with two known ends: at, to, and ord if relations have it."""
    order = [c for c in ("ord",) if c in rels.columns]
    known = nodes.select("id")
    ok = rels.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    there = ok.select(F.col("src").alias("at"), F.col("dst").alias("to"), *order)
    return there.unionByName(ok.where("src <> dst").select(F.col("dst").alias("at"), F.col("src").alias("to"), *order))


def neighborhood(seeds: DataFrame, adj: DataFrame, depth: int | None) -> DataFrame:
    """(id, depth) of all nodes within ``depth`` hops of any seed, or of all that can be reached; unknown seeds are kept."""
    seen = cut_lineage(seeds.select("id", F.lit(0).alias("depth")).distinct())
    frontier = seen
    adj = adj.select("at", "to") if depth == 1 else cut_lineage(adj.select("at", "to"))  # else every level would make the edges anew
    for level in count(1) if depth is None else range(1, depth + 1):
        frontier = cut_lineage(frontier.join(adj, frontier["id"] == adj["at"]).select(F.col("to").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def edges_within(members: DataFrame, rels: DataFrame, state: ViewState) -> DataFrame:
    """Distinct pair keys of open relations with both ends among the members; the edge filter doesn't count."""
    ids = members.select("id")
    ok = rels.where(relation_open(state, filtered=False))
    ok = ok.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return ok.select(edge_key(F.col("src"), F.col("dst")).alias("pair")).distinct()


def distances(start: str, adj: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """(id, dist) of all nodes that ``start`` reaches, within ``most`` hops if that is given."""
    return neighborhood(nodes.where(F.col("id") == start), adj, most).withColumnRenamed("depth", "dist")


def shortest_path(start: str, goal: str, adj: DataFrame) -> DataFrame | None:
    """(step, src, dst, ord): the path a first-in-first-out search finds; empty if the ends are one, None if there is none.

    Nodes of a level are found in the order (rank of the parent, relation), which
    also ranks them for the next level.
    """
    spark = adj.sparkSession
    if start == goal:
        return spark.createDataFrame([], "step int, src string, dst string, ord long")
    frontier = cut_lineage(spark.createDataFrame([(start, 0, None, None)], "id string, rank long, parent string, ord long"))
    levels = [frontier]
    seen = frontier.select("id")
    while True:
        reached = frontier.join(adj, frontier["id"] == adj["at"]).select(adj["to"].alias("id"), "rank", F.col("at").alias("parent"), adj["ord"])
        reached = reached.join(seen, "id", "left_anti")
        first = reached.groupBy("id").agg(F.min(F.struct("rank", "ord", "parent")).alias("f"))
        # ranks in parts of the parents' ranks: no level is sorted in one task
        ranked = with_ord(first.select("id", F.col("f.rank").alias("above"), "f.parent", "f.ord"), F.floor(F.col("above") / 1024), ["above", "ord"], "rank")
        frontier = cut_lineage(ranked.select("id", "rank", "parent", "ord"))
        if frontier.isEmpty():
            return None
        levels.append(frontier)
        seen = seen.unionByName(frontier.select("id"))
        if not frontier.where(F.col("id") == goal).isEmpty():
            break
    rows, at = [], goal
    for step in range(len(levels) - 1, 0, -1):  # one row a level
        r = levels[step].where(F.col("id") == at).first()
        rows.append((step, r["parent"], at, r["ord"]))
        at = r["parent"]
    return spark.createDataFrame(rows[::-1], "step int, src string, dst string, ord long")


def find_relations(rels: DataFrame, asked: DataFrame, state: ViewState) -> DataFrame:
    """For each asked (a, b, type) one relation of the pair: same type and visible, else the first visible, else the first."""
    r = rels.withColumn("pair", edge_key(F.col("src"), F.col("dst"))).withColumn("open", state.alive(F.col("from_ch"), F.col("to_ch")) & state.derived_ok(F.col("derived")))
    q = asked.withColumn("pair", edge_key(F.col("a"), F.col("b"))).withColumnRenamed("type", "wanted")
    choice = F.when(F.col("open") & (F.col("type") == F.col("wanted")), 0).when(F.col("open"), 1).otherwise(2)
    best = q.join(r, "pair").groupBy("a", "b", "wanted").agg(F.min(F.struct(choice.alias("choice"), "ord")).alias("best"))
    return best.select("a", "b", F.col("wanted").alias("type"), "best.ord", "best.choice")


def faction_edges(rels: DataFrame, nodes: DataFrame, faction: str) -> DataFrame:
    """Relations that touch the faction at either end."""
    ids = nodes.where(F.col("faction") == faction).select("id")
    touched = rels.select("ord", F.explode(F.array("src", "dst")).alias("id")).join(ids, "id", "left_semi").select("ord").distinct()
    return rels.join(touched, "ord", "left_semi")
