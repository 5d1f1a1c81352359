"""Traversals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.operators import graph
from taleweave.operators.view import ViewState, relation_open
from taleweave.plans.base import query
from taleweave.plans.view_queries import LAST, book

STATE = ViewState(LAST, progress=40)
OPEN_SQL = "ch <= 40"
ADJ_SQL = f"adj AS (SELECT src AS here, dst AS nxt, ord FROM rels WHERE {OPEN_SQL} UNION ALL SELECT dst, src, ord FROM rels WHERE {OPEN_SQL})"


def hop_sql(seeds: str, depth: int) -> str:
    return f"""WITH {ADJ_SQL}, hop AS (SELECT id, 0 AS depth FROM (VALUES {seeds}) s(id)
UNION SELECT nxt, depth + 1 FROM hop JOIN adj ON here = id WHERE depth < {depth})
SELECT id, CAST(min(depth) AS INT) AS depth FROM hop GROUP BY id"""


def _adj(spark: SparkSession, sf_dir: str, ordered: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, rels = book(spark, sf_dir, ordered)
    return nodes, rels, graph.adjacency(rels.where(relation_open(STATE, filtered=False)), nodes)


def _seeds(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query(hop_sql("('s1')", 1), recursive=True)
def khop1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighborhood(_seeds(spark, "s1"), _adj(spark, sf_dir)[2], 1)


@query(hop_sql("('s1')", 2), recursive=True)
def khop2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighborhood(_seeds(spark, "s1"), _adj(spark, sf_dir)[2], 2)


@query(hop_sql("('s2'), ('s3'), ('nobody')", 3), recursive=True)
def multi_seed_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighborhood(_seeds(spark, "s2", "s3", "nobody"), _adj(spark, sf_dir)[2], 3)


@query(f"""WITH {ADJ_SQL}, hop AS (SELECT 's1' AS id, 0 AS depth UNION SELECT nxt, depth + 1 FROM hop JOIN adj ON here = id WHERE depth < 3),
m AS (SELECT DISTINCT id FROM hop)
SELECT DISTINCT least(src, dst) || '|' || greatest(src, dst) AS pair FROM rels WHERE {OPEN_SQL} AND src IN (SELECT id FROM m) AND dst IN (SELECT id FROM m)""", recursive=True)
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rels, adj = _adj(spark, sf_dir)
    return graph.edges_within(graph.neighborhood(_seeds(spark, "s1"), adj, 3), rels, STATE)


@query(f"""WITH {ADJ_SQL}, hop AS (SELECT 's1' AS id, 0 AS d UNION SELECT nxt, d + 1 FROM hop JOIN adj ON here = id WHERE d < 12)
SELECT id, CAST(min(d) AS INT) AS dist FROM hop GROUP BY id""", recursive=True)
def shortest_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, adj = _adj(spark, sf_dir)
    return graph.distances("s1", adj, nodes)


@query()
def shortest_path_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path between two suppliers, ties by discovery order; tests hold it against a queue."""
    nodes, _, adj = _adj(spark, sf_dir, ordered=True)
    found = graph.shortest_path("s1", "s5", adj)
    return found if found is not None else spark.createDataFrame([], "step int, src string, dst string, ord long")


@query("""WITH asked AS (SELECT DISTINCT src AS a, dst AS b, 'O' AS type FROM rels WHERE ord % 3 = 0),
c AS (SELECT a, b, asked.type, rels.ord, CASE WHEN rels.type = asked.type AND (from_ch <= 30 AND (to_ch IS NULL OR to_ch > 30)) THEN 0
  WHEN from_ch <= 30 AND (to_ch IS NULL OR to_ch > 30) THEN 1 ELSE 2 END AS choice FROM asked JOIN rels ON src = a AND dst = b)
SELECT a, b, type, ord, choice FROM c QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY choice, ord) = 1""")
def find_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rels = book(spark, sf_dir)
    asked = rels.where("ord % 3 = 0").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("O").alias("type")).distinct()
    return graph.find_relations(rels, asked, ViewState(LAST).at_chapter(30))


@query("SELECT rels.ord FROM rels JOIN chars ON id = src WHERE faction = 'BUILDING'")
def faction_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir)
    return graph.faction_edges(rels, nodes, "BUILDING").select("ord")
