"""Layout, packs and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.operators import layout, view
from taleweave.plans.base import query
from taleweave.plans.view_queries import DEGREE_SQL, book
from taleweave.sources import bridge, packs


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("group"), (F.get("embedding", F.lit(0)).cast("double") * 1000).alias("x"), (F.get("embedding", F.lit(1)).cast("double") * 1000).alias("y"))


POINTS_SQL = """pts AS (SELECT vec_id AS id, label AS grp, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y FROM embeddings)"""


@query("""WITH n AS (SELECT ord, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY ord) - 1 AS n FROM rels)
SELECT ord, round(CASE WHEN n = 0 THEN 0.08 WHEN n % 2 = 1 THEN 0.08 + 0.12 * (n // 2) ELSE -(0.08 + 0.12 * (n // 2)) END, 6)::DOUBLE AS curve FROM n""")
def parallel_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.parallel_curves(bridge.relations(spark, sf_dir))


@query(f"""WITH {POINTS_SQL}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts),
s AS (SELECT *, greatest(0.02, least(1.4, 800 / greatest(x1 - x0, 1.0), 600 / greatest(y1 - y0, 1.0))) AS s FROM b)
SELECT id, round((x - (x0 + x1) / 2) * s, 6) AS x, round((y - (y0 + y1) / 2) * s, 6) AS y FROM pts, s""")
def bbox_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.fit(_points(spark, sf_dir).drop("group"), 800.0, 600.0)


@query(f"""WITH {POINTS_SQL}, a AS (SELECT x AS x0, y AS y0 FROM pts WHERE id = 7)
SELECT id, round(((x - x0) * 1.0 + (y - y0) * 0.0) + 2.5 * abs((x - x0) * 0.0 - (y - y0) * 1.0), 6) AS score FROM pts, a WHERE id <> 7 AND x - x0 > 1 ORDER BY 2, 1 LIMIT 1""")
def directional_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.move_cursor(_points(spark, sf_dir), 7, 1.0, 0.0)


@query(f"""WITH {POINTS_SQL} SELECT p.id AS a, q.id AS b FROM pts p JOIN pts q ON p.id < q.id AND pow(p.x - q.x, 2) + pow(p.y - q.y, 2) < 36""")
def grid_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.close_pairs(_points(spark, sf_dir), 6.0)


@query(f"""WITH {DEGREE_SQL}, n AS (SELECT c.id, faction, row_number() OVER (PARTITION BY faction ORDER BY degree DESC, name) - 1 AS nth FROM chars c JOIN deg USING (id)),
g AS (SELECT faction, coalesce(sum(least(count(*), 8)) OVER (ORDER BY faction ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM chars GROUP BY faction)
SELECT id, CAST((off + nth % 8) * 240.0 AS DOUBLE) AS x, CAST((nth // 8) * 90.0 AS DOUBLE) AS y FROM n JOIN g USING (faction)""")
def group_grid_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir)
    return layout.grid_positions(view.degrees(rels, nodes), "faction", [F.desc("degree"), "name"]).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@query("""WITH a AS (SELECT dst AS node, ord AS edge, ord % 628 / 100.0::DOUBLE - 3.14 AS angle FROM rels),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY angle, edge) - 1 AS k FROM a),
f AS (SELECT *, max(angle - k * 0.05) OVER (PARTITION BY node ORDER BY angle, edge ROWS UNBOUNDED PRECEDING) + k * 0.05 AS want, greatest(max(angle) OVER (PARTITION BY node), pi()) AS lim FROM k)
SELECT node, edge, round(min(least(want, lim) - k * 0.05) OVER (PARTITION BY node ORDER BY angle, edge ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + k * 0.05, 6) AS angle FROM f""")
def edge_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bridge.relations(spark, sf_dir).select(F.col("dst").alias("node"), F.col("ord").alias("edge"), (F.col("ord") % 628 / F.lit(100.0) - 3.14).alias("angle"))
    return layout.edge_fan(r, 0.05)


@query(f"""WITH {POINTS_SQL} SELECT id, round(sqrt(pow(x - 10, 2) + pow(y - 10, 2)), 6) AS d FROM pts WHERE sqrt(pow(x - 10, 2) + pow(y - 10, 2)) <= 60 ORDER BY 2, 1 LIMIT 1""")
def hit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.hit_test(_points(spark, sf_dir), 10.0, 10.0, 60.0)


@query()
def force_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One layout a nation: its suppliers and their customers; reruns are equal to the last bit."""
    r = bridge.relation_places(spark, sf_dir, bridge.relations(spark, sf_dir, ordered=False)).withColumnRenamed("place", "book")
    ends = r.select("book", F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes = ends.select(F.col("book").alias("of"), "id", F.concat(F.length("id"), F.col("id")).alias("ord"))
    return layout.force_positions(nodes.withColumnRenamed("of", "book"), r.select(F.col("book").alias("in"), F.col("src").alias("a"), F.col("dst").alias("b")).withColumnRenamed("in", "book"))


@query()
def label_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).select(F.concat(F.lit("g"), "group").alias("book"), F.col("id").cast("string").alias("id"), F.col("id").alias("ord"), "x", "y", (F.col("id") % 17).alias("degree"))
    return layout.keep_labels(p)


@query("SELECT c_custkey AS id, c_name AS name, nullif(c_mktsegment, 'BUILDING') AS title FROM customer")
def pack_split_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bridge.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("").alias("title"))
    return packs.merge(*packs.split(c))


@query("""WITH a AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment ELSE '' END AS title FROM customer),
b AS (SELECT id, name, CASE WHEN id % 10 = 0 THEN upper(name) ELSE nullif(title, '') END AS title FROM a WHERE id % 25 <> 0)
SELECT id, 'first' AS side FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.id = a.id AND b.title IS NOT DISTINCT FROM a.title)
UNION ALL SELECT id, 'second' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.id = a.id AND b.title IS NOT DISTINCT FROM a.title)""")
def pack_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What splitting, editing and merging changes: titles that were empty come back as none, every tenth was rewritten, every twenty-fifth row lost."""
    k = F.col("c_custkey")
    c = bridge.table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 6 != 0, F.col("c_mktsegment")).otherwise("").alias("title"))
    structure, prose = packs.split(c)
    edited = packs.merge(structure.where("id % 25 <> 0"), prose).withColumn("title", F.when(F.col("id") % 10 == 0, F.upper("name")).otherwise(F.col("title")))
    return packs.differences(c, edited).select("id", "side")


@query(f"""WITH {POINTS_SQL}, p AS (SELECT id, CASE WHEN id % 50 = 1 THEN 0 ELSE x END AS x, CASE WHEN id % 50 = 1 THEN 0 ELSE y END AS y, 2 + id % 9 AS size FROM pts),
m AS (SELECT a.id, a.id < b.id AS lower, least(a.id, b.id) AS o, b.x - a.x AS dx, b.y - a.y AS dy, (a.size + b.size) / 2.0 + 2 AS least_, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS d FROM p a JOIN p b ON a.id <> b.id AND abs(a.x - b.x) < 14 AND abs(a.y - b.y) < 14),
s AS (SELECT id, sum(CASE WHEN d = 0 THEN CASE WHEN lower THEN -1 ELSE 1 END * cos(radians((o * 137) % 360)) * least_ * 0.5 ELSE -dx * (least_ - d) / d / 2 END) AS mx,
 sum(CASE WHEN d = 0 THEN CASE WHEN lower THEN -1 ELSE 1 END * sin(radians((o * 137) % 360)) * least_ * 0.5 ELSE -dy * (least_ - d) / d / 2 END) AS my FROM m WHERE d < least_ GROUP BY id)
SELECT p.id, round(x + coalesce(mx, 0), 5) AS x, round(y + coalesce(my, 0), 5) AS y FROM p LEFT JOIN s USING (id)""")
def positions_relaxed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as symbols of different sizes, every fiftieth at one place."""
    p = _points(spark, sf_dir)
    spot = lambda c: F.when(F.col("id") % 50 == 1, 0.0).otherwise(F.col(c)).alias(c)
    points = p.select("id", F.col("id").alias("ord"), spot("x"), spot("y"), (2 + F.col("id") % 9).cast("double").alias("size"))
    return layout.relax_step(points, 2.0, 14.0).select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))
