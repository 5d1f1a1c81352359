"""The warehouse tables as one book: characters, relations, places, phases, events.

Each function returns a lazy DataFrame; ``SQL`` states the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taleweave.functions.dealing import dealt, parts_of

#: What line items are numbered by.
ITEM_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chapter(date: Column) -> Column:
    return ((F.year(date) - 1995) * 12 + F.month(date)).cast("int")


def numbered_items(items: DataFrame, orders: DataFrame, parts: int | None = None) -> DataFrame:
    """Line items with their orders and ``ord``, from 1, by order and what else is in ``keys``.

    Items are counted by order, the counts summed up within ranges of orders and
    over the ranges, and items numbered within their order, in the partitions of the
    join (``parts`` of them, if given): the wide rows are dealt out once.
    """
    n = items.groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("items")).join(orders.groupBy(F.col("o_orderkey").alias("key")).agg(F.count("*").alias("orders")), "key")
    n = n.select("key", (F.col("items") * F.col("orders")).alias("n"), F.floor(F.col("key") / 65536).alias("range"))
    ranges = n.groupBy("range").agg(F.sum("n").alias("n")).select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = n.withColumn("within", within).join(F.broadcast(ranges), "range").select(F.col("key").alias("o_orderkey"), (F.col("first") + F.col("within")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ITEM_KEYS[1:]))
    joined = dealt(items, parts, "l_orderkey").join(dealt(orders.join(before, "o_orderkey"), parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.withColumn("nth", nth).withColumn("ord", (F.col("before") + F.col("nth")).cast("long"))


def relation_parts(spark: SparkSession, sf_dir: str) -> int | None:
    """``parts_of`` the relations: as many as line items, which are counted in the files' metadata."""
    return parts_of(table(spark, sf_dir, "lineitem").count())


def relations(spark: SparkSession, sf_dir: str, ordered: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """ord, src, dst, type, style, kin, ch, from_ch, to_ch, derived: line items as edges from customer to supplier; no ``ord`` unless ``ordered``.

    ``keep``: columns of line items to keep; all of ITEM_KEYS sort as ``ord`` does, which then needs no numbering.
    """
    items, orders, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), relation_parts(spark, sf_dir)
    if ordered:
        return _edges(numbered_items(items, orders, parts), "ord", *keep)
    return _edges(dealt(items, parts, "l_orderkey").join(dealt(orders, parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")), *keep)


def _edges(rows: DataFrame, *first: str) -> DataFrame:
    ch = chapter(F.col("o_orderdate"))
    return rows.select(
        *first,
        F.concat(F.lit("c"), F.col("o_custkey")).alias("src"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"),
        F.col("l_linestatus").alias("type"),
        F.when(F.col("l_returnflag") == "R", "dashed").when(F.col("l_returnflag") == "A", "dotted").otherwise("solid").alias("style"),
        F.element_at(F.array(*[F.lit(k) for k in ("blood", "marriage", "adoptive", "sworn", None)]), F.substring("o_orderpriority", 1, 1).cast("int")).alias("kin"),
        ch.alias("ch"),
        ch.alias("from_ch"),
        F.when(F.col("o_orderstatus") == "F", ch + 12).alias("to_ch"),
        (F.col("l_linenumber") == 7).alias("derived"),
    )


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, id, name, faction, generation, gender, tier, first_ch: customers, then suppliers."""
    tier = lambda c: F.when(F.col(c) >= 6000, "main").when(F.col(c) >= 1000, "minor").otherwise("mentioned")
    gender = lambda k: F.when(F.col(k) % 2 == 0, "f").otherwise("m")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("ord"), F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("faction"), F.lit(1).alias("generation"), gender("c_custkey").alias("gender"), tier("c_acctbal").alias("tier"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000).cast("long").alias("ord"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("faction"), F.lit(0).alias("generation"), gender("s_suppkey").alias("gender"), tier("s_acctbal").alias("tier"))
    r = relations(spark, sf_dir, ordered=False).where("NOT derived")
    first = r.select(F.col("src").alias("id"), "ch").unionByName(r.select(F.col("dst").alias("id"), "ch")).groupBy("id").agg(F.min("ch").alias("first_ch"))
    return c.unionByName(s).join(first, "id", "left")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place, first_ch: the nations of suppliers with edges."""
    r = relations(spark, sf_dir, ordered=False)
    return relation_places(spark, sf_dir, r).groupBy("place").agg(F.min("ch").alias("first_ch"))


def relation_places(spark: SparkSession, sf_dir: str, rels: DataFrame) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("dst"), "s_nationkey")
    n = table(spark, sf_dir, "nation")
    return rels.join(s, "dst").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(*[rels[c] for c in rels.columns if c != "dst"], "dst", F.col("n_name").alias("place"))


def phases(spark: SparkSession) -> DataFrame:
    """phase, ord, from_ch, to_ch (last chapter): seven years of twelve chapters."""
    return spark.range(1, 8).select(F.concat(F.lit("y"), F.col("id")).alias("phase"), F.col("id").cast("int").alias("ord"), ((F.col("id") - 1) * 12 + 1).cast("int").alias("from_ch"), (F.col("id") * 12).cast("int").alias("to_ch"))


def plot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, ch, phase, ord, chars: one for each hour and type, with the users in it."""
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return e.groupBy("hour", "event_type").agg(F.sort_array(F.collect_set("user_id")).alias("chars"), F.min("event_id").alias("ord")).select(
        F.concat_ws("@", "event_type", F.date_format("hour", "yyyy-MM-dd HH")).alias("event"),
        F.dayofmonth("hour").alias("ch"),
        F.floor((F.dayofmonth("hour") - 1) / 7).cast("int").alias("phase"),
        "ord",
        "chars",
    )


def kin_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, child: region over nation over supplier."""
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier")
    up = n.select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("child"))
    return up.unionByName(s.select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("parent"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("child")))


#: The same views in DuckDB's SQL.
SQL = """
rels AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord,
         'c' || o_custkey AS src, 's' || l_suppkey AS dst, l_linestatus AS type,
         CASE l_returnflag WHEN 'R' THEN 'dashed' WHEN 'A' THEN 'dotted' ELSE 'solid' END AS style,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'blood' WHEN '2' THEN 'marriage' WHEN '3' THEN 'adoptive' WHEN '4' THEN 'sworn' END AS kin,
         CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS ch,
         CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS from_ch,
         CASE WHEN o_orderstatus = 'F' THEN CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) + 12 AS INT) END AS to_ch,
         l_linenumber = 7 AS derived
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
first_chs AS (
  SELECT id, min(ch) AS first_ch FROM (SELECT src AS id, ch FROM rels WHERE NOT derived UNION ALL SELECT dst, ch FROM rels WHERE NOT derived) GROUP BY id),
chars AS (
  SELECT b.*, first_ch FROM (
    SELECT c_custkey AS ord, 'c' || c_custkey AS id, c_name AS name, c_mktsegment AS faction, 1 AS generation,
           CASE WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'm' END AS gender,
           CASE WHEN c_acctbal >= 6000 THEN 'main' WHEN c_acctbal >= 1000 THEN 'minor' ELSE 'mentioned' END AS tier FROM customer
    UNION ALL
    SELECT s_suppkey + 1000000000, 's' || s_suppkey, s_name, 'supplier', 0, CASE WHEN s_suppkey % 2 = 0 THEN 'f' ELSE 'm' END,
           CASE WHEN s_acctbal >= 6000 THEN 'main' WHEN s_acctbal >= 1000 THEN 'minor' ELSE 'mentioned' END FROM supplier) b
  LEFT JOIN first_chs USING (id)),
rel_places AS (
  SELECT rels.*, n_name AS place FROM rels JOIN supplier ON dst = 's' || s_suppkey JOIN nation ON s_nationkey = n_nationkey),
phases AS (SELECT 'y' || i AS phase, CAST(i AS INT) AS ord, CAST((i - 1) * 12 + 1 AS INT) AS from_ch, CAST(i * 12 AS INT) AS to_ch FROM range(1, 8) t(i)),
plot AS (
  SELECT event_type || '@' || strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS event, CAST(day(date_trunc('hour', ts)) AS INT) AS ch,
         CAST(floor((day(date_trunc('hour', ts)) - 1) / 7) AS INT) AS phase, min(event_id) AS ord, list_sort(list(DISTINCT user_id)) AS chars
  FROM events GROUP BY date_trunc('hour', ts), event_type),
kin_up AS (
  SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)
"""
