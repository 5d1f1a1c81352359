"""Rules of books and ledgers over the warehouse's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.operators import alike, kin, ledgers, rules, validate
from taleweave.plans.base import query
from taleweave.plans.kin_queries import LCA_SQL, SEX_SQL, _closed, _ids, _nearest, _sex
from taleweave.sources import bridge


@query("""WITH seg AS (SELECT 'c' || o_custkey AS id, c_mktsegment AS faction, o_orderkey, o_orderpriority AS named,
  CASE WHEN o_orderkey % 50 <> 0 THEN CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) END AS ch FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT *, max(ch) OVER (PARTITION BY id ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  row_number() OVER (PARTITION BY id ORDER BY o_orderkey DESC) AS back FROM seg)
SELECT DISTINCT 'error' AS severity, 'faction history without chapter' AS kind, id AS subject FROM w WHERE ch IS NULL
UNION ALL SELECT DISTINCT 'error', 'faction history not ascending', id FROM w WHERE ch < greatest(before, -1)
UNION ALL SELECT DISTINCT 'error', 'faction history unknown', id FROM w WHERE named = '5-LOW'
UNION ALL SELECT 'warning', 'last faction differs', id FROM w WHERE back = 1 AND named <> faction""")
def rule_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priorities of a customer's orders as factions one after the other."""
    o = bridge.table(spark, sf_dir, "orders")
    ch = F.when(F.col("o_orderkey") % 50 != 0, bridge.chapter(F.col("o_orderdate")))
    segments = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("faction"), ch.alias("from_ch")))).alias("history"))
    c = bridge.table(spark, sf_dir, "customer")
    chars = segments.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("c"), "o_custkey").alias("id"), F.col("c_mktsegment").alias("faction"), "history")
    factions = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("faction")).distinct()
    return validate.report(rules.faction_history(chars, factions))


@query("""WITH e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, type, coalesce(from_ch, 0) AS f, coalesce(nullif(to_ch, 0), 2147483647) AS t FROM rels),
w AS (SELECT *, max(greatest(f, t)) OVER (PARTITION BY a, b, type ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e)
SELECT 'error' AS severity, 'relation repeated' AS kind, a || '↔' || b || ' ' || type AS subject FROM w GROUP BY a, b, type HAVING count(*) > 1 AND NOT bool_or(coalesce(f > reach, false))""")
def rule_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.contiguous_repeats(bridge.relations(spark, sf_dir, ordered=False), bridge.relation_parts(spark, sf_dir))


@query("""WITH e AS (SELECT event AS id, CASE WHEN ch <> 13 THEN event END AS summary, 'y' || phase AS phase, CASE WHEN ch <> 14 THEN ch END AS ch, chars FROM plot)
SELECT 'error' AS severity, 'event without summary' AS kind, id AS subject FROM e WHERE summary IS NULL
UNION ALL SELECT DISTINCT 'error', 'phase unknown', phase FROM e WHERE phase NOT IN (SELECT phase FROM phases)
UNION ALL SELECT 'warning', 'event without chapter', id FROM e WHERE ch IS NULL
UNION ALL SELECT DISTINCT 'error', 'event with nobody', 'c' || u FROM (SELECT unnest(chars) AS u FROM e) WHERE 'c' || u NOT IN (SELECT 'c' || c_custkey FROM customer)""")
def rule_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    plot = bridge.plot_events(spark, sf_dir)
    events = plot.select(
        F.col("event").alias("id"),
        F.col("event").alias("name"),
        F.when(F.col("ch") != 13, F.col("event")).alias("summary"),
        F.lit("x").alias("impact"),
        F.concat(F.lit("y"), "phase").alias("phase"),
        "ord",
        F.when(F.col("ch") != 14, F.col("ch")).alias("ch"),
        F.transform("chars", lambda u: F.concat(F.lit("c"), u)).alias("chars"),
    )
    known = bridge.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return validate.report(rules.events(events, bridge.phases(spark).select(F.col("phase").alias("id")), known))


@query("""SELECT 'error' AS severity, 'other name is the name' AS kind, CAST(c_custkey AS VARCHAR) AS subject FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT 'error', 'other name repeated', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 = 0
UNION ALL SELECT 'error', 'other name blank', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 = 0
UNION ALL SELECT 'warning', 'form of several', form FROM (SELECT c_name AS form FROM customer UNION ALL SELECT c_mktsegment FROM customer) GROUP BY form HAVING count(*) > 1""")
def rule_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their segment as an alias, and other names that break a rule each."""
    k = F.col("c_custkey")
    alt = F.when(k % 7 == 0, F.array("c_name")).when(k % 11 == 0, F.array(F.lit("x"), F.lit("x"))).when(k % 13 == 0, F.array(F.lit(" ")))
    chars = bridge.table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("aliases"), alt.alias("alt_names"))
    return validate.report(rules.names(chars))


WORDS_SQL = """w AS (SELECT 'p' || p_partkey AS person, string_split(p_name, ' ') AS words, p_partkey AS k, p_brand AS source FROM part),
p AS (SELECT *, CASE WHEN k % 3 = 0 THEN list_append(words, 'other') ELSE words[2:] END AS alts FROM w),
said AS (SELECT person, unnest(alts) AS alt FROM p WHERE k % 10 <> 0), data AS (SELECT DISTINCT person, alt, k FROM (SELECT person, unnest(words) AS alt, k FROM p))"""


@query(f"""WITH {WORDS_SQL}
SELECT person, 'no names' AS problem, CAST(NULL AS VARCHAR) AS name FROM p WHERE k % 10 <> 0 AND len(alts) = 0
UNION ALL SELECT person, 'name repeated', NULL FROM p WHERE k % 10 <> 0 AND len(list_distinct(alts)) < len(alts)
UNION ALL SELECT person, 'source unknown', source FROM p WHERE k % 10 <> 0 AND source = (SELECT min(p_brand) FROM part)
UNION ALL SELECT person, 'unlisted', alt FROM data d WHERE k % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM said s WHERE s.person = d.person AND s.alt = d.alt)
UNION ALL SELECT person, 'no entry', NULL FROM p WHERE k % 10 = 0
UNION ALL SELECT DISTINCT person, 'stale', alt FROM said s WHERE NOT EXISTS (SELECT 1 FROM data d WHERE s.person = d.person AND s.alt = d.alt)""")
def other_name_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a part's name as its other names; the ledger leaves out the first, adds one, or has no entry."""
    p = bridge.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.split("p_name", " ").alias("alt_names"), F.col("p_partkey").alias("k"), F.col("p_brand").alias("source"))
    alts = F.when(F.col("k") % 3 == 0, F.array_append("alt_names", F.lit("other"))).otherwise(F.slice("alt_names", F.lit(2), F.size("alt_names")))
    ledger = p.where("k % 10 <> 0").select(F.col("name").alias("person"), alts.alias("alts"), "source")
    least = p.agg(F.min("source").alias("source"))
    return ledgers.other_name_problems(ledger, p, p.select("source").distinct().join(least, "source", "left_anti"))


KEY = "CAST(substr({0}, 2) AS BIGINT)"


@query(f"""WITH e AS (SELECT 'n' || o.n_nationkey AS elder, 's' || s_suppkey AS younger, 'n' || q.n_nationkey AS q, o.n_nationkey AS ok, q.n_nationkey AS qk
 FROM supplier JOIN nation q ON s_nationkey = q.n_nationkey JOIN nation o ON o.n_regionkey = q.n_regionkey AND o.n_nationkey <> q.n_nationkey),
s AS (SELECT *, {SEX_SQL.format('q')} AS qs, {SEX_SQL.format('elder')} AS es, {SEX_SQL.format('younger')} AS ys, CASE WHEN ok < qk THEN '伯' ELSE '叔' END AS o FROM e)
SELECT elder, younger, q, CASE WHEN qs = 'm' AND es = 'm' THEN '叔侄（' || o || '父' WHEN qs = 'm' THEN '姑侄（姑母' WHEN es = 'm' THEN '舅甥（舅父' ELSE '姨甥（姨母' END
 || '与' || (CASE WHEN qs = 'm' THEN '侄' ELSE '甥' END) || (CASE WHEN ys = 'm' THEN '' ELSE '女' END) || '）' AS term FROM s""")
def kin_collateral_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and the suppliers of their sister nations, one generation apart."""
    closed = _closed(spark, sf_dir)
    near, classes = _nearest(closed)
    line = closed.select(F.least("node", "ancestor").alias("a"), F.greatest("node", "ancestor").alias("b"))
    uncles = _ids(alike.expand(near.where("da = 1 AND db = 2"), kin.members(classes), but=line), "da", "db")
    pairs = uncles.select(F.col("a").alias("elder"), F.col("b").alias("younger"), (F.col("db") - F.col("da")).alias("gap"))
    p = kin.connecting_ancestors(pairs, bridge.kin_edges(spark, sf_dir), closed)
    rank = lambda c: F.substring(c, 2, 20).cast("long")
    term = kin.collateral_term(F.col("gap"), _sex("q"), _sex("q"), _sex("elder"), _sex("younger"), kin.elder_order(rank("elder"), rank("q")))
    return p.select("elder", "younger", "q", term.alias("term"))


@query(f"""WITH e AS (SELECT child, parent, {KEY.format('child')} % 3 = 0 AS adoptive FROM kin_up)
SELECT child AS node, parent AS ancestor FROM e WHERE adoptive
UNION SELECT a.child, b.parent FROM e a JOIN e b ON a.parent = b.child WHERE a.adoptive OR b.adoptive""")
def kin_adoptive_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kin.adoptive_only(bridge.kin_edges(spark, sf_dir).withColumn("adoptive", F.substring("child", 2, 20).cast("long") % 3 == 0))


@query(f"""WITH {LCA_SQL}, cousins AS (SELECT a, b FROM lca WHERE da = 2 AND db = 2)
SELECT a, b, CASE WHEN EXISTS (SELECT 1 FROM closed x JOIN closed y ON x.ancestor = y.ancestor WHERE x.node = a AND y.node = b AND x.dist = 2 AND y.dist = 2) THEN '堂' ELSE '表' END AS mark FROM cousins""")
def kin_cousin_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = _closed(spark, sf_dir)
    near, classes = _nearest(closed)
    cousins = near.where("da = 2 AND db = 2").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    marked = kin.cousin_mark(cousins, kin.of_classes(closed, classes)).select(F.col("a").alias("ca"), F.col("b").alias("cb"), "mark")
    return _ids(alike.expand(marked, kin.members(classes)), "mark")
