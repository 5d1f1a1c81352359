"""Rules of whole libraries, ledgers and labels over the warehouse's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.functions import labels, scalars
from taleweave.operators import gaps, kin, ledgers, rules, validate
from taleweave.plans.base import query
from taleweave.plans.kin_queries import SEX_SQL
from taleweave.plans.text_queries import benchmark_names
from taleweave.sources import bridge

TYPES = ("叙事类", "理论类", "", "other")


@query(f"""WITH b AS (SELECT s_suppkey AS k, 's' || s_suppkey AS book, ({list(TYPES)})[s_suppkey % 4 + 1] AS type, CASE s_suppkey % 5 WHEN 0 THEN 'generation' WHEN 1 THEN 'faction' WHEN 2 THEN 'size' END AS mode, s_suppkey % 4 AS version FROM supplier),
g AS (SELECT 's' || l_suppkey AS book, count(DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN l_linenumber ELSE 1 END) AS n FROM lineitem GROUP BY l_suppkey)
SELECT book, 'error' AS severity, 'book without slug' AS kind, book AS subject FROM b WHERE k % 7 = 0
UNION ALL SELECT book, 'error', 'book without title', book FROM b WHERE k % 9 = 0
UNION ALL SELECT book, 'warning', 'type of book missing', book FROM b WHERE type = ''
UNION ALL SELECT book, 'error', 'type of book unsupported', type FROM b WHERE type = 'other'
UNION ALL SELECT book, 'error', 'group mode illegal', mode FROM b WHERE mode = 'size'
UNION ALL SELECT b.book, 'warning', 'grouped by a single generation', b.book FROM b LEFT JOIN g USING (book) WHERE mode = 'generation' AND coalesce(n, 0) < 2
UNION ALL SELECT book, 'warning', 'schema version', book FROM b WHERE version NOT BETWEEN 1 AND 2
UNION ALL SELECT book, 'warning', 'prophecy without source', book FROM b WHERE k % 6 = 0 AND k % 4 <> 0""")
def rule_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier a book with faults by its number; its characters are line items, their numbers generations in every second book."""
    k = F.col("s_suppkey")
    books = bridge.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), k).alias("book"),
        F.when(k % 7 != 0, "slug").otherwise(" ").alias("slug"),
        F.when(k % 9 != 0, "title").alias("title"),
        F.get(F.array(*map(F.lit, TYPES)), (k % 4).cast("int")).alias("type"),
        F.when(k % 5 == 0, "generation").when(k % 5 == 1, "faction").when(k % 5 == 2, "size").alias("group_mode"),
        (k % 4).cast("int").alias("schema_version"),
        F.when(k % 6 == 0, "soon").alias("prophecy"),
        F.when(k % 4 == 0, "source").alias("prophecy_source"),
    )
    items = bridge.table(spark, sf_dir, "lineitem")
    chars = items.select(F.concat(F.lit("s"), "l_suppkey").alias("book"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linenumber")).otherwise(1).alias("generation"))
    return validate.report(rules.meta(books, chars))


@query("""WITH s AS (SELECT s_suppkey AS k, 's' || s_suppkey AS id, 'n' || s_nationkey AS real_, 'n' || ((s_nationkey + 1) % 25) AS other FROM supplier),
d AS (SELECT id, CASE WHEN k % 10 = 0 THEN 'nobody' WHEN k % 3 = 0 THEN real_ ELSE other END AS parent FROM s WHERE k % 3 <> 2 OR k % 10 = 0),
e AS (SELECT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst FROM supplier)
SELECT 'error' AS severity, 'parent unknown' AS kind, parent || '→' || id AS subject FROM d WHERE parent = 'nobody'
UNION ALL SELECT 'error', 'parent without relation', parent || '→' || id FROM d WHERE parent <> 'nobody' AND (parent, id) NOT IN (SELECT src, dst FROM e)
UNION ALL SELECT 'warning', 'parent not declared', src || '→' || dst FROM e WHERE (src, dst) NOT IN (SELECT parent, id FROM d)""")
def rule_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers declare their nation as a parent, or the next one, or nobody known, or none."""
    s = bridge.table(spark, sf_dir, "supplier")
    k, nation = F.col("s_suppkey"), lambda c: F.concat(F.lit("n"), c.cast("long").cast("string"))
    declared = F.when(k % 10 == 0, F.array(F.lit("nobody"))).when(k % 3 == 0, F.array(nation(F.col("s_nationkey")))).when(k % 3 == 1, F.array(nation((F.col("s_nationkey") + 1) % 25)))
    nations = bridge.table(spark, sf_dir, "nation").select(nation(F.col("n_nationkey")).alias("id"), F.lit(None).cast("array<string>").alias("parents"))
    chars = s.select(F.concat(F.lit("s"), k).alias("id"), declared.alias("parents")).unionByName(nations)
    rels = s.select(nation(F.col("s_nationkey")).alias("src"), F.concat(F.lit("s"), k).alias("dst"), F.lit("父子").alias("type"))
    return validate.report(rules.parents(chars, rels))


@query("""WITH o AS (SELECT 'c' || o_custkey AS id, o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN 'c' || (o_orderkey % 300) END AS lord,
  CASE WHEN o_orderkey % 40 <> 0 THEN CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) END AS ch FROM orders),
w AS (SELECT *, max(ch) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o)
SELECT 'error' AS severity, 'lord history empty' AS kind, 'c' || c_custkey AS subject FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT DISTINCT 'error', 'lord history without chapter', id FROM w WHERE ch IS NULL
UNION ALL SELECT DISTINCT 'error', 'lord history not ascending', id FROM w WHERE ch < greatest(before, -1)
UNION ALL SELECT DISTINCT 'error', 'lord unknown', id FROM w WHERE lord IS NOT NULL AND lord NOT IN (SELECT 'c' || c_custkey FROM customer)
UNION ALL SELECT DISTINCT 'error', 'lord of oneself', id FROM w WHERE lord = id""")
def rule_lords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of a customer as lords one after the other."""
    o = bridge.table(spark, sf_dir, "orders")
    lord = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("c"), F.col("o_orderkey") % 300))
    ch = F.when(F.col("o_orderkey") % 40 != 0, bridge.chapter(F.col("o_orderdate")))
    history = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", lord.alias("lord"), ch.alias("from_ch")))).alias("history"))
    c = bridge.table(spark, sf_dir, "customer").join(history, F.col("c_custkey") == F.col("o_custkey"), "left")
    none = F.array().cast("array<struct<o_orderkey: bigint, lord: string, from_ch: int>>")
    return validate.report(rules.lord_history(c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.coalesce("history", none).alias("history"))))


@query("""WITH n AS (SELECT n_name AS id, n_nationkey AS k FROM nation WHERE n_nationkey % 6 <> 5), p AS (SELECT id, k FROM n UNION ALL SELECT id, k FROM n WHERE k % 8 = 1)
SELECT 'error' AS severity, 'place without id or name' AS kind, id AS subject FROM p WHERE k % 9 = 4
UNION ALL SELECT 'warning', 'place without chapter', id FROM p WHERE k % 7 = 3
UNION ALL SELECT 'warning', 'place id repeated', id FROM n WHERE k % 8 = 1
UNION ALL SELECT DISTINCT 'error', 'place unknown', place FROM rel_places WHERE place NOT IN (SELECT id FROM n)""")
def rule_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as places, some without a name or chapter, some listed twice, some not at all."""
    k = F.col("n_nationkey")
    n = bridge.table(spark, sf_dir, "nation").where(k % 6 != 5).select(F.col("n_name").alias("id"), F.when(k % 9 != 4, F.col("n_name")).alias("name"), F.when(k % 7 != 3, 1).alias("first_ch"), k.alias("k"))
    cited = bridge.relation_places(spark, sf_dir, bridge.relations(spark, sf_dir)).select("place")
    return validate.report(rules.places(n.unionByName(n.where("k % 8 = 1")).drop("k"), cited))


@query("""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS name FROM benchmark),
d AS (SELECT doc_id, text, regexp_extract(text, '[A-Z][a-z]{3,}') AS listed FROM documents)
SELECT 'warning' AS severity, 'named but not listed' AS kind, doc_id || ' ' || name AS subject FROM d JOIN n ON regexp_matches(text, '(^|[^·])' || name || '($|[^·（]|（($|[^第]))') WHERE name <> listed OR listed IS NULL""")
def rule_unlisted_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as summaries that list their first capitalised word."""
    names = benchmark_names(spark, sf_dir).select(F.concat(F.lit("n_"), "name").alias("id"), "name", F.lit(None).cast("array<string>").alias("aliases"))
    listed = F.array(F.concat(F.lit("n_"), F.regexp_extract("text", "[A-Z][a-z]{3,}", 0)))
    texts = bridge.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("summary"), listed.alias("chars"))
    return rules.unlisted_mentions(texts, names)


@query("""SELECT 'warning' AS severity, 'begins with a pronoun' AS kind, 'c' || c_custkey AS subject FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT 'warning', 'kin without a name', 'c' || c_custkey || ' 0' FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT 'warning', 'kin without a name', 'c' || c_custkey || ' 0' FROM customer WHERE c_custkey % 4 = 1 AND c_custkey % 3 <> 0
UNION ALL SELECT 'warning', 'kin without a name', 'c' || c_custkey || ' 1' FROM customer WHERE c_custkey % 4 = 2""")
def rule_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences made of customers' names, every third of which is known."""
    k, name = F.col("c_custkey"), F.col("c_name")
    text = F.when(k % 4 == 0, "他的哥哥来了。天晴").when(k % 4 == 1, F.concat(name, F.lit("的父亲！走了"))).when(k % 4 == 2, F.concat(name, F.lit("走了；母亲来了"))).otherwise(F.concat(name, F.lit("来了")))
    c = bridge.table(spark, sf_dir, "customer")
    names = c.where(k % 3 == 0).select(name.alias("form"))
    return validate.report(rules.wording(c.select(F.concat(F.lit("c"), k).alias("id"), text.alias("text")), names))


@query("""WITH l AS (SELECT CASE c_custkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'a，' || c_custkey WHEN 2 THEN '_' || c_custkey WHEN 3 THEN 'x' || (c_custkey // 16) WHEN 4 THEN c_name ELSE 'w' || c_custkey END AS name, c_custkey % 8 AS k, c_custkey % 3 AS why FROM customer
 UNION ALL SELECT n_name, 9, 1 FROM nation),
g AS (SELECT name, count(*) AS n, bool_or(k <> 2 AND why = 0) AS bare, any_value(k) AS k FROM l WHERE k <> 2 GROUP BY name)
SELECT name, 'blank' AS problem FROM g WHERE name = '' UNION ALL SELECT name, 'prose' FROM g WHERE name LIKE '%，%' OR length(name) > 12
UNION ALL SELECT name, 'repeated' FROM g WHERE k = 3 AND n > 1 UNION ALL SELECT name, 'no reason' FROM g WHERE bare
UNION ALL SELECT name, 'a place' FROM g WHERE k = 9 AND length(name) <= 12""")
def ledger_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to ignore made of customers and nations; those of customers are too long to be names."""
    k = F.col("c_custkey")
    name = F.when(k % 8 == 0, "").when(k % 8 == 1, F.concat(F.lit("a，"), k)).when(k % 8 == 2, F.concat(F.lit("_"), k)).when(k % 8 == 3, F.concat(F.lit("x"), F.floor(k / 16))).when(k % 8 == 4, F.col("c_name")).otherwise(F.concat(F.lit("w"), k))
    c, n = bridge.table(spark, sf_dir, "customer"), bridge.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    entries = c.select(name.alias("name"), F.when(k % 3 != 0, "why").alias("why"), (k % 8 != 2).alias("with_reason")).unionByName(n.select("name", F.lit("why").alias("why"), F.lit(True).alias("with_reason")))
    return ledgers.ignored_problems(entries, c.select(F.col("c_name").alias("name")), n)


@query("""WITH l AS (SELECT 'r' || (c_custkey % 6) AS book, 'c' || c_custkey AS src, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN 'c' || c_custkey WHEN c_custkey % 5 = 0 THEN 'nobody' ELSE 'c' || (c_custkey % 6 + 6) END AS dst, c_custkey % 4 AS why FROM customer),
c AS (SELECT 'r' || (c_custkey % 6) AS book, 'c' || c_custkey AS id FROM customer WHERE c_custkey % 6 <> 5)
SELECT book, src, dst, 'field missing' AS problem FROM l WHERE dst = '' UNION ALL SELECT book, src, dst, 'no reason' FROM l WHERE why = 0
UNION ALL SELECT book, src, dst, 'book unknown' FROM l WHERE book = 'r5' UNION ALL SELECT book, src, dst, 'one person' FROM l WHERE src = dst
UNION ALL SELECT book, src, dst, 'nobody second' FROM l WHERE book <> 'r5' AND dst <> '' AND (book, dst) NOT IN (SELECT book, id FROM c)""")
def ledger_exemptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exemptions between customers of a book, some with nobody, with oneself, or without a second."""
    k = F.col("c_custkey")
    c = bridge.table(spark, sf_dir, "customer")
    book, own = F.concat(F.lit("r"), k % 6), F.concat(F.lit("c"), k)
    second = F.when(k % 11 == 0, "").when(k % 7 == 0, own).when(k % 5 == 0, "nobody").otherwise(F.concat(F.lit("c"), k % 6 + 6))
    entries = c.select(book.alias("book"), own.alias("src"), second.alias("dst"), F.when(k % 4 == 0, "short").otherwise("as the source has it").alias("why"))
    return ledgers.exemption_problems(entries, c.where("c_custkey % 6 <> 5").select(book.alias("book"), own.alias("id")))


@query("""WITH p AS (SELECT DISTINCT p_name AS name FROM part), a AS (SELECT DISTINCT p_brand AS alias FROM part),
d AS (SELECT name, 1 AS n FROM p WHERE length(name) % 3 = 0 UNION ALL SELECT alias, 2 FROM a UNION ALL SELECT 'zz', 1)
SELECT name, 'undeclared' AS problem FROM p WHERE length(name) % 3 <> 0 AND NOT regexp_full_match(name, '[a-m].*') UNION ALL SELECT name, 'repeated' FROM d WHERE n > 1
UNION ALL SELECT name, 'within reach' FROM p WHERE length(name) % 3 = 0 AND regexp_full_match(name, '[a-m].*') UNION ALL SELECT name, 'alias' FROM d WHERE n > 1 UNION ALL SELECT 'zz', 'unknown'""")
def ledger_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts that a pattern for a to m can't yield; brands are aliases, declared twice."""
    p = bridge.table(spark, sf_dir, "part")
    chars = p.groupBy(F.col("p_name").alias("name")).agg(F.collect_set("p_brand").alias("aliases"))
    brands = p.select(F.col("p_brand").alias("name")).distinct()
    declared = chars.where("char_length(name) % 3 = 0").select("name").unionByName(brands).unionByName(brands).unionByName(spark.createDataFrame([("zz",)], "name string"))
    return ledgers.coverage_problems(declared, chars, "[a-m].*")


@query("""SELECT event_id AS text_id, CAST(k AS INT) AS nth, 'e-' || (event_id * m) AS event FROM events, (VALUES (0, 1), (1, 2), (2, 2)) v(k, m) WHERE event_id * m IN (SELECT event_id FROM events WHERE event_id % 3 <> 0)""")
def text_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that cite their own number once and twice it twice; every third event isn't known."""
    e = bridge.table(spark, sf_dir, "events")
    ref = lambda m: F.concat(F.lit("e-"), F.col("event_id") * m)
    texts = e.select(F.col("event_id").alias("text_id"), F.concat(F.lit("see "), ref(1), F.lit(", "), ref(2), F.lit(" or "), ref(2), F.lit(".")).alias("text"))
    return labels.references(texts, e.where("event_id % 3 <> 0").select(F.concat(F.lit("e-"), "event_id").alias("id")))


PALETTE = list(labels.FACTION_COLORS)


@query(f"""WITH f AS (SELECT c_mktsegment AS key, min(c_custkey) AS first FROM customer GROUP BY 1 UNION ALL SELECT p_brand, min(p_partkey) + 10000000 FROM part GROUP BY 1),
o AS (SELECT key, row_number() OVER (ORDER BY first, key) - 1 AS nth FROM f), l AS (SELECT DISTINCT c_mktsegment AS key FROM customer WHERE c_mktsegment < 'F')
SELECT key, upper(key) AS name, CASE WHEN key = 'BUILDING' THEN ({PALETTE})[2] ELSE '#000000' END AS color FROM l
UNION ALL SELECT key, key, ({PALETTE})[nth % 12 + 1] FROM o WHERE key NOT IN (SELECT key FROM l)""")
def faction_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and brands as factions in order of appearance; two segments are listed, one without a colour."""
    c, p = bridge.table(spark, sf_dir, "customer"), bridge.table(spark, sf_dir, "part")
    chars = c.select(F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("faction")).unionByName(p.select((F.col("p_partkey") + 10_000_000).alias("ord"), F.col("p_brand").alias("faction")))
    listed = c.where("c_mktsegment < 'F'").select(F.col("c_mktsegment").alias("key")).distinct()
    return labels.colored_factions(chars, listed.select("key", F.upper("key").alias("name"), F.when(F.col("key") != "BUILDING", "#000000").otherwise("").alias("color"), F.lit(1).alias("nth")))


@query("""SELECT 'title' AS field, 'lost' AS problem UNION ALL SELECT 'more', 'extra'""")
def pack_field_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of customers against two packs, one of which forgets the title and one of which adds a field."""
    c = bridge.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("title"), F.lit("").alias("note"))
    return labels.field_problems(c, [c.select("id", F.lit("").alias("title")), c.select("name", F.col("id").alias("more"))])


@query("SELECT CAST(p_size AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY p_size UNION ALL SELECT NULL, count(*) FROM part")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts, and as many rows without one."""
    p = bridge.table(spark, sf_dir, "part").select("p_size")
    return labels.distribution(p.unionByName(p.select(F.lit(None).cast("int").alias("p_size"))), "p_size")


@query("""WITH x AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg FROM customer)
SELECT k, k AS ch, CASE k % 3 WHEN 0 THEN '前史' WHEN 1 THEN '开端' ELSE '第 7 代' END AS generation, CASE WHEN k % 2 = 0 THEN 'g' || (k % 3) ELSE 'f' || coalesce(CASE WHEN k % 5 <> 0 THEN seg END, 'other') END AS grp,
 CASE WHEN k % 4 = 0 THEN '#8b94a7' ELSE '#' || k END AS color, replace(replace(replace(replace(name || '<"&">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html, 'a ' || name || ' b' AS plain,
 'A|' || seg || '|' || k AS segments, k % 1000 AS num, seg AS base, least(greatest(coalesce(nullif(k % 70, 0), 10), 10), 50) AS shown, CASE WHEN least(greatest(coalesce(nullif(k % 70, 0), 10), 10), 50) >= 50 THEN 'collapse' ELSE 'more' END AS action,
 k % 2 = 0 AS inferred, seg AS basis, CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS generations FROM x""")
def label_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every kind for every customer."""
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    folded = labels.fold((k % 70).cast("int"), F.lit(10), F.lit(50))
    told = labels.basis(F.concat(F.when(k % 2 == 0, "整理者推断（").otherwise("原文依据（"), seg, F.lit("）")))
    han = lambda n: F.when(n > 0, F.concat(F.get(F.array(*map(F.lit, "零一二三四五六七八九")), n)))
    hundreds, tens, ones = ((F.floor(k / d) % 10).cast("int") for d in (100, 10, 1))
    spelt = F.concat_ws("", F.concat(han(hundreds), F.lit("百")), F.concat(han(tens), F.lit("十")), han(ones))
    side = F.get(F.array(*map(F.lit, ("曾祖父与曾孙", "姑祖母与叔祖父", "叔侄", "盟友"))), (k % 4).cast("int"))
    return bridge.table(spark, sf_dir, "customer").select(
        k.alias("k"),
        scalars.ch_of(F.concat(F.lit("第 "), k, F.lit(" 章 12"))).cast("long").alias("ch"),
        F.when(k % 3 == 0, scalars.generation_label(F.lit(-1))).when(k % 3 == 1, scalars.generation_label(F.lit(0), F.array(F.lit("开端")))).otherwise(scalars.generation_label(F.lit(7), F.array(F.lit("开端")))).alias("generation"),
        scalars.group_key(F.when(k % 2 == 0, "generation").otherwise("faction"), k % 3, F.when(k % 5 != 0, seg)).alias("grp"),
        labels.faction_color(F.when(k % 4 != 0, F.concat(F.lit("#"), k)).otherwise(""), k).alias("color"),
        scalars.escape_html(F.concat(name, F.lit('<"&">'))).alias("html"),
        scalars.unbold(F.concat(F.lit("a **"), name, F.lit("** b"))).alias("plain"),
        F.array_join(scalars.name_segments(F.concat(F.lit("A· "), seg, F.lit("··"), k)), "|").alias("segments"),
        F.when(k % 1000 == 0, 0).otherwise(labels.chapter_numeral(spelt)).cast("long").alias("num"),
        scalars.base_name(F.concat(seg, F.lit("（x）(y)"))).alias("base"),
        folded["shown"].cast("long").alias("shown"),
        folded["action"].alias("action"),
        told["inferred"].alias("inferred"),
        told["text"].alias("basis"),
        labels.kin_generations(side).alias("generations"),
    )


@query(f"""WITH e AS (SELECT *, {SEX_SQL.format('child')} AS sex FROM kin_up),
r AS (SELECT a.child AS a, b.child AS b, a.sex AS sa, b.sex AS sb, CAST(substr(a.child, 2) AS BIGINT) AS ka, CAST(substr(b.child, 2) AS BIGINT) AS kb FROM e a JOIN e b ON a.parent = b.parent AND a.child < b.child),
t AS (SELECT *, CASE WHEN (ka + kb) % 2 = 0 THEN '兄妹（推导）' ELSE '同父异母的姐弟' END AS type FROM r)
SELECT a AS src, b AS dst, type, CASE WHEN ka % 7 = 0 OR kb % 7 = 0 THEN 'order unknown' ELSE 'against the order' END AS finding FROM t WHERE (ka + kb) % 5 <> 0 AND (ka % 7 = 0 OR kb % 7 = 0 OR (ka < kb) <> (type = '兄妹（推导）'))""")
def kin_sibling_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings worded as elder brother or elder sister by their numbers; of every seventh the order of birth isn't known."""
    e = bridge.kin_edges(spark, sf_dir)
    rank = lambda c: F.substring(c, 2, 20).cast("long")
    p = kin.sibling_pairs(e).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    edges = p.select("src", "dst", F.when((rank("src") + rank("dst")) % 2 == 0, "兄妹（推导）").otherwise("同父异母的姐弟").alias("type"), ((rank("src") + rank("dst")) % 5 != 0).alias("derived"))
    ranks = e.select(F.col("child").alias("id")).distinct().select("id", F.when(rank("id") % 7 != 0, rank("id")).alias("rank"))
    return kin.sibling_direction(edges, ranks)


@query("""SELECT parent, child, CAST(row_number() OVER (PARTITION BY parent ORDER BY CAST(substr(child, 2) AS BIGINT) DESC, child) AS INT) AS nth FROM kin_up""")
def kin_birth_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.kin_edges(spark, sf_dir)
    return kin.birth_order(e.withColumn("rank", -F.substring("child", 2, 20).cast("long"))).select("parent", "child", "nth")


@query("""WITH p AS (SELECT p_partkey, (['父子', '盟友', '养母女', '夫妻'])[p_partkey % 4 + 1] AS type, (['', 'none', 'sworn'])[p_partkey % 3 + 1] AS kin FROM part)
SELECT p_partkey, CASE WHEN kin = 'sworn' THEN 'sworn' ELSE CASE type WHEN '父子' THEN 'blood' WHEN '养母女' THEN 'adoptive' WHEN '夫妻' THEN 'marriage' END END AS kin, (p_partkey % 5 IN (0, 1)) OR (p_partkey % 5 = 2 AND p_partkey % 2 = 1) AS worth FROM p""")
def kin_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kin given or read off the wording, and whether a pair is worth deriving."""
    k = F.col("p_partkey")
    p = bridge.table(spark, sf_dir, "part")
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (k % n).cast("int"))
    kind = F.when(k % 5 == 0, "direct").when(k % 5 == 1, "sibling").when(k % 5 == 2, "collateral").otherwise("unrelated")
    return p.select("p_partkey", kin.filled_kin(pick(("父子", "盟友", "养母女", "夫妻"), 4), pick(("", "none", "sworn"), 3)).alias("kin"), kin.worth_deriving(kind, (k % 2).cast("int")).alias("worth"))


@query("""WITH x AS (SELECT 'c' || c_custkey AS id, c_custkey AS ord, CASE WHEN c_custkey % 10 = 0 THEN 'Cust 1' ELSE 'Cust ' || c_custkey END AS name, c_mktsegment AS faction, 'cust·' || (c_custkey % 50) AS alias FROM customer),
o AS (SELECT replace(lower(name), ' ', '') AS key, arg_min(id, ord) AS id, arg_min(faction, ord) AS f FROM x GROUP BY 1)
SELECT o.id, x.id AS alias_of, alias, faction = f AS same_faction FROM x JOIN o ON o.key = replace(alias, '·', '') WHERE o.id <> x.id AND o.key <> replace(lower(name), ' ', '') AND alias <> 'cust·7'""")
def alias_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose alias is the number of another one, spelt otherwise; every tenth has the first one's name."""
    k = F.col("c_custkey")
    c = bridge.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k).alias("id"), k.alias("ord"), F.when(k % 10 == 0, "Cust 1").otherwise(F.concat(F.lit("Cust "), k)).alias("name"), F.col("c_mktsegment").alias("faction"), F.array(F.concat(F.lit("cust·"), k % 50), F.lit("x")).alias("aliases"))
    return gaps.alias_candidates(c, "^cust7$")


@query("""WITH f AS (SELECT DISTINCT left(p_name, 6) AS name FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT n_name FROM nation UNION SELECT DISTINCT left(p_name, 3) FROM part UNION SELECT left(r_name, 2) || '来' FROM region),
k AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT left(p_name, 2) FROM part WHERE p_size = 7)
SELECT name, CASE WHEN name IN (SELECT n_name FROM nation) THEN 'place' WHEN length(name) = 3 AND left(name, 2) IN (SELECT name FROM k) THEN 'known and a sign'
 WHEN EXISTS (SELECT 1 FROM k WHERE length(k.name) > length(f.name) AND starts_with(k.name, f.name)) THEN 'start of known' WHEN name LIKE '%来' THEN 'ends in a particle' ELSE 'open' END AS kind FROM f""")
def fragment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of names, nations and regions as candidates, the names of parts and some of their beginnings as known names."""
    p, n, r = (bridge.table(spark, sf_dir, t) for t in ("part", "nation", "region"))
    names = p.select(F.col("p_name").alias("name"))
    head = lambda m: p.select(F.left("p_name", F.lit(m)).alias("name"))
    asked = head(6).union(names).union(n.select("n_name")).union(head(3)).union(r.select(F.concat(F.left("r_name", F.lit(2)), F.lit("来"))))
    known = names.union(p.where("p_size = 7").select(F.left("p_name", F.lit(2))))
    return gaps.fragment_kinds(asked, known, n.select(F.col("n_name").alias("name")))


@query("""WITH x AS (SELECT id, name, CASE WHEN ord % 4 = 0 THEN 'alias-1' END AS alias FROM chars), d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM rels UNION ALL SELECT dst FROM rels) GROUP BY id)
SELECT 'no alias' AS kind, x.id, CAST(n AS VARCHAR) AS subject FROM x JOIN d USING (id) WHERE alias IS NULL AND n >= 20
UNION ALL SELECT 'variant missing', id, 'Kustomer' || substr(name, 9) FROM x WHERE name LIKE 'Customer%'
UNION ALL SELECT 'variant missing', id, 'Supplyer' || substr(name, 9) FROM x WHERE name LIKE 'Supplier%'""")
def search_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the warehouse, every fourth with an alias, and other spellings of their names."""
    chars = bridge.characters(spark, sf_dir).select("id", "name", F.when(F.col("ord") % 4 == 0, F.array(F.lit("alias-1"))).alias("aliases"), F.lit(None).cast("array<string>").alias("alt_names"))
    pairs = spark.createDataFrame([("Cust", "Kust"), ("pplie", "pplye"), ("zz", "z"), ("alias", "lia")], "a string, b string")
    return gaps.search_audit(chars, bridge.relations(spark, sf_dir), pairs, 20)


KINDS = ("early", "named", "told")


@query(f"""WITH c AS (SELECT 'b' || (c_custkey % 4) AS book, c_name AS name, c_custkey AS k, 10 + c_custkey % 9 AS ch FROM customer),
l AS (SELECT CASE WHEN k % 31 = 0 THEN 'zz' ELSE book END AS book, CASE WHEN k % 13 = 0 THEN 'nobody' || k ELSE name END AS name, CASE WHEN k % 17 = 0 THEN 0 WHEN k % 11 = 0 THEN 1 ELSE ch END AS first_ch, CASE WHEN k % 7 = 0 THEN 9 ELSE 2 END AS text_first,
 ({list(KINDS + ('odd',))})[k % 4 + 1] AS kind, k % 5 AS why, k, book AS real_book, ch FROM c WHERE k % 3 <> 0)
SELECT book, name, 'first chapter illegal' AS problem FROM l WHERE first_ch = 0 UNION ALL SELECT book, name, 'no reason' FROM l WHERE why = 0 UNION ALL SELECT book, name, 'kind unknown' FROM l WHERE kind = 'odd'
UNION ALL SELECT book, name, 'book unknown' FROM l WHERE book = 'zz' UNION ALL SELECT book, name, 'nobody' FROM l WHERE book <> 'zz' AND k % 13 = 0
UNION ALL SELECT book, name, 'chapter differs' FROM l WHERE book <> 'zz' AND k % 13 <> 0 AND first_ch > 0 AND first_ch <> ch
UNION ALL SELECT book, name, 'not late' FROM l WHERE book <> 'zz' AND k % 13 <> 0 AND first_ch > 0 AND first_ch - text_first <= 5
UNION ALL SELECT book, name, 'unlisted' FROM c WHERE k % 6 = 0""")
def ledger_first_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as people of four books; the ledger has two thirds of them, with faults by their number, and an audit finds every sixth late."""
    k = F.col("c_custkey")
    c = bridge.table(spark, sf_dir, "customer").select(F.concat(F.lit("b"), k % 4).alias("book"), F.col("c_name").alias("name"), (10 + k % 9).cast("int").alias("first_ch"), k.alias("k"))
    k = F.col("k")
    ledger = c.where("k % 3 <> 0").select(
        F.when(k % 31 == 0, "zz").otherwise(F.col("book")).alias("book"),
        F.when(k % 13 == 0, F.concat(F.lit("nobody"), k)).otherwise(F.col("name")).alias("name"),
        F.when(k % 17 == 0, 0).when(k % 11 == 0, 1).otherwise(F.col("first_ch")).alias("first_ch"),
        F.when(k % 7 == 0, 9).otherwise(2).alias("text_first"),
        F.get(F.array(*map(F.lit, (*KINDS, "odd"))), (k % 4).cast("int")).alias("kind"),
        F.when(k % 5 == 0, "so　 it is").otherwise("as it is told there").alias("why"),
    )
    return ledgers.first_chapter_problems(ledger, c.select("book", "name", "first_ch"), KINDS, c.where("k % 6 = 0").select("book", "name"))


@query("""WITH c AS (SELECT 'b' || (c_custkey % 4) AS book, c_custkey AS k, 'c' || c_custkey AS id, c_custkey // 8 AS base, CASE WHEN c_custkey % 7 = 0 THEN 'P' || (c_custkey // 8) ELSE 'P' || (c_custkey // 8) || '（' || c_custkey || '）' END AS name FROM customer),
g AS (SELECT book, 'P' || base AS base, list_sort(list(id)) AS ids, bool_or(k % 7 = 0) AS bare, min(k) AS k FROM c GROUP BY book, base HAVING count(*) > 1),
l AS (SELECT book, base, CASE WHEN k % 3 = 0 THEN ids[1:1] WHEN k % 5 = 0 THEN list_append(ids, 'x') ELSE ids END AS members, k % 11 AS why, ids FROM g WHERE k % 2 = 0)
SELECT book, base, 'unlisted' AS problem FROM g WHERE k % 2 = 1 UNION ALL SELECT book, base, 'no bracket' FROM g WHERE bare UNION ALL SELECT 'b9', 'P0', 'stale'
UNION ALL SELECT book, base, 'members differ' FROM l WHERE len(members) <> len(ids) UNION ALL SELECT book, base, 'outsider' FROM l WHERE len(members) > len(ids) UNION ALL SELECT book, base, 'no reason' FROM l WHERE why = 0""")
def ledger_same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers named in pairs but for brackets; the ledger has every second pair, some short of a member or with one too many."""
    k = F.col("c_custkey")
    base = F.concat(F.lit("P"), F.floor(k / 8))
    c = bridge.table(spark, sf_dir, "customer").select(F.concat(F.lit("b"), k % 4).alias("book"), k.alias("k"), F.concat(F.lit("c"), k).alias("id"), base.alias("base"), F.when(k % 7 == 0, base).otherwise(F.concat(base, F.lit("（"), k, F.lit("）"))).alias("name"))
    g = c.groupBy("book", "base").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("k").alias("k")).where("size(ids) > 1 AND k % 2 = 0")
    members = F.when(F.col("k") % 3 == 0, F.slice("ids", 1, 1)).when(F.col("k") % 5 == 0, F.array_append("ids", F.lit("x"))).otherwise(F.col("ids"))
    ledger = g.select("book", "base", members.alias("members"), F.when(F.col("k") % 11 == 0, "short").otherwise("two people in the source").alias("why"))
    stale = spark.createDataFrame([("b9", "P0", ["c1", "c2"], "two people in the source")], ledger.schema)
    return ledgers.same_name_problems(ledger.unionByName(stale), c.select("book", "id", "name"))


@query("""WITH ev AS (SELECT 'b' || (event_id % 3) AS book, 'e' || event_id AS event, CAST(event_id % 20 + 1 AS INT) AS ch, event_id AS k FROM events),
it AS (SELECT book, CASE WHEN k % 4 = 0 THEN ch + 1 ELSE ch END AS ch, event, k FROM ev WHERE k % 5 <> 0),
l AS (SELECT CASE WHEN k % 35 = 3 THEN '' WHEN k % 35 = 4 THEN 'zz' ELSE book END AS book, CASE WHEN k % 35 = 5 THEN 99 WHEN k % 4 = 0 AND k % 5 <> 0 THEN ch + 1 ELSE ch END AS ch, CASE WHEN k % 35 = 6 THEN 'gone' || k ELSE event END AS event, k % 9 AS why, k FROM ev WHERE k % 7 < 3 OR k % 35 BETWEEN 3 AND 6),
p AS (SELECT l.book, l.ch, l.event, CASE WHEN l.book = '' THEN 'field missing' WHEN why = 0 THEN 'no reason' WHEN l.book = 'zz' THEN 'book unknown' WHEN (l.book, l.ch) NOT IN (SELECT book, ch FROM it) THEN 'no annotation'
 WHEN (l.book, l.event) NOT IN (SELECT book, event FROM ev) THEN 'event unknown' WHEN (l.book, l.ch, l.event) NOT IN (SELECT book, ch, event FROM it) THEN 'undeclared'
 WHEN EXISTS (SELECT 1 FROM ev WHERE ev.book = l.book AND ev.event = l.event AND ev.ch = l.ch) THEN 'same chapter' END AS problem FROM l)
SELECT * FROM p WHERE problem IS NOT NULL UNION ALL SELECT book, ch, event, 'unlisted' FROM it WHERE k % 4 = 0 AND (book, ch, event) NOT IN (SELECT book, ch, event FROM l WHERE book <> '')""")
def ledger_cross_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of three books, every fourth declared a chapter late; a ledger with faults by their number."""
    k = F.col("k")
    ev = bridge.table(spark, sf_dir, "events").select(F.concat(F.lit("b"), F.col("event_id") % 3).alias("book"), F.concat(F.lit("e"), "event_id").alias("event"), (F.col("event_id") % 20 + 1).cast("int").alias("ch"), F.col("event_id").alias("k"))
    late = F.when((k % 4 == 0) & (k % 5 != 0), F.col("ch") + 1).otherwise(F.col("ch"))
    items = ev.where("k % 5 <> 0").groupBy("book", late.alias("ch")).agg(F.collect_list("event").alias("events"))
    ledger = ev.where("k % 7 < 3 OR k % 35 BETWEEN 3 AND 6").select(
        F.when(k % 35 == 3, "").when(k % 35 == 4, "zz").otherwise(F.col("book")).alias("book"),
        F.when(k % 35 == 5, 99).otherwise(late).alias("ch"),
        F.when(k % 35 == 6, F.concat(F.lit("gone"), k)).otherwise(F.col("event")).alias("event"),
        F.when(k % 9 == 0, "short").otherwise("so it is meant there").alias("why"),
    )
    return ledgers.cross_chapter_problems(ledger, items, ev.select("book", "event", "ch"))


@query("""WITH c AS (SELECT 'b' || (c_custkey % 4) AS book, c_name AS name, 'al' || (c_custkey // 4) AS alias, c_custkey AS k FROM customer),
l AS (SELECT CASE WHEN k % 13 = 0 THEN 'zz' ELSE book END AS book, CASE k % 5 WHEN 0 THEN alias WHEN 1 THEN 'none' || k WHEN 2 THEN ' ' ELSE name END AS name, k % 7 AS why, k FROM c),
g AS (SELECT book, name, count(*) AS n, bool_or(why = 0) AS bare FROM l GROUP BY ALL)
SELECT book, name, 'book unknown' AS problem, CAST(NULL AS VARCHAR) AS owner FROM g WHERE book = 'zz' UNION ALL SELECT book, name, 'blank name', NULL FROM g WHERE book <> 'zz' AND name = ' '
UNION ALL SELECT book, name, 'no reason', NULL FROM g WHERE book <> 'zz' AND name <> ' ' AND bare UNION ALL SELECT book, name, 'repeated', NULL FROM g WHERE book <> 'zz' AND name <> ' ' AND n > 1
UNION ALL SELECT g.book, g.name, 'alias', c.name FROM g JOIN c ON c.book = g.book AND c.alias = g.name UNION ALL SELECT book, name, 'unknown', NULL FROM g WHERE book <> 'zz' AND name LIKE 'none%'""")
def ledger_name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by main names, by aliases, by names of nobody and by blanks."""
    k = F.col("k")
    c = bridge.table(spark, sf_dir, "customer").select(F.concat(F.lit("b"), F.col("c_custkey") % 4).alias("book"), F.col("c_name").alias("name"), F.concat(F.lit("al"), F.floor(F.col("c_custkey") / 4)).alias("alias"), F.col("c_custkey").alias("k"))
    name = F.when(k % 5 == 0, F.col("alias")).when(k % 5 == 1, F.concat(F.lit("none"), k)).when(k % 5 == 2, " ").otherwise(F.col("name"))
    ledger = c.select(F.when(k % 13 == 0, "zz").otherwise(F.col("book")).alias("book"), name.alias("name"), F.when(k % 7 == 0, " ").otherwise("so").alias("why"))
    return ledgers.name_form_problems(ledger, c.select("book", "name", F.array("alias").alias("aliases")))


@query("""WITH n AS (SELECT 'n' || n_nationkey AS book, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey * 2 END AS n FROM nation), s AS (SELECT 'n' || s_nationkey AS book, count(*) AS found FROM supplier GROUP BY 1)
SELECT book, CAST(n AS BIGINT) AS said, coalesce(found, 0) AS found FROM n LEFT JOIN s USING (book) WHERE n <> coalesce(found, 0)""")
def ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations state a number of suppliers, every third none."""
    n = bridge.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("book"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey") * 2).alias("n"))
    return ledgers.declared_counts(n, bridge.table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("book")))


@query("""SELECT 'warning' AS severity, 'faction missing' AS kind, id AS subject FROM chars WHERE ord % 9 = 0 UNION ALL SELECT 'warning', 'title missing', id FROM chars WHERE ord % 4 = 0 UNION ALL SELECT 'warning', 'desc missing', id FROM chars WHERE ord % 5 = 0
UNION ALL SELECT 'warning', 'fate missing', id FROM chars UNION ALL SELECT 'error', 'faction unknown', id FROM chars WHERE ord % 9 <> 0 AND faction = 'BUILDING'""")
def rule_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the warehouse without a title, a description or a faction by their number; a faction of customers isn't listed."""
    c = bridge.characters(spark, sf_dir)
    chars = c.select("id", F.when(F.col("ord") % 9 != 0, F.col("faction")).alias("faction"), F.when(F.col("ord") % 4 != 0, "t").alias("title"), F.when(F.col("ord") % 5 != 0, "d").otherwise("").alias("desc"), F.lit(None).cast("string").alias("fate"))
    return validate.report(validate.profiles(chars, c.where("faction <> 'BUILDING'").select("faction").distinct()))


@query("""WITH e AS (SELECT src, dst, type, style, min(ord) AS id, min(from_ch) AS f, max(to_ch) - 20 AS t FROM rels GROUP BY ALL),
x AS (SELECT id, f, t, ord, ch FROM rels JOIN e USING (src, dst, type, style) WHERE ord % 7 <> 0)
SELECT 'warning' AS severity, 'relation without evidence' AS kind, CAST(id AS VARCHAR) AS subject FROM e WHERE id NOT IN (SELECT id FROM x) UNION ALL SELECT 'error', 'evidence without text', CAST(id AS VARCHAR) FROM x WHERE ord % 11 = 0
UNION ALL SELECT 'warning', 'evidence chapter without number', CAST(id AS VARCHAR) FROM x WHERE ord % 11 <> 0 AND ord % 3 = 1 UNION ALL SELECT 'warning', 'evidence outside period', id || ' ' || ch FROM x WHERE ord % 3 = 0 AND (ch < f OR ch >= t)""")
def rule_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a pair, type and style as evidence of one relation, some untold, some without a chapter, the period cut short."""
    r = bridge.relations(spark, sf_dir)
    chapter = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("第"), "ch", F.lit("回"))).when(F.col("ord") % 3 == 1, F.lit("later"))
    told = F.struct(F.when(F.col("ord") % 11 != 0, "so").alias("text"), chapter.alias("chapter"))
    one = r.groupBy("src", "dst", "type", "style").agg(F.min("ord").alias("ord"), F.min("from_ch").alias("from_ch"), (F.max("to_ch") - 20).alias("to_ch"), F.collect_list(F.when(F.col("ord") % 7 != 0, told)).alias("events"))
    return validate.report(validate.evidence(one))


@query("""WITH e AS (SELECT CAST(substr(child, 2) AS BIGINT) AS k, parent, child FROM kin_up WHERE child LIKE 's%'), r AS (SELECT k AS ord, parent AS src, child AS dst, CASE k % 3 WHEN 0 THEN '父子' WHEN 1 THEN '盟友' ELSE '养父子' END AS type, CASE k % 4 WHEN 0 THEN 'blood' WHEN 1 THEN 'friend' WHEN 2 THEN '' ELSE 'sworn' END AS kin FROM e
 UNION ALL SELECT 100000 + k, child, parent, '母女', 'blood' FROM e WHERE k % 6 = 0)
SELECT 'error' AS severity, 'kin: illegal' AS kind, CAST(ord AS VARCHAR) AS subject FROM r WHERE kin = 'friend' UNION ALL SELECT 'warning', 'kin: missing', CAST(ord AS VARCHAR) FROM r WHERE kin = '' AND type <> '盟友'
UNION ALL SELECT 'error', 'kin: blood term', CAST(ord AS VARCHAR) FROM r WHERE kin = 'sworn' AND type = '父子' UNION ALL SELECT 'warning', 'kin: blood unseen', CAST(ord AS VARCHAR) FROM r WHERE kin = 'blood' AND type = '盟友'
UNION ALL SELECT 'warning', 'kin: mismatch', CAST(ord AS VARCHAR) FROM r WHERE (kin = 'sworn' AND type <> '盟友') OR (kin = 'blood' AND type = '养父子')
UNION ALL SELECT DISTINCT 'warning', 'parent cycle', unnest([src, dst]) FROM r WHERE type = '母女'""")
def rule_kinship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and suppliers with wordings and kin by their number; every sixth supplier is also its nation's mother."""
    e = bridge.kin_edges(spark, sf_dir).where("child LIKE 's%'").withColumn("k", F.substring("child", 2, 20).cast("long"))
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("k") % len(xs)).cast("int"))
    down = e.select(F.col("k").alias("ord"), F.col("parent").alias("src"), F.col("child").alias("dst"), pick(("父子", "盟友", "养父子")).alias("type"), pick(("blood", "friend", "", "sworn")).alias("kin"))
    up = e.where("k % 6 = 0").select((F.col("k") + 100_000).alias("ord"), F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit("母女").alias("type"), F.lit("blood").alias("kin"))
    return validate.report(validate.kinship(down.union(up)))


@query("""SELECT c_custkey AS k, 'a&lt;b&gt; &#39;' || c_name || '&#39; &amp; <strong>' || c_mktsegment || '</strong> **' AS html, '&apos;' || c_name || '&quot;' AS xml, 'x ' || c_name || ' y' AS plain, c_mktsegment || 'ab|' || CASE WHEN c_custkey % 2 = 0 THEN 'dashed' ELSE 'solid' END AS run FROM customer""")
def text_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes, bold marks and run keys of every customer."""
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    return bridge.table(spark, sf_dir, "customer").select(
        k.alias("k"),
        scalars.bold_html(F.concat(F.lit("a<b> '"), name, F.lit("' & **"), seg, F.lit("** **"))).alias("html"),
        scalars.escape_xml(F.concat(F.lit("'"), name, F.lit('"'))).alias("xml"),
        scalars.unbold(F.concat(F.lit("x **"), name, F.lit("** y**"))).alias("plain"),
        scalars.run_key(F.concat(seg, F.lit(" a·b（x）")), F.when(k % 2 == 0, "dashed").otherwise("")).alias("run"),
    )


@query("""SELECT s_suppkey AS k, CASE WHEN s_suppkey % 6 = 0 OR n_nationkey % 4 = 0 THEN 'nation ' || CASE WHEN s_suppkey % 6 = 0 THEN -1 ELSE s_nationkey END ELSE n_name END AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def named_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of suppliers by name; every fourth has none, and every sixth supplier names one that isn't there."""
    n, s = bridge.table(spark, sf_dir, "nation"), bridge.table(spark, sf_dir, "supplier")
    names = n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).otherwise("").alias("name"))
    asked = s.select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 6 == 0, -1).otherwise(F.col("s_nationkey")).alias("key"))
    return labels.named(asked, "key", names, F.concat(F.lit("nation "), "key")).select("k", "label")
