"""Locks, places as filters, looking people up, digests, curves and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.operators import graph, panels, view
from taleweave.operators.panels import Lock
from taleweave.operators.view import ViewState
from taleweave.plans.base import query
from taleweave.plans.layout_queries import POINTS_SQL, _points
from taleweave.plans.view_queries import DEGREE_SQL, book
from taleweave.sources import bridge

LOCKS = [Lock.on("c1", ("c1", "nobody"), True, saved=7), Lock.on("s1 and s2", ("s1", "s2"), True, "relation"), Lock.on("three", ("c3", "c4", "c5"), False, "faction"), Lock.on("none", ("nobody",), True)]
LOCK_SQL = """adj AS (SELECT src AS at_, dst AS to_ FROM rels JOIN chars a ON a.id = src JOIN chars b ON b.id = dst UNION SELECT dst, src FROM rels JOIN chars a ON a.id = src JOIN chars b ON b.id = dst),
h0 AS (SELECT * FROM (VALUES (0, 'c1', 3), (1, 's1', 1), (1, 's2', 1), (2, 'c3', 0), (2, 'c4', 0), (2, 'c5', 0)) v(lock, id, depth) WHERE id IN (SELECT id FROM chars)),
h1 AS (SELECT DISTINCT lock, to_ AS id, depth FROM h0 JOIN adj ON at_ = id WHERE depth >= 1), h2 AS (SELECT DISTINCT lock, to_ AS id, depth FROM h1 JOIN adj ON at_ = id WHERE depth >= 2), h3 AS (SELECT DISTINCT lock, to_ AS id, depth FROM h2 JOIN adj ON at_ = id WHERE depth >= 3),
mem AS (SELECT CAST(lock AS INT) AS lock, id, CAST(min(hops) AS INT) AS hops FROM (SELECT lock, id, 0 AS hops FROM h0 UNION ALL SELECT lock, id, 1 FROM h1 UNION ALL SELECT lock, id, 2 FROM h2 UNION ALL SELECT lock, id, 3 FROM h3) GROUP BY ALL)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir, ordered=False)
    return panels.expanded(panels.seeds_of(spark, LOCKS), nodes, graph.adjacency(rels, nodes))


@query(f"WITH {LOCK_SQL} SELECT * FROM mem")
def lock_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four locks at once: of a search with too great a depth saved, of a relation, of a closed group, and of nobody."""
    return _members(spark, sf_dir)


@query(f"WITH {LOCK_SQL} SELECT DISTINCT m.lock, least(src, dst) || '|' || greatest(src, dst) AS pair FROM rels JOIN mem m ON m.id = src JOIN mem o ON o.id = dst AND o.lock = m.lock WHERE ch <= 10")
def lock_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.locked_edges(_members(spark, sf_dir), bridge.relations(spark, sf_dir, ordered=False), ViewState(80, progress=10, styles=frozenset({"dashed"})))


@query("""WITH sc AS (SELECT DISTINCT place, dst AS id FROM rel_places WHERE ch <= 3), a AS (SELECT n_name AS place FROM nation)
SELECT place, CASE WHEN count(id) > 0 THEN 'filter' ELSE 'empty' END AS status, count(id) AS n FROM a LEFT JOIN sc USING (place) GROUP BY place""")
def place_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = bridge.relation_places(spark, sf_dir, bridge.relations(spark, sf_dir)).where("ch <= 3").select("place", F.col("dst").alias("id"))
    return panels.place_filter(scope, bridge.table(spark, sf_dir, "nation").select(F.col("n_name").alias("place")))


@query("""WITH sc AS (SELECT DISTINCT place, dst AS id FROM rel_places WHERE ch <= 3), c AS (SELECT n_name AS place, 's' || s_suppkey AS id FROM nation, supplier WHERE s_nationkey = n_nationkey OR s_suppkey % 25 = n_nationkey)
SELECT place, id, (place, id) IN (SELECT place, id FROM sc) AS keeps FROM c""")
def place_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers chosen under the filter of their nation, and under another's."""
    scope = bridge.relation_places(spark, sf_dir, bridge.relations(spark, sf_dir)).where("ch <= 3").select("place", F.col("dst").alias("id"))
    n, s = bridge.table(spark, sf_dir, "nation"), bridge.table(spark, sf_dir, "supplier")
    under = lambda key: s.join(n, key == F.col("n_nationkey")).select(F.col("n_name").alias("place"), F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return panels.keeps_place(scope, under(F.col("s_nationkey")).union(under(F.col("s_suppkey") % 25)).distinct())


ASKED = (" 00012 ", "alias-7", "Supplier", "nobody", "", "Customer#00000000")


@query(f"""WITH a AS (SELECT unnest({list(ASKED)}) AS asked), c AS (SELECT id, ord, name, 'alias-' || (ord % 10) AS alias, CASE WHEN coalesce(first_ch, 0) > 3 THEN 3 WHEN tier <> 'main' THEN 2 ELSE 1 END AS bucket FROM chars),
m AS (SELECT asked, bucket, id FROM a JOIN c ON trim(asked) <> '' AND (contains(name, trim(asked)) OR contains(alias, trim(asked))) QUALIFY row_number() OVER (PARTITION BY asked ORDER BY bucket, ord) = 1)
SELECT asked, CASE bucket WHEN 1 THEN 'found' WHEN 2 THEN 'hidden' WHEN 3 THEN 'locked' ELSE 'nobody' END AS status, CASE WHEN bucket < 3 THEN id END AS id FROM a LEFT JOIN m USING (asked)""")
def people_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = ViewState(80, progress=3, show_minor=False, show_mentioned=False)
    chars = bridge.characters(spark, sf_dir).withColumn("aliases", F.array(F.concat(F.lit("alias-"), F.col("ord") % 10)))
    asked = spark.createDataFrame([(a,) for a in ASKED], "asked string")
    return panels.find_people(chars, asked, ~state.not_yet(F.col("first_ch")), state.hidden(F.col("tier")), state.locked(F.col("first_ch")))


@query(f"""WITH {DEGREE_SQL} SELECT c.id, c.name, degree FROM chars c JOIN deg USING (id) WHERE contains(name, '7') OR contains('alias-' || (c.ord % 10), '7') ORDER BY degree DESC, c.ord LIMIT 80""")
def people_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir)
    return panels.candidates(view.degrees(rels, nodes).withColumn("aliases", F.array(F.concat(F.lit("alias-"), F.col("ord") % 10))), " 7 ")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by pair and type; the chapter of every third line item is told in words, or without a number."""
    r = bridge.relations(spark, sf_dir)
    chapter = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("第 "), "ch", F.lit(" 回"))).when(F.col("ord") % 3 == 1, F.lit("early on"))
    return r.groupBy("src", "dst", "type").agg(F.min("ord").alias("ord"), F.collect_list(F.struct(chapter.alias("chapter"))).alias("events"))


@query("""WITH e AS (SELECT src, dst, type, min(ord) AS ord, min(CASE WHEN ord % 3 = 0 THEN ch END) AS told FROM rels GROUP BY ALL)
SELECT e.ord, CAST(coalesce(told, least(coalesce(a.first_ch, 0), coalesce(b.first_ch, 0))) AS INT) AS ch FROM e LEFT JOIN chars a ON a.id = src LEFT JOIN chars b ON b.id = dst""")
def evidence_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.relation_chapters(_evidence(spark, sf_dir), bridge.characters(spark, sf_dir)).select("ord", "ch")


@query("SELECT greatest(1, max(ch)) AS last FROM (SELECT first_ch AS ch FROM chars UNION ALL SELECT ch FROM plot)")
def last_of_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.last_chapter(bridge.characters(spark, sf_dir), bridge.plot_events(spark, sf_dir))


@query("""WITH h AS (SELECT * FROM plot WHERE ch BETWEEN 3 AND 40), t AS (SELECT type, CASE WHEN ord % 3 = 0 THEN ch END AS ch FROM rels)
SELECT 'events' AS section, CAST(ch AS VARCHAR) AS key, count(*) AS n FROM h GROUP BY ch UNION ALL SELECT 'relations', CAST(ch AS VARCHAR), count(*) FROM t WHERE ch BETWEEN 3 AND 40 GROUP BY ch
UNION ALL SELECT 'deaths', CAST(ch AS VARCHAR), count(*) FROM t WHERE ch BETWEEN 3 AND 40 AND type = 'F' GROUP BY ch UNION ALL SELECT 'debuts', CAST(first_ch AS VARCHAR), count(*) FROM chars WHERE first_ch BETWEEN 3 AND 40 GROUP BY first_ch
UNION ALL (SELECT 'people', CAST(u AS VARCHAR), count(*) FROM (SELECT unnest(chars) AS u FROM h) GROUP BY u ORDER BY count(*) DESC, u LIMIT 30)
UNION ALL SELECT 'evidence', CASE WHEN ord % 4 = 0 THEN 'none' ELSE 'text' END, count(*) FROM h GROUP BY 2 UNION ALL SELECT 'quoted', 'all', count(*) FROM h WHERE ord % 5 = 0
UNION ALL SELECT 'missing', CAST(c AS VARCHAR), 1 FROM range(3, 41) r(c) WHERE c NOT IN (SELECT ch FROM plot) UNION ALL SELECT 'without chapter', 'all', count(*) FROM t WHERE ch IS NULL""")
def chapter_digest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.plot_events(spark, sf_dir).select("ch", "chars", F.when(F.col("ord") % 4 != 0, "text").otherwise("").alias("evidence"), F.when(F.col("ord") % 5 == 0, "so").alias("quote"))
    return panels.digest(e, _evidence(spark, sf_dir), bridge.characters(spark, sf_dir), 3, 40, ("F",))


@query("""WITH e AS (SELECT ch, event AS id, ord FROM plot), n AS (SELECT CAST(c AS INT) AS ch FROM range(3, 41) r(c)), t AS (SELECT type, CASE WHEN ord % 3 = 0 THEN ch END AS ch FROM rels)
SELECT ch, '### chapter ' || ch || chr(10) || (SELECT count(*) FROM e WHERE e.ch = n.ch) || ' events, ' || (SELECT count(*) FROM t WHERE t.ch = n.ch) || ' relations, ' || (SELECT count(*) FROM t WHERE t.ch = n.ch AND type = 'F') || ' deaths, '
 || (SELECT count(*) FROM chars WHERE first_ch = n.ch) || ' debuts' || chr(10) || coalesce((SELECT string_agg('- `' || id || '` ' || id || ': ' || 's', chr(10) ORDER BY ord, id) FROM e WHERE e.ch = n.ch), 'no events') AS text FROM n""")
def chapter_digest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bridge.plot_events(spark, sf_dir)
    e = p.select("ch", "chars", F.lit("text").alias("evidence"), F.lit(None).cast("string").alias("quote"))
    found = panels.digest(e, _evidence(spark, sf_dir), bridge.characters(spark, sf_dir), 3, 40, ("F",))
    return panels.digest_lines(p.select("ch", "ord", F.col("event").alias("id"), F.col("event").alias("name"), F.lit("s").alias("summary")), found, 3, 40)


@query("""WITH e AS (SELECT parent, child, CAST(substr(child, 2) AS BIGINT) AS k FROM kin_up), x AS (SELECT CASE WHEN k % 3 = 0 THEN child ELSE parent END AS parent, CASE WHEN k % 3 = 0 THEN parent ELSE child END AS child, k FROM e UNION ALL SELECT child, parent, k FROM e WHERE k % 4 = 1),
c AS (SELECT parent, child FROM e WHERE k % 5 <> 0), m AS (SELECT x.*, (child, parent) IN (SELECT parent, child FROM c) AS against, (child, parent) IN (SELECT parent, child FROM x) AS other FROM x)
SELECT CASE WHEN against THEN child ELSE parent END AS parent, CASE WHEN against THEN parent ELSE child END AS child, count(*) AS n FROM m WHERE NOT (against AND other) GROUP BY ALL""")
def parents_oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of which every third is turned, and some there both ways; the canonical table lacks every fifth."""
    e = bridge.kin_edges(spark, sf_dir).withColumn("k", F.substring("child", 2, 20).cast("long"))
    turned = lambda df: df.select(F.col("child").alias("parent"), F.col("parent").alias("child"), "k")
    edges = turned(e.where("k % 3 = 0")).union(e.where("k % 3 <> 0").select("parent", "child", "k")).union(turned(e.where("k % 4 = 1")))
    return panels.oriented_parents(edges, e.where("k % 5 <> 0")).groupBy("parent", "child").agg(F.count("*").alias("n"))


@query("""SELECT parent, child, p.c AS parent_ch, q.c AS child_ch FROM kin_up JOIN (SELECT 'n' || n_nationkey AS id, CAST(n_nationkey % 9 AS INT) AS c FROM nation) p ON p.id = parent JOIN (SELECT 's' || s_suppkey AS id, CAST(s_suppkey % 7 AS INT) AS c FROM supplier) q ON q.id = child WHERE p.c - q.c >= 3""")
def parents_suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bridge.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), (F.col("n_nationkey") % 9).cast("int").alias("first_ch"))
    s = bridge.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), (F.col("s_suppkey") % 7).cast("int").alias("first_ch"))
    return panels.suspicious_parents(bridge.kin_edges(spark, sf_dir), n.union(s))


CURVE_SQL = "pow(1 - {t}, 2) * {a} + 2 * (1 - {t}) * {t} * {c} + pow({t}, 2) * {b}"


@query(f"""WITH {POINTS_SQL}, e AS (SELECT p.id AS src, q.id AS dst, p.id * 10 + k AS ord, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_, CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END * (0.08 + 0.12 * (k // 2)) AS curve FROM pts p JOIN pts q ON q.id = p.id + 1, range(3) r(k)),
c AS (SELECT *, (ax + bx) / 2 + (ay - by_) * curve * 0.5 AS cx, (ay + by_) / 2 + (bx - ax) * curve * 0.5 AS cy FROM e),
d AS (SELECT ord, curve, min(sqrt(pow({CURVE_SQL.format(t='(i / 12.0)', a='ax', c='cx', b='bx')} - 5, 2) + pow({CURVE_SQL.format(t='(i / 12.0)', a='ay', c='cy', b='by_')} + 5, 2))) AS d FROM c, range(13) s(i) GROUP BY ALL)
SELECT ord, round(d, 6) AS d, round(curve, 6)::DOUBLE AS curve FROM d WHERE d <= 16 ORDER BY d.d, ord LIMIT 1""")
def edge_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three curves between each vector and the next."""
    p = _points(spark, sf_dir)
    pairs = p.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    rels = pairs.select("src", "dst", (F.col("src") * 10 + F.col("k")).alias("ord"))
    return panels.nearest_edge(rels, p, 5.0, -5.0, 0.5)


LAYOUT_SQL = f"""{POINTS_SQL}, po AS (SELECT 'gen-v' AS layout, id, x, y * 4 AS y FROM pts UNION ALL SELECT 'force', id, x, y FROM pts UNION ALL SELECT 'gen-h', id, x * 9, y FROM pts),
bo AS (SELECT layout, coalesce(min(x) FILTER (WHERE id % 3 = 0), min(x)) AS x0, coalesce(max(x) FILTER (WHERE id % 3 = 0), max(x)) AS x1, coalesce(min(y) FILTER (WHERE id % 3 = 0), min(y)) AS y0, coalesce(max(y) FILTER (WHERE id % 3 = 0), max(y)) AS y1 FROM po GROUP BY layout)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).select("id", "x", "y")
    every = lambda name, x, y: p.select(F.lit(name).alias("layout"), "id", (F.col("x") * x).alias("x"), (F.col("y") * y).alias("y"))
    return panels.boxes(every("gen-v", 1, 4).union(every("force", 1, 1)).union(every("gen-h", 9, 1)), p.where("id % 3 = 0"))


@query(f"""WITH {LAYOUT_SQL}, s AS (SELECT *, least((1200 - 40) / greatest(60.0, x1 - x0), (900 - 40) / greatest(60.0, y1 - y0)) AS s FROM bo)
SELECT layout, round(s, 6) AS scale, round(600 - (x0 + x1) / 2 * s, 6) AS tx, round(450 - (y0 + y1) / 2 * s, 6) AS ty FROM s""")
def card_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.card_fit(_boxes(spark, sf_dir), 1200.0, 900.0)


@query(f"""WITH {LAYOUT_SQL}, a AS (SELECT layout, greatest(greatest(1, x1 - x0) / greatest(1, y1 - y0), greatest(1, y1 - y0) / greatest(1, x1 - x0)) AS a FROM bo), o AS (SELECT a AS own FROM a WHERE layout = 'gen-h')
SELECT CASE WHEN own <= 2.2 OR (SELECT min(a) FROM a) >= own THEN 'gen-h' ELSE (SELECT layout FROM a ORDER BY a, layout LIMIT 1) END AS layout FROM o""")
def card_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.card_layout(_boxes(spark, sf_dir), "gen-h")


@query(f"""WITH {DEGREE_SQL}, op AS (SELECT id FROM chars WHERE coalesce(first_ch, 0) <= 4), en AS (SELECT src AS id, dst AS other, r.* FROM rels r UNION ALL SELECT dst, src, r.* FROM rels r),
tot AS (SELECT id, count(*) AS n_relations, count(*) FILTER (WHERE ch > 4) AS n_locked FROM en GROUP BY id),
sh AS (SELECT en.id, other, type, row_number() OVER (PARTITION BY en.id ORDER BY degree DESC, en.ord) AS nth FROM en JOIN deg ON deg.id = other WHERE ch <= 4 AND style = 'solid'),
li AS (SELECT 'c' || u AS id, event, row_number() OVER (PARTITION BY u ORDER BY ch, ord, event) AS nth FROM (SELECT unnest(chars) AS u, event, ch, ord FROM plot WHERE ch <= 4))
SELECT op.id, coalesce(n_relations, 0) AS n_relations, coalesce(n_locked, 0) AS n_locked, coalesce((SELECT string_agg(other || ' ' || type, ',' ORDER BY nth) FROM sh WHERE sh.id = op.id AND nth <= 12), '') AS relations,
 coalesce((SELECT string_agg(event, ',' ORDER BY nth) FROM li WHERE li.id = op.id AND nth <= 12), '') AS life FROM op LEFT JOIN tot USING (id)""")
def character_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir)
    events = bridge.plot_events(spark, sf_dir).select(F.explode("chars").alias("u"), "event", "ch", "ord").select(F.concat(F.lit("c"), "u").alias("char"), "event", "ch", "ord")
    out = panels.character_panels(view.degrees(rels, nodes), rels, events, ViewState(80, progress=4, styles=frozenset({"solid"})))
    return out.select("id", "n_relations", "n_locked", F.array_join(F.transform("relations", lambda r: F.concat_ws(" ", r["other"], r["type"])), ",").alias("relations"), F.array_join("life", ",").alias("life"))


@query(f"""WITH {DEGREE_SQL}, f AS (SELECT faction, row_number() OVER (ORDER BY faction DESC) AS nth FROM (SELECT DISTINCT faction FROM chars WHERE faction <> 'BUILDING')),
c AS (SELECT c.id, name, c.ord % 5 AS generation, c.faction, degree, coalesce(f.nth, 99) AS fn FROM chars c JOIN deg USING (id) LEFT JOIN f ON f.faction = c.faction)
SELECT id, 'g' || generation AS "group", CAST(generation + 1 AS INT) AS group_rank, CAST(row_number() OVER (PARTITION BY generation ORDER BY fn, degree DESC, name, id) AS INT) AS nth, 'generation' AS mode FROM c
UNION ALL SELECT id, 'f' || faction, CAST(dense_rank() OVER (ORDER BY fn) AS INT), CAST(row_number() OVER (PARTITION BY faction ORDER BY generation, degree DESC, name, id) AS INT), 'faction' FROM c""")
def group_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five generations by number, and factions in falling order of their names, one of them unknown."""
    nodes, rels = book(spark, sf_dir)
    chars = view.degrees(rels, nodes).withColumn("generation", F.col("ord") % 5)
    names = sorted((r["faction"] for r in nodes.where("faction <> 'BUILDING'").select("faction").distinct().collect()), reverse=True)  # a handful of segments
    factions = spark.createDataFrame([(f, k + 1) for k, f in enumerate(names)], "faction string, nth int")
    return panels.group_places(chars, factions, True).withColumn("mode", F.lit("generation")).unionByName(panels.group_places(chars, factions, False).withColumn("mode", F.lit("faction")))


@query("""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{6,}')) AS name FROM benchmark), m AS (SELECT name, min(doc_id) AS text_id FROM n JOIN documents ON contains(text, name) GROUP BY name),
a AS (SELECT name, text_id, text, instr(text, name) - 1 AS at_ FROM m JOIN documents ON doc_id = text_id)
SELECT name, text_id, regexp_replace(substr(text, CAST(greatest(at_ - 30, 0) + 1 AS BIGINT), CAST(at_ + length(name) + 30 - greatest(at_ - 30, 0) AS BIGINT)), '\\s+', ' ', 'g') AS passage FROM a""")
def name_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = bridge.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{6,}"), F.lit(0))).alias("name")).distinct()
    texts = bridge.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return panels.passages(texts, names)


@query(f"""WITH {LAYOUT_SQL}, f AS (SELECT b.layout, x0 / k AS x0, x1 / k AS x1, y0 / k AS y0, y1 / k AS y1, k FROM bo b, (VALUES (1), (20), (200), (2000)) v(k)),
s AS (SELECT layout || ' ' || k AS layout, greatest(x1 - x0, 1.0) AS w, greatest(y1 - y0, 1.0) AS h, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM f),
t AS (SELECT *, least(800 * 0.55 / w, 500 * 0.55 / h) / 2.0 AS want, greatest(w, h) * 2.0 AS px FROM s), u AS (SELECT *, want < 1.5 AND px > 500 * 0.92 AS shr FROM t),
g AS (SELECT *, CASE WHEN shr THEN greatest(0.05, least(want, 1.5)) ELSE least(greatest(want, 1.5), 4, greatest(1.5, 500 / (900 * 2.0 * 0.35) * 1.5)) END AS target FROM u),
o AS (SELECT *, CASE WHEN shr THEN target <= 1.5 / 1.25 ELSE target >= 1.5 * 1.25 END AS better, abs(cx - 3) + w / 2 > 800 / 2.0 / 2 * 0.9 OR abs(cy + 4) + h / 2 > 500 / 2.0 / 2 * 0.9 AS outside FROM g),
m AS (SELECT *, outside OR (better AND (shr OR px < 500 / 3.0)) AS moves FROM o), z AS (SELECT *, CASE WHEN outside THEN better ELSE moves END AS zooms FROM m)
SELECT layout, CASE WHEN zooms THEN 'zoom' WHEN moves THEN 'move' ELSE 'stay' END AS action, round(CASE WHEN zooms THEN target ELSE 1.5 END, 6)::DOUBLE AS zoom, round(CASE WHEN moves THEN cx ELSE 3 END, 6)::DOUBLE AS x, round(CASE WHEN moves THEN cy ELSE -4 END, 6)::DOUBLE AS y FROM z""")
def focus_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of three layouts in four sizes, as if of a few nodes each."""
    box = _boxes(spark, sf_dir).withColumn("k", F.explode(F.array(*map(F.lit, (1, 20, 200, 2000)))))
    sized = box.select(F.concat_ws(" ", "layout", "k").alias("layout"), *[(F.col(c) / F.col("k")).alias(c) for c in ("x0", "x1", "y0", "y1")], F.lit(9).alias("n"))
    return panels.focus_view(sized, 800.0, 500.0, 1.5, 2.0, (3.0, -4.0), 900.0)
