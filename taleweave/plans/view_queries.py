"""Queries on what a reader may see."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taleweave.functions.scalars import kin_bucket, period_text, style_of
from taleweave.operators import view
from taleweave.operators.view import ViewState
from taleweave.plans.base import query
from taleweave.sources import bridge

LAST = 80
#: The grid of states under which views are compared.
GRID = {
    "plain": ViewState(LAST),
    "p5": ViewState(LAST, progress=5),
    "p10": ViewState(LAST, progress=10),
    "p30": ViewState(LAST, progress=30),
    "p10_blood": ViewState(LAST, progress=10, kins=frozenset({"blood"})),
    "p10_dashed": ViewState(LAST, progress=10, styles=frozenset({"dashed"})),
    "p10_underived": ViewState(LAST, progress=10, show_derived=False),
    "at8": ViewState(LAST).at_chapter(8),
    "p20_at6": ViewState(LAST, progress=20).at_chapter(6),
}
#: The same as SQL values: state, progress, as-of chapter, kin bucket, style, derived shown.
GRID_SQL = """(VALUES ('plain', NULL, NULL, NULL, NULL, true), ('p5', 5, NULL, NULL, NULL, true), ('p10', 10, NULL, NULL, NULL, true),
  ('p30', 30, NULL, NULL, NULL, true), ('p10_blood', 10, NULL, 'blood', NULL, true), ('p10_dashed', 10, NULL, NULL, 'dashed', true),
  ('p10_underived', 10, NULL, NULL, NULL, false), ('at8', NULL, 8, NULL, NULL, true), ('p20_at6', 20, 6, NULL, NULL, true))
  AS g(state, progress, as_of, kin_b, sty, der)"""
BUCKET_SQL = "CASE kin WHEN 'blood' THEN 'blood' WHEN 'marriage' THEN 'marriage' WHEN 'adoptive' THEN 'adopt' WHEN 'sworn' THEN 'sworn' ELSE 'none' END"
DEGREE_SQL = """deg AS (SELECT c.id, c.ord, CAST(count(r.id) AS BIGINT) AS degree FROM chars c
  LEFT JOIN (SELECT src AS id FROM rels UNION ALL SELECT dst FROM rels) r ON r.id = c.id GROUP BY c.id, c.ord)"""


def book(spark: SparkSession, sf_dir: str, ordered: bool = True) -> tuple[DataFrame, DataFrame]:
    return bridge.characters(spark, sf_dir), bridge.relations(spark, sf_dir, ordered)


@query("""WITH a AS (SELECT first_ch AS ch, count(*) AS new_chars FROM chars WHERE first_ch IS NOT NULL GROUP BY 1),
b AS (SELECT ch, count(DISTINCT id) AS chars_here FROM (SELECT ch, src AS id FROM rels WHERE NOT derived UNION ALL SELECT ch, dst FROM rels WHERE NOT derived) GROUP BY 1),
c AS (SELECT ch, count(*) AS new_rels FROM rels WHERE NOT derived GROUP BY 1),
d AS (SELECT ch, count(DISTINCT place) AS places_here FROM rel_places WHERE NOT derived GROUP BY 1),
e AS (SELECT ch, count(*) AS new_places FROM (SELECT place, min(ch) AS ch FROM rel_places GROUP BY 1) GROUP BY 1)
SELECT ch, coalesce(new_chars, 0) AS new_chars, coalesce(chars_here, 0) AS chars_here, coalesce(new_rels, 0) AS new_rels,
  coalesce(places_here, 0) AS places_here, coalesce(new_places, 0) AS new_places
FROM a FULL JOIN b USING (ch) FULL JOIN c USING (ch) FULL JOIN d USING (ch) FULL JOIN e USING (ch)""")
def chapter_digest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir)
    return view.chapter_digest(nodes, rels, bridge.relation_places(spark, sf_dir, rels), bridge.places(spark, sf_dir))


@query("""WITH n AS (SELECT ch, count(*) AS new_rels FROM rels WHERE NOT derived GROUP BY 1)
SELECT ch, new_rels, lead(ch) OVER (ORDER BY ch) AS next_ch, lead(new_rels) OVER (ORDER BY ch) AS next_new_rels FROM n""")
def digest_teaser(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bridge.relations(spark, sf_dir).where("NOT derived").groupBy("ch").agg(F.count("*").alias("new_rels"))
    w = Window.orderBy("ch")  # one row a chapter
    return n.select("ch", "new_rels", F.lead("ch").over(w).alias("next_ch"), F.lead("new_rels").over(w).alias("next_new_rels"))


@query("""SELECT ord, src, dst, CASE WHEN derived THEN least(a.first_ch, b.first_ch) ELSE ch END AS rel_ch
FROM rels JOIN (SELECT id, coalesce(first_ch, 0) AS first_ch FROM chars) a ON a.id = src JOIN (SELECT id, coalesce(first_ch, 0) AS first_ch FROM chars) b ON b.id = dst""")
def rel_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived edges have no evidence chapter and fall back to the earlier end."""
    nodes, rels = book(spark, sf_dir)
    first = nodes.select("id", F.coalesce("first_ch", F.lit(0)).alias("f"))
    r = rels.join(first.select(F.col("id").alias("src"), F.col("f").alias("fa")), "src").join(first.select(F.col("id").alias("dst"), F.col("f").alias("fb")), "dst")
    evidence = F.when(~F.col("derived"), F.col("ch"))
    return r.select("ord", "src", "dst", F.coalesce(evidence, F.least("fa", "fb")).alias("rel_ch"))


@query("""SELECT ord, CASE WHEN to_ch IS NOT NULL AND to_ch - 1 <= 30 THEN '第' || from_ch || '–' || (to_ch - 1) || '章' ELSE '第' || from_ch || '章起' END AS period FROM rels""")
def rel_period_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.relations(spark, sf_dir).select("ord", period_text(F.col("from_ch"), F.col("to_ch"), F.lit(30)).alias("period"))


def _counts(state: ViewState, nodes: DataFrame, rels: DataFrame) -> DataFrame:
    c = nodes.agg(F.count_if(state.locked(F.col("first_ch"))).alias("chars_locked"), F.count_if(~state.not_yet(F.col("first_ch"))).alias("chars_there"))
    r = rels.agg(F.count_if(state.locked(F.col("ch"))).alias("rels_locked"), F.count_if(state.alive(F.col("from_ch"), F.col("to_ch"))).alias("rels_alive"))
    return c.crossJoin(r)


@query("""SELECT (SELECT count(*) FROM chars WHERE coalesce(first_ch, 0) > 20) AS chars_locked, (SELECT count(*) FROM chars) AS chars_there,
 (SELECT count(*) FROM rels WHERE ch > 20) AS rels_locked, (SELECT count(*) FROM rels) AS rels_alive""")
def locked_counts_p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(ViewState(LAST, progress=20), *book(spark, sf_dir))


@query("""SELECT CAST(0 AS BIGINT) AS chars_locked, (SELECT count(*) FROM chars WHERE coalesce(first_ch, 0) <= 30) AS chars_there,
 CAST(0 AS BIGINT) AS rels_locked, (SELECT count(*) FROM rels WHERE from_ch <= 30 AND (to_ch IS NULL OR to_ch > 30)) AS rels_alive""")
def asof_counts_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(ViewState(LAST).at_chapter(30), *book(spark, sf_dir))


@query("""SELECT (SELECT count(*) FROM chars WHERE coalesce(first_ch, 0) > 20) AS chars_locked, (SELECT count(*) FROM chars WHERE coalesce(first_ch, 0) <= 20) AS chars_there,
 (SELECT count(*) FROM rels WHERE ch > 20) AS rels_locked, (SELECT count(*) FROM rels WHERE from_ch <= 20 AND (to_ch IS NULL OR to_ch > 20)) AS rels_alive""")
def asof_under_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time travel to chapter 30 stops at the progress of 20."""
    return _counts(ViewState(LAST, progress=20).at_chapter(30), *book(spark, sf_dir))


@query(f"""SELECT state, id, progress IS NOT NULL AND coalesce(first_ch, 0) > progress AS locked
FROM chars CROSS JOIN {GRID_SQL} WHERE as_of IS NULL OR coalesce(first_ch, 0) <= as_of""")
def visible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir)
    parts = [view.visible_nodes(s, nodes, rels).select(F.lit(name).alias("state"), "id", "locked") for name, s in GRID.items()]
    return reduce(DataFrame.unionByName, parts)


@query(f"""WITH drawn AS (SELECT state, id FROM chars CROSS JOIN {GRID_SQL} WHERE as_of IS NULL OR coalesce(first_ch, 0) <= as_of)
SELECT g.state, r.ord FROM rels r CROSS JOIN {GRID_SQL}
WHERE (progress IS NULL OR ch <= progress) AND (as_of IS NULL OR (from_ch <= as_of AND (to_ch IS NULL OR to_ch > as_of)))
 AND (der OR NOT derived) AND (sty IS NULL OR style = sty) AND (kin_b IS NULL OR {BUCKET_SQL} = kin_b)
 AND EXISTS (SELECT 1 FROM drawn d WHERE d.state = g.state AND d.id = r.src) AND EXISTS (SELECT 1 FROM drawn d WHERE d.state = g.state AND d.id = r.dst)""")
def visible_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir)
    parts = [view.visible_links(s, view.visible_nodes(s, nodes, rels), rels).select(F.lit(name).alias("state"), "ord") for name, s in GRID.items()]
    return reduce(DataFrame.unionByName, parts)


@query(f"SELECT style, {BUCKET_SQL} AS bucket, count(*) AS n, count(*) FILTER (WHERE derived) AS n_derived FROM rels GROUP BY ALL")
def edge_filter_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bridge.relations(spark, sf_dir)
    return r.groupBy(style_of(F.col("style")).alias("style"), kin_bucket(F.col("kin")).alias("bucket")).agg(F.count("*").alias("n"), F.count_if("derived").alias("n_derived"))


@query(f"WITH {DEGREE_SQL} SELECT id, degree FROM deg")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir)
    return view.degrees(rels, nodes).select("id", "degree")


@query(f"WITH {DEGREE_SQL} SELECT id, degree, row_number() OVER (ORDER BY degree DESC, ord) AS rank FROM deg")
def degree_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir)
    return view.ranks(view.degrees(rels, nodes)).select("id", "degree", "rank")


@query(f"WITH {DEGREE_SQL} SELECT id, CAST(row_number() OVER (ORDER BY degree DESC, ord) AS INT) AS rank FROM deg QUALIFY rank <= 60")
def size_filter_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir)
    return view.top_by_degree(view.degrees(rels, nodes), view.SIZES["main"])


@query(f"WITH {DEGREE_SQL} SELECT id, round(greatest(13, least(40, 13 + 27 * sqrt(degree / greatest((SELECT max(degree) FROM deg), 1)))), 6) AS size FROM deg")
def symbol_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir)
    return view.with_symbol_size(view.degrees(rels, nodes)).select("id", "size")


LAST_SQL = """last_chs AS (SELECT id, max(ch) AS last_ch FROM (SELECT id, coalesce(first_ch, 0) AS ch FROM chars UNION ALL SELECT src, ch FROM rels UNION ALL SELECT dst, ch FROM rels) GROUP BY id)"""


def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir)
    ends = rels.select(F.explode(F.array("src", "dst")).alias("id"), "ch")
    return nodes.select("id", F.coalesce("first_ch", F.lit(0)).alias("ch")).unionByName(ends).groupBy("id").agg(F.max("ch").alias("last_ch"))


@query(f"WITH {LAST_SQL} SELECT id, last_ch FROM last_chs")
def last_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last(spark, sf_dir)


@query(f"WITH {LAST_SQL} SELECT id, last_ch > 40 AS fate_locked FROM last_chs")
def fate_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last(spark, sf_dir).select("id", ViewState(LAST, progress=40).locked(F.col("last_ch")).alias("fate_locked"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE tier = 'main' OR tier = 'minor') AS shown,
 count(*) FILTER (WHERE coalesce(first_ch, 0) > 12) AS locked FROM chars""")
def count_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = replace(ViewState(LAST, progress=12), show_mentioned=False)
    nodes = bridge.characters(spark, sf_dir)
    return nodes.agg(F.count("*").alias("total"), F.count_if(~state.hidden(F.col("tier"))).alias("shown"), F.count_if(state.locked(F.col("first_ch"))).alias("locked"))


@query("""SELECT place, id FROM (SELECT place, src AS id FROM rel_places UNION SELECT place, dst FROM rel_places)""")
def place_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bridge.relation_places(spark, sf_dir, bridge.relations(spark, sf_dir))
    return p.select("place", F.explode(F.array("src", "dst")).alias("id")).distinct()


@query("""SELECT place, first_ch FROM (SELECT place, min(ch) AS first_ch FROM rel_places GROUP BY 1) WHERE first_ch <= 24""")
def place_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = ViewState(LAST, progress=24)
    return bridge.places(spark, sf_dir).where(~state.locked(F.col("first_ch")) & ~state.not_yet(F.col("first_ch")))


@query(f"""WITH {DEGREE_SQL} SELECT c.id, d.degree FROM chars c JOIN deg d USING (id) WHERE coalesce(first_ch, 0) <= 20 AND tier <> 'mentioned'""")
def selectable(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir)
    state = replace(ViewState(LAST, progress=20), show_mentioned=False)
    ok = ~state.locked(F.col("first_ch")) & ~state.not_yet(F.col("first_ch")) & ~state.hidden(F.col("tier"))
    return view.degrees(rels, nodes).where(ok).select("id", "degree")
