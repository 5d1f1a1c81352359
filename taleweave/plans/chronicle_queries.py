"""Queries of panels, audits and selections over chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.operators import annotations, chronicle, validate
from taleweave.operators.view import ViewState
from taleweave.plans.base import query
from taleweave.plans.view_queries import LAST, book
from taleweave.sources import bridge


def _event_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """char, event, ch, ord of every user in every hour's events."""
    return bridge.plot_events(spark, sf_dir).select(F.explode("chars").alias("char"), "event", "ch", "ord")


@query("""SELECT DISTINCT CAST(i AS INT) AS ch FROM (VALUES (1, 30), (35, 35), (40, 41), (50, 50)) t(low, high), range(1, 60) r(i) WHERE i BETWEEN low AND high""")
def chapter_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chronicle.selected_chapters(spark.createDataFrame([("1-30, 35,40-41",), ("x,50",)], "selection string"))


@query(f"""WITH ec AS (SELECT unnest(chars) AS char, event, ch, ord FROM plot),
ranked AS (SELECT char, event, row_number() OVER (PARTITION BY char ORDER BY ch, ord, event) AS nth FROM ec WHERE ch <= 20),
lists AS (SELECT char, list(event ORDER BY nth) AS events FROM ranked WHERE nth <= {chronicle.LIFE_LIST} GROUP BY char)
SELECT char, total, shown, coalesce(events, []) AS events FROM (SELECT char, count(*) AS total, count(*) FILTER (WHERE ch <= 20) AS shown FROM ec GROUP BY char) LEFT JOIN lists USING (char)""")
def life_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chronicle.life_lists(_event_chars(spark, sf_dir), ViewState(31, progress=20))


@query("""WITH ends AS (SELECT src AS id, * FROM rels UNION ALL SELECT dst, * FROM rels)
SELECT id, type, count(*) FILTER (WHERE ch <= 30 AND NOT derived AND style = 'dashed') AS n, count(*) FILTER (WHERE ch > 30 AND NOT derived) AS locked,
 count(*) FILTER (WHERE ch <= 30 AND NOT derived AND style <> 'dashed') AS filtered FROM ends GROUP BY id, type""")
def relation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = ViewState(LAST, progress=30, show_derived=False, styles=frozenset({"dashed"}))
    return chronicle.relation_lists(bridge.relations(spark, sf_dir), state)


@query("""WITH pairs AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, list(struct_pack(ch := ch, ord := ord) ORDER BY ch, ord) AS ev FROM rels GROUP BY 1, 2)
SELECT a, b, len(ev) AS total, len(list_filter(ev, lambda e: e.ch <= 30)) AS shown FROM pairs""")
def visible_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bridge.relations(spark, sf_dir)
    pairs = r.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.array_sort(F.collect_list(F.struct("ch", "ord"))).alias("ev"))
    seen = chronicle.evidence_within(F.col("ev"), ViewState(LAST, progress=30))
    return pairs.select("a", "b", F.size("ev").cast("long").alias("total"), F.size(seen).cast("long").alias("shown"))


@query("""WITH ec AS (SELECT unnest(chars) AS char, event, ch, ord FROM plot), f AS (SELECT char, max(ch) AS first_ch FROM ec GROUP BY char),
l AS (SELECT event, max(ord) AS end_ord FROM ec GROUP BY event)
SELECT char, count(*) AS n, count(*) FILTER (WHERE ord = end_ord) AS at_end, any_value(first_ch) AS first_ch
FROM ec JOIN f USING (char) JOIN l USING (event) WHERE first_ch - ch > 5 GROUP BY char""")
def late_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed first chapters are the characters' last ones, so that earlier events are late."""
    ec = _event_chars(spark, sf_dir)
    return chronicle.late_characters(ec, ec.groupBy("char").agg(F.max("ch").alias("first_ch")))


HEADING = "^(Licensed|[A-Z][a-z]+ [a-z]+)"


@query(f"""WITH l AS (SELECT doc_id AS text_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS nth, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT *, CASE WHEN regexp_matches(line, '{HEADING}') THEN trim(line, ' ') END AS title FROM l),
s AS (SELECT text_id, title, max(nth) AS start FROM m WHERE title IS NOT NULL GROUP BY ALL),
h AS (SELECT m.text_id, m.nth, last_value(s.title IGNORE NULLS) OVER (PARTITION BY m.text_id ORDER BY m.nth) AS heading FROM m LEFT JOIN s ON s.text_id = m.text_id AND s.start = m.nth)
SELECT text_id, heading, count(*) AS n_lines FROM h GROUP BY ALL""")
def main_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = bridge.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.posexplode(F.split("text", "\n")).alias("nth", "line"))
    return chronicle.main_text(texts, HEADING).groupBy("text_id", "heading").agg(F.count("*").alias("n_lines"))


@query("""WITH ec AS (SELECT DISTINCT unnest(chars) AS item, event, ch FROM plot), cited AS (SELECT * FROM ec WHERE item % 3 <> 0), declared AS (SELECT item, event, CASE WHEN item % 5 = 0 THEN ch + 1 ELSE ch END AS ch FROM ec WHERE item % 4 <> 0),
known AS (SELECT DISTINCT event, ch AS event_ch FROM plot WHERE ch <= 20),
b AS (SELECT coalesce(c.item, d.item) AS item, coalesce(c.event, d.event) AS event, c.ch AS cc, d.ch AS dc, c.item IS NOT NULL AS is_c, d.item IS NOT NULL AS is_d FROM cited c FULL JOIN declared d ON c.item = d.item AND c.event = d.event),
k AS (SELECT b.*, event_ch FROM b LEFT JOIN known USING (event)),
f AS (SELECT item, event, 'missing' AS finding FROM k WHERE event_ch IS NULL UNION ALL SELECT item, event, 'uncited' FROM k WHERE event_ch IS NOT NULL AND NOT is_c
 UNION ALL SELECT item, event, 'undeclared' FROM k WHERE event_ch IS NOT NULL AND NOT is_d UNION ALL SELECT item, event, 'other chapter' FROM k WHERE event_ch <> coalesce(dc, cc))
SELECT * FROM f""")
def annotation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users cite and declare the events they are in; some are left out, some told with a wrong chapter."""
    plot = bridge.plot_events(spark, sf_dir)
    ec = plot.select(F.explode("chars").alias("item"), "event", "ch").distinct()
    declared = ec.where("item % 4 <> 0").withColumn("ch", F.when(F.col("item") % 5 == 0, F.col("ch") + 1).otherwise(F.col("ch")))
    known = plot.where("ch <= 20").select("event", F.col("ch").alias("event_ch")).distinct()
    return chronicle.cited_and_declared(ec.where("item % 3 <> 0"), declared, known)


@query("""SELECT 'text' AS field, count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS n_marks, count(*) FILTER (WHERE n % 2 = 1) AS n_unpaired
FROM (SELECT len(regexp_extract_all(replace(text, 'the', '**'), '\\*\\*')) AS n FROM documents) WHERE n > 0 HAVING count(*) > 0""")
def bold_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frequent word stands in for the marks, which these texts lack."""
    texts = bridge.table(spark, sf_dir, "documents").select(F.replace(F.col("text"), F.lit("the"), F.lit("**")).alias("text"))
    return chronicle.bold_tally(texts, "text")


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]*')) AS word FROM conversations)
WHERE length(word) >= 2 AND NOT regexp_matches(word, '^[a-z]+-?[0-9][0-9A-Za-z_-]*$') GROUP BY word""")
def latin_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chronicle.latin_words(bridge.table(spark, sf_dir, "conversations").select("text"))


@query("""SELECT text_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS nth, unnest(s) AS span FROM (SELECT doc_id AS text_id, regexp_extract_all(text, '\\(([^()]*)\\)', 1) AS s FROM documents)""")
def bracket_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = bridge.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return chronicle.quoted_spans(texts, r"\(", r"\)")


@query("""SELECT count(*) FILTER (WHERE a.generation < b.generation) AS as_expected, count(*) FILTER (WHERE a.generation = b.generation) AS equal,
 count(*) FILTER (WHERE a.generation > b.generation) AS suspicious, count(*) FILTER (WHERE a.generation IS NULL OR b.generation IS NULL) AS unknown
FROM (SELECT src AS parent, dst AS child FROM rels UNION ALL SELECT parent, child FROM kin_up) e LEFT JOIN chars a ON a.id = parent LEFT JOIN chars b ON b.id = child""")
def kin_direction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir)
    edges = rels.select(F.col("src").alias("parent"), F.col("dst").alias("child")).unionByName(bridge.kin_edges(spark, sf_dir))
    return chronicle.generation_direction(edges, nodes)


@query("""WITH led AS (SELECT c_name AS name, 'settled by hand' AS why FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_name, 'settled by hand' FROM customer WHERE c_custkey % 21 = 0
 UNION ALL SELECT 'Nobody#' || c_custkey, 'short' FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT 'alias' || s_suppkey, 'settled by hand' FROM supplier),
e AS (SELECT name, count(*) AS n, min(length(why)) AS reason FROM led GROUP BY name),
k AS (SELECT e.*, EXISTS (SELECT 1 FROM customer WHERE c_name = e.name) AS main, EXISTS (SELECT 1 FROM supplier WHERE 'alias' || s_suppkey = e.name) AS alias FROM e),
f AS (SELECT name, 'repeated' AS problem FROM k WHERE n > 1 UNION ALL SELECT name, 'no reason' FROM k WHERE reason < 8
 UNION ALL SELECT name, 'alias' FROM k WHERE NOT main AND alias UNION ALL SELECT name, 'unknown' FROM k WHERE NOT main AND NOT alias)
SELECT * FROM f""")
def name_ledger_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = bridge.table(spark, sf_dir, "customer"), bridge.table(spark, sf_dir, "supplier")
    good = F.lit("settled by hand").alias("why")
    led = c.where("c_custkey % 7 = 0").select(F.col("c_name").alias("name"), good).unionByName(c.where("c_custkey % 21 = 0").select(F.col("c_name").alias("name"), good))
    led = led.unionByName(c.where("c_custkey % 50 = 0").select(F.concat(F.lit("Nobody#"), F.col("c_custkey")).alias("name"), F.lit("short").alias("why")))
    alias = s.select(F.concat(F.lit("alias"), F.col("s_suppkey")).alias("alias"))
    led = led.unionByName(alias.select(F.col("alias").alias("name"), good))
    return chronicle.name_ledger_problems(led, c.select(F.col("c_name").alias("name")), alias)


# Every user of the plot writes an annotation in the chapter of the first event; ids stand in the body, some of them misspelt.
ITEMS_SQL = """ev AS (SELECT 'b' || (event_id % 2) AS book, 'e' || event_id AS id, CAST(event_id % 25 + 1 AS INT) AS ch, event_id AS k, user_id FROM events),
it AS (SELECT book, user_id AS item, min(ch) AS ch, list_sort(list(id) FILTER (WHERE k % 3 <> 0)) AS events, list_sort(list(CASE WHEN k % 7 = 0 THEN id || 'x' WHEN k % 8 = 1 THEN 'e' || (k + 2) ELSE id END) FILTER (WHERE k % 4 <> 0)) AS ids FROM ev GROUP BY book, user_id)"""


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT book, item, ch, unnest(list_distinct(ids)) AS event FROM it), d AS (SELECT book, item, ch, unnest(events) AS event FROM it),
b AS (SELECT coalesce(c.book, d.book) AS book, coalesce(c.item, d.item) AS item, coalesce(c.ch, d.ch) AS ch, coalesce(c.event, d.event) AS event, c.item IS NOT NULL AS ci, d.item IS NOT NULL AS de FROM c FULL JOIN d ON c.book = d.book AND c.item = d.item AND c.event = d.event),
kn AS (SELECT book, id, ch AS ech FROM ev WHERE k % 11 <> 0), rv AS (SELECT book, item, ch, event FROM d WHERE item % 2 = 0), e AS (SELECT b.*, ech FROM b LEFT JOIN kn ON kn.book = b.book AND kn.id = b.event)
SELECT book, item, event, 'no such event' AS finding FROM e WHERE ci AND ech IS NULL UNION ALL SELECT book, item, event, CASE WHEN ech <> ch THEN 'cited across chapters' WHEN (book, event) IN (SELECT book, event FROM d) THEN 'declared elsewhere' ELSE 'unclaimed' END FROM e WHERE ci AND ech IS NOT NULL AND NOT de
UNION ALL SELECT book, item, event, 'declared, no such event' FROM e WHERE de AND ech IS NULL UNION ALL SELECT book, item, event, 'uncited' FROM e WHERE de AND ech IS NOT NULL AND NOT ci
UNION ALL SELECT book, item, event, CASE WHEN (book, ch, event) IN (SELECT book, ch, event FROM rv) THEN 'across, reviewed' ELSE 'across chapters' END FROM e WHERE de AND ech <> ch""")
def annotation_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, ev = _items(spark, sf_dir)
    reviewed = items.where("item % 2 = 0").select("book", "ch", F.explode("events").alias("event"))
    return annotations.citations(items, ev.where("k % 11 <> 0").select("book", F.col("id").alias("event"), "ch"), reviewed)


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = bridge.table(spark, sf_dir, "events")
    k = F.col("event_id")
    ev = e.select(F.concat(F.lit("b"), k % 2).alias("book"), F.concat(F.lit("e"), k).alias("id"), (k % 25 + 1).cast("int").alias("ch"), k.alias("k"), "user_id")
    kept = F.sort_array(F.collect_list(F.when(F.col("k") % 3 != 0, F.col("id"))))
    cited = F.sort_array(F.collect_list(F.when(F.col("k") % 4 != 0, F.when(F.col("k") % 7 == 0, F.concat("id", F.lit("x"))).when(F.col("k") % 8 == 1, F.concat(F.lit("e"), F.col("k") + 2)).otherwise(F.col("id")))))
    items = ev.groupBy("book", F.col("user_id").alias("item")).agg(F.min("ch").alias("ch"), kept.alias("events"), F.array_join(cited, "，").alias("body"))
    return items, ev


@query(f"""WITH {ITEMS_SQL}, x AS (SELECT book, item, CASE WHEN item % 13 = 0 THEN 99 ELSE ch END AS ch, CASE WHEN item % 9 = 0 THEN ' ' WHEN item % 10 = 0 THEN '……' ELSE '题' || (item % 40) END AS title, coalesce(ids, []) AS ids, coalesce(events, []) AS events,
 CASE WHEN item % 4 = 0 THEN 'Basis「原' WHEN item % 4 = 1 THEN '原文' ELSE NULL END AS basis FROM it), kn AS (SELECT book, id, ch FROM ev WHERE k % 11 <> 0), pe AS (SELECT 'p' || (c_custkey % 30) AS id, CAST(c_custkey % 30 AS INT) AS first_ch FROM customer WHERE c_custkey <= 30),
ch AS (SELECT book, item, 'p' || (item % 33) AS id FROM x)
SELECT book, 'error' AS severity, 'title missing' AS kind, CAST(item AS VARCHAR) AS subject FROM x WHERE title = ' ' UNION ALL SELECT book, 'error', 'body missing', CAST(item AS VARCHAR) FROM x WHERE len(ids) = 0 UNION ALL SELECT book, 'error', 'basis missing', CAST(item AS VARCHAR) FROM x WHERE basis IS NULL
UNION ALL SELECT book, 'error', 'title to come', CAST(item AS VARCHAR) FROM x WHERE title = '……' UNION ALL SELECT book, 'error', 'basis with foreign words', item || ' Basis' FROM x WHERE item % 4 = 0 UNION ALL SELECT book, 'error', 'basis with unpaired marks', CAST(item AS VARCHAR) FROM x WHERE item % 4 = 0
UNION ALL SELECT book, 'error', 'chapter outside the book', CAST(item AS VARCHAR) FROM x WHERE ch > 25 UNION ALL SELECT book, 'error', 'events unknown', item || ' ' || e FROM (SELECT book, item, unnest(events) AS e FROM x) WHERE (book, e) NOT IN (SELECT book, id FROM kn)
UNION ALL SELECT book, 'error', 'reference to nothing', item || ' ' || e FROM (SELECT book, item, unnest(list_distinct(ids)) AS e FROM x) WHERE (book, e) NOT IN (SELECT book, id FROM kn) UNION ALL SELECT book, 'error', 'chars unknown', item || ' ' || id FROM ch WHERE id NOT IN (SELECT id FROM pe)
UNION ALL SELECT y.book, 'error', 'person before their time', y.item || ' ' || y.e || ' ' || ch.id FROM (SELECT book, item, unnest(events) AS e FROM x) y JOIN kn ON kn.book = y.book AND kn.id = y.e JOIN ch ON ch.book = y.book AND ch.item = y.item JOIN pe ON pe.id = ch.id WHERE first_ch - kn.ch > 5
UNION ALL SELECT book, 'error', 'title repeated', ch || ' ' || trim(title) FROM x GROUP BY book, ch, trim(title) HAVING count(*) > 1""")
def annotation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same annotations with titles, bases and people of their own, faults by their number."""
    items, ev = _items(spark, sf_dir)
    k = F.col("item")
    title = F.when(k % 9 == 0, " ").when(k % 10 == 0, "……").otherwise(F.concat(F.lit("题"), k % 40))
    basis = F.when(k % 4 == 0, "Basis「原").when(k % 4 == 1, "原文")
    items = items.withColumns({"ch": F.when(k % 13 == 0, 99).otherwise(F.col("ch")), "title": title, "basis": basis, "chars": F.array(F.concat(F.lit("p"), k % 33)), "places": F.lit(None).cast("array<string>")})
    books = spark.createDataFrame([("b0", 25), ("b1", 25)], "book string, last int")
    c = bridge.table(spark, sf_dir, "customer").where("c_custkey <= 30").select(F.concat(F.lit("p"), F.col("c_custkey") % 30).alias("id"), (F.col("c_custkey") % 30).cast("int").alias("first_ch"))
    chars = c.withColumn("book", F.explode(F.array(F.lit("b0"), F.lit("b1"))))  # the same people in both books
    events = ev.where("k % 11 <> 0").select("book", "id", "ch")
    nothing = items.limit(0)
    return validate.report(annotations.field_rules(items, nothing.select("book", "item", "title", "body", "basis"), events, chars, events.limit(0).select("book", "id"), books))
