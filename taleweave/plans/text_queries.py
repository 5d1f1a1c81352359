"""Text mining, validation and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.functions.scalars import plain_text, short_name, slug
from taleweave.operators import ledgers, textmine, validate, view
from taleweave.operators.graph import cut_lineage
from taleweave.plans.base import query
from taleweave.plans.view_queries import DEGREE_SQL, book
from taleweave.sources import bridge


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")


@query("""SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '&#[0-9]+;', '', 'g') AS plain FROM pages""")
def html_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.table(spark, sf_dir, "pages").select("page_id", plain_text(F.col("html")).alias("plain"))


@query("""SELECT doc_id AS text_id, concat_ws(' ', CASE WHEN length(text) - length(replace(text, '(', '')) <> length(text) - length(replace(text, ')', '')) THEN '()' END,
 CASE WHEN length(text) - length(replace(text, '[', '')) <> length(text) - length(replace(text, ']', '')) THEN '[]' END,
 CASE WHEN length(text) - length(replace(text, '<', '')) <> length(text) - length(replace(text, '>', '')) THEN '<>' END,
 CASE WHEN length(text) - length(replace(text, '「', '')) <> length(text) - length(replace(text, '」', '')) THEN '「」' END) AS marks FROM documents""")
def markup_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("text_id", textmine.unbalanced(F.col("text")).alias("marks"))


@query("SELECT leak, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in textmine.LEAKS) + " END AS leak FROM documents) WHERE leak IS NOT NULL GROUP BY leak")
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select(textmine.leak_of(F.col("text")).alias("leak")).where("leak IS NOT NULL").groupBy("leak").agg(F.count("*").alias("n"))


def benchmark_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bridge.table(spark, sf_dir, "benchmark")
    return b.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("name")).distinct()


FORMS = ("the", "and ", "License", "que", "zzz")


@query(f"""WITH f AS (SELECT unnest({list(FORMS)}) AS form)
SELECT form, count(*) AS n_texts, CAST(sum((length(text) - length(replace(text, form, ''))) // length(form)) AS BIGINT) AS n FROM documents JOIN f ON contains(text, form) GROUP BY form""")
def occurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textmine.form_counts(_texts(spark, sf_dir), spark.createDataFrame([(f,) for f in FORMS], "form string"))


@query("""WITH q AS (SELECT item_id, regexp_replace(text, '[\\s　 ]+', '', 'g') AS t FROM benchmark), d AS (SELECT doc_id, regexp_replace(text, '[\\s　 ]+', '', 'g') AS t FROM documents)
SELECT item_id AS quote_id, count(*) AS n_texts, min(doc_id) AS first_text, count(*) FILTER (WHERE contains(d.t, q.t)) AS n_whole
FROM q JOIN d ON contains(d.t, substr(q.t, 1, 40)) WHERE q.t <> '' GROUP BY item_id""")
def quote_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = bridge.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return textmine.locate_quotes(q, _texts(spark, sf_dir))


@query("""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS name FROM benchmark)
SELECT name, min(doc_id) AS first FROM n JOIN documents ON regexp_matches(text, '(^|[^·])' || name || '($|[^·（]|（($|[^第]))') GROUP BY name""")
def first_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capitalised words of the benchmark as names, found inside longer words too."""
    return textmine.first_mentions(_texts(spark, sf_dir), benchmark_names(spark, sf_dir))


WORD = "[a-z]{6,}"


@query(f"""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{WORD}'))) AS name FROM documents),
f AS (SELECT name, min(doc_id) AS first FROM t GROUP BY name), c AS (SELECT name, max(doc_id) AS claimed FROM t GROUP BY name)
SELECT name, claimed, first FROM f JOIN c USING (name) WHERE claimed - first > 5 AND name NOT IN (SELECT name FROM t WHERE doc_id % 50 = 0)""")
def first_occurrence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims are the last document of each word; the ledger has settled the words of every fiftieth."""
    texts = _texts(spark, sf_dir)
    tokens = texts.select("text_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("name"))
    claimed = tokens.groupBy("name").agg(F.max("text_id").alias("claimed"))
    firsts = textmine.first_occurrences(texts, claimed, WORD)
    ledger = tokens.where("text_id % 50 = 0").select("name").distinct()
    return textmine.audit_first(firsts, claimed, 5, ledger).select("name", "claimed", "first")


@query(f"""WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Z]{WORD}')) AS word FROM documents), g AS (SELECT word, count(*) AS n FROM t GROUP BY word HAVING count(*) >= 3)
SELECT word, n FROM g WHERE word NOT LIKE 'Th%' AND word NOT IN ('Licensed')""")
def gap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    known = texts.select(F.explode(F.regexp_extract_all("text", F.lit(f"[A-Z]{WORD}"), F.lit(0))).alias("name")).where("name LIKE 'Th%'").distinct()
    return textmine.gap_candidates(texts, f"[A-Z]{WORD}", known, 3, spark.createDataFrame([("Licensed",)], "name string"))


@query(f"""WITH tk AS (SELECT doc_id AS text_id, regexp_extract_all(text, '[A-Z]{WORD}') AS ws, regexp_split_to_array(text, '[A-Z]{WORD}') AS gs FROM documents),
ti AS (SELECT text_id, unnest(ws) AS word, unnest(list_transform(gs[1:len(ws)], lambda g: length(g))) AS gap, unnest(range(len(ws))) AS k FROM tk),
tp AS (SELECT text_id, word, CAST(sum(gap + length(word)) OVER (PARTITION BY text_id ORDER BY k) - length(word) AS INT) AS pos FROM ti)
SELECT DISTINCT a.text_id, a.pos, a.word FROM tp a JOIN tp b ON a.text_id = b.text_id AND a.word <> 'Licensed' AND b.word = 'Licensed' AND abs(a.pos - b.pos) <= {textmine.NEAR}""")
def gap_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words within 90 characters of a license line's first word."""
    texts = _texts(spark, sf_dir)
    found = textmine.positions(texts, f"[A-Z]{WORD}")
    return textmine.near_pairs(found.where("word <> 'Licensed'"), found.where("word = 'Licensed'"), textmine.NEAR)


@query("""SELECT doc_id AS text_id, round(10000 * (length(text) - length(replace(text, '·', ''))) / greatest(length(text), 1), 6) AS rate,
 round(10000 * (length(text) - length(replace(text, '·', ''))) / greatest(length(text), 1), 6) >= 5 AS translation FROM documents""")
def script_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textmine.script_kind(_texts(spark, sf_dir))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS nth, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(line, '^Licensed|^[A-Z][a-z]+\\.$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY nth) AS INT) AS chapter FROM l)
SELECT doc_id AS text_id, chapter, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM m GROUP BY ALL""")
def chapter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textmine.chapters(_texts(spark, sf_dir), r"^Licensed|^[A-Z][a-z]+\.$")


@query("""SELECT conv_id, turn, CASE WHEN regexp_extract(trim(text), '^([^：:]+)[：:]', 1) = '' THEN trim(text) ELSE regexp_extract(trim(text), '^([^：:]+)[：:]', 1) END AS short,
 regexp_replace(regexp_replace(lower(role || ' ' || conv_id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM conversations""")
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bridge.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", short_name(F.col("text")).alias("short"), slug(F.concat_ws(" ", "role", F.col("conv_id").cast("string"))).alias("slug"))


@query("""WITH led AS (SELECT doc_id, quality AS lang_ok FROM labels), dat AS (SELECT doc_id, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS lang_ok FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlisted' WHEN d.doc_id IS NULL THEN 'stale' ELSE 'differs' END AS problem
FROM led l FULL JOIN dat d ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR d.doc_id IS NULL OR l.lang_ok <> d.lang_ok""")
def ledger_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = bridge.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("ok"))
    data = bridge.table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("n_chars") > 600, 1).otherwise(0).alias("ok"))
    return ledgers.reconcile(ledger, data, ["doc_id"], "ok")


REPORT_SQL = f"""{DEGREE_SQL}, found AS (
 SELECT 'warning' AS severity, 'first chapter missing' AS kind, id AS subject FROM chars WHERE first_ch IS NULL
 UNION ALL SELECT 'warning', 'character name repeated', name FROM chars GROUP BY name HAVING count(*) > 1
 UNION ALL SELECT 'warning', 'mentioned without relation', id FROM chars JOIN deg USING (id) WHERE tier = 'mentioned' AND degree = 0
 UNION ALL SELECT 'warning', 'many relations, no alias', id FROM deg WHERE degree >= 8
 UNION ALL SELECT 'warning', 'relation without evidence', CAST(ord AS VARCHAR) FROM rels WHERE derived
 UNION ALL SELECT 'error', 'relation to nobody', dst FROM rels WHERE dst = 's1' GROUP BY dst)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One supplier is left out, so that its relations dangle."""
    nodes, rels = map(cut_lineage, book(spark, sf_dir))  # every rule reads them
    degree = view.degrees(rels, nodes)
    return validate.report(validate.characters(nodes, degree) + validate.relations(rels, nodes.where("id <> 's1'")))


@query(f"WITH {REPORT_SQL} SELECT * FROM found")
def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@query(f"WITH {REPORT_SQL} SELECT severity, kind, count(*) AS n FROM found GROUP BY ALL")
def validate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.summary(_report(spark, sf_dir))
