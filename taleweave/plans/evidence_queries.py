"""Audits of evidence and ledger quotes over conversations, and lenient JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.functions import lenient
from taleweave.operators import evidence, ledgers
from taleweave.plans.base import query
from taleweave.sources import bridge

KINDS = ("父子", "夫妻", "盟友", "兄弟（义）")
NAME = "[A-Z][a-z]{3,}"
# Every conversation's rest by 3 is a book; its people are the capitalised words; the texts of half the conversations are the book, and book b2 has none.
TURNS_SQL = f"""c AS (SELECT 'b' || (conv_id % 3) AS book, conv_id, conv_id * 1000 + turn AS rel, turn, text, regexp_extract_all(text, '{NAME}') AS names FROM conversations),
links AS (SELECT book, rel, 'n_' || names[1] AS src, 'n_' || names[2] AS dst, ({list(KINDS)})[conv_id % 4 + 1] AS type FROM c WHERE len(names) >= 2
 UNION ALL SELECT book, -1 - rel, 'n_' || names[1], 'n_' || names[3], '母子' FROM c WHERE len(names) >= 3),
people AS (SELECT DISTINCT book, unnest(names) AS name FROM c),
forms AS (SELECT book, 'n_' || name AS char, name AS main, name AS form FROM people UNION SELECT book, 'n_' || name, name, left(name, 4) FROM people WHERE length(name) >= 6),
src AS (SELECT book, regexp_replace(string_agg(text, ' ' ORDER BY conv_id, turn), '[\\s·]', '', 'g') AS text FROM c WHERE conv_id % 6 < 2 GROUP BY book)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bridge.table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("b"), F.col("conv_id") % 3).alias("book"), "conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("rel"), "turn", "text", F.regexp_extract_all("text", F.lit(NAME), F.lit(0)).alias("names"))


def _people(turns: DataFrame) -> DataFrame:
    name = turns.select("book", F.explode("names").alias("name")).distinct()
    return name.select("book", F.concat(F.lit("n_"), "name").alias("id"), "name", F.when(F.char_length("name") >= 6, F.array(F.left("name", F.lit(4)))).alias("aliases"))


def _sources(turns: DataFrame) -> DataFrame:
    nth = F.col("conv_id").cast("long") * 2**24 + F.coalesce("turn", F.lit(-1))
    return turns.where("conv_id % 6 < 2").select("book", nth.alias("nth"), F.coalesce("text", F.lit("")).alias("text"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    end = lambda k: F.concat(F.lit("n_"), F.get("names", F.lit(k)))
    rels = t.where(F.size("names") >= 2).select("book", "rel", end(0).alias("src"), end(1).alias("dst"), F.get(F.array(*map(F.lit, KINDS)), (F.col("conv_id") % 4).cast("int")).alias("type"))
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("他说「"), F.left("text", F.lit(24)), F.lit("」"))).when(F.col("turn") % 3 == 1, F.left("text", F.lit(200)))
    more = t.where(F.size("names") >= 3).select("book", (-1 - F.col("rel")).alias("rel"), end(0).alias("src"), end(2).alias("dst"), F.lit("母子").alias("type"))
    told = t.select("book", "rel", F.col("turn").alias("nth"), F.coalesce(said, F.concat(F.lit("「"), F.substring("text", 5, 30), F.lit("」"), F.coalesce(F.get("names", F.lit(2)), F.lit("x")))).alias("text"), F.lit(False).alias("derived"))
    return evidence.actor_findings(rels.unionByName(more), told, _people(t), _sources(t))


FINDINGS_SQL = rf"""{TURNS_SQL},
e AS (SELECT c.book, c.rel, turn AS nth, src, dst, CASE turn % 3 WHEN 0 THEN '他说「' || left(text, 24) || '」' WHEN 1 THEN left(text, 200) ELSE '「' || substr(text, 5, 30) || '」' || coalesce(names[3], 'x') END AS text FROM c JOIN links USING (rel)),
ev AS (SELECT *, regexp_replace(text, '[\s·]', '', 'g') AS whole, regexp_matches(text, '「[^」]{{2,}}」') AS verbatim, regexp_replace(regexp_extract(text, '「([^」]+)」', 1), '[\s·]', '', 'g') AS q FROM e),
named AS (SELECT ev.*, char, main, form, char IN (src, dst) AS is_end FROM ev JOIN forms ON forms.book = ev.book AND contains(whole, form)),
loc AS (SELECT rel FROM ev JOIN src ON src.book = ev.book WHERE (length(q) >= 2 AND contains(src.text, left(q, 40))) OR contains(src.text, left(whole, 40))),
adj AS (SELECT book, src AS a, dst AS b FROM links WHERE type <> '盟友' UNION SELECT book, dst, src FROM links WHERE type <> '盟友'),
third AS (SELECT DISTINCT n.rel, n.char FROM named n WHERE form = main AND NOT is_end AND EXISTS (SELECT 1 FROM adj WHERE adj.book = n.book AND a IN (src, dst) AND b = n.char)
  AND NOT EXISTS (SELECT 1 FROM forms p WHERE p.book = n.book AND p.char IN (n.src, n.dst) AND (contains(p.form, n.main) OR contains(n.main, p.form)))),
thirds AS (SELECT rel, list_sort(list(char)) AS chars FROM third GROUP BY rel),
f AS (SELECT ev.book, ev.rel, nth, src, dst, verbatim AND regexp_matches(whole, '[他她其此人该]') AND ev.rel NOT IN (SELECT rel FROM named WHERE is_end) AS nameless,
  CASE WHEN ev.book <> 'b2' THEN ev.rel IN (SELECT rel FROM loc) AND chars IS NOT NULL END AS third,
  CASE WHEN ev.book <> 'b2' THEN verbatim AND ev.rel NOT IN (SELECT rel FROM loc) END AS missing,
  CASE WHEN ev.book <> 'b2' AND ev.rel IN (SELECT rel FROM loc) THEN coalesce(chars, []) ELSE [] END AS thirds FROM ev LEFT JOIN thirds t ON t.rel = ev.rel)"""


@query(f"WITH {FINDINGS_SQL} SELECT book, rel, nth, src, dst, nameless, third, missing, array_to_string(thirds, ' ') AS thirds FROM f")
def actor_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).withColumn("thirds", F.array_join("thirds", " "))


@query(f"""WITH {FINDINGS_SQL}, fl AS (SELECT book, src, dst, (CASE WHEN bool_or(nameless) THEN 'A' ELSE '' END) || (CASE WHEN bool_or(third) THEN 'B' ELSE '' END) || (CASE WHEN bool_or(missing) THEN 'C' ELSE '' END) AS flag FROM f GROUP BY ALL),
led AS (SELECT book, src, dst, CASE WHEN min(rel) % 4 = 0 THEN 'ABC' ELSE 'C' END AS flag, min(rel) % 5 AS short FROM links WHERE rel >= 0 AND rel % 1000 <> 1 GROUP BY ALL),
b AS (SELECT coalesce(l.book, d.book) AS book, coalesce(l.src, d.src) AS src, coalesce(l.dst, d.dst) AS dst, l.flag AS said, d.flag AS found, short FROM led l FULL JOIN (SELECT * FROM fl WHERE flag <> '') d ON l.book = d.book AND l.src = d.src AND l.dst = d.dst)
SELECT book, src, dst, 'unlisted' AS problem FROM b WHERE said IS NULL UNION ALL SELECT book, src, dst, 'stale' FROM b WHERE found IS NULL UNION ALL SELECT book, src, dst, 'differs' FROM b WHERE said <> found
UNION ALL SELECT book, src, dst, 'no reason' FROM b WHERE said IS NOT NULL AND short = 0""")
def actor_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger made of the relations but for those of second turns, against the flags found."""
    t = _turns(spark, sf_dir).where(F.size("names") >= 2)
    end = lambda k: F.concat(F.lit("n_"), F.get("names", F.lit(k)))
    led = t.where("rel % 1000 <> 1").groupBy("book", end(0).alias("src"), end(1).alias("dst")).agg(F.min("rel").alias("r"))
    led = led.select("book", "src", "dst", F.when(F.col("r") % 4 == 0, "ABC").otherwise("C").alias("flag"), F.when(F.col("r") % 5 == 0, "so").otherwise("read in the source").alias("why"))
    return ledgers.actor_problems(led, evidence.relation_flags(_findings(spark, sf_dir)))


@query(rf"""WITH {TURNS_SQL.replace('·', '')},
q AS (SELECT book, rel AS entry, names[1] AS subject, CASE turn % 4 WHEN 0 THEN left(text, 30) WHEN 1 THEN left(text, 12) || '……' || substr(text, 40, 9) WHEN 2 THEN names[1] || ' says' ELSE substr(text, 3, 9) || '…' || left(text, 9) END AS quote FROM c WHERE len(names) >= 1),
f AS (SELECT *, regexp_replace(quote, '\s', '', 'g') AS flat FROM q)
SELECT f.book, entry, CAST(0 AS INT) AS nth, quote, CASE WHEN f.book = 'b2' THEN 'not judged'
 WHEN contains(quote, '…') THEN CASE WHEN regexp_matches(s.text, regexp_escape(regexp_extract(flat, '^([^…]*)…+([^…]*)$', 1)) || '.*' || regexp_escape(regexp_extract(flat, '^([^…]*)…+([^…]*)$', 2))) THEN 'elided' ELSE 'elided, missing' END
 WHEN NOT contains(flat, subject) THEN 'aside' WHEN contains(s.text, flat) THEN 'found' ELSE 'missing' END AS verdict
FROM f LEFT JOIN src s ON s.book = f.book""")
def ledger_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons that quote the first words of a turn, with and without dots of omission, once in the wrong order."""
    t = _turns(spark, sf_dir)
    part = lambda a, n: F.substring("text", a, n)
    quote = F.when(F.col("turn") % 4 == 0, part(1, 30)).when(F.col("turn") % 4 == 1, F.concat(part(1, 12), F.lit("……"), part(40, 9))).when(F.col("turn") % 4 == 2, F.concat(F.get("names", F.lit(0)), F.lit(" says"))).otherwise(F.concat(part(3, 9), F.lit("…"), part(1, 9)))
    ledger = t.where(F.size("names") >= 1).select("book", F.col("rel").alias("entry"), F.concat(F.lit("see 「"), quote, F.lit("」")).alias("why"), F.array(F.get("names", F.lit(0))).alias("subjects"))
    return evidence.ledger_quotes(ledger, _sources(t))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"id": ' || event_id || ', "p": ' || props || '}' WHEN 1 THEN NULL ELSE '{"a": ' || props || '}' END AS mended FROM events""")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events inside objects that are cut off, inside nothing that closes, and inside a whole object with words around it."""
    e = bridge.table(spark, sf_dir, "events")
    cut = F.concat(F.lit('so: {"id": '), "event_id", F.lit(', "p": '), "props", F.lit(', "l": [1, "'), "event_type")
    text = F.when(F.col("event_id") % 3 == 0, cut).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"id": "'), "event_type")).otherwise(F.concat(F.lit('it is {"a": '), "props", F.lit("} then")))
    return e.select("event_id", lenient.repair_json(text).alias("mended"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN least(c_name, c_mktsegment) || ' ' || greatest(c_name, c_mktsegment) WHEN 2 THEN '' WHEN 3 THEN '' END AS names, CASE c_custkey % 5 WHEN 2 THEN 'no list' WHEN 3 THEN 'no JSON' END AS error FROM customer""")
def ledger_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers of names as a list, as an object with one, as an object without, as broken text, and none."""
    c = bridge.table(spark, sf_dir, "customer")
    shape = F.col("c_custkey") % 5
    text = (
        F.when(shape == 0, F.concat(F.lit('["_why", "'), "c_name", F.lit('", {"name": "'), "c_name", F.lit('"}, 7]')))
        .when(shape == 1, F.concat(F.lit('{"_说明": "x", "明细": [{"name": "'), "c_name", F.lit('"}, "'), "c_mktsegment", F.lit('"]}')))
        .when(shape == 2, F.concat(F.lit('{"names": ["'), "c_name", F.lit('"]}')))
        .when(shape == 3, F.concat(F.lit('["'), "c_name"))
    )
    read = lenient.ledger_names(text)
    return c.select("c_custkey", F.array_join(read["names"], " ").alias("names"), read["error"].alias("error"))
