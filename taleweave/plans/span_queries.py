"""Spans of known forms in texts, names swallowed by longer ones, and dotted names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.operators import dotted, gaps, matching
from taleweave.plans.base import query
from taleweave.sources import bridge

# Long words of the benchmark are known forms, and so are their last six letters: nested in the words, and elsewhere alone.
# None ends as it begins, so that SQL can find all places by splitting.
NO_BORDER = "len(list_filter(range(1, length({0})), lambda k: left({0}, k) = right({0}, k))) = 0"
WORDS_SQL = f"""words AS (SELECT DISTINCT form FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{{8,16}}')) AS form FROM benchmark) WHERE {NO_BORDER.format('form')} AND {NO_BORDER.format('right(form, 6)')}),
forms AS (SELECT form FROM words UNION SELECT right(form, 6) FROM words)"""
SPANS_SQL = f"""{WORDS_SQL},
pieces AS (SELECT doc_id AS text_id, form, unnest(string_split(text, form)) AS piece, unnest(range(len(string_split(text, form)))) AS k FROM documents JOIN forms ON contains(text, form)),
ends AS (SELECT text_id, form, k, sum(length(piece)) OVER (PARTITION BY text_id, form ORDER BY k) + k * length(form) AS start, max(k) OVER (PARTITION BY text_id, form) AS last FROM pieces),
spans AS (SELECT text_id, CAST(start AS INT) AS start, CAST(start + length(form) AS INT) AS stop, form FROM ends WHERE k < last)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bridge.table(spark, sf_dir, "benchmark")
    words = b.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{8,16}"), F.lit(0))).alias("form")).distinct()
    plain = lambda f: ~F.exists(F.sequence(F.lit(1), F.char_length(f) - 1), lambda k: F.left(f, k) == F.right(f, k))
    return words.where(plain(F.col("form")) & plain(F.right("form", F.lit(6))))


def _tails(words: DataFrame) -> DataFrame:
    return words.select(F.right("form", F.lit(6)).alias("form")).distinct()


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    return words.union(_tails(words)).distinct()


@query(f"WITH {SPANS_SQL} SELECT * FROM spans")
def known_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.spans(_texts(spark, sf_dir), _forms(spark, sf_dir))


@query(f"""WITH {WORDS_SQL}, f AS (SELECT list(form ORDER BY length(form) DESC, form) AS fs FROM forms)
SELECT doc_id AS text_id, list_reduce(fs, lambda t, x: replace(t, x, '{matching.MASK}'), text) AS text FROM documents, f""")
def masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return matching.masked(texts, matching.longest(matching.spans(texts, _forms(spark, sf_dir))))


@query(f"""WITH {SPANS_SQL}, p AS (SELECT text_id, start AS pos, form AS word FROM spans WHERE length(form) = 6)
SELECT text_id, pos, word FROM p WHERE EXISTS (SELECT 1 FROM spans s WHERE s.text_id = p.text_id AND length(s.form) > 6 AND pos BETWEEN s.start - 30 AND s.stop + 30)""")
def near_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short forms that stand within 30 characters of a long one."""
    found = matching.spans(_texts(spark, sf_dir), _forms(spark, sf_dir))
    places = found.where("char_length(form) = 6").select("text_id", F.col("start").alias("pos"), F.col("form").alias("word"))
    return matching.near_spans(places, found.where("char_length(form) > 6"), 30)


@query(f"""WITH {SPANS_SQL},
n AS (SELECT DISTINCT right(form, 6) AS char FROM words),
own AS (SELECT right(form, 6) AS char, form FROM words WHERE length(form) = 8),
named AS (SELECT text_id, char, start FROM spans JOIN n ON form = char),
hit AS (SELECT n.text_id, n.char, n.start, min(e.form) AS by_form FROM named n JOIN spans e ON e.text_id = n.text_id AND e.form IN (SELECT form FROM words) AND n.start - e.start BETWEEN 1 AND 3 AND e.stop > n.start
  AND length(e.form) >= 6 AND e.form <> n.char AND (n.char, e.form) NOT IN (SELECT char, form FROM own) GROUP BY ALL),
f AS (SELECT char, min((text_id, start)) AS first FROM named WHERE (text_id, char, start) NOT IN (SELECT text_id, char, start FROM hit) GROUP BY char)
SELECT f.char, f.char AS name, first[1] AS first_text, first[2] AS first_at, count(h.char) AS n_swallowed
FROM f LEFT JOIN hit h ON h.char = f.char AND (h.text_id, h.start) < first GROUP BY ALL""")
def first_clean_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short forms are names, swallowed by the words they end; words of eight letters are forms of the same character."""
    words = _words(spark, sf_dir)
    names = _tails(words).select(F.col("form").alias("char"), F.col("form").alias("name"))
    own = words.where("char_length(form) = 8").select(F.right("form", F.lit(6)).alias("char"), "form")
    return matching.first_clean(_texts(spark, sf_dir), names, words, own)


DOTTED_SQL = r"""cut AS (SELECT doc_id AS text_id, string_split(text, '.') AS p FROM documents WHERE text IS NOT NULL),
d AS (SELECT text_id, unnest(range(1, len(p))) AS j, unnest(list_transform(range(1, len(p)), lambda j: {'l': right(p[j], 5), 'r': array_to_string(list_transform(p[j + 1:j + 4], lambda s: left(s, 16)), '.')})) AS d FROM cut),
e AS (SELECT text_id, j, regexp_extract(d.l, '[a-z0-9]*$') AS l, regexp_extract(d.r, '^[a-z0-9]*(?:\.[a-z0-9]*){0,2}') AS r FROM d),
x AS (SELECT text_id, j, k, right(l, k) || '.' || left(r, m) AS name FROM e, range(2, 6) a(k), range(1, 16) b(m)
  WHERE k <= length(l) AND m <= length(r) AND NOT ends_with(left(r, m), '.') AND length(replace(left(r, m), '.', '')) BETWEEN 2 AND 12),
t AS (SELECT name, count(*) AS total FROM x GROUP BY name),
b AS (SELECT text_id, j, name FROM x JOIN t USING (name) QUALIFY row_number() OVER (PARTITION BY text_id, j ORDER BY total DESC, length(name) DESC, k) = 1),
g AS (SELECT name, count(*) AS n FROM b GROUP BY name)"""
KNOWN = ("mail1.example.com", "example", "mail5.example", "168")
SETTLED = ("mail9.example.com",)


@query(rf"""WITH {DOTTED_SQL}, kn AS (SELECT unnest({list(KNOWN)}) AS k),
s AS (SELECT * FROM g WHERE NOT (len(string_split(name, '.')) <= 2 AND EXISTS (SELECT 1 FROM kn WHERE list_contains(string_split(name, '.'), replace(k, '.', ''))))
  AND NOT EXISTS (SELECT 1 FROM kn WHERE contains(k, name)) AND NOT EXISTS (SELECT 1 FROM kn WHERE contains(name, k) AND length(name) - length(k) <= 3) AND n >= 2)
SELECT name, n FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.name <> s.name AND contains(o.name, s.name)) AND name NOT IN {SETTLED + ('',)}""")
def dotted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, addresses and versions as names held together by full stops."""
    named = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    return dotted.unknown_names(_texts(spark, sf_dir), named(KNOWN), named(SETTLED), 2, ".", "a-z0-9")


GAP, GAP_STOP, GAP_FILL = "th[a-z]{3,5}", "^(?:there|thing)", "[xkm]"


@query(f"""WITH {SPANS_SQL}, fs AS (SELECT list(form ORDER BY length(form) DESC, form) AS fs FROM forms),
m AS (SELECT doc_id AS text_id, list_reduce(fs, lambda t, x: replace(t, x, repeat('〇', length(x))), text) AS text FROM documents, fs WHERE text IS NOT NULL),
tk AS (SELECT text_id, regexp_extract_all(text, '{GAP}') AS ws, regexp_split_to_array(text, '{GAP}') AS gs FROM m),
ti AS (SELECT text_id, unnest(ws) AS name, unnest(list_transform(gs[1:len(ws)], lambda g: length(g))) AS gap, unnest(range(len(ws))) AS k FROM tk),
tp AS (SELECT text_id, name, sum(gap + length(name)) OVER (PARTITION BY text_id ORDER BY k) - length(name) AS pos FROM ti),
c AS (SELECT * FROM tp WHERE NOT regexp_matches(name, '{GAP_STOP}') AND NOT regexp_matches(name, '{GAP_FILL}') AND name NOT IN (SELECT form FROM forms)),
n AS (SELECT name, count(*) AS n FROM c GROUP BY name HAVING count(*) >= 4),
ok AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM forms WHERE contains(form, name) OR contains(name, form)) AND length(name) <> 7),
r AS (SELECT c.name, count(*) AS near FROM c JOIN ok USING (name) WHERE EXISTS (SELECT 1 FROM spans s WHERE s.text_id = c.text_id AND pos BETWEEN s.start - 40 AND s.stop + 40) GROUP BY c.name)
SELECT name, n, near FROM ok JOIN r USING (name)""")
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings with th as a surname, near known forms; those of seven letters are settled."""
    texts = _texts(spark, sf_dir)
    known = _forms(spark, sf_dir).withColumnRenamed("form", "name")
    settled = texts.select(F.explode(F.regexp_extract_all("text", F.lit("th[a-z]{5}"), F.lit(0))).alias("name")).where("char_length(name) = 7").distinct()
    return gaps.gap_report(texts, known, settled, GAP, GAP_STOP, GAP_FILL, "[aeiou]", 4, 40).select("name", "n", "near")
