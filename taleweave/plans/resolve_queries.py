"""Names, duplicates, search and pruning."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.operators import resolve, view
from taleweave.operators.view import ViewState
from taleweave.plans.base import query
from taleweave.plans.text_queries import benchmark_names
from taleweave.plans.view_queries import DEGREE_SQL, LAST, book
from taleweave.sources import bridge


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bridge.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_brand").alias("faction"), F.col("p_size").cast("long").alias("degree"))


@query("SELECT trim(regexp_replace(p_name, '[（(].*$', '')) AS base, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) > 1")
def dup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.dupe_groups(_parts(spark, sf_dir))


@query("""WITH p AS (SELECT p_partkey AS id, lower(regexp_replace(p_name || ' ' || p_brand || (p_size % 3), '[\\s·•.]', '', 'g')) AS norm, p_brand AS faction, CAST(p_size AS BIGINT) AS degree FROM part),
g AS (SELECT norm, arg_max(id, struct_pack(d := degree, o := -id)) AS into_ FROM p WHERE length(norm) >= 2 GROUP BY norm HAVING count(*) > 1 AND min(faction) = max(faction))
SELECT id, into_ AS "into" FROM p JOIN g USING (norm) WHERE id <> into_""")
def dedupe_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir).withColumn("name", F.concat("name", F.lit(" "), "faction", F.col("degree") % 3))
    return resolve.merge_map(p)


@query("""WITH m AS (SELECT id, min(id) OVER (PARTITION BY faction, first_ch) AS into_ FROM chars WHERE generation = 1 AND first_ch IS NOT NULL)
SELECT ord, coalesce(into_, src) AS src, dst FROM rels LEFT JOIN m ON id = src WHERE coalesce(into_, src) <> dst""")
def remapped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir)
    own = nodes.where("generation = 1 AND first_ch IS NOT NULL").select("id", "faction", "first_ch")
    to = own.groupBy("faction", "first_ch").agg(F.min("id").alias("into"))
    return resolve.remap_edges(rels, own.join(to, ["faction", "first_ch"]).select("id", "into")).select("ord", "src", "dst")


@query("""WITH f AS (SELECT p_name AS form, p_brand AS id, 1 AS exact FROM part UNION ALL SELECT split_part(p_name, ' ', 1), p_brand, 0 FROM part),
b AS (SELECT form, max(exact) AS exact FROM f GROUP BY 1), i AS (SELECT form, exact, count(DISTINCT id) AS n, min(id) AS id FROM f JOIN b USING (form, exact) GROUP BY ALL),
asked AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part UNION SELECT 'nobody')
SELECT name, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN n = 1 THEN id END AS id,
 CASE WHEN n IS NOT NULL THEN CASE WHEN exact = 1 THEN 'exact' ELSE 'loose' END END AS how FROM asked LEFT JOIN i ON form = name""")
def name_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bridge.table(spark, sf_dir, "part")
    first = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    forms = p.select(F.col("p_name").alias("form"), F.col("p_brand").alias("id"), F.lit(1).alias("exact")).unionByName(p.select(first.alias("form"), F.col("p_brand").alias("id"), F.lit(0).alias("exact")))
    asked = p.select(F.col("p_name").alias("name")).union(p.select(first)).union(spark.createDataFrame([("nobody",)], "name string")).distinct()
    return resolve.resolve_names(asked, forms)


ASKED = ("#000000012", "1", "supplier#0000000", "CUSTOMER#00000000", "zzz")


@query(f"""WITH asked AS (SELECT unnest({list(ASKED)}) AS asked), c AS (SELECT *, CASE WHEN coalesce(first_ch, 0) > 20 THEN 3 WHEN tier = 'mentioned' THEN 2 ELSE 1 END AS bucket FROM chars)
SELECT asked, bucket, id FROM asked JOIN c ON contains(lower(name), lower(asked)) QUALIFY row_number() OVER (PARTITION BY asked ORDER BY bucket, ord) = 1""")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = replace(ViewState(LAST, progress=20), show_mentioned=False)
    nodes, _ = book(spark, sf_dir)
    asked = spark.createDataFrame([(a,) for a in ASKED], "asked string")
    return resolve.search(nodes, asked, ~state.not_yet(F.col("first_ch")), state.hidden(F.col("tier")), state.locked(F.col("first_ch")))


@query(f"""WITH {DEGREE_SQL} SELECT c.id, c.name, degree, CAST(row_number() OVER (ORDER BY degree DESC, c.ord) AS INT) AS nth
FROM chars c JOIN deg USING (id) WHERE contains(lower(name), '1') QUALIFY nth <= 60""")
def combo_top60(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir)
    return resolve.ranked_suggestions(view.degrees(rels, nodes), "1")


@query("SELECT id FROM chars WHERE id NOT IN (SELECT src FROM rels WHERE ch < 6 UNION SELECT dst FROM rels WHERE ch < 6)")
def prune_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters without a relation in the first five chapters."""
    nodes, rels = book(spark, sf_dir)
    return resolve.orphans(nodes, rels.where("ch < 6")).select("id")


@query(f"WITH {DEGREE_SQL} SELECT c.id, CASE WHEN degree <= 1 AND tier <> 'mentioned' THEN 'minor' ELSE tier END AS tier FROM chars c JOIN deg USING (id)")
def demote_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = book(spark, sf_dir)
    return resolve.demote(view.degrees(rels, nodes), 1).select("id", "tier")


@query("""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS name FROM benchmark)
SELECT doc_id AS text_id, 'n_' || name AS id FROM documents JOIN n ON regexp_matches(text, '(^|[^·])' || name || '($|[^·（]|（($|[^第]))')""")
def mention_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = benchmark_names(spark, sf_dir).withColumn("id", F.concat(F.lit("n_"), "name"))
    return resolve.link_mentions(bridge.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text"), names)


PAIRS = (("small", "little"), ("green", "verdant"), ("o", "0"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), pr AS (SELECT * FROM (VALUES ('small', 'little'), ('green', 'verdant'), ('o', '0')) v(a, b)),
b AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr)
SELECT name, name AS variant FROM n UNION SELECT name, substr(name, 1, instr(name, a) - 1) || b || substr(name, instr(name, a) + length(a)) FROM n JOIN b ON contains(name, a)""")
def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = bridge.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return resolve.variants(names, spark.createDataFrame(list(PAIRS), "a string, b string"))


@query("""WITH st AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS title FROM customer WHERE c_custkey % 2 = 0),
b AS (SELECT c_custkey AS id, 'new ' || c_custkey AS name, c_mktsegment AS title FROM customer)
SELECT coalesce(st.id, b.id) AS id, coalesce(nullif(st.name, ''), b.name) AS name, coalesce(nullif(st.title, ''), b.title) AS title FROM st FULL JOIN b ON st.id = b.id""")
def upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bridge.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("title"))
    state = c.where("id % 2 = 0").withColumn("title", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("title")))
    batch = c.select("id", F.concat(F.lit("new "), "id").alias("name"), "title", F.col("id").alias("ord"))
    once = resolve.upsert(state, batch, ["id"], ["name", "title"])
    return resolve.upsert(once, batch, ["id"], ["name", "title"])
