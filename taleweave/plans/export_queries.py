"""Exports, packs, positions filled in, and speakers nobody knows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.operators import graph, layout, textmine
from taleweave.operators.view import ViewState
from taleweave.plans.base import query
from taleweave.sources import bridge, exports, packs

STATE = ViewState(80, progress=20, time_travel=True, chapter=6)


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of one pair, type and style as one, each line item a piece of evidence with its chapter and place."""
    rels = bridge.relations(spark, sf_dir)
    one = bridge.relation_places(spark, sf_dir, rels)
    events = F.array_sort(F.collect_list(F.struct("ord", "ch", "place"))).alias("events")
    return one.groupBy("src", "dst", "type", "style").agg(F.min("ch").alias("ch"), F.min("from_ch").alias("from_ch"), F.max("to_ch").alias("to_ch"), F.first("kin").alias("kin"), F.lit(False).alias("derived"), events)


@query("""WITH cs AS (SELECT id FROM chars WHERE coalesce(first_ch, 0) <= 6),
rs AS (SELECT src, dst, type, style, min(ch) AS ch, min(from_ch) AS f, max(to_ch) AS t, list({'ch': ch, 'place': place}) AS ev FROM rel_places GROUP BY ALL),
ks AS (SELECT *, list_filter(ev, lambda e: e.ch <= 6) AS seen FROM rs WHERE ch <= 20 AND f <= 6 AND (t IS NULL OR t > 6) AND src IN (SELECT id FROM cs) AND dst IN (SELECT id FROM cs)),
es AS (SELECT event, event_place FROM (SELECT event, ch, upper(substr(event, 1, 1)) AS event_place FROM plot) WHERE ch <= 6),
ps AS (SELECT DISTINCT place FROM (SELECT unnest(seen).place AS place FROM ks UNION SELECT event_place FROM es))
SELECT 'character' AS kind, id, CAST(0 AS BIGINT) AS n FROM cs UNION ALL SELECT 'relation', src || ' ' || dst || ' ' || type || ' ' || style, len(seen) FROM ks
UNION ALL SELECT 'event', event, 0 FROM es UNION ALL SELECT 'place', place, 0 FROM ps WHERE place IN (SELECT place FROM rel_places)""")
def standalone_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export at progress 20, travelled back to chapter 6: what is in it, and how much evidence is left of each relation."""
    events = bridge.plot_events(spark, sf_dir).withColumn("place", F.upper(F.substring("event", 1, 1)))
    out = exports.standalone(STATE, bridge.characters(spark, sf_dir), _nested(spark, sf_dir), events, bridge.places(spark, sf_dir))
    row = lambda df, kind, name, n=None: df.select(F.lit(kind).alias("kind"), name.alias("id"), (n if n is not None else F.lit(0)).cast("long").alias("n"))
    rels = row(out["relations"], "relation", F.concat_ws(" ", "src", "dst", "type", "style"), F.size("events"))
    return row(out["characters"], "character", F.col("id")).unionByName(rels).unionByName(row(out["events"], "event", F.col("event"))).unionByName(row(out["places"], "place", F.col("place")))


BOOK_SQL = "'b' || (CAST(substr({0}, 2) AS BIGINT) % 3)"


@query(f"""WITH own AS (SELECT src AS id FROM rels UNION ALL SELECT dst FROM rels WHERE {BOOK_SQL.format('src')} = {BOOK_SQL.format('dst')})
SELECT {BOOK_SQL.format('c.id')} AS book, c.id, count(own.id) AS degree FROM chars c LEFT JOIN own ON own.id = c.id GROUP BY c.id""")
def pack_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third character is of one book, and a relation of its first end's; degrees count the ends in it."""
    book = lambda c: F.concat(F.lit("b"), F.substring(c, 2, 20).cast("long") % 3)
    chars = bridge.characters(spark, sf_dir).select(book("id").alias("book"), "id")
    rels = bridge.relations(spark, sf_dir).select(book("src").alias("book"), "src", "dst", "ord")
    nowhere = chars.limit(0).select("book", F.lit("").alias("layout"), "id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return exports.pack_collections(chars, rels, nowhere)["characters"].select("book", "id", "degree")


@query("""WITH pl AS (SELECT id, CAST(ord % 101 AS DOUBLE) AS x, CAST(ord % 37 AS DOUBLE) AS y FROM chars WHERE tier = 'main'), ce AS (SELECT avg(x) AS cx, avg(y) AS cy FROM pl),
mc AS (SELECT id, ord FROM chars WHERE tier <> 'main' AND id LIKE 'c%'), ms AS (SELECT id, ord FROM chars WHERE tier <> 'main' AND id LIKE 's%'),
ca AS (SELECT mc.id, avg(x) AS x, avg(y) AS y FROM mc JOIN rels ON src = mc.id JOIN pl ON pl.id = dst GROUP BY mc.id),
al AS (SELECT id, ord FROM mc WHERE id NOT IN (SELECT id FROM ca) UNION ALL SELECT id, ord FROM ms WHERE id NOT IN (SELECT dst FROM rels)),
sp AS (SELECT id, row_number() OVER (ORDER BY ord) - 1 AS k FROM al), so AS (SELECT id, cx + cos(k * 2.399963) * 18 * sqrt(k + 1) AS x, cy + sin(k * 2.399963) * 18 * sqrt(k + 1) AS y FROM sp, ce),
kn AS (SELECT * FROM pl UNION ALL SELECT * FROM ca UNION ALL SELECT * FROM so),
sa AS (SELECT ms.id, avg(x) AS x, avg(y) AS y FROM ms JOIN rels ON dst = ms.id JOIN kn ON kn.id = src GROUP BY ms.id)
SELECT id, round(x, 5) AS x, round(y, 5) AS y FROM (SELECT * FROM ca UNION ALL SELECT * FROM so UNION ALL SELECT * FROM sa)""")
def positions_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main characters have places; customers come before suppliers, so the others follow in two waves."""
    chars, rels = bridge.characters(spark, sf_dir), bridge.relations(spark, sf_dir)
    placed = chars.where("tier = 'main'").select("id", (F.col("ord") % 101).cast("double").alias("x"), (F.col("ord") % 37).cast("double").alias("y"))
    both = graph.adjacency(rels, chars).select("at", "to")
    return layout.fill_positions(chars, placed, both).select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


SAYS, TAIL, NOBODY = "([a-z]{2,8})(?:ed|ing|ly)?,", "(?:tion|ing|ed|ly)$", "^(?:the|and|of|that)"


@query(rf"""WITH w AS (SELECT regexp_replace(regexp_replace(w, '{TAIL}', ''), '{TAIL}', '') AS name FROM (SELECT unnest(regexp_extract_all(text, '{SAYS}', 1)) AS w FROM documents)),
g AS (SELECT name, count(*) AS said FROM w WHERE length(name) BETWEEN 5 AND 7 AND NOT regexp_matches(name, '{NOBODY}') AND left(name, 1) IN ('t', 'h', 's') GROUP BY name),
kn AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS name FROM benchmark)
SELECT name, said, CAST(sum((length(text) - length(replace(text, name, ''))) // length(name)) AS BIGINT) AS n FROM g JOIN documents ON contains(text, name) WHERE name NOT IN (SELECT name FROM kn) GROUP BY ALL HAVING n >= 12""")
def unseen_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words before commas stand for speakers, the benchmark's words for known names."""
    texts = bridge.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    known = bridge.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("name"))
    signs = spark.createDataFrame([(x,) for x in "ths"], "sign string")
    return textmine.unseen_speakers(texts, known, signs, 12, SAYS, TAIL, NOBODY, (5, 7))


def _library(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Characters and relations of three books, and a place of every character in two layouts."""
    book = lambda c: F.concat(F.lit("b"), F.substring(c, 2, 20).cast("long") % 3)
    chars = bridge.characters(spark, sf_dir).select(book("id").alias("book"), "id", "name", F.array("faction", "tier").alias("tags"))
    rels = bridge.relations(spark, sf_dir).select(book("src").alias("book"), "src", "dst", "type", "kin")
    places = chars.select("book", F.explode(F.array(F.lit("gen-v"), F.lit("force"))).alias("layout"), "id", F.length("id").cast("double").alias("x"), F.lit(0.4).alias("y"))
    return {"characters": chars, "relations": rels}, places


@query(f"""WITH c AS (SELECT {BOOK_SQL.format('id')} AS book, * FROM chars), d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM rels UNION ALL SELECT dst FROM rels WHERE {BOOK_SQL.format('src')} = {BOOK_SQL.format('dst')}) GROUP BY id)
SELECT 'characters' AS collection, book, id AS key, faction || ' ' || tier || ' ' || coalesce(n, 0) AS held, CAST(1 AS BIGINT) AS n FROM c LEFT JOIN d USING (id)
UNION ALL SELECT 'relations', {BOOK_SQL.format('src')}, src || ' ' || dst, type || ' ' || coalesce(kin, '-'), count(*) FROM rels GROUP BY ALL
UNION ALL SELECT 'layouts', book, id, l || ' ' || length(id) || ' 0', 1 FROM c, (VALUES ('gen-v'), ('force')) v(l)""")
def packs_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of three books written to the shared folder, by collection and book, and read back."""
    source, places = _library(spark, sf_dir)
    path = f"{graph.shared_folder(spark)}/packs-{uuid.uuid4().hex}"
    exports.write_packs(exports.pack_collections(source["characters"], source["relations"], places), path)
    schemas = {"characters": "id string, name string, tags array<string>, degree long", "relations": "src string, dst string, type string, kin string", "layouts": "layout string, id string, x long, y long"}
    back = exports.read_packs(spark, path, schemas)
    row = lambda name, key, held: back[name].select(F.lit(name).alias("collection"), "book", key.alias("key"), held.alias("held"))
    chars = row("characters", F.col("id"), F.concat_ws(" ", F.array_join("tags", " "), "degree"))
    rels = row("relations", F.concat_ws(" ", "src", "dst"), F.concat_ws(" ", "type", F.coalesce("kin", F.lit("-"))))
    every = chars.unionByName(rels).unionByName(row("layouts", F.col("id"), F.concat_ws(" ", "layout", "x", "y")))
    return every.groupBy("collection", "book", "key", "held").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT {BOOK_SQL.format('id')} AS book, ord, id FROM chars), r AS (SELECT {BOOK_SQL.format('src')} AS book, src, dst, ord FROM rels),
p AS (SELECT book, count(*) FILTER (WHERE ord % 10 = 0) AS renamed, count(*) FILTER (WHERE ord % 13 = 0) AS lost, count(*) FILTER (WHERE ord % 17 = 0) AS endless FROM c GROUP BY book)
SELECT book, 'characters out of step' AS problem, CAST(2 * renamed AS BIGINT) AS n FROM p WHERE renamed > 0
UNION ALL SELECT book, 'relations out of step', count(*) FROM r WHERE ord % 50 = 0 GROUP BY book UNION ALL SELECT book, 'degree', 2 * count(*) FROM c WHERE ord % 9 = 0 GROUP BY book
UNION ALL SELECT book, 'layout gen-v', count(*) FROM c WHERE ord % 13 = 0 OR ord % 17 = 0 GROUP BY book UNION ALL SELECT book, 'layout gen-h', count(*) FROM c GROUP BY book""")
def pack_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs in which every tenth character is renamed, some relations are lost, degrees are off, and places are lost or endless."""
    source, places = _library(spark, sf_dir)
    packs = exports.pack_collections(source["characters"], source["relations"], places)
    nth = bridge.characters(spark, sf_dir).select("id", "ord")
    chars = packs["characters"].join(nth, "id").withColumn("name", F.when(F.col("ord") % 10 == 0, F.upper("name")).otherwise(F.col("name"))).withColumn("degree", F.col("degree") + (F.col("ord") % 9 == 0).cast("long")).drop("ord")
    book = F.concat(F.lit("b"), F.substring("src", 2, 20).cast("long") % 3)
    rels = bridge.relations(spark, sf_dir).where("ord % 50 <> 0").select(book.alias("book"), "src", "dst", "type", "kin")
    moved = places.join(nth, "id").where("NOT (layout = 'gen-v' AND ord % 13 = 0)").withColumn("x", F.when((F.col("layout") == "gen-v") & (F.col("ord") % 17 == 0), float("nan")).otherwise(F.col("x"))).drop("ord")
    return exports.pack_problems(source, {"characters": chars, "relations": rels, "layouts": moved}, ("gen-v", "gen-h", "force"))


@query("""SELECT n_nationkey AS key, n_name AS title, CAST((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS INT) AS chapters FROM nation""")
def script_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation's pack as a script around JSON, written to the shared folder and read back."""
    n = bridge.table(spark, sf_dir, "nation")
    count = bridge.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").cast("int").alias("chapters"))
    books = n.join(count, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    doc = F.to_json(F.struct(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("title"), F.coalesce("chapters", F.lit(0)).alias("chapters")).alias("meta")))
    path = f"{graph.shared_folder(spark)}/scripts-{uuid.uuid4().hex}"
    books.select(F.concat(F.lit("module.exports = "), doc, F.lit(";\n")).alias("value"), F.col("n_nationkey").alias("book")).write.partitionBy("book").text(path)
    return packs.read_pack(spark, path, "meta struct<key: int, title: string, chapters: int>").select("meta.*")
