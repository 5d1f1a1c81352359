"""What leaves the library: a book without spoilers, and packs of many books; and the folder of books that comes in."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.operators import view
from taleweave.operators.chronicle import evidence_within
from taleweave.operators.view import ViewState

# Names of files beside the books that are none themselves, and the ending of a book's structure without prose.
SIDE_FILE = r"\.(graph|text|annotations|missing-ok)\.json$|^(books|ui-notes|.*-ok|.*-exempt|.*-sources|.*-baseline|.*-form)\.json$"
GRAPH = ".graph.json"


def standalone(state: ViewState, chars: DataFrame, rels: DataFrame, events: DataFrame, places: DataFrame) -> dict[str, DataFrame]:
    """A book as a reader at ``state`` may have it: characters, relations, events, places.

    ``rels`` has ``events``, an array of evidence (ch, place and others), which
    is pruned in place; a relation whose evidence is all ahead stays without any.
    ``events``: ch, place and others; ``places``: place and others, of which those
    stay that some event or evidence still names.  Nodes beyond the progress go,
    where a view would draw them grey; size, tiers and focus don't count.
    """
    seen = lambda ch: ~state.locked(ch) & ~state.not_yet(ch)
    kept = chars.where(seen(F.col("first_ch")))
    ids = kept.select("id")
    told = rels.where(view.relation_open(state)).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    told = told.withColumn("events", evidence_within(F.col("events"), state))
    happened = events.where(seen(F.col("ch")))
    used = happened.select("place").union(told.select(F.explode("events").alias("e")).select("e.place")).where("place IS NOT NULL").distinct()
    return {"characters": kept, "relations": told.select(*rels.columns), "events": happened, "places": places.join(used, "place", "left_semi")}


def export_note(state: ViewState) -> str:
    """What an export says of itself."""
    return "whole book" if state.progress is None else f"up to chapter {state.progress}"


def write_packs(collections: Mapping[str, DataFrame], path: str) -> None:
    """Collections of many books (each with ``book``) as JSON lines: a folder a collection, in it a folder a book.

    Rows are rebalanced by book, so a small book is one file and a large one
    several; nothing holds a book as a whole.  A null book has a folder of its own.
    """
    for name, rows in collections.items():
        rows.hint("rebalance", "book").write.partitionBy("book").option("ignoreNullFields", False).mode("overwrite").json(f"{path}/{name}")


def read_packs(spark: SparkSession, path: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """The collections of ``write_packs`` by their schemas (without book); a book's rows come without an order."""
    return {name: spark.read.schema(f"{schema}, book string").json(f"{path}/{name}") for name, schema in schemas.items()}


def pack_collections(chars: DataFrame, rels: DataFrame, positions: DataFrame) -> dict[str, DataFrame]:
    """Characters with their degree within their book, relations, and positions by layout.

    ``chars``: book, id and others; ``rels``: book, src, dst and others;
    ``positions``: book, layout, id, x, y.  Each end that the book has counts,
    even if the other is missing, and a loop counts twice.
    """
    degree = rels.select("book", F.explode(F.array("src", "dst")).alias("id")).groupBy("book", "id").agg(F.count("*").alias("degree"))
    counted = chars.join(degree, ["book", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    return {"characters": counted, "relations": rels, "layouts": positions.select("book", "layout", "id", F.round("x").cast("long").alias("x"), F.round("y").cast("long").alias("y"))}


def catalog(spark: SparkSession, folder: str, side_file: str = SIDE_FILE) -> DataFrame:
    """(book, path, bytes, modified): the books of a folder by its files' metadata; no file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).where(~F.col("name").rlike(side_file)).select(F.regexp_replace("name", r"\.json$", "").alias("book"), "path", "bytes", "modified")


def _parsed(raw: DataFrame, schema: str, ending: str) -> DataFrame:
    """(book, doc): files of an ending; a file that is no JSON object gives null."""
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    mine = raw.where(F.endswith(name, F.lit(ending)))
    whole = F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT"))
    doc: Column = F.when(whole, F.from_json("value", schema))
    return mine.select(F.left(name, F.char_length(name) - len(ending)).alias("book"), doc.alias("doc"))


def load_books(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(book, source, doc): every book of a folder from its graph file, or, where that is missing or broken, from its full file.

    ``source`` is ``graph`` or ``full``, or null where neither can be read (the
    document is null then); one book's broken file doesn't hold up the others.
    """
    raw = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    books = catalog(spark, folder).select("book")
    graph = _parsed(raw, schema, GRAPH).withColumnRenamed("doc", "graph")
    full = _parsed(raw.where(~F.element_at(F.split("path", "/"), -1).rlike(SIDE_FILE)), schema, ".json").withColumnRenamed("doc", "full")
    every = books.union(graph.select("book")).distinct()
    out = every.join(graph, "book", "left").join(full, "book", "left")
    source = F.when(F.col("graph").isNotNull(), "graph").when(F.col("full").isNotNull(), "full")
    return out.select("book", source.alias("source"), F.coalesce("graph", "full").alias("doc"))


def out_of_step(source: DataFrame, packed: DataFrame) -> DataFrame:
    """(book, n): in how many rows the two sides (book and others, nested fields too) differ, repeated rows counted."""
    whole = lambda df: F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c != "book"]), {"ignoreNullFields": "false"})
    count = lambda df, c: df.groupBy("book", whole(df).alias("row")).agg(F.count("*").alias(c))
    a, b = count(source, "n_source"), count(packed, "n_packed").withColumnsRenamed({"book": "__book", "row": "__row"})
    both = a.join(b, F.col("book").eqNullSafe(F.col("__book")) & (F.col("row") == F.col("__row")), "full_outer")
    apart = F.abs(F.coalesce("n_source", F.lit(0)) - F.coalesce("n_packed", F.lit(0)))
    book = F.when(F.col("n_source").isNotNull(), F.col("book")).otherwise(F.col("__book"))
    return both.withColumn("apart", apart).where("apart > 0").groupBy(book.alias("book")).agg(F.sum("apart").alias("n"))


def pack_problems(source: Mapping[str, DataFrame], packs: Mapping[str, DataFrame], layouts: tuple[str, ...]) -> DataFrame:
    """(book, problem, n): packs against the books that they were made of.

    Collections out of step, degrees that the relations don't give, and
    characters without a finite place in one of the ``layouts``.
    """
    parts = []
    for name, rows in source.items():
        held = packs[name].select(*rows.columns)
        parts.append(out_of_step(rows, held).select("book", F.lit(f"{name} out of step").alias("problem"), "n"))
    chars = source["characters"].select("book", "id").distinct()
    counted = pack_collections(chars, source["relations"], packs["layouts"])["characters"].select("book", "id", "degree")
    parts.append(out_of_step(counted, packs["characters"].select("book", "id", "degree")).select("book", F.lit("degree").alias("problem"), "n"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    placed = packs["layouts"].where(finite("x") & finite("y")).select("book", "layout", "id").distinct()
    asked = chars.withColumn("layout", F.explode(F.array(*map(F.lit, layouts))))
    lost = asked.join(placed, ["book", "layout", "id"], "left_anti").groupBy("book", "layout").agg(F.count("*").alias("n"))
    parts.append(lost.select("book", F.concat(F.lit("layout "), "layout").alias("problem"), "n"))
    return reduce(DataFrame.unionByName, parts)
