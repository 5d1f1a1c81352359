"""Annotations of chapters: what they cite and declare, and rules of their fields.

``items``: book, item, ch, title, body, basis, events, chars, places (arrays; null
where the field isn't given); ``globals_``: book, item, title, body, basis.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleweave.operators.validate import finding

# Ids of events inside texts, texts that stand for one to come, words of Latin letters, marks that come in pairs, chapters by which a person may come late.
EVENT_ID = r"e-?[0-9][A-Za-z0-9_-]*"
PLACEHOLDER = r"^(待补|待填|todo|TODO|无|未详|暂无|\.{3}|…+|-+)$"
LATIN = "[A-Za-z][A-Za-z'-]*"
PAIRS = (("「", "」"), ("『", "』"), ("（", "）"), ("《", "》"))
LATE = 5


def citations(items: DataFrame, events: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(book, item, event, finding): what annotations cite in their bodies against what they declare.

    ``events``: book, event, ch; ``reviewed`` (book, ch, event): declarations across
    chapters that were settled.  Cited: ``no such event``; and where the item
    doesn't declare it ``cited across chapters``, ``declared elsewhere`` (by another
    item) or ``unclaimed``.  Declared: ``declared, no such event``, ``uncited``, and
    of another chapter ``across chapters`` or ``across, reviewed``.
    """
    one = ["book", "item", "event"]
    cited = items.select("book", "item", "ch", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(EVENT_ID), F.lit(0)))).alias("event"), F.lit(True).alias("cited"))
    declared = items.select("book", "item", "ch", F.explode(F.array_distinct("events")).alias("event"), F.lit(True).alias("declared"))
    both = cited.join(declared.withColumnRenamed("ch", "item_ch"), one, "full_outer").withColumn("ch", F.coalesce("ch", "item_ch"))
    known = events.groupBy("book", "event").agg(F.min("ch").alias("event_ch"), F.lit(True).alias("known"))
    anywhere = declared.select("book", "event").distinct().withColumn("anywhere", F.lit(True))
    done = reviewed.select("book", "ch", "event").distinct().withColumn("done", F.lit(True))
    e = both.join(known, ["book", "event"], "left").join(anywhere, ["book", "event"], "left").join(done, ["book", "ch", "event"], "left")
    c, d, there = F.col("cited").isNotNull(), F.col("declared").isNotNull(), F.col("known").isNotNull()
    across = F.coalesce(F.col("event_ch") != F.col("ch"), F.lit(False))
    told = F.array(
        F.when(c & ~there, F.lit("no such event")),
        F.when(c & there & ~d, F.when(across, "cited across chapters").when(F.col("anywhere"), "declared elsewhere").otherwise("unclaimed")),
        F.when(d & ~there, F.lit("declared, no such event")),
        F.when(d & there & ~c, F.lit("uncited")),
        F.when(d & there & across, F.when(F.col("done"), "across, reviewed").otherwise("across chapters")),
    )
    return e.select(*one, F.explode(F.array_compact(told)).alias("finding"))


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def latin(text: Column, ids_allowed: bool) -> Column:
    """Distinct words of Latin letters; in bodies ids of events are none."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, EVENT_ID, "") if ids_allowed else text, F.lit(LATIN), F.lit(0)))


def unpaired(text: Column) -> Column:
    """Whether some mark that comes in pairs doesn't, or double stars are odd in number."""
    n = lambda m: F.floor((F.char_length(text) - F.char_length(F.replace(text, F.lit(m), F.lit("")))) / len(m))
    return reduce(lambda a, b: a | b, [n(a) != n(b) for a, b in PAIRS], n("**") % 2 == 1)


def _fields(df: DataFrame, placeholders: bool) -> list[DataFrame]:
    out = [finding(df.where(_blank(c)), "error", f"{c} missing", "item") for c in ("title", "body", "basis")]
    if placeholders:
        out += [finding(df.where(F.trim(c).rlike(PLACEHOLDER)), "error", f"{c} to come", "item") for c in ("title", "body")]
    for c in ("title", "body", "basis"):
        words = df.withColumn("w", latin(F.col(c), c == "body")).where(F.size("w") > 0)
        out.append(finding(words, "error", f"{c} with foreign words", F.concat_ws(" ", "item", F.array_join("w", " "))))
        out.append(finding(df.where(unpaired(F.col(c))), "error", f"{c} with unpaired marks", "item"))
    return out


def field_rules(items: DataFrame, globals_: DataFrame, events: DataFrame, chars: DataFrame, places: DataFrame, last: DataFrame) -> list[DataFrame]:
    """Findings of ``items`` and ``globals_``, like those of ``validate``.

    ``events``: book, id, ch; ``chars``: book, id, first_ch; ``places``: book, id;
    ``last`` (book, last): each book's last chapter.  Beside missing and odd fields:
    chapters outside the book, references to nothing (in bodies too), people who
    come more than five chapters after an event that the item has them in, and
    titles told twice in a chapter.
    """
    known = {"events": events, "chars": chars, "places": places}
    out = _fields(items, True) + _fields(globals_, False)
    bounded = items.join(last, "book", "left")
    out.append(finding(bounded.where(~F.coalesce((F.col("ch") >= 1) & (F.col("ch") <= F.col("last")), F.lit(False))), "error", "chapter outside the book", "item"))
    for name, rows in known.items():
        said = items.select("book", "item", F.explode(F.array_distinct(name)).alias("id"))
        out.append(finding(said.join(rows.select("book", "id").distinct(), ["book", "id"], "left_anti"), "error", f"{name} unknown", F.concat_ws(" ", "item", "id")))
    bodies = items.select("book", "item", "body").unionByName(globals_.select("book", "item", "body"))
    inside = bodies.select("book", "item", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(EVENT_ID), F.lit(0)))).alias("id"))
    out.append(finding(inside.join(events.select("book", "id").distinct(), ["book", "id"], "left_anti"), "error", "reference to nothing", F.concat_ws(" ", "item", "id")))
    pairs = items.select("book", "item", F.explode("events").alias("event"), "chars").select("book", "item", "event", F.explode("chars").alias("char")).distinct()
    met = pairs.join(events.select("book", F.col("id").alias("event"), "ch"), ["book", "event"]).join(chars.select("book", F.col("id").alias("char"), "first_ch"), ["book", "char"])
    out.append(finding(met.where(F.col("first_ch") - F.col("ch") > LATE), "error", "person before their time", F.concat_ws(" ", "item", "event", "char")))
    titles = items.groupBy("book", "ch", F.trim(F.coalesce("title", F.lit(""))).alias("title")).agg(F.count("*").alias("n"))
    out.append(finding(titles.where("n > 1"), "error", "title repeated", F.concat_ws(" ", "ch", "title")))
    return out
