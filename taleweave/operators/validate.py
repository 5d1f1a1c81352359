"""Validation rules: each gives (severity, kind, subject); errors fail a book, warnings don't.

Where the frames have a column ``book``, ids are unique within their book and
findings carry it, so that one run checks a whole library.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.functions.scalars import ch_of
from taleweave.operators import kin


def keys(df: DataFrame) -> list[str]:
    return [c for c in ("book",) if c in df.columns]


def finding(df: DataFrame, severity: str, kind: str, subject) -> DataFrame:
    subject = F.col(subject) if isinstance(subject, str) else subject
    return df.select(*keys(df), F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), subject.cast("string").alias("subject"))


def empty_collection(df: DataFrame, name: str, books: DataFrame | None = None) -> DataFrame:
    """With ``books`` (book), the books that have no row in the collection."""
    if books is None:
        return finding(df.agg(F.count("*").alias("n")).where("n = 0"), "error", f"{name} empty", F.lit(name))
    return finding(books.select("book").join(df.select("book").distinct(), "book", "left_anti"), "error", f"{name} empty", F.lit(name))


def repeated(df: DataFrame, key: str, severity: str, kind: str) -> DataFrame:
    return finding(df.groupBy(*keys(df), key).agg(F.count("*").alias("n")).where("n > 1"), severity, kind, key)


def dangling(df: DataFrame, key: str, known: DataFrame, known_key: str, kind: str) -> DataFrame:
    on = [*keys(df), known_key]
    named = df.select(*keys(df), F.col(key).alias(known_key)).where(F.col(known_key).isNotNull()).distinct()
    return finding(named.join(known.select(*on).distinct(), on, "left_anti"), "error", kind, known_key)


def characters(chars: DataFrame, degree: DataFrame, books: DataFrame | None = None, aliases: DataFrame | None = None) -> list[DataFrame]:
    """``aliases`` (id): the characters that have one; without it, none has."""
    many = degree.where("degree >= 8")
    if aliases is not None:
        on = [*keys(many), "id"]
        many = many.join(aliases.select(*on).distinct(), on, "left_anti")
    tiers = ("main", "minor", "mentioned")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return [
        empty_collection(chars, "characters", books),
        finding(chars.where(blank("id") | blank("name")), "error", "character without id or name", "id"),
        finding(chars.where("generation IS NULL"), "error", "generation missing", "id"),
        finding(chars.where(~F.coalesce(F.col("gender"), F.lit("")).isin("m", "f")), "warning", "gender missing", "id"),
        finding(chars.where("first_ch IS NULL"), "warning", "first chapter missing", "id"),
        finding(chars.where(~F.coalesce(F.col("tier"), F.lit("")).isin(*tiers)), "warning", "tier unknown", "id"),
        repeated(chars, "id", "error", "character id repeated"),
        repeated(chars, "name", "warning", "character name repeated"),
        finding(degree.where("tier = 'mentioned' AND degree = 0"), "warning", "mentioned without relation", "id"),
        finding(many, "warning", "many relations, no alias", "id"),
    ]


def relations(rels: DataFrame, chars: DataFrame, books: DataFrame | None = None) -> list[DataFrame]:
    whole = lambda c: F.col(c).isNull() | (F.col(c) >= 1)
    return [
        empty_collection(rels, "relations", books),
        dangling(rels, "src", chars, "id", "relation from nobody"),
        dangling(rels, "dst", chars, "id", "relation to nobody"),
        finding(rels.where(F.coalesce(F.col("type"), F.lit("")) == ""), "error", "relation without type", "ord"),
        finding(rels.where(~F.col("style").isin("solid", "dashed", "dotted")), "error", "style illegal", "ord"),
        finding(rels.where("derived"), "warning", "relation without evidence", "ord"),
        finding(rels.where(~whole("from_ch") | ~whole("to_ch")), "error", "period before chapter 1", "ord"),
        finding(rels.where("to_ch IS NOT NULL AND to_ch <= from_ch"), "error", "period ends before it begins", "ord"),
        finding(rels.where("ch < from_ch OR (to_ch IS NOT NULL AND ch >= to_ch)"), "warning", "evidence outside period", "ord"),
    ]


#: Kin findings that fail a book.
KIN_ERRORS = ("illegal", "blood term")


def profiles(chars: DataFrame, factions: DataFrame) -> list[DataFrame]:
    """``chars``: id, faction, title, desc, fate, each of which should be told; ``factions``: faction."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    on = [*keys(chars), "faction"]
    unknown = chars.where(~empty("faction")).join(factions.select(*on).distinct(), on, "left_anti")
    return [
        *[finding(chars.where(empty(c)), "warning", f"{c} missing", "id") for c in ("faction", "title", "desc", "fate")],
        finding(unknown, "error", "faction unknown", "id"),
    ]


def evidence(rels: DataFrame) -> list[DataFrame]:
    """``rels``: ord, from_ch, to_ch, events (array of text, chapter): evidence that is missing, untold, without a chapter's number or outside the period."""
    each = rels.select(*keys(rels), "ord", "from_ch", "to_ch", F.explode("events").alias("e")).withColumn("ch", ch_of(F.col("e.chapter")))
    untold = F.coalesce(F.col("e.text"), F.lit("")) == ""
    dated = F.col("from_ch").isNotNull() | F.col("to_ch").isNotNull()
    outside = dated & ((F.col("ch") < F.coalesce("from_ch", F.lit(0))) | F.coalesce(F.col("ch") >= F.col("to_ch"), F.lit(False)))
    return [
        finding(rels.where(F.coalesce(F.size("events"), F.lit(0)) <= 0), "warning", "relation without evidence", "ord"),
        finding(each.where(untold), "error", "evidence without text", "ord"),
        finding(each.where(~untold & (F.coalesce(F.col("e.chapter"), F.lit("")) != "") & F.col("ch").isNull()), "warning", "evidence chapter without number", "ord"),
        finding(each.where(outside), "warning", "evidence outside period", F.concat_ws(" ", "ord", "ch")),
    ]


def kinship(rels: DataFrame) -> list[DataFrame]:
    """``rels``: ord, src, dst, type, kin: kin that doesn't go with its wording, and people who are their own ancestors.

    Cycles are looked for in the frame as a whole: ids of several books must differ.
    """
    found = rels.select(*keys(rels), "ord", F.explode(kin.check_kin(F.col("type"), F.col("kin"))).alias("found"))
    edges = rels.where(kin.is_parent_child(F.col("type"))).select(F.col("src").alias("parent"), F.col("dst").alias("child"))
    cycle = kin.cycle_nodes(edges)
    if keys(rels):
        cycle = cycle.join(rels.select("book", F.col("src").alias("node")).distinct(), "node")
    told = found.select(*keys(rels), F.when(F.col("found").isin(*KIN_ERRORS), "error").otherwise("warning").alias("severity"), F.concat(F.lit("kin: "), "found").alias("kind"), F.col("ord").cast("string").alias("subject"))
    return [told, finding(cycle, "warning", "parent cycle", "node")]


def report(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy(*keys(found), "severity", "kind").agg(F.count("*").alias("n"))
