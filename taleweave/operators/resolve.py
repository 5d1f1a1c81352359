"""Entity resolution: duplicate names, merging, name lookup, search, pruning, mentions, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.functions.scalars import BLANK, base_name
from taleweave.operators.matching import occurring


def norm_name(name: Column) -> Column:
    """For merging: without blanks and dots, lower case."""
    return F.lower(F.regexp_replace(name, rf"{BLANK}|[·•.]", ""))


def dupe_groups(names: DataFrame) -> DataFrame:
    """base, n, first of names that agree but for a bracketed tail."""
    return names.groupBy(base_name(F.col("name")).alias("base")).agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")


def merge_map(chars: DataFrame) -> DataFrame:
    """(id, into): characters of one normalised name (two signs at least) and one faction go to the one with most relations.

    A name that spans factions is left alone.
    """
    n = chars.withColumn("norm", norm_name(F.col("name"))).where(F.char_length("norm") >= 2)
    groups = n.groupBy("norm").agg(F.count("*").alias("n"), F.min("faction").alias("low"), F.max("faction").alias("high"), F.max(F.struct(F.col("degree"), -F.col("ord"), "id"))["id"].alias("into"))
    return n.join(groups.where("n > 1 AND low = high"), "norm").where("id <> into").select("id", "into")


def remap_edges(rels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ends rewritten by (id, into); loops that arise are dropped."""
    out = rels
    for end in ("src", "dst"):
        m = mapping.select(F.col("id").alias(end), F.col("into").alias(f"{end}_into"))
        out = out.join(m, end, "left").withColumn(end, F.coalesce(f"{end}_into", end)).drop(f"{end}_into")
    return out.where("src <> dst")


def resolve_names(asked: DataFrame, forms: DataFrame) -> DataFrame:
    """asked (name) against forms (form, id, exact): name, status (found, ambiguous, unknown), id, how; exact forms beat loose ones."""
    best = forms.groupBy("form").agg(F.max("exact").alias("exact"))
    ids = forms.join(best, ["form", "exact"]).groupBy("form", "exact").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    out = asked.join(ids, asked["name"] == ids["form"], "left")
    status = F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return out.select("name", status.alias("status"), F.when(status == "found", F.col("id")).alias("id"), F.when(F.col("n").isNotNull(), F.when(F.col("exact") == 1, "exact").otherwise("loose")).alias("how"))


def search(chars: DataFrame, asked: DataFrame, visible: Column, hidden: Column, locked: Column) -> DataFrame:
    """First hit of each asked text by bucket (visible, hidden tier, locked) and data order; names that contain the text.

    All asked texts are looked for in one pass over the names.
    """
    bucket = F.when(locked, 3).when(hidden, 2).when(visible, 1)
    c = chars.withColumn("bucket", bucket).where("bucket IS NOT NULL")
    low = asked.select("asked", F.lower("asked").alias("form"))
    hits = occurring(c.withColumn("text", F.lower("name")), low).join(low, "form")
    return hits.groupBy("asked").agg(F.min(F.struct("bucket", "ord", "id")).alias("m")).select("asked", "m.bucket", "m.id")


def orphans(chars: DataFrame, rels: DataFrame) -> DataFrame:
    ends = rels.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return chars.join(ends, "id", "left_anti")


def demote(chars: DataFrame, k: int) -> DataFrame:
    """Tier ``minor`` for nodes of at most ``k`` relations, but for mentioned ones."""
    return chars.withColumn("tier", F.when((F.col("degree") <= k) & (F.col("tier") != "mentioned"), "minor").otherwise(F.col("tier")))


def link_mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, id): texts that hold a name, in scripts without blanks too.

    A name counts where it isn't a part of a longer dotted name.  Names that two
    entries share, and those of one character, are dropped.
    """
    trimmed = names.select(F.trim("name").alias("form"), "id").where(F.char_length("form") >= 2)
    unique = trimmed.groupBy("form").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1")
    hit = occurring(texts.select("text_id", "text"), unique).where("alone")
    return hit.join(unique, "form").select("text_id", "id").distinct()


def variants(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """(name, variant): each name and, for each pair, the name with its first occurrence swapped either way."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hit = occurring(names.select("name", F.col("name").alias("text")), both.select(F.col("a").alias("form")))
    swapped = hit.join(both, hit["form"] == both["a"])
    at = F.instr(F.col("name"), F.col("a"))
    other = F.overlay(F.col("name"), F.col("b"), at, F.char_length("a"))
    return names.select("name", F.col("name").alias("variant")).unionByName(swapped.select("name", other.alias("variant"))).distinct()


def upsert(state: DataFrame, batch: DataFrame, keys: list[str], fill: list[str]) -> DataFrame:
    """New keys are added; for known ones only empty attributes are filled.  Replaying a batch changes nothing."""
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    b = batch.groupBy(*keys).agg(*[F.min_by(empty(c), F.when(empty(c).isNotNull(), F.col("ord"))).alias(f"new_{c}") for c in fill])
    out = state.join(b, keys, "full_outer")
    return out.select(*keys, *[F.coalesce(empty(c), F.col(f"new_{c}")).alias(c) for c in fill])


def ranked_suggestions(chars: DataFrame, part: str, k: int = 60) -> DataFrame:
    """The ``k`` names that contain ``part``, most relations first."""
    hit = chars.where(F.contains(F.lower("name"), F.lit(part.lower()))).orderBy(F.desc("degree"), "ord").limit(k)
    return hit.select("id", "name", "degree", F.row_number().over(Window.orderBy(F.desc("degree"), "ord")).alias("nth"))
