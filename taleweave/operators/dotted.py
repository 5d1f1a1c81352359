"""Full names that a separator holds together (``A·B·C``) and that the data doesn't know yet.

Prose runs into such a name on both sides, so every extent around a separator is
tried: each end of the run of letters before it with each beginning of what
follows, further separators included.  The extent that occurs most often in all
texts, or the longer of two as frequent, is taken to be the name.  What an extent
can be depends on the letters around the separator alone, so equal surroundings
are counted first and enumerated once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleweave.operators.graph import cut_lineage
from taleweave.operators.matching import MASK, occurring

# Least and most letters before a separator and after it, further separators, and the letters that a title adds to a known name at most.
LEFT, RIGHT, MORE, TITLE = (2, 5), (2, 12), 2, 3
HAN = "一-龥"
#: Signs that don't tell two names apart.
SIGNS = "[\\s·・．.,，。、\"'“”‘’()（）]"


def normal(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, SIGNS, ""))


def surroundings(texts: DataFrame, separator: str, letters: str) -> DataFrame:
    """(left, right, into_known, n, first): the letters before and after each separator, how often these occur, and where first."""
    rest = RIGHT[1] + MORE + 2
    parts = F.split("text", re.escape(separator), -1)
    cut = texts.select("text_id", parts.alias("parts")).withColumn("heads", F.transform("parts", lambda p: F.left(p, F.lit(rest))))
    after = lambda j: F.array_join(F.slice("heads", j + 2, MORE + 2), separator)
    places = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda j: j < F.size("parts") - 1)
    dots = cut.select("text_id", F.posexplode(F.transform(places, lambda j: F.struct(F.right(F.get("parts", j), F.lit(LEFT[1])).alias("l"), after(j).alias("r")))).alias("nth", "d"))
    run = f"[{letters}]"
    left = F.regexp_extract("d.l", f"({run}*)$", 1)
    right = F.regexp_extract("d.r", f"^({run}*(?:{re.escape(separator)}{run}*){{0,{MORE}}})", 1)
    into = F.startswith(F.substring(F.col("d.r"), F.char_length("right") + 1, 2), F.lit(separator + MASK))
    found = dots.withColumn("left", left).withColumn("right", right).select("left", "right", into.alias("into_known"), F.struct("text_id", "nth").alias("place"))
    return found.where((F.char_length("left") >= LEFT[0]) & (F.col("right") != "")).groupBy("left", "right", "into_known").agg(F.count("*").alias("n"), F.min("place").alias("first"))


def extents(around: DataFrame, separator: str) -> DataFrame:
    """``around`` with a row (name, n_left) for every extent."""
    pure = lambda s: F.char_length(F.replace(s, F.lit(separator), F.lit("")))
    lefts = F.transform(F.sequence(F.lit(LEFT[0]), F.char_length("left")), lambda k: F.struct(k.alias("k"), F.right("left", k).alias("s")))
    rights = F.transform(F.sequence(F.lit(1), F.char_length("right")), lambda k: F.left("right", k))
    rights = F.filter(rights, lambda s: ~F.endswith(s, F.lit(separator)) & pure(s).between(*RIGHT))
    return around.withColumn("l", F.explode(lefts)).withColumn("r", F.explode(rights)).select(*around.columns, F.concat("l.s", F.lit(separator), "r").alias("name"), F.col("l.k").alias("n_left"))


def chosen_names(texts: DataFrame, separator: str = "·", letters: str = HAN) -> DataFrame:
    """(name, n, into_known): the extent taken at each separator, at how many, and whether a masked name follows the first of them."""
    around = cut_lineage(surroundings(texts, separator, letters))  # read twice below, and texts are long
    tried = extents(around, separator)
    totals = tried.groupBy("name").agg(F.sum("n").alias("total"))
    best = F.max_by(F.struct("name"), F.struct("total", F.char_length("name"), -F.col("n_left")))["name"]
    picked = tried.join(totals, "name").groupBy("left", "right", "into_known").agg(F.first("n").alias("n"), F.first("first").alias("first"), best.alias("name"))
    return picked.groupBy("name").agg(F.sum("n").alias("n"), F.min_by("into_known", "first").alias("into_known"))


def unknown_names(texts: DataFrame, known: DataFrame, settled: DataFrame, least: int = 2, separator: str = "·", letters: str = HAN) -> DataFrame:
    """(name, n): names held together by ``separator`` that occur ``least`` times and that neither the data nor a ledger knows.

    ``texts``: text_id, text; ``known`` and ``settled``: name.  Left out are names
    that a masked one follows, those of two parts with a known part, parts of
    known names, known names with a title, and names inside other such names.
    """
    names = known.select(F.trim("name").alias("name")).where(F.char_length("name") >= 2).distinct()
    found = cut_lineage(chosen_names(texts, separator, letters).where(~F.col("into_known"))).withColumn("parts", F.split("name", re.escape(separator), -1))
    part = found.where(F.size("parts") <= 2).select("name", F.explode("parts").alias("part")).withColumn("plain", normal(F.col("part")))
    with_known = part.join(names.select(normal(F.col("name")).alias("plain")).distinct(), "plain", "left_semi").select("name")
    inside = occurring(names.select(F.col("name").alias("text")), found.select(F.col("name").alias("form"))).select(F.col("form").alias("name"))
    holds = occurring(found.select("name", F.col("name").alias("text")), names.select(F.col("name").alias("form")))
    titled = holds.where(F.char_length("name") - F.char_length("form") <= TITLE).select("name")
    out = with_known.unionByName(inside).unionByName(titled).distinct()
    passing = cut_lineage(found.where(F.col("n") >= least).join(out, "name", "left_anti").select("name", "n"))
    lesser = occurring(passing.select("name", F.col("name").alias("text")), passing.select(F.col("name").alias("form"))).where("form <> name").select(F.col("form").alias("name")).distinct()
    return passing.join(lesser, "name", "left_anti").join(settled.select("name").distinct(), "name", "left_anti")
