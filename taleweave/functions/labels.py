"""Labels, colours, folds and wordings as columns; references inside texts and coverage of fields as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from taleweave.functions.ordinals import with_ord

# Colours, the batch of a fold, and marks of annotations.
NO_COLOR = "#8b94a7"
FACTION_COLORS = ("#e74c3c", "#3498db", "#2ecc71", "#9b59b6", "#e67e22", "#1abc9c", "#f39c12", "#e91e63", "#00bcd4", "#ff5722", "#8bc34a", "#3f51b5")
FOLD_BATCH = 20
FOLD_ONE_STEP = 40
INFERRED = "推断|整理"
BASIS_LABEL = "^(整理者推断|原文依据)"
EVENT_REF = r"e-?[0-9][A-Za-z0-9_-]*"


def faction_color(color: Column, nth: Column, palette: tuple[str, ...] = ()) -> Column:
    """The faction's own colour, or with a palette the one of its place (from 0; unknown: first)."""
    if palette:
        return F.get(F.array(*map(F.lit, palette)), F.greatest(F.coalesce(nth, F.lit(0)), F.lit(0)) % len(palette))
    return F.coalesce(F.when(color != "", color), F.lit(NO_COLOR))


def colored_factions(chars: DataFrame, factions: DataFrame) -> DataFrame:
    """(key, name, color): factions (key, name, color, nth) and those that characters (ord, faction) add, in order of first appearance.

    New ones take the colour of their place among the characters' factions, listed ones without a colour that of their place in the list.
    """
    color = lambda nth: F.get(F.array(*map(F.lit, FACTION_COLORS)), (nth % len(FACTION_COLORS)).cast("int"))
    seen = chars.groupBy(F.col("faction").alias("key")).agg(F.min("ord").alias("first"))
    placed = with_ord(seen, F.floor(F.col("first") / 65536), ["first", "key"])
    fresh = placed.join(factions.select("key").distinct(), "key", "left_anti").select("key", F.col("key").alias("name"), color(F.col("ord") - 1).alias("color"))
    listed = factions.select("key", "name", F.coalesce(F.when(F.col("color") != "", F.col("color")), color(F.col("nth"))).alias("color"))
    return listed.unionByName(fresh)


def named(df: DataFrame, key: str, names: DataFrame, fallback: Column) -> DataFrame:
    """``df`` with ``label``: the name (names: id, name) of its key, else the fallback."""
    return df.join(names.select(F.col("id").alias(key), F.col("name").alias("_name")), key, "left").withColumn("label", F.coalesce(F.when(F.col("_name") != "", F.col("_name")), fallback)).drop("_name")


def fold(asked: Column, first: Column, total: Column) -> Column:
    """Struct of shown, open, full, action and step of a folded list of which ``asked`` are to be shown, at least the ``first``."""
    shown = F.least(F.greatest(F.coalesce(F.nullif(asked, F.lit(0)), first), first), total)
    action = F.when(shown >= total, "collapse").when(total <= FOLD_ONE_STEP, "all").otherwise("more")
    return F.struct(shown.alias("shown"), (shown > first).alias("open"), (shown >= total).alias("full"), action.alias("action"), F.least(F.lit(FOLD_BATCH), total - shown).alias("step"))


def basis(text: Column) -> Column:
    """Struct of inferred and text: an annotation's basis without its label and outer brackets."""
    text = F.coalesce(text, F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, BASIS_LABEL, ""), "^[（(]", ""), "[)）]$", "")
    return F.struct(text.rlike(INFERRED).alias("inferred"), F.trim(rest).alias("text"))


def references(texts: DataFrame, events: DataFrame) -> DataFrame:
    """(text_id, nth, event): ids of events (id) that occur in texts (text_id, text), each as often as it does."""
    cited = texts.select("text_id", F.posexplode(F.regexp_extract_all("text", F.lit(EVENT_REF), F.lit(0))).alias("nth", "event"))
    return cited.join(events.select(F.col("id").alias("event")).distinct(), "event", "left_semi").select("text_id", "nth", "event")


def chapter_numeral(text: Column) -> Column:
    """A Chinese numeral of tens and hundreds; signs that are no digits count as nothing.  Unlike ``han_to_num`` each unit counts on its own."""
    # fixed values: digits and units
    digits = F.create_map(*[F.lit(x) for pair in zip("一二三四五六七八九", range(1, 10), strict=True) for x in pair])
    units = F.create_map(*[F.lit(x) for pair in zip("十百", (10, 100), strict=True) for x in pair])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"))

    def step(acc: Column, c: Column) -> Column:
        unit = F.try_element_at(units, c)
        added = acc["total"] + F.greatest(acc["digit"], F.lit(1)) * unit
        return F.when(unit.isNotNull(), F.struct(added.alias("total"), F.lit(0).alias("digit"))).otherwise(F.struct(acc["total"].alias("total"), F.coalesce(F.try_element_at(digits, c), F.lit(0)).alias("digit")))

    return F.aggregate(F.split(text, ""), start, step, lambda acc: acc["total"] + acc["digit"])


def kin_headword(term: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(term, F.lit("")), "[（(].*$", ""))


def kin_generations(term: Column) -> Column:
    """Generations from the elder down, as the wording of a side line shows; 0 where it doesn't."""
    term = F.coalesce(term, F.lit(""))
    grand = F.when(term.contains("天祖"), 4).when(term.rlike("高祖|曾祖"), 3).otherwise(2)
    return F.when(term.contains("祖父"), grand).when(term.rlike("[叔伯姑舅姨侄甥]"), 1).otherwise(0)


def distribution(df: DataFrame, by: str) -> DataFrame:
    """(value, n): how many rows have each value, null included."""
    return df.groupBy(F.col(by).cast("string").alias("value")).agg(F.count("*").alias("n"))


def filled(df: DataFrame) -> DataFrame:
    """(field, n): in how many rows each column has a value that isn't empty."""

    def there(field) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, StringType):
            return c != ""
        return F.size(c) > 0 if isinstance(field.dataType, ArrayType) else c.isNotNull()

    counts = df.agg(*[F.count_if(there(f)).alias(f.name) for f in df.schema.fields])
    return counts.unpivot([], [F.col(f"`{c}`") for c in counts.columns], "field", "n")


def field_problems(source: DataFrame, packs: list[DataFrame], dropped: tuple[str, ...] = ()) -> DataFrame:
    """(field, problem): fields filled in the source but in no pack (``lost``), and fields of packs that the source doesn't have (``extra``)."""
    held = filled(packs[0])
    for pack in packs[1:]:
        held = held.unionByName(filled(pack))
    both = filled(source).join(held.groupBy("field").agg(F.max("n").alias("held")), "field", "full_outer").where(~F.col("field").isin(*dropped) if dropped else F.lit(True))
    problem = F.when(F.col("n").isNull(), "extra").when((F.col("n") > 0) & (F.coalesce("held", F.lit(0)) == 0), "lost")
    return both.select("field", problem.alias("problem")).where("problem IS NOT NULL")
