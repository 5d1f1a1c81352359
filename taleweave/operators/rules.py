"""Validation rules of books, parents, histories, names, events, places and summaries.

All give findings like ``validate``; frames may carry ``book``.  Null arrays mean
that a field isn't given.  A rule that looks at list fields reads them in place;
only references to other rows are joined, on equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.functions.dealing import dealt
from taleweave.operators.matching import occurring
from taleweave.operators.validate import dangling, empty_collection, finding, keys, repeated

# Types of books, the schema's number, and wordings.
BOOK_TYPES = ("叙事类", "理论类")
SCHEMA = 2
SIDE_LINES = "外祖母|外孙女|外祖父|外孙|婆媳|儿媳|儿媳妇|女婿|媳妇|岳母|岳父|岳丈|祖母|祖父|岳|姑|舅|叔|伯|侄|甥|兄弟|姐妹|兄妹|姐弟|堂兄|堂弟|表兄|表姐|孪生"
PARENT_AXIS = "父子|父女|母子|母女|父母|父[儿女子]|母[儿女子]|[儿女子][父母]"
KIN_WORD = "哥哥|弟弟|姐姐|妹妹|父亲|母亲|儿子|女儿|丈夫|妻子|叔叔|姑姑|侄子|侄女|祖父|祖母|外公|外婆|曾祖|孙子|孙女"
PRONOUN = "^[他她]"
STOPS = "[。；！？]"


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def is_parent_axis(kind: Column) -> Column:
    """Looser than ``kin.is_parent_child``: wording of parents and children is left once side lines are taken out."""
    return F.regexp_replace(F.coalesce(kind, F.lit("")), SIDE_LINES, "").rlike(PARENT_AXIS)


def unsupported(books: DataFrame) -> DataFrame:
    """Books of a type that isn't analysed; the other rules leave them out (``left_anti`` on book)."""
    return books.where(~blank("type") & ~F.col("type").isin(*BOOK_TYPES))


def meta(books: DataFrame, chars: DataFrame) -> list[DataFrame]:
    """``books``: book, slug, title, type, group_mode, schema_version, prophecy, prophecy_source."""
    generations = chars.select("book", F.coalesce(F.col("generation").cast("string"), F.lit("")).alias("g")).distinct().groupBy("book").agg(F.count("*").alias("n_generations"))
    grouped = books.where("group_mode = 'generation'").join(generations, "book", "left").where(F.coalesce("n_generations", F.lit(0)) < 2)
    return [
        finding(books.where(blank("slug")), "error", "book without slug", "book"),
        finding(books.where(blank("title")), "error", "book without title", "book"),
        finding(books.where(blank("type")), "warning", "type of book missing", "book"),
        finding(unsupported(books), "error", "type of book unsupported", "type"),
        finding(books.where(~blank("group_mode") & ~F.col("group_mode").isin("generation", "faction")), "error", "group mode illegal", "group_mode"),
        finding(grouped, "warning", "grouped by a single generation", "book"),
        finding(books.where(F.col("schema_version").isNull() | ~F.col("schema_version").between(1, SCHEMA)), "warning", "schema version", "book"),
        finding(books.where(~blank("prophecy") & blank("prophecy_source")), "warning", "prophecy without source", "book"),
    ]


def not_a_list(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Rows (id) whose field, kept as JSON text, is something else than a list."""
    return finding(df.where(F.col(column).isNotNull() & ~F.col(column).rlike(r"^\s*\[")), "error", kind, "id")


def parents(chars: DataFrame, rels: DataFrame) -> list[DataFrame]:
    """Declared parents (id, parents) against relations (src, dst, type); undeclared ones count only in books that declare any."""
    on = keys(chars)
    known = chars.select(*on, "id").distinct()
    declared = chars.select(*on, "id", F.explode("parents").alias("parent")).distinct()
    as_parent = known.withColumnRenamed("id", "parent")
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    lines = rels.where(is_parent_axis(F.col("type"))).select(*on, "src", "dst").distinct()
    edges = lines.select(*on, *pair("src", "dst")).distinct()
    real = declared.join(as_parent, [*on, "parent"], "left_semi").select(*on, "id", "parent", *pair("id", "parent"))
    missing = real.join(edges, [*on, "a", "b"], "left_anti")
    between = lines.join(known.withColumnRenamed("id", "src"), [*on, "src"], "left_semi").join(known.withColumnRenamed("id", "dst"), [*on, "dst"], "left_semi")
    unsaid = between.select(*on, *pair("src", "dst"), "src", "dst").join(declared.select(*on, *pair("id", "parent")).distinct(), [*on, "a", "b"], "left_anti")
    some = chars.where("parents IS NOT NULL")
    library = F.col("book") if on else F.lit("")
    unsaid = unsaid.withColumn("of", library).join(some.select(library.alias("of")).distinct(), "of", "left_semi").drop("of")
    return [
        finding(declared.join(as_parent, [*on, "parent"], "left_anti"), "error", "parent unknown", F.concat_ws("→", "parent", "id")),
        finding(missing, "error", "parent without relation", F.concat_ws("→", "parent", "id")),
        finding(unsaid, "warning", "parent not declared", F.concat_ws("→", "src", "dst")),
    ]


def falls(chapters: Column) -> Column:
    """Whether a list of chapters isn't ascending; nulls are passed over, and a chapter that falls doesn't count for the next."""
    start = F.struct(F.lit(-1).cast("int").alias("last"), F.lit(False).alias("fell"))

    def step(acc: Column, ch: Column) -> Column:
        lower = F.coalesce(ch.cast("int") < acc["last"], F.lit(False))
        return F.struct(F.when(lower, acc["last"]).otherwise(F.coalesce(ch.cast("int"), acc["last"])).alias("last"), (acc["fell"] | lower).alias("fell"))

    return F.aggregate(chapters, start, step)["fell"]


def _history(chars: DataFrame, name: str) -> list[DataFrame]:
    """An empty list, entries without a chapter and chapters that fall, of the list ``history``."""
    chapters = F.transform("history", lambda x: x["from_ch"])
    return [
        finding(chars.where("size(history) = 0"), "error", f"{name} history empty", "id"),
        finding(chars.where(F.exists(chapters, lambda c: c.isNull())), "error", f"{name} history without chapter", "id"),
        finding(chars.where(falls(chapters)), "error", f"{name} history not ascending", "id"),
    ]


def faction_history(chars: DataFrame, factions: DataFrame) -> list[DataFrame]:
    """``chars``: id, faction, history (array of faction, from_ch); ``factions``: faction.  One finding a character and kind."""
    said = chars.select(*keys(chars), "id", F.explode("history.faction").alias("named")).distinct()
    known = factions.select(*keys(chars), F.col("faction").alias("named")).distinct()
    unknown = said.where("named IS NULL").unionByName(said.where("named IS NOT NULL").join(known, [*keys(chars), "named"], "left_anti").select(said.columns))
    last = F.try_element_at("history", F.lit(-1))["faction"]
    return [
        *_history(chars, "faction"),
        finding(unknown.select(*keys(chars), "id").distinct(), "error", "faction history unknown", "id"),
        finding(chars.where((F.size("history") > 0) & ~last.eqNullSafe(F.col("faction"))), "warning", "last faction differs", "id"),
    ]


def lord_history(chars: DataFrame) -> list[DataFrame]:
    """``chars``: id, history (array of lord, from_ch); a null lord is none.  One finding a character and kind."""
    said = chars.select(*keys(chars), F.col("id").alias("subject"), F.explode("history.lord").alias("id")).where("id <> ''").distinct()
    unknown = said.join(chars.select(*keys(chars), "id").distinct(), [*keys(chars), "id"], "left_anti").select(*keys(chars), "subject").distinct()
    return [
        *_history(chars, "lord"),
        finding(unknown, "error", "lord unknown", "subject"),
        finding(chars.where(F.exists("history", lambda x: F.coalesce(x["lord"] == F.col("id"), F.lit(False)))), "error", "lord of oneself", "id"),
    ]


def names(chars: DataFrame, least: int = 3) -> list[DataFrame]:
    """``chars``: id, name, aliases, alt_names.  Forms of ``least`` characters should belong to one row only."""
    none = F.array().cast("array<string>")
    alt, aliases = F.coalesce("alt_names", none), F.coalesce("aliases", none)
    forms = chars.select(*keys(chars), F.explode(F.array_distinct(F.concat(F.array("name"), aliases, alt))).alias("form")).where(F.char_length("form") >= least)
    return [
        finding(chars.where(F.exists(alt, lambda x: F.coalesce(F.trim(x), F.lit("")) == "")), "error", "other name blank", "id"),
        finding(chars.where(F.coalesce(F.array_contains(alt, F.col("name")), F.lit(False))), "error", "other name is the name", "id"),
        finding(chars.where(F.size(F.array_distinct(alt)) < F.size(alt)), "error", "other name repeated", "id"),
        repeated(forms, "form", "warning", "form of several"),
    ]


def contiguous_repeats(rels: DataFrame, parts: int | None = None) -> DataFrame:
    """Pairs (either way) with a type more than once and no gap between the periods: they are one relation.

    No beginning is chapter 0, no end is for ever.  ``parts``: partitions to deal the periods to.
    """
    group = [*keys(rels), "a", "b", "type"]
    ends = rels.select(
        *keys(rels),
        F.least("src", "dst").alias("a"),
        F.greatest("src", "dst").alias("b"),
        F.trim(F.coalesce("type", F.lit(""))).alias("type"),
        F.coalesce("from_ch", F.lit(0)).alias("begins"),
        F.coalesce(F.nullif(F.col("to_ch"), F.lit(0)), F.lit(2**31 - 1)).alias("ends"),
    )
    before = Window.partitionBy(*group).orderBy("begins").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.greatest("begins", "ends")).over(before)
    gaps = dealt(ends, parts, *group).withColumn("gap", F.coalesce(F.col("begins") > reach, F.lit(False)))
    whole = gaps.groupBy(*group).agg(F.count("*").alias("n"), F.max("gap").alias("gap")).where("n > 1 AND NOT gap")
    return finding(whole, "error", "relation repeated", F.concat(F.col("a"), F.lit("↔"), F.col("b"), F.lit(" "), F.col("type")))


def events(events_: DataFrame, phases: DataFrame, chars: DataFrame, books: DataFrame | None = None) -> list[DataFrame]:
    """``events_``: id, name, summary, impact, phase, ord, ch, chars; ``phases`` and ``chars``: id."""
    named = events_.select(*keys(events_), F.explode("chars").alias("char"))
    return [
        empty_collection(phases, "phases", books),
        empty_collection(events_, "events", books),
        *[finding(events_.where(blank(c)), "error", f"event without {c}", "id") for c in ("id", "name", "summary", "impact")],
        repeated(events_, "id", "error", "event id repeated"),
        dangling(events_.where("phase <> ''"), "phase", phases.withColumnRenamed("id", "known_phase"), "known_phase", "phase unknown"),
        finding(events_.where("ord IS NULL"), "error", "event without order", "id"),
        finding(events_.where("ch IS NULL"), "warning", "event without chapter", "id"),
        dangling(named, "char", chars.withColumnRenamed("id", "known_char"), "known_char", "event with nobody"),
    ]


def places(places_: DataFrame, cited: DataFrame) -> list[DataFrame]:
    """``places_``: id, name, first_ch; ``cited`` (place): the places of events and of relations' evidence."""
    return [
        finding(places_.where(blank("id") | blank("name")), "error", "place without id or name", "id"),
        finding(places_.where("first_ch IS NULL"), "warning", "place without chapter", "id"),
        repeated(places_, "id", "warning", "place id repeated"),
        dangling(cited.where("place <> ''"), "place", places_.withColumnRenamed("id", "known_place"), "known_place", "place unknown"),
    ]


def base(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, "[（(].*$", ""))


def unlisted_mentions(summaries: DataFrame, chars: DataFrame) -> DataFrame:
    """Summaries (id, summary, chars) that name a character who isn't listed, nor anyone with the same name but for brackets.

    ``chars``: id, name, aliases.  Forms of several characters, and of one sign, name nobody.
    """
    on = keys(summaries)
    forms = chars.select(*on, F.col("id").alias("char"), base(F.col("name")).alias("base"), F.explode(F.array_distinct(F.concat(F.array(base(F.col("name"))), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("form")).where(F.char_length("form") >= 2)
    own = forms.groupBy(*on, "form").agg(F.min("char").alias("char"), F.min("base").alias("base"), F.count_distinct("base").alias("n")).where("n = 1")
    texts = summaries.select(*on, "id", F.col("summary").alias("text"))
    named = occurring(texts, own).where("alone").select(*on, "id", "form").join(own, [*on, "form"]).select(*on, "id", "base").distinct()
    listed = summaries.select(*on, "id", F.explode("chars").alias("char")).join(chars.select(*on, F.col("id").alias("char"), base(F.col("name")).alias("base")), [*on, "char"]).select(*on, "id", "base").distinct()
    return finding(named.join(listed, [*on, "id", "base"], "left_anti"), "warning", "named but not listed", F.concat_ws(" ", "id", "base"))


def sentences(texts: DataFrame) -> DataFrame:
    """(id, nth, text): sentences that aren't blank; ``texts``: id, text."""
    split = F.filter(F.transform(F.split("text", STOPS), F.trim), lambda s: s != "")
    return texts.select(*keys(texts), "id", F.posexplode(split).alias("nth", "text"))


def wording(texts: DataFrame, names_: DataFrame) -> list[DataFrame]:
    """Texts (id, text) that begin with a pronoun, and sentences with a word of kin but none of the names (form)."""
    parts = sentences(texts)
    akin = parts.where(F.col("text").rlike(KIN_WORD))
    on = [*keys(texts), "id", "nth"]
    hit = occurring(akin, names_)
    if keys(texts):
        hit = hit.join(names_.select("book", "form").distinct(), ["book", "form"], "left_semi")
    return [
        finding(parts.where((F.col("nth") == 0) & F.col("text").rlike(PRONOUN)), "warning", "begins with a pronoun", "id"),
        finding(akin.join(hit.select(*on).distinct(), on, "left_anti"), "warning", "kin without a name", F.concat_ws(" ", "id", "nth")),
    ]
