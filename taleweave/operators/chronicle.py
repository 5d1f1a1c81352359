"""Panels, audits and selections over chapters: life lists, relation lists, ranges, headings, lateness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.functions.scalars import base_name
from taleweave.operators.view import ViewState, relation_open

LIFE_LIST = 12  # events shown in a panel


def selected_chapters(spec: DataFrame) -> DataFrame:
    """(ch): chapters named by rows of ``spec`` (selection), such as ``1-30,35``; parts that are no range are passed over."""
    part = spec.select(F.explode(F.split(F.regexp_replace("selection", r"\s", ""), ",")).alias("part")).where(F.col("part").rlike("^[0-9]+(-[0-9]+)?$"))
    low = F.regexp_extract("part", "^([0-9]+)", 1).cast("int")
    high = F.coalesce(F.nullif(F.regexp_extract("part", "-([0-9]+)$", 1), F.lit("")).cast("int"), low)
    ranges = part.select(low.alias("low"), high.alias("high")).where("low <= high")
    return ranges.select(F.explode(F.sequence("low", "high")).alias("ch")).distinct()


def life_lists(event_chars: DataFrame, state: ViewState, most: int = LIFE_LIST) -> DataFrame:
    """(char, total, shown, events): each character's first open events by chapter, and how many there are.

    ``event_chars`` has char, event, ch, ord.  The list is cut to ``most``
    events before any row meets another, so a busy character is no large value.
    """
    open_ = ~state.locked(F.col("ch")) & ~state.not_yet(F.col("ch"))
    marked = event_chars.withColumn("open", open_)
    totals = marked.groupBy("char").agg(F.count("*").alias("total"), F.count_if("open").alias("shown"))
    nth = F.row_number().over(Window.partitionBy("char").orderBy("ch", "ord", "event"))
    first = marked.where("open").withColumn("nth", nth).where(F.col("nth") <= most)
    lists = first.groupBy("char").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "event"))), lambda s: s["event"]).alias("events"))
    return totals.join(lists, "char", "left").select("char", "total", "shown", F.coalesce("events", F.array().cast("array<string>")).alias("events"))


def relation_lists(rels: DataFrame, state: ViewState) -> DataFrame:
    """(id, type, n, locked, filtered): each character's relations by type, those still locked, and those the edge filter hides."""
    ends = rels.withColumn("id", F.explode(F.array("src", "dst")))
    locked = state.locked(F.col("ch"))
    there = state.alive(F.col("from_ch"), F.col("to_ch")) & state.derived_ok(F.col("derived"))
    hidden = ~locked & there & ~state.passes(F.col("style"), F.col("kin"))
    return ends.groupBy("id", "type").agg(F.count_if(relation_open(state)).alias("n"), F.count_if(locked & there).alias("locked"), F.count_if(hidden).alias("filtered"))


def evidence_within(events: Column, state: ViewState) -> Column:
    """The entries of an evidence array that a reader may see; an entry without a chapter counts as chapter 0."""
    return F.filter(events, lambda e: ~state.locked(e["ch"]) & ~state.not_yet(e["ch"]))


def late_characters(event_chars: DataFrame, firsts: DataFrame, slack: int = 5) -> DataFrame:
    """(char, n, at_end, first_ch): characters whose first chapter comes more than ``slack`` chapters after events they are in."""
    late = event_chars.join(firsts.select("char", "first_ch"), "char").where(F.col("first_ch") - F.col("ch") > slack)
    last = event_chars.groupBy("event").agg(F.max("ord").alias("end_ord"))
    return late.join(last, "event").groupBy("char").agg(F.count("*").alias("n"), F.count_if(F.col("ord") == F.col("end_ord")).alias("at_end"), F.first("first_ch").alias("first_ch"))


def main_text(lines: DataFrame, heading: str) -> DataFrame:
    """(text_id, nth, line, heading) of each text from its headings on; of a heading that occurs twice the last counts.

    A table of contents repeats the headings before the main text, so the
    earlier occurrences are no chapter starts.  Lines before the first heading
    that counts have a null one.
    """
    marked = lines.withColumn("title", F.when(F.col("line").rlike(heading), F.trim("line")))
    last = marked.where("title IS NOT NULL").groupBy("text_id", "title").agg(F.max("nth").alias("start"))
    starts = last.select("text_id", F.col("start").alias("nth"), F.col("title").alias("starts"))
    held = marked.join(starts, ["text_id", "nth"], "left")
    before = Window.partitionBy("text_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    return held.select("text_id", "nth", "line", F.last("starts", ignorenulls=True).over(before).alias("heading"))


def cited_and_declared(cited: DataFrame, declared: DataFrame, chapters: DataFrame) -> DataFrame:
    """(item, event, finding) where an item's citations and declarations of events differ.

    ``cited`` and ``declared`` have item, event and the item's chapter ``ch``;
    ``chapters`` has event and its own ``event_ch``.  Findings: missing (no such
    event), uncited, undeclared, other chapter.
    """
    c = cited.select("item", "event", F.col("ch").alias("cited_ch"), F.lit(True).alias("is_cited")).distinct()
    d = declared.select("item", "event", F.col("ch").alias("declared_ch"), F.lit(True).alias("is_declared")).distinct()
    both = c.join(d, ["item", "event"], "full_outer").join(chapters.select("event", "event_ch", F.lit(True).alias("known")), "event", "left")
    findings = F.array(
        F.when(F.col("known").isNull(), F.lit("missing")),
        F.when(F.col("known") & F.col("is_cited").isNull(), F.lit("uncited")),
        F.when(F.col("known") & F.col("is_declared").isNull(), F.lit("undeclared")),
        F.when(F.col("event_ch") != F.coalesce("declared_ch", "cited_ch"), F.lit("other chapter")),
    )
    return both.select("item", "event", F.explode(F.array_compact(findings)).alias("finding"))


def bold_tally(texts: DataFrame, field: str) -> DataFrame:
    """(field, n_texts, n_marks, n_unpaired): double stars in texts, and texts with an odd number of them."""
    n = F.regexp_count("text", F.lit(r"\*\*"))
    return texts.select(F.lit(field).alias("field"), n.alias("n")).where("n > 0").groupBy("field").agg(F.count("*").alias("n_texts"), F.sum("n").cast("long").alias("n_marks"), F.count_if(F.col("n") % 2 == 1).alias("n_unpaired"))


def latin_words(texts: DataFrame, least: int = 2) -> DataFrame:
    """(word, n): tokens of Latin letters, but for ids such as ``e-12``."""
    tokens = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z0-9_-]*"), F.lit(0))).alias("word"))
    return tokens.where((F.char_length("word") >= least) & ~F.col("word").rlike(r"^[a-z]+-?[0-9][\w-]*$")).groupBy("word").agg(F.count("*").alias("n"))


def quoted_spans(texts: DataFrame, left: str = "「", right: str = "」") -> DataFrame:
    """(text_id, nth, span): what stands between two marks, not nested."""
    pattern = f"{left}([^{left}{right}]*){right}"
    return texts.select("text_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("nth", "span"))


def generation_direction(edges: DataFrame, chars: DataFrame) -> DataFrame:
    """One row: parent edges whose parent's generation is lower, equal, higher (suspicious) or unknown."""
    g = chars.select("id", "generation")
    e = edges.join(g.select(F.col("id").alias("parent"), F.col("generation").alias("up")), "parent", "left").join(g.select(F.col("id").alias("child"), F.col("generation").alias("down")), "child", "left")
    return e.agg(
        F.count_if(F.col("up") < F.col("down")).alias("as_expected"),
        F.count_if(F.col("up") == F.col("down")).alias("equal"),
        F.count_if(F.col("up") > F.col("down")).alias("suspicious"),
        F.count_if(F.col("up").isNull() | F.col("down").isNull()).alias("unknown"),
    )


def name_ledger_problems(ledger: DataFrame, names: DataFrame, aliases: DataFrame, least_reason: int = 8) -> DataFrame:
    """(name, problem): ledger entries (name, why) that are repeated, without a reason, an alias, unknown, or differ from a main name only by a bracket."""
    entries = ledger.groupBy("name").agg(F.count("*").alias("n"), F.min(F.char_length("why")).alias("reason"))
    main = names.select("name").distinct().withColumn("is_main", F.lit(True))
    alias = aliases.select(F.col("alias").alias("name")).distinct().withColumn("is_alias", F.lit(True))
    bases = names.select(base_name(F.col("name")).alias("base")).distinct().withColumn("is_base", F.lit(True))
    e = entries.join(main, "name", "left").join(alias, "name", "left").join(bases, entries["name"] == bases["base"], "left")
    known = F.col("is_main").isNotNull()
    problems = F.array(
        F.when(F.col("n") > 1, F.lit("repeated")),
        F.when(F.coalesce("reason", F.lit(0)) < least_reason, F.lit("no reason")),
        F.when(~known & F.col("is_alias").isNotNull(), F.lit("alias")),
        F.when(~known & F.col("is_alias").isNull() & F.col("is_base").isNotNull(), F.lit("bracket left out")),
        F.when(~known & F.col("is_alias").isNull() & F.col("is_base").isNull(), F.lit("unknown")),
    )
    return e.select(entries["name"], F.explode(F.array_compact(problems)).alias("problem"))
