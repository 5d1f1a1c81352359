"""Two-way reconciliation of ledgers with data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleweave.functions.scalars import BLANK, base_name


def reconcile(ledger: DataFrame, data: DataFrame, keys: list[str], value: str, least_reason: int = 8, reason: str | None = None) -> DataFrame:
    """keys and problem of every row that doesn't agree: unlisted, stale, differs, duplicate or without a reason."""
    entries = ledger.groupBy(*keys).agg(F.count("*").alias("n_entries"), F.min(value).alias("said"), *([F.min(F.char_length(reason)).alias("reason")] if reason else []))
    both = entries.join(data.select(*keys, F.col(value).alias("found"), F.lit(True).alias("there")), keys, "full_outer")
    problems = [
        F.when(F.col("n_entries").isNull(), F.lit("unlisted")),
        F.when(F.col("there").isNull(), F.lit("stale")),
        F.when(F.col("n_entries").isNotNull() & F.col("there") & ~F.col("said").eqNullSafe(F.col("found")), F.lit("differs")),
        F.when(F.col("n_entries") > 1, F.lit("duplicate")),
    ]
    if reason:
        problems.append(F.when(F.col("reason") < least_reason, F.lit("no reason")))
    return both.select(*keys, F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def other_name_problems(ledger: DataFrame, chars: DataFrame, sources: DataFrame) -> DataFrame:
    """(person, problem, name): other names in a ledger against those in the data, both ways.

    ``ledger``: person, alts (array), source; ``chars``: name, alt_names (array);
    ``sources``: source.  A person without an entry, an entry without a person,
    entries that are repeated, blank or of an unknown source are problems too.
    """
    none = F.array().cast("array<string>")
    problem = lambda df, kind, name=None: df.select("person", F.lit(kind).alias("problem"), (F.col(name) if name else F.lit(None)).cast("string").alias("name"))
    people = chars.select(F.col("name").alias("person")).distinct()
    said = ledger.select("person", F.explode("alts").alias("alt")).where(F.trim("alt") != "")
    there = chars.select(F.col("name").alias("person"), F.explode("alt_names").alias("alt")).where("alt IS NOT NULL").distinct()
    entries = ledger.select("person").distinct()
    alts = F.coalesce("alts", none)
    found = [
        problem(ledger.groupBy("person").count().where("count > 1"), "repeated"),
        problem(entries.join(people, "person", "left_anti"), "nobody"),
        problem(ledger.where(F.size(alts) == 0), "no names"),
        problem(ledger.where(F.exists(alts, lambda x: F.coalesce(F.trim(x), F.lit("")) == "")), "blank name"),
        problem(ledger.where(F.size(F.array_distinct(alts)) < F.size(alts)), "name repeated"),
        problem(ledger.where("source IS NOT NULL").join(sources.select("source").distinct(), "source", "left_anti"), "source unknown", "source"),
        problem(there.join(said.distinct(), ["person", "alt"], "left_anti").join(entries, "person", "left_semi"), "unlisted", "alt"),
        problem(there.join(entries, "person", "left_anti").select("person").distinct(), "no entry"),
        problem(said.distinct().join(people, "person", "left_semi").join(there, ["person", "alt"], "left_anti"), "stale", "alt"),
    ]
    return reduce(DataFrame.unionByName, found)


# What no name holds, and the length none has.
PROSE = "[：。；！？，]"
LONGEST_NAME = 12


def ignored_problems(ledger: DataFrame, persons: DataFrame, places: DataFrame) -> DataFrame:
    """(name, problem): entries (name, why, with_reason) of names to ignore that are blank, prose, hidden by ``_``, repeated, without a reason, or real.

    Plain entries that begin with ``_`` are remarks.  ``persons`` and ``places`` (name): all forms of names in the data.
    """
    e = ledger.where("with_reason OR name IS NULL OR NOT startswith(name, '_')")
    no_name = F.coalesce(F.trim("name"), F.lit("")) == ""
    prose = ~no_name & (F.col("name").rlike(PROSE) | (F.char_length("name") > LONGEST_NAME))
    hidden = ~no_name & ~prose & F.startswith("name", F.lit("_"))
    fine = ~no_name & ~prose & ~hidden
    real = lambda df, c: df.select("name").where("char_length(name) >= 2").distinct().withColumn(c, F.lit(True))
    grouped = e.groupBy("name").agg(F.count("*").alias("n"), F.max(F.col("with_reason") & (F.coalesce(F.trim("why"), F.lit("")) == "")).alias("unexplained"))
    known = grouped.join(real(persons, "person"), "name", "left").join(real(places, "place"), "name", "left")
    problems = F.array(
        F.when(no_name, F.lit("blank")),
        F.when(prose, F.lit("prose")),
        F.when(hidden, F.lit("hidden")),
        F.when(fine & (F.col("n") > 1), F.lit("repeated")),
        F.when(F.col("unexplained"), F.lit("no reason")),
        F.when(fine & F.col("person"), F.lit("a person")),
        F.when(fine & F.col("person").isNull() & F.col("place"), F.lit("a place")),
    )
    return known.select("name", F.explode(F.array_compact(problems)).alias("problem"))


def exemption_problems(ledger: DataFrame, chars: DataFrame, least_reason: int = 8) -> DataFrame:
    """(book, src, dst, problem): exemptions (book, src, dst, why) from checks of kinship terms; ``chars``: book, id."""
    key = ["book", "src", "dst"]
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    known = chars.select("book", "id").distinct()
    end = lambda c: known.select("book", F.col("id").alias(c), F.lit(True).alias(f"{c}_known"))
    e = ledger.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.char_length(F.coalesce(F.trim("why"), F.lit("")))).alias("reason"))
    e = e.join(chars.select("book").distinct().withColumn("book_known", F.lit(True)), "book", "left").join(end("src"), ["book", "src"], "left").join(end("dst"), ["book", "dst"], "left")
    whole = filled("book") & filled("src") & filled("dst")
    problems = F.array(
        F.when(~whole, F.lit("field missing")),
        F.when(F.col("reason") < least_reason, F.lit("no reason")),
        F.when(filled("book") & F.col("book_known").isNull(), F.lit("book unknown")),
        F.when(F.col("book_known") & filled("src") & F.col("src_known").isNull(), F.lit("nobody first")),
        F.when(F.col("book_known") & filled("dst") & F.col("dst_known").isNull(), F.lit("nobody second")),
        F.when(filled("src") & (F.col("src") == F.col("dst")), F.lit("one person")),
        F.when(F.col("n") > 1, F.lit("repeated")),
    )
    return e.select(*key, F.explode(F.array_compact(problems)).alias("problem"))


def coverage_problems(declared: DataFrame, chars: DataFrame, pattern: str) -> DataFrame:
    """(name, problem): main names that ``pattern`` (whole name) can't yield must be declared, and only those.

    ``declared``: name; ``chars``: name, aliases (array).
    """
    yields = F.coalesce(F.col("name").rlike(f"^(?:{pattern})$"), F.lit(False))
    main = chars.select("name").distinct().withColumn("is_main", F.lit(True))
    alias = chars.select(F.explode("aliases").alias("name")).distinct().withColumn("is_alias", F.lit(True))
    e = declared.groupBy("name").agg(F.count("*").alias("n")).join(main, "name", "full_outer").join(alias, "name", "left")
    problems = F.array(
        F.when(F.col("n").isNull() & F.col("is_main") & ~yields, F.lit("undeclared")),
        F.when(F.col("n") > 1, F.lit("repeated")),
        F.when(F.col("n").isNotNull() & F.col("is_main") & yields, F.lit("within reach")),
        F.when(F.col("n").isNotNull() & F.col("is_main").isNull() & F.col("is_alias"), F.lit("alias")),
        F.when(F.col("n").isNotNull() & F.col("is_main").isNull() & F.col("is_alias").isNull(), F.lit("unknown")),
    )
    return e.select("name", F.explode(F.array_compact(problems)).alias("problem"))


def actor_problems(ledger: DataFrame, flags: DataFrame, least_reason: int = 8) -> DataFrame:
    """(book, src, dst, problem): the ledger (book, src, dst, flag, why) of relations whose actors were found wanting against the flags found."""
    return reconcile(ledger, flags, ["book", "src", "dst"], "flag", least_reason, "why")


LATE = 5  # chapters by which a first chapter may come after the first occurrence


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def _problems(df: DataFrame, *columns: str, **found: Column) -> DataFrame:
    """A row for every problem (named by keyword, underscores for blanks) that holds."""
    each = F.array_compact(F.array(*[F.when(c, F.lit(name.replace("_", " "))) for name, c in found.items()]))
    return df.select(*columns, F.explode(each).alias("problem"))


def declared_counts(declared: DataFrame, counted: DataFrame) -> DataFrame:
    """(book, said, found): books whose ledger states another number (book, n) than there is (a row of ``counted`` (book) each); null numbers state nothing."""
    n = counted.groupBy("book").agg(F.count("*").alias("found"))
    both = declared.where("n IS NOT NULL").select("book", F.col("n").cast("long").alias("said")).join(n, "book", "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    return both.where("said <> found").select("book", "said", "found")


def rejected_problems(rejected: DataFrame) -> DataFrame:
    """(book, alt, problem): rejected other names (book, alt, why) need a name and a reason."""
    return _problems(rejected, "book", "alt", blank_name=_blank("alt"), no_reason=_blank("why"))


def first_chapter_problems(ledger: DataFrame, chars: DataFrame, kinds: tuple[str, ...], late: DataFrame | None = None, slack: int = LATE, least_reason: int = 8) -> DataFrame:
    """(book, name, problem): entries of first chapters that are meant to be late.

    ``ledger``: book, name, first_ch, text_first, kind, why; ``chars``: book, name,
    first_ch (of a name the first counts); ``late`` (book, name): what an audit of
    the texts finds late and unsettled; without it, whether the ledger is whole
    isn't judged.
    """
    key = ["book", "name"]
    n = ledger.groupBy(*key).agg(F.count("*").alias("n"))
    known = chars.groupBy(*key).agg(F.min("first_ch").alias("data_ch"), F.lit(True).alias("known"))
    books = chars.select("book").distinct().withColumn("book_known", F.lit(True))
    e = ledger.join(n, key, "left").join(known, key, "left").join(books, "book", "left")
    positive = lambda c: F.coalesce(F.col(c) >= 1, F.lit(False))
    named = F.col("book").isNotNull() & F.col("name").isNotNull()
    reason = F.char_length(F.regexp_replace(F.coalesce("why", F.lit("")), BLANK, ""))
    out = _problems(
        e,
        *key,
        field_missing=_blank("book") | _blank("name"),
        first_chapter_illegal=~positive("first_ch"),
        text_chapter_illegal=~positive("text_first"),
        no_reason=reason < least_reason,
        kind_unknown=~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)),
        repeated=F.coalesce(F.col("n") > 1, F.lit(False)),
        book_unknown=named & F.col("book_known").isNull(),
        nobody=F.col("book_known") & F.col("name").isNotNull() & F.col("known").isNull(),
        chapter_differs=F.col("known") & positive("first_ch") & ~F.col("data_ch").eqNullSafe(F.col("first_ch")),
        not_late=F.col("known") & positive("first_ch") & positive("text_first") & (F.col("first_ch") - F.col("text_first") <= slack),
    ).distinct()
    if late is None:
        return out
    return out.unionByName(late.select(*key).distinct().join(ledger.select(*key), key, "left_anti").withColumn("problem", F.lit("unlisted")))


def same_name_problems(ledger: DataFrame, chars: DataFrame, least_reason: int = 8) -> DataFrame:
    """(book, base, problem): people whose names agree but for brackets, against a ledger of such groups, both ways.

    ``ledger``: book, base, members (array of ids), why; ``chars``: book, id,
    name.  Without a ledger every group is unlisted.  Every name of a group needs a
    bracket to be told apart.
    """
    key = ["book", "base"]
    bare = ~F.col("name").rlike("[（(]")
    groups = chars.groupBy("book", base_name(F.col("name")).alias("base")).agg(F.sort_array(F.collect_set("id")).alias("ids"), F.count("*").alias("n"), F.max(bare).alias("bare")).where("n > 1")
    e = ledger.withColumn("entries", F.lit(1)).groupBy(*key).agg(F.count("*").alias("entries"), F.first(F.coalesce("members", F.array().cast("array<string>"))).alias("members"), F.min(F.char_length(F.trim(F.coalesce("why", F.lit(""))))).alias("reason"))
    both = e.join(groups, key, "full_outer")
    listed, there = F.col("entries").isNotNull(), F.col("n").isNotNull()
    outside = F.size(F.array_except("members", "ids")) > 0
    return _problems(
        both,
        *key,
        stale=listed & ~there,
        outsider=listed & there & outside,
        members_differ=listed & there & (outside | (F.size("members") != F.size("ids"))),
        repeated=listed & (F.col("entries") > 1),
        no_reason=listed & (F.col("reason") < least_reason),
        unlisted=there & ~listed,
        no_bracket=there & F.col("bare"),
    )


def cross_chapter_problems(ledger: DataFrame, items: DataFrame, events: DataFrame, least_reason: int = 8) -> DataFrame:
    """(book, ch, event, problem): entries of events that an annotation of another chapter declares on purpose; the first problem of each counts.

    ``ledger``: book, ch, event, why; ``items``: book, ch, events (array);
    ``events``: book, event, ch.  Declarations across chapters that no entry
    settles are ``unlisted``.
    """
    key = ["book", "ch", "event"]
    whole = ~_blank("book") & F.coalesce(F.col("ch") >= 1, F.lit(False)) & ~_blank("event")
    entries = ledger.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.char_length(F.trim(F.coalesce("why", F.lit(""))))).alias("reason"))
    flag = lambda df, c, *on: df.select(*on).distinct().withColumn(c, F.lit(True))
    declared = items.select("book", "ch", F.explode("events").alias("event")).distinct()
    own = events.groupBy("book", "event").agg(F.min("ch").alias("event_ch"), F.lit(True).alias("event_known"))
    both_books = items.select("book").distinct().join(events.select("book").distinct(), "book", "left_semi")
    e = entries.join(flag(both_books, "book_known", "book"), "book", "left").join(flag(items, "item_known", "book", "ch"), ["book", "ch"], "left")
    e = e.join(own, ["book", "event"], "left").join(flag(declared, "declared", *key), key, "left")
    first = (
        F.when(~whole, "field missing")
        .when(F.col("reason") < least_reason, "no reason")
        .when(F.col("book_known").isNull(), "book unknown")
        .when(F.col("item_known").isNull(), "no annotation")
        .when(F.col("event_known").isNull(), "event unknown")
        .when(F.col("declared").isNull(), "undeclared")
        .when(F.col("event_ch") == F.col("ch"), "same chapter")
    )
    again = entries.where(whole & (F.col("n") > 1)).select(*key, F.lit("repeated").alias("problem"))
    across = declared.join(own, ["book", "event"]).where(F.col("event_ch") != F.col("ch")).select(*key)
    open_ = across.join(entries.where(whole).select(*key), key, "left_anti").select(*key, F.lit("unlisted").alias("problem"))
    return e.select(*key, first.alias("problem")).where("problem IS NOT NULL").unionByName(again).unionByName(open_)


def name_form_problems(ledger: DataFrame, chars: DataFrame) -> DataFrame:
    """(book, name, problem, owner): entries (book, name, why) on how main names are written; ``owner`` is whose alias the name is instead.

    ``chars``: book, name, aliases (array).
    """
    key = ["book", "name"]
    main = chars.select(*key).distinct().withColumn("is_main", F.lit(True))
    alias = chars.select("book", F.col("name").alias("owner"), F.explode("aliases").alias("alias")).groupBy("book", F.col("alias").alias("name")).agg(F.min("owner").alias("owner"))
    books = chars.select("book").distinct().withColumn("book_known", F.lit(True))
    e = ledger.groupBy(*key).agg(F.count("*").alias("n"), F.max(_blank("why")).alias("unexplained")).join(books, "book", "left").join(main, key, "left").join(alias, key, "left")
    there, named = F.col("book_known").isNotNull(), ~_blank("name")
    lone = there & named & F.col("is_main").isNull()
    found = _problems(
        e.withColumn("owner", F.when(lone, F.col("owner"))),
        *key,
        "owner",
        book_unknown=~there,
        blank_name=there & ~named,
        no_reason=there & named & F.col("unexplained"),
        repeated=there & named & (F.col("n") > 1),
        alias=lone & F.col("owner").isNotNull(),
        unknown=lone & F.col("owner").isNull(),
    )
    return found.select(*key, "problem", F.when(F.col("problem") == "alias", F.col("owner")).alias("owner"))
