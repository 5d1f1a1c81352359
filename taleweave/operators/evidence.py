"""Audits of evidence against the books' own texts: who acts in a relation's evidence, and quotes in ledgers.

``sources`` have a row a book, or one for each piece of its text, numbered
(``nth``, joined by blanks); texts are searched in slices.
A book whose text is missing can't be judged by it: such verdicts are null or
``not judged``, never "no problem".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.operators.graph import cut_lineage
from taleweave.operators.kin import BRACKET_TAIL, is_parent_child
from taleweave.operators.matching import held, occurring, places
from taleweave.operators.textmine import HEAD

# Blanks and dots that names are compared without, quotation marks, signs of a pronoun, kin besides parents, dots of an elision, what tells a derived text.
BLANKS, DOTS = r"\s　 ", "·・･"
QUOTED, VERBATIM = "[「『]([^」』]+)[」』]", "[「『][^」』]{2,}[」』]"
PRONOUNS = "[他她其此人该]"
OTHER_KIN = "叔侄|姑侄|舅甥|姨甥|祖孙|兄弟|姐妹|夫妻|父子|母子|父女|母女"
ELISION = "[…⋯]+"
DERIVED = "由.*推导"


def flat(text: Column) -> Column:
    """Without blanks and dots between names."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANKS}{DOTS}]", "")


def printed(text: Column) -> Column:
    """Without blanks, as it is printed otherwise."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANKS}]", "")


def actor_findings(rels: DataFrame, evidence: DataFrame, chars: DataFrame, sources: DataFrame) -> DataFrame:
    """(book, rel, nth, src, dst, nameless, third, missing, thirds): who acts in each piece of evidence.

    ``rels``: book, rel, src, dst, type; ``evidence``: book, rel, nth, text,
    derived; ``chars``: book, id, name, aliases (array); ``sources``: book, text.

    nameless (A): a quotation with a pronoun that names neither end.  third (B): the
    text, found in the book, names somebody else who is kin to an end and whose
    name is no part of an end's names, nor holds one.  missing (C): a quotation that
    the book doesn't have.  B and C are null where the book's text is missing.
    Derived evidence is left out, and so is blank.
    """
    ev = evidence.where("NOT coalesce(derived, false)").where(~F.coalesce(F.col("text"), F.lit("")).rlike(DERIVED))
    ev = ev.withColumn("whole", flat(F.col("text"))).where("whole <> ''").join(rels.select("book", "rel", "src", "dst"), ["book", "rel"])
    key = ["book", "rel", "nth"]
    ev = ev.select(*key, "src", "dst", "whole", F.col("text").rlike(VERBATIM).alias("verbatim"), F.array_distinct(F.concat(F.transform(F.regexp_extract_all("text", F.lit(QUOTED), F.lit(1)), flat), F.array("whole"))).alias("quotes"))
    names = chars.select("book", F.col("id").alias("char"), flat(F.col("name")).alias("main"), F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), flat)).alias("forms"))
    names = names.withColumn("forms", F.filter("forms", lambda f: F.char_length(f) >= 2))
    forms = names.select("book", "char", "main", F.explode("forms").alias("form"))
    named = occurring(ev.select(*key, "src", "dst", F.col("whole").alias("text")), forms.select("form")).select(*key, "src", "dst", "form").join(forms, ["book", "form"])
    named = cut_lineage(named.withColumn("is_end", (F.col("char") == F.col("src")) | (F.col("char") == F.col("dst"))))
    # the book's text: the first signs of any quotation place the evidence
    heads = ev.select(*key, F.explode("quotes").alias("q")).where(F.char_length("q") >= 2).select(*key, F.left("q", F.lit(HEAD)).alias("form"))
    known = sources.where("text IS NOT NULL").select("book").distinct()
    located = heads.join(held(sources, flat, heads.select("form").distinct()), ["book", "form"], "left_semi").select(*key).distinct()
    # kin to an end, named in full, and no namesake of an end
    akin = rels.where(is_parent_child(F.col("type")) | F.regexp_replace("type", BRACKET_TAIL, "").rlike(OTHER_KIN))
    pairs = akin.select("book", F.col("src").alias("end"), F.col("dst").alias("char")).union(akin.select("book", "dst", "src")).distinct()
    others = named.where("form = main AND NOT is_end").withColumn("end", F.explode(F.array("src", "dst"))).join(pairs, ["book", "end", "char"], "left_semi")
    others = others.select(*key, "src", "dst", "char", "form").distinct()
    of = lambda c: names.select("book", F.col("char").alias(c), F.col("forms").alias(f"{c}_forms"))
    none = F.array().cast("array<string>")
    others = others.join(of("src"), ["book", "src"], "left").join(of("dst"), ["book", "dst"], "left")
    alike = F.exists(F.concat(F.coalesce("src_forms", none), F.coalesce("dst_forms", none)), lambda p: F.contains(p, F.col("form")) | F.contains(F.col("form"), p))
    thirds = others.where(~alike).groupBy(*key).agg(F.sort_array(F.collect_set("char")).alias("thirds"))
    yes = lambda df, c: df.select(*key).distinct().withColumn(c, F.lit(True))
    out = ev.join(yes(named.where("is_end"), "has_end"), key, "left").join(yes(located, "is_located"), key, "left").join(thirds, key, "left")
    out = out.join(known.withColumn("judged", F.lit(True)), "book", "left")
    there = F.coalesce("is_located", F.lit(False))
    found = F.when(there & F.col("judged"), F.coalesce("thirds", none)).otherwise(none)
    return out.select(
        *key,
        "src",
        "dst",
        (F.col("verbatim") & F.col("whole").rlike(PRONOUNS) & F.col("has_end").isNull()).alias("nameless"),
        F.when(F.col("judged"), F.size(found) > 0).alias("third"),
        F.when(F.col("judged"), F.col("verbatim") & ~there).alias("missing"),
        found.alias("thirds"),
    )


def relation_flags(findings: DataFrame) -> DataFrame:
    """(book, src, dst, flag): the letters A, B and C that hold for some evidence of a relation, for ``ledgers.actor_problems``."""
    letter = F.array_compact(F.array(F.when(F.col("nameless"), F.lit("A")), F.when(F.col("third"), F.lit("B")), F.when(F.col("missing"), F.lit("C"))))
    each = findings.select("book", "src", "dst", F.explode(letter).alias("letter"))
    return each.groupBy("book", "src", "dst").agg(F.array_join(F.sort_array(F.collect_set("letter")), "").alias("flag"))


def in_order(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """``asked`` (book, quote, parts) whose parts all stand in the book's text, without blanks, one after the other.

    Every part goes to its first place after the part before, which is never too late; all quotes advance by one part a round.
    Places and quotes are sorted together, so a place is read once for all quotes.
    """
    forms = asked.select(F.explode("parts").alias("form")).distinct()
    found = cut_lineage(places(sources, printed, forms))
    ends = found.select("book", "form", F.col("start").alias("pos"), "stop")
    after = Window.partitionBy("book", "form").orderBy(F.desc("pos"), "is_asked").rowsBetween(Window.unboundedPreceding, 0)
    going = asked.select("book", "quote", "parts", F.lit(0).cast("long").alias("pos")).distinct()
    most = asked.agg(F.max(F.size("parts"))).first()[0] or 0
    for k in range(most):
        done = going.where(F.size("parts") <= k)
        left = going.where(F.size("parts") > k).withColumn("form", F.get("parts", F.lit(k)))
        both = left.withColumn("is_asked", F.lit(True)).unionByName(ends.withColumn("is_asked", F.lit(False)), allowMissingColumns=True)
        met = both.withColumn("next", F.min("stop").over(after)).where("is_asked AND next IS NOT NULL")
        going = cut_lineage(done.unionByName(met.select("book", "quote", "parts", F.col("next").alias("pos"))))
    return going.select("book", "quote")


def ledger_quotes(ledger: DataFrame, sources: DataFrame) -> DataFrame:
    """(book, entry, nth, quote, verdict): quotes 「」 in the reasons of ledger entries, against the book's text.

    ``ledger``: book, entry, why, subjects (array of names); ``sources``: book,
    text.  Verdicts: ``not judged`` (no text of the book, or no subject), ``aside``
    (the quote names no subject of its entry), ``found`` and ``missing`` (as printed,
    blanks aside), ``elided`` (with dots of omission, its parts standing in order)
    and ``elided, missing``.
    """
    each = ledger.select("book", "entry", "subjects", F.posexplode(F.regexp_extract_all("why", F.lit("「([^」]+)」"), F.lit(1))).alias("nth", "quote"))
    each = each.withColumn("form", printed(F.col("quote"))).withColumn("is_elided", F.col("quote").rlike(ELISION))
    known = sources.where("text IS NOT NULL").select("book").distinct()
    subjects = F.filter(F.transform(F.coalesce("subjects", F.array().cast("array<string>")), lambda s: flat(F.regexp_replace(s, BRACKET_TAIL, ""))), lambda s: s != "")
    names = F.exists(subjects, lambda s: F.contains(flat(F.col("quote")), s))
    each = each.withColumn("has_subject", F.size(subjects) > 0).withColumn("names", F.coalesce(names, F.lit(False)))
    each = cut_lineage(each.select("book", "entry", "nth", "quote", "form", "is_elided", "has_subject", "names"))  # read several times below
    whole = held(sources, printed, each.where("NOT is_elided").select("form").distinct()).withColumn("whole", F.lit(True))
    parts = F.filter(F.split(F.col("form"), ELISION, -1), lambda p: p != "")
    ordered = in_order(each.where("is_elided").select("book", F.col("form").alias("quote"), parts.alias("parts")), sources)
    out = each.join(whole, ["book", "form"], "left").join(ordered.select("book", F.col("quote").alias("form"), F.lit(True).alias("ordered")).distinct(), ["book", "form"], "left")
    out = out.join(known.withColumn("judged", F.lit(True)), "book", "left")
    verdict = (
        F.when(F.col("judged").isNull() | ~F.col("has_subject"), "not judged")
        .when(F.col("is_elided"), F.when(F.col("ordered"), "elided").otherwise("elided, missing"))
        .when(~F.col("names"), "aside")
        .when(F.col("whole"), "found")
        .otherwise("missing")
    )
    return out.select("book", "entry", "nth", "quote", verdict.alias("verdict"))
