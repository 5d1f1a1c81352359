"""Text mining against source texts: occurrences, quotes, gaps in the list of names, markup and leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.functions.scalars import BLANK
from taleweave.operators.matching import occurring

NEAR = 90  # characters between a candidate and a known name
HEAD = 40  # characters by which a quote is located
# Fixed values: (name, pattern) of internal wording that mustn't reach readers; the first that fits counts.
LEAKS = (("secret", "token = \"[0-9a-f]+\""), ("address", "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+"), ("mail", "[A-Za-z0-9.]+@[A-Za-z0-9.]+"), ("license", "Licensed under|All rights reserved"))
#: Marks that come in pairs.
PAIRS = (("(", ")"), ("[", "]"), ("<", ">"), ("「", "」"))


def flat(text: Column) -> Column:
    """Without any blanks."""
    return F.regexp_replace(text, f"{BLANK}+", "")


def form_counts(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """(form, n_texts, n): occurrences of the forms in all texts."""
    hit = occurring(texts.select("text_id", "text"), forms)
    return hit.groupBy("form").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n"))


def words_with_position(texts: DataFrame, pattern: str) -> DataFrame:
    """(text_id, nth, word): tokens in order."""
    return texts.select("text_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("nth", "word"))


def first_occurrences(texts: DataFrame, names: DataFrame, pattern: str) -> DataFrame:
    """(name, first): the first text, by number, that holds the name as a token; equality, so no text meets all names."""
    tokens = texts.select("text_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("name"))
    return tokens.join(names.select("name").distinct(), "name").groupBy("name").agg(F.min("text_id").alias("first"))


def first_mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(name, first): the first text, by number, that holds the name, in scripts without blanks too; not as a part of a longer dotted name."""
    hit = occurring(texts.select("text_id", "text"), names.select(F.col("name").alias("form")))
    return hit.where("alone").groupBy(F.col("form").alias("name")).agg(F.min("text_id").alias("first"))


def audit_first(firsts: DataFrame, claimed: DataFrame, slack: int, ledger: DataFrame) -> DataFrame:
    """Claims later than the first occurrence by more than ``slack``, less those a ledger has settled."""
    late = claimed.join(firsts, "name").where(F.col("claimed") - F.col("first") > slack)
    return late.join(ledger.select("name"), "name", "left_anti")


def locate_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote_id, n_texts, first_text, n_whole): texts that hold the head of a quote, and the whole of it, blanks aside.

    Heads and quotes are forms of one search, so quotes of any script and length
    are found; a quote of blanks alone is not.
    """
    q = quotes.select("quote_id", flat(F.col("quote")).alias("quote")).withColumn("head", F.substring("quote", 1, HEAD))
    forms = q.select(F.explode(F.array("head", "quote")).alias("form"))
    hit = occurring(texts.select("text_id", flat(F.col("text")).alias("text")), forms).select("text_id", "form")
    whole = hit.select("text_id", F.col("form").alias("quote"), F.lit(1).alias("whole"))
    found = hit.join(q, hit["form"] == q["head"]).join(whole, ["text_id", "quote"], "left")
    return found.groupBy("quote_id").agg(F.count("*").alias("n_texts"), F.min("text_id").alias("first_text"), F.count("whole").alias("n_whole"))


# Signs before a quoted run that turn its meaning.
NEGATIONS = "不非未无莫勿没毋弗"
TAIL = r"[，。！？；、,.!?;:：…—\s　]+$"


def quote_class(quote: Column, spans: Column, found: Column) -> Column:
    """``unlocated``, ``quote`` (a whole quoted span of the source), ``negated`` (a part of one, after a negation), ``partial`` (another part) or ``epithet`` (in no span).

    ``spans`` are the source's quoted spans in order; the first that holds the quote decides between the parts.
    """
    bare = lambda c: F.regexp_replace(c, TAIL, "")
    q = bare(quote)
    inside = F.get(F.filter(F.transform(spans, bare), lambda s: F.contains(s, q)), F.lit(0))
    before = F.substring(inside, F.instr(inside, q) - 1, F.lit(1))
    part = F.when((F.instr(inside, q) > 1) & F.contains(F.lit(NEGATIONS), before), "negated").otherwise("partial")
    whole = F.exists(spans, lambda s: bare(s) == q)
    return F.when(q == "", "partial").when(~found, "unlocated").when(whole, "quote").when(inside.isNotNull(), part).otherwise("epithet")


def gap_candidates(texts: DataFrame, pattern: str, known: DataFrame, least: int, ledger: DataFrame) -> DataFrame:
    """(word, n): tokens of a pattern that occur ``least`` times, are no known name and aren't settled."""
    tokens = texts.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("word"))
    counted = tokens.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counted.join(known.select(F.col("name").alias("word")), "word", "left_anti").join(ledger.select(F.col("name").alias("word")), "word", "left_anti")


def near_pairs(a: DataFrame, b: DataFrame, distance: int) -> DataFrame:
    """Rows of ``a`` (text_id, pos, ...) with some row of ``b`` (text_id, pos) within ``distance``: an equi-join on buckets of positions."""
    width = distance + 1
    spread = b.select("text_id", F.col("pos").alias("pos_b"), F.explode(F.array(*[F.floor(F.col("pos") / width) + k for k in (-1, 0, 1)])).alias("bucket"))
    left = a.withColumn("bucket", F.floor(F.col("pos") / width))
    return left.join(spread, ["text_id", "bucket"]).where(F.abs(F.col("pos") - F.col("pos_b")) <= distance).select(*a.columns).distinct()


def positions(texts: DataFrame, pattern: str) -> DataFrame:
    """(text_id, pos, word): tokens with the number of characters before them."""
    words = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    both = texts.select("text_id", F.posexplode(F.zip_with(F.slice(F.split("text", pattern, -1), F.lit(1), F.size(words)), words, lambda g, w: F.struct(g.alias("gap"), w.alias("word")))).alias("nth", "t"))
    before = Window.partitionBy("text_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.sum(F.char_length("t.gap") + F.char_length("t.word")).over(before)
    return both.withColumn("pos", (reach - F.char_length("t.word")).cast("int")).select("text_id", "pos", "t.word")


def leak_of(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(LEAKS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def unbalanced(text: Column) -> Column:
    """The pairs of marks whose counts differ, joined by a blank."""
    count = lambda m: F.char_length(text) - F.char_length(F.replace(text, F.lit(m), F.lit("")))
    return F.array_join(F.array_compact(F.array(*[F.when(count(a) != count(b), F.lit(a + b)) for a, b in PAIRS])), " ")


def script_kind(texts: DataFrame) -> DataFrame:
    """text_id, dots per 10,000 characters, and whether the text reads as a translation (5 or more)."""
    n = F.char_length("text")
    dots = n - F.char_length(F.replace("text", F.lit("·"), F.lit("")))
    rate = F.round(10000 * dots / F.greatest(n, F.lit(1)), 6)
    return texts.select("text_id", rate.alias("rate"), (rate >= 5).alias("translation"))


def chapters(texts: DataFrame, heading: str) -> DataFrame:
    """(text_id, chapter, n_lines, n_chars): lines grouped under the last heading before them; chapter 0 precedes the first."""
    lines = texts.select("text_id", F.posexplode(F.split("text", "\n")).alias("nth", "line"))
    w = Window.partitionBy("text_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("chapter", F.sum(F.when(F.col("line").rlike(heading), 1).otherwise(0)).over(w).cast("int"))
    return marked.groupBy("text_id", "chapter").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("line")).alias("n_chars"))


# What says that somebody speaks, endings that are no part of a name, beginnings that are nobody's, and the lengths of names.
SAYS = "([一-鿿]{2,4})(?:笑|怒|惊|喜|叹|问|喝|叱|呼|叫|拍|顿|抚|指|答|回|冷|仰|大)?曰"
TAIL_WORDS = "(?:大笑|大怒|大惊|大叫|大呼|大哭|大喝|高叫|笑|怒|惊|喜|叹|问|喝|叱|呼|叫|拍|顿|抚|指|答|回|冷|仰|曰)$"
NOBODY = "^(?:左右|百姓|军民|父子|兄弟|夫妻|陛下|主公|将士|军士|部下|帐下|麾下|百官|群臣|文武|先主|后主|四众|三众|二众|曹众|吴众|蜀众|魏众|众|诸|某|吾|汝|尔|彼|这|那)"
SPOKEN = (2, 3)


def unseen_speakers(texts: DataFrame, known: DataFrame, initials: DataFrame, least: int, says: str = SAYS, tail: str = TAIL_WORDS, nobody: str = NOBODY, lengths: tuple[int, int] = SPOKEN) -> DataFrame:
    """(name, said, n): who speaks in the texts and is no known name: how often so, and how often the name occurs in all.

    Endings (``tail``) are taken off twice.  Names begin with a surname's sign
    (``initials``: sign), have ``lengths`` characters and occur ``least`` times.
    """
    who = texts.select(F.explode(F.regexp_extract_all("text", F.lit(says), F.lit(1))).alias("name")).groupBy("name").agg(F.count("*").alias("said"))
    for _ in range(2):
        who = who.withColumn("name", F.regexp_replace("name", tail, ""))
    who = who.groupBy("name").agg(F.sum("said").alias("said")).where(F.char_length("name").between(*lengths) & ~F.col("name").rlike(nobody))
    who = who.join(known.select("name").distinct(), "name", "left_anti").withColumn("sign", F.left("name", F.lit(1))).join(initials.select("sign").distinct(), "sign", "left_semi").select("name", "said")
    n = form_counts(texts, who.select(F.col("name").alias("form"))).select(F.col("form").alias("name"), "n")
    return who.join(n, "name").where(F.col("n") >= least).select("name", "said", "n")
