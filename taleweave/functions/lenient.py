"""Reading JSON that models and editors left unfinished or wrapped: columns of Spark's VARIANT and strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parses(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else.

    Spark's parser reads one value and leaves what follows, so the value is read
    inside a list, of which it must be all, and inside an object, out of which no
    bracket of a list leads.
    """
    alone = F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")) == 1
    return F.coalesce(alone & F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull(), F.lit(False))


def extract_json(text: Column) -> Column:
    """The JSON text in an answer: the whole of it, what stands in the first code fence, or from the first brace to the last; else null."""
    fenced = F.trim(F.regexp_extract(text, r"```(?:json)?\s*((?s:.*?))```", 1), F.lit(" \t\r\n"))
    braced = F.regexp_extract(text, r"(\{(?s:.*)\})", 1)
    return F.coalesce(*[F.when((c != "") & parses(c), c) for c in (text, fenced, braced)])


MARK = "struct<at: int, closing: string>"


def _marks(body: Column) -> Column:
    """Where brackets close outside strings, with the brackets that are still open there, innermost first: one fold over the characters."""
    start = F.struct(
        F.lit(0).alias("at"), F.lit("").alias("open"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.array().cast(f"array<{MARK}>").alias("marks")
    )

    def step(s: Column, c: Column) -> Column:
        outside = ~s["quoted"]
        closes = outside & c.isin("}", "]")
        opened = F.when(outside & (c == "{"), F.concat(F.lit("}"), s["open"])).when(outside & (c == "["), F.concat(F.lit("]"), s["open"])).when(closes, F.substring(s["open"], 2, 1 << 30)).otherwise(s["open"])
        quoted = F.when(s["quoted"], ~((c == '"') & ~s["escaped"])).otherwise(c == '"')
        marks = F.when(closes, F.concat(s["marks"], F.array(F.struct((s["at"] + 1).alias("at"), opened.alias("closing"))))).otherwise(s["marks"])
        return F.struct((s["at"] + 1).alias("at"), opened.alias("open"), quoted.alias("quoted"), (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"), marks.alias("marks"))

    return F.aggregate(F.split(body, ""), start, step, lambda s: s["marks"])


def repair_json(text: Column) -> Column:
    """An object's JSON text that was cut off, mended: cut after the last bracket at which closing what is open makes it whole; null if there is none.

    What stands before the first brace is left out.  A whole object is taken up
    to its last brace as it is.
    """
    body = F.regexp_extract(text, r"(\{(?s:.*))$", 1)
    whole = F.regexp_extract(body, r"^((?s:.*)\})", 1)
    mended = F.aggregate(
        F.reverse(_marks(body)),
        F.lit(None).cast("string"),
        lambda have, m: F.coalesce(have, F.when(parses(F.concat(F.left(body, m["at"]), m["closing"])), F.concat(F.left(body, m["at"]), m["closing"]))),
    )
    return F.when(body != "", F.coalesce(F.when((whole != "") & parses(whole), whole), mended))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def ledger_names(text: Column) -> Column:
    """struct<names: array<string>, entries: int, error: string> of a ledger of names to ignore.

    A ledger is a list, or an object with one under ``明细``; an entry is a string or
    an object with a string ``name``, and a string that begins with ``_`` is a
    remark.  Text that is no JSON, or has no list, is an error and no empty
    ledger; a null text (no file) gives null.
    """
    doc = F.try_parse_json(text)
    inner = F.when(F.startswith(_kind(doc), F.lit("OBJECT")), F.try_variant_get(doc, "$.明细", "variant"))
    found = F.when(F.startswith(_kind(doc), F.lit("ARRAY")), doc).when(F.startswith(_kind(inner), F.lit("ARRAY")), inner)
    entries = F.try_variant_get(found, "$", "array<variant>")
    said = lambda v: F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
    name = lambda e: F.when(_kind(e) == "STRING", F.when(~F.startswith(said(e), F.lit("_")), said(e))).when(F.startswith(_kind(e), F.lit("OBJECT")), said(F.try_variant_get(e, "$.name", "variant")))
    names = F.array_compact(F.transform(entries, name))
    error = F.when(doc.isNull(), "no JSON").when(found.isNull(), "no list")
    return F.when(text.isNotNull(), F.struct(F.coalesce(F.array_sort(F.array_distinct(names)), F.array().cast("array<string>")).alias("names"), F.coalesce(F.size(names), F.lit(0)).alias("entries"), error.alias("error")))
