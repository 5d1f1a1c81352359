"""Which texts hold which forms, and where: all forms in one pass over a text, in any script.

Forms are an automaton in every task: all of them where they are few enough
(MOST_FORMS and MOST_CHARS, counted first), else a part of them at a time, each
part meeting every bucket of texts.  So neither side is ever exploded into grams,
and no table is broadcast whose size isn't known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from taleweave.operators.graph import cut_lineage

MOST_FORMS, MOST_CHARS = 50_000, 2_000_000  # in one automaton
BUCKET_BYTES = 16 << 20  # of texts that meet a part of the forms
BITE_BYTES = 1 << 20  # of texts searched before what was found becomes columns; a longer text is one bite
SLICE_CHARS = 1 << 16  # of a slice of a book
# What makes an occurrence a part of a longer dotted name, or of a name with an ordinal.
DOT, ORDINAL = "·", "（第"

Kernel = Callable[["object", str], list[tuple]]


def automaton(forms: list[str]):
    """None without forms."""
    import ahocorasick

    if not forms:
        return None
    out = ahocorasick.Automaton()
    for form in forms:
        out.add_word(form, form)
    out.make_automaton()
    return out


def text_spans(find, text: str) -> list[tuple]:
    return [(end + 1 - len(form), end + 1, form) for end, form in find.iter(text)]


def _held(find, text: str) -> list[tuple]:
    """(form, occurrences that don't overlap, whether one stands alone)."""
    found: dict[str, list] = {}
    for end, form in find.iter(text):
        start = end + 1 - len(form)
        have = found.setdefault(form, [0, -1, False])
        if start >= have[1]:
            have[0], have[1] = have[0] + 1, end + 1
        have[2] = have[2] or not (text[start - 1 : start] == DOT or text[end + 1 : end + 2] == DOT or text.startswith(ORDINAL, end + 1))
    return [(form, n, alone) for form, (n, _, alone) in found.items()]


def _rows(find, batch: pa.RecordBatch | pa.Table, others: list[str], names: list[str], kernel: Kernel) -> pa.Table:
    at: list[int] = []
    out: list[tuple] = []
    for i, text in enumerate(batch["text"].to_pylist()):
        if text and find is not None:
            found = kernel(find, text)
            at += [i] * len(found)
            out += found
    columns = list(zip(*out, strict=True)) if out else [() for _ in names]
    return pa.table([*(batch[c].take(pa.array(at, pa.int64())) for c in others), *map(list, columns)], names=[*others, *names])


def _bites(rows: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch | pa.Table]:
    """Rows in order, as many at a time as have BITE_BYTES of text."""
    first = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(rows["text"]), 0).to_pylist()):
        if size and size + n > BITE_BYTES:
            yield rows.slice(first, i - first)
            first, size = i, 0
        size += n
    yield rows.slice(first)


def parts_for(n: int, chars: int) -> int:
    """In how many automata ``n`` forms of ``chars`` characters go."""
    return max(-(-n // MOST_FORMS), -(-chars // MOST_CHARS))


def scanned(texts: DataFrame, forms: DataFrame, kernel: Kernel, fields: list[StructField]) -> DataFrame:
    """The columns of ``texts`` but its text, and what ``kernel`` finds of ``forms`` (form) in every text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = texts.sparkSession
    others = [c for c in texts.columns if c != "text"]
    schema = StructType([*(texts.schema[c] for c in others), *fields])
    arrow, names = to_arrow_schema(schema), [f.name for f in fields]
    distinct = forms.where("form <> ''").select("form").distinct()
    size = distinct.agg(F.count("*").alias("n"), F.sum(F.char_length("form")).alias("chars")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    parts = parts_for(size["n"], size["chars"])
    if parts == 1:
        few = sorted(r["form"] for r in distinct.collect())  # bounded by the counts above

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = automaton(few)
            for batch in batches:
                for bite in _bites(batch):
                    yield from _rows(find, bite, others, names, kernel).cast(arrow).to_batches()

        return texts.select(*others, "text").mapInArrow(scan, schema)

    def meet(own: pa.Table, some: pa.Table) -> pa.Table:
        find = automaton(some["form"].to_pylist())
        return pa.concat_tables([_rows(find, bite, others, names, kernel).cast(arrow) for bite in _bites(own)])

    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = int(total // BUCKET_BYTES) + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = texts.withColumn("__bucket", F.pmod(F.xxhash64(*texts.columns), F.lit(n_buckets)).cast("int")).withColumn("__part", every(parts))
    some = distinct.withColumn("__part", F.pmod(F.xxhash64("form"), F.lit(parts)).cast("int")).withColumn("__bucket", every(n_buckets))
    return own.groupBy("__part", "__bucket").cogroup(some.groupBy("__part", "__bucket")).applyInArrow(meet, schema)


def occurring(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """The columns of ``texts`` but its text, with a row for every form of ``forms`` (form) that the text holds.

    ``form``, ``n`` (occurrences that don't overlap) and ``alone`` (whether one
    of them is no part of a longer dotted name, nor before a bracketed ordinal).
    Null and empty forms, and null texts, hold nothing.
    """
    fields = [StructField("form", StringType()), StructField("n", LongType()), StructField("alone", BooleanType())]
    return scanned(texts, forms, _held, fields)


def spans(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """The columns of ``texts`` but its text, with ``start``, ``stop`` (characters) and ``form`` of every occurrence, overlapping and nested ones too."""
    return scanned(texts, forms, text_spans, [StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("form", StringType())])


def sliced(books: DataFrame, clean: Callable[[Column], Column], forms: DataFrame, width: int = SLICE_CHARS) -> tuple[DataFrame, int]:
    """(book, begin, text) and a width: cleaned texts in slices that begin at its multiples, each with as much of the next as the longest of ``forms`` (form) needs.

    ``books``: book, text, and ``nth`` if a text comes in pieces; a piece is
    cleaned by itself, so ``clean`` looks at single signs.  Lengths are summed up
    within ranges of pieces and over the ranges; no text is ever in one row.
    """
    reach = forms.agg(F.max(F.char_length("form"))).first()[0] or 0
    width = max(width, reach)
    pieces = books.where("text IS NOT NULL").withColumn("text", clean(F.col("text"))).withColumn("n", F.char_length("text")).where("n > 0")
    at = F.lit(0).cast("long")
    if "nth" in books.columns:
        low, high = books.agg(F.min("nth"), F.max("nth")).first()
        pieces = pieces.withColumn("range", F.floor((F.col("nth") - F.lit(low or 0)) / ((high or 0) - (low or 0)) * 4096) if high != low else F.lit(0))
        before = lambda c: F.coalesce(F.sum("n").over(c.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranges = pieces.groupBy("book", "range").agg(F.sum("n").alias("n")).select("book", "range", before(Window.partitionBy("book").orderBy("range")).alias("first"))
        pieces = pieces.withColumn("within", before(Window.partitionBy("book", "range").orderBy("nth", "text"))).join(ranges, ["book", "range"])
        at = F.col("first") + F.col("within")
    slices = F.sequence(F.greatest(F.floor((F.col("at") - reach) / width), F.lit(0)), F.floor((F.col("at") + F.col("n") - 1) / width))
    cut = pieces.select("book", "text", "n", at.alias("at")).withColumn("nth", F.explode(slices)).withColumn("begin", F.col("nth") * width)
    skip = F.greatest(F.col("begin") - F.col("at"), F.lit(0))
    upto = F.least(F.col("n").cast("long"), F.col("begin") + width + reach - F.col("at"))
    cut = cut.select("book", "begin", "at", F.substring("text", (skip + 1).cast("int"), (upto - skip).cast("int")).alias("text"))
    if "nth" in books.columns:
        cut = cut.groupBy("book", "begin").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda t: t["text"]), "").alias("text"))
    return cut.select("book", "begin", "text"), width


def held(books: DataFrame, clean: Callable[[Column], Column], forms: DataFrame) -> DataFrame:
    """(book, form): which of ``forms`` stand in which of ``books`` (as for ``sliced``)."""
    return occurring(sliced(books, clean, forms)[0], forms).select("book", "form").distinct()


def places(books: DataFrame, clean: Callable[[Column], Column], forms: DataFrame) -> DataFrame:
    """(book, form, start, stop): where ``forms`` stand in ``books`` (as for ``sliced``), in signs of the cleaned text."""
    texts, width = sliced(books, clean, forms)
    found = spans(texts, forms).where(F.col("start") < width)
    return found.select("book", "form", (F.col("begin") + F.col("start")).alias("start"), (F.col("begin") + F.col("stop")).alias("stop"))


def staying(start: list[int], stop: list[int], form: list[str]) -> list[int]:
    """Which spans of one text stay, by place, when longer forms go first, then lesser ones, then earlier places, and none overlaps another."""
    taken = bytearray(max(stop, default=0))
    kept = []
    for i in sorted(range(len(start)), key=lambda i: (start[i] - stop[i], form[i], start[i])):
        if taken.find(1, start[i], stop[i]) < 0:
            taken[start[i] : stop[i]] = b"\x01" * (stop[i] - start[i])
            kept.append(i)
    return sorted(kept, key=lambda i: start[i])


def longest(found: DataFrame) -> DataFrame:
    """Of the ``spans`` of each text (text_id) those that stay when longer forms go first, then lesser ones, then earlier places, and none overlaps another.

    A text's spans meet in one task: no more of them than the text has characters and nested forms.
    """

    def resolve(own: pa.Table) -> pa.Table:
        return own.take(pa.array(staying(*(own[c].to_pylist() for c in ("start", "stop", "form"))), pa.int64()))

    return found.groupBy("text_id").applyInArrow(resolve, found.schema)


MASK = "〇"


def masked(texts: DataFrame, kept: DataFrame) -> DataFrame:
    """(text_id, text): texts with MASK in place of each of the spans ``kept``, which don't overlap."""
    per_text = kept.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("s"))
    starts = F.concat(F.transform("s", lambda x: x["start"]), F.array(F.char_length("text")))
    stops = F.concat(F.array(F.lit(0)), F.transform("s", lambda x: x["stop"]))
    between = F.zip_with(starts, stops, lambda to, begin: F.substring(F.col("text"), begin + 1, to - begin))
    joined = texts.select("text_id", "text").join(per_text, "text_id", "left")
    return joined.select("text_id", F.when(F.col("s").isNull(), F.col("text")).otherwise(F.array_join(between, MASK)).alias("text"))


def near_spans(places: DataFrame, found: DataFrame, distance: int) -> DataFrame:
    """Rows of ``places`` (text_id, pos, ...) with a span of ``found`` that begins or ends within ``distance``, or holds the place: an equi-join on buckets of positions."""
    width = distance + 1
    low, high = F.floor((F.col("start") - distance) / width), F.floor((F.col("stop") + distance) / width)
    spread = found.select(F.col("text_id").alias("__text"), (F.col("start") - distance).alias("__low"), (F.col("stop") + distance).alias("__high"), F.explode(F.sequence(low, high)).alias("__bucket"))
    left = places.withColumn("__at", F.floor(F.col("pos") / width))
    on = (F.col("text_id") == F.col("__text")) & (F.col("__at") == F.col("__bucket")) & F.col("pos").between(F.col("__low"), F.col("__high"))
    return left.join(spread, on, "left_semi").drop("__at")


def collisions(named: DataFrame, found: DataFrame, own: DataFrame, reach: int = 3) -> DataFrame:
    """Occurrences of names that are swallowed by a longer form that begins 1 to ``reach`` characters earlier and goes on into them.

    ``named``: text_id, char, name, start; ``found``: spans of all known forms;
    ``own`` (char, form): the forms of each character, which swallow no name of
    its own.  Gives text_id, char, name, start and ``swallowed_by``, the least such form.
    """
    after = F.explode(F.sequence(F.col("start") + 1, F.col("start") + reach))
    at = found.select(F.col("text_id").alias("__text"), after.alias("__at"), "stop", F.col("form").alias("__form"))
    into = at.where("stop > __at")
    met = named.join(into, (F.col("text_id") == F.col("__text")) & (F.col("start") == F.col("__at")) & (F.col("__form") != F.col("name")) & (F.char_length("__form") >= F.char_length("name")))
    mine = own.select(F.col("char").alias("__char"), F.col("form").alias("__own")).distinct()
    others = met.join(mine, (F.col("char") == F.col("__char")) & (F.col("__form") == F.col("__own")), "left_anti")
    return others.groupBy("text_id", "char", "name", "start").agg(F.min("__form").alias("swallowed_by"))


def first_clean(texts: DataFrame, names: DataFrame, entities: DataFrame, own: DataFrame) -> DataFrame:
    """(char, name, first_text, first_at, n_swallowed): each name's first occurrence that no longer form swallows, by text and place.

    ``names``: char, name; ``entities`` (form): all known forms of people and
    places; ``own``: char, form.  ``n_swallowed`` counts the occurrences before it.
    Names that occur nowhere by themselves are left out.
    """
    forms = entities.select("form").unionByName(names.select(F.col("name").alias("form")))
    found = cut_lineage(spans(texts.select("text_id", "text"), forms))  # read twice below
    named = found.join(names.select("char", "name"), F.col("form") == F.col("name")).select("text_id", "char", "name", "start")
    known = found.join(entities.select("form").distinct(), "form", "left_semi").select("text_id", "start", "stop", "form")
    bad = collisions(named, known, own)
    marked = named.join(bad, ["text_id", "char", "name", "start"], "left")
    place = F.struct("text_id", "start")
    firsts = marked.where("swallowed_by IS NULL").groupBy("char", "name").agg(F.min(place).alias("first"))
    before = bad.join(firsts, ["char", "name"]).where(place < F.col("first")).groupBy("char", "name").agg(F.count("*").alias("n_swallowed"))
    out = firsts.join(before, ["char", "name"], "left")
    return out.select("char", "name", F.col("first.text_id").alias("first_text"), F.col("first.start").alias("first_at"), F.coalesce("n_swallowed", F.lit(0).cast("long")).alias("n_swallowed"))
