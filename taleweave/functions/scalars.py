"""Column builders for chapters, styles, kin buckets, keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relation kinds and the bucket each is filtered by.
KIN_BUCKETS = {"blood": "blood", "marriage": "marriage", "inlaw": "marriage", "adoptive": "adopt", "foster": "adopt", "step": "adopt", "sworn": "sworn"}
STYLES = ("solid", "dashed", "dotted")
#: White space as the book texts use it; Java's \s lacks the last two.
BLANK = r"[\s　 ]"


def ch_of(text: Column) -> Column:
    """The first run of digits as a chapter, else null."""
    return F.nullif(F.regexp_extract(text, "([0-9]+)", 1), F.lit("")).try_cast("int")


def style_of(style: Column) -> Column:
    return F.when(style.isin("dashed", "dotted"), style).otherwise(F.lit("solid"))


def kin_bucket(kin: Column) -> Column:
    out = F.lit("none")
    for name, bucket in KIN_BUCKETS.items():
        out = F.when(kin == name, F.lit(bucket)).otherwise(out)
    return out


def edge_key(a: Column, b: Column) -> Column:
    """Key of an unordered pair."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def symbol_size(degree: Column, max_degree: Column) -> Column:
    """13 to 40 by the square root of the relative degree."""
    return F.greatest(F.lit(13.0), F.least(F.lit(40.0), 13 + 27 * F.sqrt(degree / F.greatest(max_degree, F.lit(1)))))


def period_text(from_ch: Column, to_ch: Column, ceiling: Column) -> Column:
    """Chapters of a period; an end after the reader's ceiling isn't told."""
    last = to_ch - 1
    told = to_ch.isNotNull() & (ceiling.isNull() | (last <= ceiling))
    return (
        F.when(from_ch.isNull() & to_ch.isNull(), F.lit(""))
        .when(told & from_ch.isNotNull(), F.format_string("第%d–%d章", from_ch, last))
        .when(told, F.format_string("至第%d章", last))
        .when(from_ch.isNotNull(), F.format_string("第%d章起", from_ch))
        .otherwise(F.lit(""))
    )


def generation_label(generation: Column, labels: Column | None = None) -> Column:
    """The n-th label if given, ``前史`` before the first generation, else the number."""
    numbered = F.when(generation < 0, F.lit("前史")).otherwise(F.format_string("第 %d 代", generation))
    return numbered if labels is None else F.coalesce(F.when(generation >= 0, F.get(labels, generation)), numbered)


def group_key(mode: Column, generation: Column, faction: Column) -> Column:
    return F.when(mode == "generation", F.concat(F.lit("g"), generation.cast("string"))).otherwise(F.concat(F.lit("f"), F.coalesce(faction, F.lit("other"))))


def short_name(text: Column) -> Column:
    """What stands before the first colon, if anything does."""
    head = F.regexp_extract(F.trim(text), "^([^：:]+)[：:]", 1)
    return F.when(head == "", F.trim(text)).otherwise(head)


def base_name(name: Column) -> Column:
    """The name without what follows its first bracket."""
    return F.trim(F.regexp_replace(name, "[（(].*$", ""))


def name_segments(name: Column) -> Column:
    return F.filter(F.transform(F.split(name, "·"), lambda s: F.trim(s)), lambda s: s != "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9一-鿿]+", "-"), "^-+|-+$", "")


def plain_text(html: Column) -> Column:
    """HTML without tags; five named entities decoded, numeric ones dropped."""
    out = F.regexp_replace(html, "<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(out, "&#[0-9]+;", "")


# Signs and their entities; an apostrophe has another one in XML.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def _escaped(text: Column, apostrophe: str) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    for char, entity in (*ENTITIES, ("'", apostrophe)):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def escape_html(text: Column) -> Column:
    return _escaped(text, "&#39;")


def escape_xml(text: Column) -> Column:
    return _escaped(text, "&apos;")


def bold_html(text: Column) -> Column:
    """Escaped, with what stands between double stars set in bold; an odd pair of stars stays."""
    return F.regexp_replace(escape_html(text), r"\*\*([^*]+)\*\*", "<strong>$1</strong>")


def unbold(text: Column) -> Column:
    """Without double stars, for where there is no bold."""
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("**"), F.lit(""))


def norm_type(kind: Column) -> Column:
    """A relation's type itself: without what stands in brackets, blanks and separators."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(kind, F.lit("")), "（[^）]*）", ""), r"[\s·、,，。／/]", "")


def run_key(kind: Column, style: Column) -> Column:
    """Key by which successive relations of a pair are one: type and style, solid where none is given."""
    return F.concat_ws("|", norm_type(kind), F.when(F.coalesce(style, F.lit("")) != "", style).otherwise("solid"))


def han_to_num(text: Column) -> Column:
    """A Chinese numeral (or digits) as an integer; 0 if it isn't one."""
    # fixed values: digits and units
    digits = F.create_map(*[F.lit(x) for pair in zip("零〇一二三四五六七八九两", (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 2), strict=True) for x in pair])
    units = F.create_map(*[F.lit(x) for pair in zip("十百千", (10, 100, 1000), strict=True) for x in pair])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"))

    def step(acc: Column, c: Column) -> Column:
        unit = F.try_element_at(units, c)
        grown = acc["total"] + F.when((acc["digit"] == 0) & (unit == 10), 1).otherwise(acc["digit"]) * unit
        return F.when(unit.isNotNull(), F.struct(grown.alias("total"), F.lit(0).alias("digit"))).otherwise(F.struct(acc["total"].alias("total"), F.coalesce(F.try_element_at(digits, c), F.lit(0)).alias("digit")))

    number = F.aggregate(F.split(text, ""), start, step, lambda acc: acc["total"] + acc["digit"])
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int")).when(text.rlike("^[零〇一二三四五六七八九两十百千]+$"), number).otherwise(F.lit(0))
