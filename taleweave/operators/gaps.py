"""Who is missing: names in texts that the data doesn't know, names that can't be searched for, and what candidates really are."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from taleweave.operators.dotted import normal
from taleweave.operators.graph import cut_lineage
from taleweave.operators.matching import near_spans, occurring, parts_for, scanned, spans, staying, text_spans
from taleweave.operators.resolve import norm_name

# Signs that no name holds, those before which none begins, endings that are none, the reach of a known name, and the signs of a passage around a name.
FILLERS = "[的地得了着是不在有和与及然后里上下之就都也很还只把被让给对着向往从]"
PARTICLES = "[的了在和与并及而就都也很还只把被让给对着向往从到]"
TAIL_JUNK = "[之乎者也矣哉曰云不又来去上下中前后里外大多少]$"
NEAR, LEAST, TOP = 90, 2, 60
BEFORE, AFTER = 30, 36
BRACKETS = r"（[^）]*）|\([^)]*\)"


def known_forms(names: DataFrame) -> DataFrame:
    """(form): names without what stands in brackets, of two signs at least."""
    return names.select(F.trim(F.regexp_replace("name", BRACKETS, "")).alias("form")).where(F.char_length("form") >= 2).distinct()


def named_between(text: str, found: list[tuple], word: re.Pattern, near: int) -> list[tuple]:
    """(name, n, near) of a text: matches of ``word`` between the longest of the spans ``found`` (start, stop, form), and how many are within ``near`` of any span."""
    start, stop, form = zip(*found, strict=True) if found else ((), (), ())
    kept = staying(start, stop, form)
    ordered = sorted(zip(start, stop, strict=True))
    starts = [s for s, _ in ordered]
    reach = list(accumulate((e for _, e in ordered), max))
    out: dict[str, list[int]] = {}
    for low, high in zip([0, *(stop[i] for i in kept)], [*(start[i] for i in kept), len(text)], strict=True):
        for m in word.finditer(text[low:high]):
            if m[0]:
                pos = low + m.start()
                before = bisect_right(starts, pos + near)
                have = out.setdefault(m[0], [0, 0])
                have[0] += 1
                have[1] += bool(before and reach[before - 1] >= pos - near)
    return [(name, n, close) for name, (n, close) in out.items()]


def candidates(texts: DataFrame, forms: DataFrame, pattern: str, near: int) -> DataFrame:
    """(name, n, near): what ``pattern`` finds in ``texts`` (text_id, text) once ``forms`` (form) are taken out, longest first, and how often it stands near one.

    A text is gone through once, where its forms are found.  Forms too many for
    one automaton are found in parts, and meet the text on its id.
    """
    word = re.compile(pattern)
    fields = [StructField("name", StringType()), StructField("n", LongType()), StructField("near", LongType())]
    size = forms.agg(F.count("*"), F.coalesce(F.sum(F.char_length("form")), F.lit(0))).first()
    if parts_for(*size) <= 1:
        each = scanned(texts.select("text"), forms, lambda find, text: named_between(text, text_spans(find, text), word, near), fields)
    else:

        def meet(own: pa.Table, found: pa.Table) -> pa.Table:
            spans_ = list(zip(*(found[c].to_pylist() for c in ("start", "stop", "form")), strict=True))
            rows = [t for text in own["text"].to_pylist() for t in named_between(text, spans_, word, near)]
            return pa.table([pa.array([t[k] for t in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["name", "n", "near"])

        whole = texts.where("text IS NOT NULL").select("text_id", "text")
        each = whole.groupBy("text_id").cogroup(spans(whole, forms).groupBy("text_id")).applyInArrow(meet, StructType(fields))
    return each.groupBy("name").agg(F.sum("n").alias("n"), F.sum("near").alias("near"))


def gap_report(texts: DataFrame, known: DataFrame, settled: DataFrame, pattern: str, stop: str, fillers: str = FILLERS, particles: str = PARTICLES, least: int = LEAST, near: int = NEAR) -> DataFrame:
    """(name, n, near, snippet, plausible): strings that look like names and that the data doesn't know.

    ``texts``: text_id, text; ``known`` and ``settled``: name.  Known names are
    taken out, longest first; what ``pattern`` (a surname and one or two signs)
    finds in the rest counts where it is no part of a known name and holds none,
    isn't ``stop`` and has no ``fillers``.  Names occur ``least`` times, one of
    them at least within ``near`` characters of a known name; places are those of
    the whole text.  ``snippet`` is the passage around the first occurrence near a
    known name; a name after a particle is hardly one, so it isn't ``plausible``.
    ``pattern`` is Python's, the other expressions are Spark's.
    """
    forms = cut_lineage(known_forms(known))
    tokens = candidates(texts, forms, pattern, near).where((F.col("n") >= least) & (F.col("near") > 0))
    names = cut_lineage(tokens.where(~F.col("name").rlike(stop) & ~F.col("name").rlike(fillers)))
    plain = forms.select(normal(F.col("form")).alias("plain")).distinct()
    names = names.withColumn("plain", normal(F.col("name"))).join(plain, "plain", "left_anti").drop("plain")
    inside = occurring(forms.select(F.col("form").alias("text")).distinct(), names.select(F.col("name").alias("form"))).select(F.col("form").alias("name")).distinct()
    holding = occurring(names.select("name", F.col("name").alias("text")), forms).select("name").distinct()
    names = names.join(inside, "name", "left_anti").join(holding, "name", "left_anti").join(settled.select("name").distinct(), "name", "left_anti")
    names = cut_lineage(names)
    found = spans(texts.select("text_id", "text"), forms)
    # any occurrence of the string may show it best, the first near a known name does
    places = near_spans(spans(texts.select("text_id", "text"), names.select(F.col("name").alias("form"))).withColumnRenamed("start", "pos"), found, near)
    first = places.groupBy(F.col("form").alias("name")).agg(F.min(F.struct("text_id", "pos")).alias("at")).select("name", "at.text_id", "at.pos")
    begin = F.greatest(F.col("pos") - BEFORE, F.lit(0))
    passage = F.substring(F.col("text"), begin + 1, F.col("pos") + F.char_length("name") + AFTER - begin)
    shown = first.join(texts.select("text_id", "text"), "text_id").select("name", F.regexp_replace(passage, r"\s+", " ").alias("snippet"))
    shown = shown.groupBy("name").agg(F.min("snippet").alias("snippet"))  # one a name, as Spark can see: where nobody asks for it, the texts aren't searched again
    out = names.join(shown, "name", "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))
    at = F.instr(F.col("snippet"), F.col("name"))
    return out.select("name", "n", "near", "snippet", ((at <= 1) | ~F.substring(F.col("snippet"), at - 1, F.lit(1)).rlike(particles)).alias("plausible"))


def shown_gaps(report: DataFrame, top: int = TOP) -> DataFrame:
    """The plausible names, most often near a known one first, then the most frequent; ``top`` of them, or all for 0."""
    out = report.where("plausible").orderBy(F.desc("near"), F.desc("n"), "name")
    return out.limit(top) if top > 0 else out


def fragment_kinds(candidates: DataFrame, known: DataFrame, places: DataFrame) -> DataFrame:
    """(name, kind): what candidates (name) are: ``place``, ``known and a sign``, ``start of known``, ``ends in a particle`` or ``open``."""
    names = known.select("name").where("name <> ''").distinct()
    two = names.select(F.col("name").alias("head"), F.lit(True).alias("tailed"))
    starts = names.where(F.char_length("name") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("name") - 1), lambda k: F.left("name", k))).alias("name")).distinct().withColumn("begins", F.lit(True))
    c = candidates.select("name").distinct().withColumn("head", F.when(F.char_length("name") == 3, F.left("name", F.lit(2))))
    c = c.join(places.select("name").distinct().withColumn("is_place", F.lit(True)), "name", "left").join(two, "head", "left").join(starts, "name", "left")
    kind = F.when(F.col("is_place"), "place").when(F.col("tailed"), "known and a sign").when(F.col("begins"), "start of known").when(F.col("name").rlike(TAIL_JUNK), "ends in a particle").otherwise("open")
    return c.select("name", kind.alias("kind"))


def alias_candidates(chars: DataFrame, generic: str) -> DataFrame:
    """(id, alias_of, alias, same_faction): characters whose name is somebody else's alias, and who may be one person.

    ``chars``: id, ord, name, faction, aliases.  Of a normalised name the first by
    data order counts.  Generic titles, single signs, and people of one name (who
    are merged anyway) are left out.
    """
    c = chars.withColumn("norm", norm_name(F.col("name")))
    owner = c.where(F.char_length("norm") >= 2).groupBy("norm").agg(F.min_by(F.struct("id", "faction"), "ord").alias("o")).select(F.col("norm").alias("key"), F.col("o.id").alias("id"), F.col("o.faction").alias("own_faction"))
    said = c.select(F.col("id").alias("alias_of"), F.col("norm").alias("own_norm"), "faction", F.explode("aliases").alias("alias")).withColumn("key", norm_name(F.col("alias")))
    said = said.where((F.char_length("key") >= 2) & ~F.col("key").rlike(generic) & (F.col("key") != F.col("own_norm")))
    return said.join(owner, "key").where("id <> alias_of").select("id", "alias_of", "alias", F.col("faction").eqNullSafe(F.col("own_faction")).alias("same_faction")).distinct()


def loose_degrees(rels: DataFrame) -> DataFrame:
    """(id, degree): how often an id stands at an end of a relation, known or not."""
    return rels.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def search_audit(chars: DataFrame, rels: DataFrame, pairs: DataFrame, least: int = 3) -> DataFrame:
    """(kind, id, subject): what can't be searched for: ``no alias`` (with the degree) of characters with ``least`` relations, and ``variant missing``.

    ``chars``: id, name, aliases, alt_names; ``pairs`` (a, b): spellings of one
    sound.  A character some form of which holds ``a``, and none ``b``, should also
    be found by its first form that does with ``b`` instead, once.
    """
    none = F.array().cast("array<string>")
    forms = F.concat(F.array("name"), F.coalesce("aliases", none), F.coalesce("alt_names", none))
    few = chars.where(F.size(F.coalesce("aliases", none)) <= 0).join(loose_degrees(rels), "id").where(F.col("degree") >= least)
    pooled = chars.select("id", forms.alias("forms")).withColumn("pool", F.array_join("forms", "|"))
    held = occurring(pooled.withColumn("text", F.col("pool")), pairs.select(F.col("a").alias("form")))
    met = held.join(pairs.where("a <> b").distinct(), held["form"] == pairs["a"]).where(~F.contains("pool", "b"))
    first = F.get(F.filter("forms", lambda f: F.contains(f, F.col("a"))), F.lit(0))
    variant = F.overlay(first, F.col("b"), F.instr(first, F.col("a")), F.char_length("a"))
    missing = met.select("id", "pool", variant.alias("variant")).where(F.col("variant").isNotNull() & ~F.contains("pool", "variant"))
    return few.select(F.lit("no alias").alias("kind"), "id", F.col("degree").cast("string").alias("subject")).unionByName(missing.select(F.lit("variant missing").alias("kind"), "id", F.col("variant").alias("subject")).distinct())
