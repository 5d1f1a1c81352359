"""As-of lookups, phases, periods of relations and coverage of chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.functions.ordinals import with_ord
from taleweave.operators.alike import expand
from taleweave.operators.graph import cut_lineage


def effective_segment(history: Column, ch: Column | None, fallback: Column, field: str = "faction") -> Column:
    """The last segment of ``history`` (array of structs with from_ch) begun by ``ch``, else the first, else ``fallback``; null ``ch`` is the end."""
    begun = history if ch is None else F.filter(history, lambda s: ch.isNull() | (s["from_ch"] <= ch))
    return F.coalesce(F.get(begun, F.size(begun) - 1)[field], F.get(history, F.lit(0))[field], fallback)


LEVELS = range(32)  # a range of chapters is cut into blocks of 1, 2, 4 ... chapters


def blocks_of_range(low: Column, high: Column) -> Column:
    """The fewest aligned blocks (level, index) that make up the chapters from ``low`` to ``high``: at most two a level."""
    out = []
    for k in LEVELS:
        width = F.lit(1 << k).cast("long")
        first, last = F.ceil(low / width), F.floor((high + 1) / width) - 1
        block = lambda i, k=k: F.struct(F.lit(k).alias("level"), i.cast("long").alias("at"))
        out.append(F.when((first <= last) & (F.pmod(first, F.lit(2)) == 1), block(first)))
        out.append(F.when((first <= last) & (F.pmod(last, F.lit(2)) == 0), block(last)))
    return F.array_distinct(F.array_compact(F.array(*out)))


def blocks_of_chapter(ch: Column) -> Column:
    """All aligned blocks that hold a chapter."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.floor(ch / (1 << k)).cast("long").alias("at")) for k in LEVELS])


def assign_phases(events: DataFrame, phases: DataFrame) -> DataFrame:
    """Each event with the first phase, in order, whose range holds its chapter.

    Chapters and ranges meet on equality of aligned blocks, so phases may be
    many and long; only distinct chapters take part.
    """
    p = phases.where("from_ch <= to_ch").select("phase", F.col("ord").alias("phase_ord"), F.explode(blocks_of_range(F.col("from_ch"), F.col("to_ch"))).alias("block"))
    chapters = events.select("ch").where("ch IS NOT NULL").distinct().select("ch", F.explode(blocks_of_chapter(F.col("ch"))).alias("block"))
    of = chapters.join(p, "block").groupBy("ch").agg(F.min(F.struct("phase_ord", "phase"))["phase"].alias("phase"))
    return events.join(of, "ch", "left").select(*events.columns, "phase")


def phase_table(events: DataFrame, rels: DataFrame, phases: DataFrame) -> DataFrame:
    p = phases.select("phase", "from_ch", "to_ch")
    count = lambda df, name: df.groupBy("ch").agg(F.count("*").alias(name))
    by_ch = count(events, "n_events").join(count(rels.select("ch"), "n_rels"), "ch", "full_outer").na.fill(0)
    return p.join(by_ch, (F.col("ch") >= F.col("from_ch")) & (F.col("ch") <= F.col("to_ch")), "left").groupBy("phase").agg(F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"), F.coalesce(F.sum("n_rels"), F.lit(0)).alias("n_rels"))


def shared_events(pairs: DataFrame, event_chars: DataFrame, open_events: DataFrame) -> DataFrame:
    """For each pair (a, b) the first open event, by (phase, ord), with both in it."""
    ec = event_chars.select("event", "char")
    both = pairs.join(ec.withColumnRenamed("char", "a"), "a").join(ec.select(F.col("event").alias("e2"), F.col("char").alias("b")), "b").where("event = e2")
    ranked = both.join(open_events.select("event", "phase", "ord"), "event")
    return ranked.groupBy("a", "b").agg(F.min(F.struct(F.coalesce("phase", F.lit(99)).alias("phase"), "ord", "event")).alias("m")).select("a", "b", "m.event")


BITS = 2  # longs of bits of a character's earlier events
SHARERS = 4096  # characters of a block, about


def first_shared_events(event_chars: DataFrame, open_events: DataFrame) -> DataFrame:
    """(a, b, event): ``shared_events`` of all pairs (a < b) that share an open event.

    Pairs are written out from blocks of an event's characters, and only those that
    share no earlier event, so none is shuffled.  Every character brings the numbers
    of its earlier events, and bits of them that mostly show at once that two have
    none in common; numbers grow with the square of one character's events.
    """
    events = open_events.select("event", F.coalesce("phase", F.lit(99)).alias("phase"), "ord")
    ranked = cut_lineage(with_ord(events, F.col("phase"), ["phase", "ord", "event"], "nth"))
    there = event_chars.join(ranked, "event").select("nth", "char").distinct()
    earlier = Window.partitionBy("char").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    bit = F.pmod(F.xxhash64("nth"), F.lit(64 * BITS))
    bits = [F.coalesce(F.bit_or(F.when(F.floor(bit / 64) == i, F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).otherwise(F.lit(0).cast("long"))).over(earlier), F.lit(0).cast("long")).alias(f"bits{i}") for i in range(BITS)]
    brought = there.select("nth", F.col("char").alias("id"), *bits, F.collect_list("nth").over(earlier).alias("earlier"))
    members = brought.select(F.col("nth").alias("cls"), F.struct("id", *[f"bits{i}" for i in range(BITS)], "earlier").alias("item"))
    met = expand(ranked.select(F.col("nth").alias("ca"), F.col("nth").alias("cb"), "event"), members, block=SHARERS)
    apart = F.lit(True)
    for i in range(BITS):
        apart = apart & (F.col(f"a.bits{i}").bitwiseAND(F.col(f"b.bits{i}")) == 0)
    return met.where(apart | ~F.arrays_overlap("a.earlier", "b.earlier")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "event")


def islands(rels: DataFrame, keys: list[str]) -> DataFrame:
    """Periods of the same key merged where they touch or overlap: keys, island, n, from_ch, to_ch (null: open)."""
    end = F.coalesce("to_ch", F.lit(2**31 - 1))
    w = Window.partitionBy(*keys).orderBy("from_ch", end)  # equal periods may come in any order
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rels.withColumn("gap", F.when(F.col("from_ch") > reach, 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    out = numbered.groupBy(*keys, "island").agg(F.count("*").alias("n"), F.min("from_ch").alias("from_ch"), F.max(end).alias("to_ch"))
    return out.withColumn("to_ch", F.nullif("to_ch", F.lit(2**31 - 1)))


def segments(evidence: DataFrame, keys: list[str], value: str, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Runs of one value by chapter and ``order``: run i lasts from its first chapter to the next run's first, at least past its own last."""
    w = Window.partitionBy(*keys).orderBy("ch", *order)
    changed = evidence.withColumn("change", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1))
    runs = changed.withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    runs = runs.groupBy(*keys, "run", value).agg(F.min("ch").alias("from_ch"), F.max("ch").alias("last_ch"))
    after = F.lead("from_ch").over(Window.partitionBy(*keys).orderBy("run"))
    return runs.withColumn("to_ch", F.when(after.isNotNull(), F.greatest(after, F.col("last_ch") + 1))).drop("last_ch")


def missing_chapters(present: DataFrame, last: int) -> DataFrame:
    spark = present.sparkSession
    return spark.range(1, last + 1).select(F.col("id").cast("int").alias("ch")).join(present.select("ch").distinct(), "ch", "left_anti")
