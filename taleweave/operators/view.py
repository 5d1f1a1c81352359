"""Reader's view of a book: progress gate, as-of time travel, tier, size, edge and place filters."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.functions.scalars import kin_bucket, style_of, symbol_size

SIZES = {"all": None, "mid": 200, "main": 60}
MAX_DEPTH = 3


@dataclass(frozen=True)
class ViewState:
    """The parameters of a view.  ``max_chapter`` is the book's last chapter."""

    max_chapter: int
    progress: int | None = None
    time_travel: bool = False
    chapter: int | None = None
    show_minor: bool = True
    show_mentioned: bool = True
    show_derived: bool = True
    styles: frozenset[str] = frozenset()
    kins: frozenset[str] = frozenset()
    size: str = "all"
    focus: tuple[str, int] | None = None
    place: str | None = None
    highlight: frozenset[str] = frozenset()

    @property
    def ceiling(self) -> int:
        return self.max_chapter if self.progress is None else min(self.max_chapter, self.progress)

    @property
    def as_of(self) -> int | None:
        return min(self.chapter or 1, self.ceiling) if self.time_travel else None

    def with_progress(self, ch: int | None) -> ViewState:
        moved = replace(self, progress=ch)
        return replace(moved, chapter=min(moved.chapter or 1, moved.ceiling)) if moved.time_travel else moved

    def at_chapter(self, n: int) -> ViewState:
        return replace(self, time_travel=True, chapter=max(1, min(n, self.max_chapter)))

    def focus_on(self, node: str | None, depth: int = 1) -> ViewState:
        return replace(self, focus=None if node is None else (node, max(1, min(depth, MAX_DEPTH))))

    def preset(self, name: str | None) -> ViewState:
        """``kin``: the four kin buckets; ``enemy``: dashed edges; else no edge filter."""
        if name == "kin":
            return replace(self, styles=frozenset(), kins=frozenset({"blood", "marriage", "adopt", "sworn"}))
        return replace(self, kins=frozenset(), styles=frozenset({"dashed"}) if name == "enemy" else frozenset())

    def reveal(self, tier: str) -> ViewState:
        return replace(self, show_minor=self.show_minor or tier == "minor", show_mentioned=self.show_mentioned or tier == "mentioned")

    # predicates

    def locked(self, ch: Column) -> Column:
        return F.lit(False) if self.progress is None else F.coalesce(ch, F.lit(0)) > self.progress

    def not_yet(self, ch: Column) -> Column:
        """Not happened at the as-of chapter."""
        return F.lit(False) if self.as_of is None else F.coalesce(ch, F.lit(0)) > self.as_of

    def alive(self, from_ch: Column, to_ch: Column) -> Column:
        """The half-open period [from, to) holds the as-of chapter."""
        return F.lit(True) if self.as_of is None else (from_ch <= self.as_of) & (to_ch.isNull() | (to_ch > self.as_of))

    def passes(self, style: Column, kin: Column) -> Column:
        ok = F.lit(True)
        if self.styles:
            ok = ok & style_of(style).isin(*sorted(self.styles))
        if self.kins:
            ok = ok & kin_bucket(kin).isin(*sorted(self.kins))
        return ok

    def derived_ok(self, derived: Column) -> Column:
        return F.lit(True) if self.show_derived else ~F.coalesce(derived, F.lit(False))

    def hidden(self, tier: Column, node: Column | None = None) -> Column:
        h = F.when(tier == "mentioned", not self.show_mentioned).when(tier == "minor", not self.show_minor).otherwise(False)
        return h & ~node.isin(*sorted(self.highlight)) if self.highlight and node is not None else h


def relation_open(state: ViewState, filtered: bool = True) -> Column:
    """A relation can be used: unlocked, alive, derived edges as asked, and the edge filter if ``filtered``."""
    ok = ~state.locked(F.col("ch")) & state.alive(F.col("from_ch"), F.col("to_ch")) & state.derived_ok(F.col("derived"))
    return ok & state.passes(F.col("style"), F.col("kin")) if filtered else ok


def degrees(rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, degree of every node: edges with two known ends count, a loop twice."""
    known = nodes.select("id")
    ends = rels.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


PLACES = 65536  # of data order in one sort


def ranks(ranked: DataFrame) -> DataFrame:
    """``ranked`` (degree, ord and others) with ``rank`` by degree, highest first, ties by data order.

    Nodes are counted by degree and stretch of the data order, and only those
    counts meet in one window, so the many nodes of a low degree share no sort.
    """
    rows = ranked.withColumn("__part", F.floor(F.col("ord") / PLACES))
    counts = rows.groupBy("degree", "__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy(F.desc("degree"), "__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("degree", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("degree", "__part").orderBy("ord"))
    return rows.withColumn("__nth", nth).join(counts, ["degree", "__part"]).withColumn("rank", F.col("__before") + F.col("__nth")).drop("__part", "__nth", "__before")


def top_by_degree(ranked: DataFrame, k: int) -> DataFrame:
    """The ``k`` first by degree, ties by data order, as (id, rank)."""
    best = ranked.orderBy(F.desc("degree"), "ord").limit(k)
    return best.select("id", F.row_number().over(Window.orderBy(F.desc("degree"), "ord")).alias("rank"))


def with_symbol_size(ranked: DataFrame) -> DataFrame:
    top = ranked.agg(F.max("degree").alias("max_degree"))
    return ranked.crossJoin(F.broadcast(top)).withColumn("size", F.round(symbol_size(F.col("degree"), F.col("max_degree")), 6)).drop("max_degree")


def visible_nodes(state: ViewState, nodes: DataFrame, rels: DataFrame, focus: DataFrame | None = None) -> DataFrame:
    """Nodes that are drawn; a locked node is drawn grey and carries ``locked``."""
    out = nodes.where(~state.hidden(F.col("tier"), F.col("id")) & ~state.not_yet(F.col("first_ch")))
    limit = SIZES[state.size]
    if limit:
        keep = top_by_degree(degrees(rels, nodes), limit).select("id")
        extra = sorted(state.highlight | ({state.focus[0]} if state.focus else set()))
        if extra:
            keep = keep.unionByName(nodes.where(F.col("id").isin(*extra)).select("id")).distinct()
        out = out.join(keep, "id", "left_semi")
    if focus is not None:
        out = out.join(focus.select("id"), "id", "left_semi")
    return out.withColumn("locked", state.locked(F.col("first_ch")))


def visible_links(state: ViewState, drawn: DataFrame, rels: DataFrame) -> DataFrame:
    ends = drawn.select("id")
    ok = rels.where(relation_open(state))
    return ok.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")


def chapter_digest(nodes: DataFrame, rels: DataFrame, rel_places: DataFrame, place_firsts: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """For every chapter at once: new and present characters, new relations, places and new places; derived edges don't count."""
    own = rels.where("NOT derived")
    new_chars = nodes.where("first_ch IS NOT NULL").groupBy(F.col("first_ch").alias("ch")).agg(F.count("*").alias("new_chars"))
    present = own.select("ch", F.explode(F.array("src", "dst")).alias("id")).groupBy("ch").agg(F.countDistinct("id").alias("chars_here"))
    new_rels = own.groupBy("ch").agg(F.count("*").alias("new_rels"))
    here = rel_places.where("NOT derived").groupBy("ch").agg(F.countDistinct("place").alias("places_here"))
    new_places = place_firsts.groupBy(F.col("first_ch").alias("ch")).agg(F.count("*").alias("new_places"))
    parts = [new_chars, present, new_rels, here, new_places]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "ch", "full_outer")
    return out.na.fill(0)
