"""Locks on parts of the graph, places as filters, looking people up, and digests of chapters."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.functions.scalars import ch_of
from taleweave.operators.graph import cut_lineage
from taleweave.operators.matching import occurring, spans
from taleweave.operators.view import MAX_DEPTH, ViewState, relation_open

CANDIDATES, FREQUENT = 80, 30


@dataclass(frozen=True)
class Lock:
    """A part of the graph that is held on to: its seeds, and how many hops around them belong to it.

    Locks on people, relations and events grow; those on factions, places and
    paths are closed as they are.  A lock from a search begins with the depth last
    set, others with one hop.
    """

    label: str
    origin: str
    seeds: tuple[str, ...]
    grows: bool
    depth: int

    @staticmethod
    def on(label: str, seeds: tuple[str, ...], grows: bool, origin: str = "search", saved: int = 1) -> Lock:
        depth = (max(1, min(saved, MAX_DEPTH)) if origin == "search" else 1) if grows else 0
        return Lock(label, origin, seeds, grows, depth)

    def with_depth(self, depth: int | None) -> Lock:
        return replace(self, depth=max(1, min(depth or 1, MAX_DEPTH))) if self.grows else self


def seeds_of(spark, locks: list[Lock]) -> DataFrame:
    """(lock, id, depth): the seeds of some locks, in their order."""
    return spark.createDataFrame([(k, s, x.depth) for k, x in enumerate(locks) for s in x.seeds], "lock int, id string, depth int")


def expanded(seeds: DataFrame, nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """(lock, id, hops): what belongs to each lock, all locks a hop further at a time.

    ``seeds``: lock, id, depth; unknown seeds count for nothing, and a lock
    without any is left out.
    """
    known = seeds.join(nodes.select("id"), "id", "left_semi").select("lock", "id", "depth").distinct()
    seen = cut_lineage(known.withColumn("hops", F.lit(0)))
    frontier = seen
    adj = cut_lineage(adj.select("at", "to"))  # else every hop would make the edges anew
    for hop in range(1, MAX_DEPTH + 1):
        out = frontier.where(F.col("depth") >= hop).join(adj.select(F.col("at").alias("id"), "to"), "id").select("lock", F.col("to").alias("id"), "depth").distinct()
        frontier = cut_lineage(out.join(seen.select("lock", "id"), ["lock", "id"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.select("lock", "id", "hops")


def locked_edges(members: DataFrame, rels: DataFrame, state: ViewState) -> DataFrame:
    """(lock, pair): pairs of open relations with both ends in one lock; the edge filter doesn't count."""
    ends = rels.where(relation_open(state, filtered=False)).select("src", "dst").distinct()
    from_ = ends.join(members.select("lock", F.col("id").alias("src")), "src")
    whole = from_.join(members.select("lock", F.col("id").alias("dst")), ["lock", "dst"], "left_semi")
    return whole.select("lock", F.concat_ws("|", F.least("src", "dst"), F.greatest("src", "dst")).alias("pair")).distinct()


def place_filter(scope: DataFrame, asked: DataFrame) -> DataFrame:
    """(place, status, n): what asking for each place does: ``filter`` by the ``n`` people of its scope (place, id), or ``empty``, which filters nothing and says so."""
    n = scope.groupBy("place").agg(F.count_distinct("id").alias("n"))
    out = asked.select("place").distinct().join(n, "place", "left")
    return out.select("place", F.when(F.col("n") > 0, "filter").otherwise("empty").alias("status"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def keeps_place(scope: DataFrame, chosen: DataFrame) -> DataFrame:
    """(place, id, keeps): whether choosing somebody (place, id) leaves the filter on; outside its scope it is taken off."""
    inside = scope.select("place", "id").distinct().withColumn("in", F.lit(True))
    return chosen.join(inside, ["place", "id"], "left").select("place", "id", F.coalesce("in", F.lit(False)).alias("keeps"))


def _forms(chars: DataFrame) -> DataFrame:
    """A row (text) for the name and every alias."""
    return chars.withColumn("text", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))))


def find_people(chars: DataFrame, asked: DataFrame, visible: Column, hidden: Column, locked: Column) -> DataFrame:
    """(asked, status, id): the first by data order whose name or an alias holds the text: ``found``, else ``hidden`` by its tier, else ``locked``, else ``nobody``.

    A locked person isn't told, only that there is one.
    """
    bucket = F.when(locked, 3).when(~visible, None).when(hidden, 2).otherwise(1)
    c = chars.withColumn("bucket", bucket).where("bucket IS NOT NULL")
    texts = asked.select(F.trim("asked").alias("form")).where("form <> ''").distinct()
    hits = occurring(_forms(c).select("id", "ord", "bucket", "text"), texts).groupBy("form").agg(F.min(F.struct("bucket", "ord", "id")).alias("m"))
    out = asked.select("asked", F.trim("asked").alias("form")).distinct().join(hits, "form", "left")
    status = F.when(F.col("m.bucket") == 1, "found").when(F.col("m.bucket") == 2, "hidden").when(F.col("m.bucket") == 3, "locked").otherwise("nobody")
    return out.select("asked", status.alias("status"), F.when(F.col("m.bucket") < 3, F.col("m.id")).alias("id"))


def candidates(chars: DataFrame, part: str, most: int = CANDIDATES) -> DataFrame:
    """(id, name, degree): the ``most`` selectable people whose name or an alias holds ``part`` (all, if it is blank), most relations first.

    ``chars``: id, ord, name, aliases, degree.
    """
    part = part.strip()
    held = F.contains("name", F.lit(part)) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(a, F.lit(part)))
    return (chars.where(held) if part else chars).orderBy(F.desc("degree"), "ord").limit(most).select("id", "name", "degree")


def relation_chapters(rels: DataFrame, chars: DataFrame) -> DataFrame:
    """``rels`` with ``ch``: the first chapter that its evidence (``events``, an array with a text ``chapter``) names, else the first of its ends.

    An end without a first chapter counts as chapter 0, and so does an unknown one.
    """
    told = F.array_min(F.transform("events", lambda e: ch_of(e["chapter"])))
    first = lambda c: chars.select(F.col("id").alias(c), F.col("first_ch").alias(f"__{c}"))
    out = rels.join(first("src"), "src", "left").join(first("dst"), "dst", "left")
    ends = F.least(F.coalesce("__src", F.lit(0)), F.coalesce("__dst", F.lit(0)))
    return out.withColumn("ch", F.coalesce(told, ends)).drop("__src", "__dst")


def last_chapter(chars: DataFrame, events: DataFrame, declared: int | None = None) -> DataFrame:
    """(last): the book's last chapter: the declared number, else the largest of characters and events, 1 at least."""
    if declared:
        return chars.sparkSession.range(1).select(F.lit(declared).alias("last"))
    every = chars.select(F.col("first_ch").alias("ch")).union(events.select("ch"))
    return every.agg(F.greatest(F.lit(1), F.max("ch")).alias("last"))


def digest(events: DataFrame, rels: DataFrame, chars: DataFrame, first: int, last: int, deaths: tuple[str, ...], most: int = FREQUENT) -> DataFrame:
    """(section, key, n): what a stretch of chapters holds.

    ``events``: ch, chars (array), evidence, quote; ``rels``: type, events (array
    with chapter); ``chars``: id, first_ch.  Sections: events, relations, deaths and
    debuts by chapter, people (the ``most`` frequent in events), evidence by kind,
    quoted events, missing chapters without events, and relations whose evidence
    names no chapter.
    """
    inside = lambda c: F.col(c).between(first, last)
    here = events.where(inside("ch"))
    told = rels.select("type", F.explode("events").alias("e")).select("type", ch_of(F.col("e.chapter")).alias("ch"))
    count = lambda df, section, key: df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "key", "n")
    people = here.select(F.explode("chars").alias("id")).groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(most)
    span = events.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("ch"))
    parts = [
        count(here, "events", "ch"),
        count(told.where(inside("ch")), "relations", "ch"),
        count(told.where(inside("ch") & F.col("type").isin(*deaths)), "deaths", "ch"),
        count(chars.where(inside("first_ch")), "debuts", "first_ch"),
        people.select(F.lit("people").alias("section"), F.col("id").cast("string").alias("key"), "n"),
        count(here.withColumn("evidence", F.coalesce(F.when(F.col("evidence") != "", F.col("evidence")), F.lit("none"))), "evidence", "evidence"),
        count(here.where("quote <> ''").withColumn("k", F.lit("all")), "quoted", "k"),
        count(span.join(events.select("ch").distinct(), "ch", "left_anti"), "missing", "ch"),
        count(told.where("ch IS NULL").withColumn("k", F.lit("all")), "without chapter", "k"),
    ]
    return reduce(DataFrame.unionByName, parts)


def digest_lines(events: DataFrame, found: DataFrame, first: int, last: int) -> DataFrame:
    """(ch, text): the digest of each chapter as Markdown: a heading, its numbers, and a line an event in their order.

    ``events``: ch, ord, id, name, summary; ``found``: ``digest``.  A sink writes
    it as text, partitioned by chapter or phase.
    """
    n = found.where("section IN ('events', 'relations', 'deaths', 'debuts')").groupBy(F.col("key").cast("int").alias("ch")).pivot("section", ["events", "relations", "deaths", "debuts"]).agg(F.first("n"))
    lines = events.groupBy("ch").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("- `"), "id", F.lit("` "), "name", F.lit(": "), F.coalesce("summary", F.lit(""))).alias("line")))).alias("l"))
    span = events.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("ch"))
    out = span.join(n, "ch", "left").join(lines, "ch", "left")
    numbers = F.concat_ws(", ", *[F.concat(F.coalesce(c, F.lit(0)).cast("string"), F.lit(f" {c}")) for c in ("events", "relations", "deaths", "debuts")])
    body = F.when(F.col("l").isNull(), F.lit("no events")).otherwise(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return out.select("ch", F.concat(F.lit("### chapter "), "ch", F.lit("\n"), numbers, F.lit("\n"), body).alias("text"))


def oriented_parents(edges: DataFrame, canon: DataFrame) -> DataFrame:
    """``edges`` (parent, child, ord and others) the way a table of canonical pairs (parent, child) has them: an edge against it is turned, or dropped where the right one is there."""
    right = canon.select("parent", "child").distinct()
    turned = right.select(F.col("child").alias("parent"), F.col("parent").alias("child"), F.lit(True).alias("against"))
    have = edges.select("parent", "child").distinct().join(right, ["parent", "child"], "left_semi").select(F.col("child").alias("parent"), F.col("parent").alias("child"), F.lit(True).alias("both"))
    e = edges.join(turned, ["parent", "child"], "left").join(have, ["parent", "child"], "left").where("NOT (coalesce(against, false) AND coalesce(both, false))")
    flip = F.coalesce("against", F.lit(False))
    others = [c for c in edges.columns if c not in ("parent", "child")]
    return e.select(F.when(flip, F.col("child")).otherwise(F.col("parent")).alias("parent"), F.when(flip, F.col("parent")).otherwise(F.col("child")).alias("child"), *others)


def suspicious_parents(edges: DataFrame, chars: DataFrame, least: int = 3) -> DataFrame:
    """(parent, child, parent_ch, child_ch): parents who come ``least`` chapters or more after their children."""
    ch = lambda c: chars.select(F.col("id").alias(c), F.col("first_ch").alias(f"{c}_ch"))
    return edges.join(ch("parent"), "parent").join(ch("child"), "child").where(F.col("parent_ch") - F.col("child_ch") >= least).select("parent", "child", "parent_ch", "child_ch").distinct()


def nearest_edge(rels: DataFrame, points: DataFrame, x: float, y: float, scale: float = 1.0, samples: int = 12) -> DataFrame:
    """(ord, d, curve): the relation whose drawn curve comes nearest a point, within 8 pixels.

    Relations of a pair fan out by their order: 0.08, then alternating, wider by
    0.12 every second one.  A curve is quadratic and tried at ``samples`` + 1
    places.  ``rels``: src, dst, ord; ``points``: id, x, y.
    """
    at = lambda c: points.select(F.col("id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    e = rels.join(at("src"), "src").join(at("dst"), "dst")
    n = F.row_number().over(Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy("ord")) - 1
    wide = F.lit(0.08) + 0.12 * F.floor(n / 2)
    e = e.withColumn("curve", F.when(n % 2 == 1, -wide).otherwise(wide))
    nx, ny = F.col("srcy") - F.col("dsty"), F.col("dstx") - F.col("srcx")
    # half of the curvature times the length, across the middle
    cx, cy = (F.col("srcx") + F.col("dstx")) / 2 + nx * F.col("curve") * 0.5, (F.col("srcy") + F.col("dsty")) / 2 + ny * F.col("curve") * 0.5

    def far(i: Column) -> Column:
        t = i / samples
        on = lambda a, c, b: (1 - t) * (1 - t) * a + 2 * (1 - t) * t * c + t * t * b
        return F.hypot(on(F.col("srcx"), cx, F.col("dstx")) - x, on(F.col("srcy"), cy, F.col("dsty")) - y)

    d = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(samples)), far))
    return e.withColumn("d", d).where(F.col("d") <= 8 / max(scale, 0.2)).orderBy("d", "ord").limit(1).select("ord", F.round("d", 6).alias("d"), F.round("curve", 6).alias("curve"))


MARGIN, SQUARE = 40.0, 2.2


def boxes(positions: DataFrame, visible: DataFrame) -> DataFrame:
    """(layout, x0, x1, y0, y1, n): around the visible nodes of each layout, or around all of them where none is visible."""
    marked = positions.join(visible.select("id").distinct().withColumn("seen", F.lit(True)), "id", "left")
    edge = lambda f, c: F.coalesce(f(F.when(F.col("seen"), F.col(c))), f(c))
    return marked.groupBy("layout").agg(edge(F.min, "x").alias("x0"), edge(F.max, "x").alias("x1"), edge(F.min, "y").alias("y0"), edge(F.max, "y").alias("y1"), F.count_if("seen").alias("n"))


def card_layout(box: DataFrame, current: str) -> DataFrame:
    """(layout): the current one if it is square enough (2.2 to 1), else the squarest, if that is any better."""
    aspect = lambda a, b: F.greatest(F.lit(1.0), F.col(f"{a}1") - F.col(f"{a}0")) / F.greatest(F.lit(1.0), F.col(f"{b}1") - F.col(f"{b}0"))
    a = box.select("layout", F.greatest(aspect("x", "y"), aspect("y", "x")).alias("a"))
    own = F.min(F.when(F.col("layout") == current, F.col("a")))
    best = a.agg(own.alias("own"), F.min(F.struct("a", "layout")).alias("best"))
    keep = F.coalesce(F.col("own") <= SQUARE, F.lit(False)) | F.coalesce(F.col("best.a") >= F.col("own"), F.lit(False)) | F.col("best").isNull()
    return best.select(F.when(keep, F.lit(current)).otherwise(F.col("best.layout")).alias("layout"))


def card_fit(box: DataFrame, width: float, height: float) -> DataFrame:
    """(layout, scale, tx, ty): how each layout's box goes into an area of a card, with a margin; spans count as 60 at least."""
    span = lambda c: F.greatest(F.lit(60.0), F.col(f"{c}1") - F.col(f"{c}0"))
    scale = F.least((width - MARGIN) / span("x"), (height - MARGIN) / span("y"))
    middle = lambda c: (F.col(f"{c}0") + F.col(f"{c}1")) / 2
    return box.select("layout", F.round(scale, 6).alias("scale"), F.round(width / 2 - middle("x") * scale, 6).alias("tx"), F.round(height / 2 - middle("y") * scale, 6).alias("ty"))


PANEL = 12  # relations and events shown of a person


def character_panels(chars: DataFrame, rels: DataFrame, event_chars: DataFrame, state: ViewState, most: int = PANEL) -> DataFrame:
    """(id, n_relations, n_locked, relations, life): what a panel of each unlocked person shows.

    ``n_relations`` counts all edges at the person whatever the view, ``n_locked``
    those ahead of the reader; ``relations`` are the ``most`` open ones (other,
    type), those to the best connected first, and ``life`` the first ``most`` open
    events.  ``chars``: id, first_ch, degree; ``event_chars``: char, event, ch, ord.
    Lists are cut before any row meets another.
    """
    open_chars = chars.where(~state.locked(F.col("first_ch"))).select("id")
    ends = rels.withColumn("id", F.explode(F.array_distinct(F.array("src", "dst")))).withColumn("other", F.when(F.col("src") == F.col("id"), F.col("dst")).otherwise(F.col("src")))
    total = ends.groupBy("id").agg(F.count("*").alias("n_relations"), F.count_if(state.locked(F.col("ch"))).alias("n_locked"))
    shown = ends.where(relation_open(state)).join(chars.select(F.col("id").alias("other"), F.col("degree").alias("other_degree")), "other", "left")
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.coalesce("other_degree", F.lit(0))), "ord"))
    lists = shown.withColumn("nth", best).where(F.col("nth") <= most).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", "other", "type"))).alias("relations"))
    early = F.row_number().over(Window.partitionBy("char").orderBy(F.coalesce("ch", F.lit(0)), "ord", "event"))
    life = event_chars.where(~state.locked(F.col("ch"))).withColumn("nth", early).where(F.col("nth") <= most).groupBy(F.col("char").alias("id")).agg(F.array_sort(F.collect_list(F.struct("nth", "event"))).alias("life"))
    out = open_chars.join(total, "id", "left").join(lists, "id", "left").join(life, "id", "left")
    zero = F.lit(0).cast("long")
    told = F.transform(F.coalesce("relations", F.array().cast("array<struct<nth: int, other: string, type: string>>")), lambda r: F.struct(r["other"].alias("other"), r["type"].alias("type")))
    events = F.transform(F.coalesce("life", F.array().cast("array<struct<nth: int, event: string>>")), lambda e: e["event"])
    return out.select("id", F.coalesce("n_relations", zero).alias("n_relations"), F.coalesce("n_locked", zero).alias("n_locked"), told.alias("relations"), events.alias("life"))


UNKNOWN_FACTION = 99


def group_places(chars: DataFrame, factions: DataFrame, by_generation: bool) -> DataFrame:
    """(id, group, group_rank, nth): groups by generation or faction in their order, and who stands where in them.

    ``chars``: id, name, generation, faction, degree; ``factions``: faction, nth (its
    place in the book).  Within a generation people go by faction, within a faction
    by generation, then by relations, most first, and name.  An unknown faction
    comes after all.  A group is ranked in one window: groups of a layout are drawn
    whole.
    """
    c = chars.join(factions.select("faction", F.col("nth").alias("faction_nth")), "faction", "left").withColumn("faction_nth", F.coalesce("faction_nth", F.lit(UNKNOWN_FACTION)))
    group = F.concat(F.lit("g"), F.col("generation").cast("string")) if by_generation else F.concat(F.lit("f"), F.coalesce("faction", F.lit("other")))
    first, then = ("generation", "faction_nth") if by_generation else ("faction_nth", "generation")
    c = c.withColumn("group", group)
    ranks = c.groupBy("group").agg(F.min(first).alias("key")).withColumn("group_rank", F.row_number().over(Window.orderBy("key", "group")))  # a row a group
    nth = F.row_number().over(Window.partitionBy("group").orderBy(then, F.desc("degree"), "name", "id"))
    return c.withColumn("nth", nth).join(ranks.select("group", "group_rank"), "group").select("id", "group", "group_rank", "nth")


def passages(texts: DataFrame, names: DataFrame, before: int = 30, after: int = 30) -> DataFrame:
    """(name, text_id, passage): the surroundings of each name's first occurrence by text and place, runs of blanks as one."""
    first = spans(texts.select("text_id", "text"), names.select(F.col("name").alias("form"))).groupBy(F.col("form").alias("name")).agg(F.min(F.struct("text_id", "start")).alias("at"))
    at = first.select("name", "at.text_id", "at.start").join(texts.select("text_id", "text"), "text_id")
    begin = F.greatest(F.col("start") - before, F.lit(0))
    cut = F.substring(F.col("text"), begin + 1, F.col("start") + F.char_length("name") + after - begin)
    return at.select("name", "text_id", F.regexp_replace(cut, r"\s+", " ").alias("passage"))


FOCUS_NODES, FOCUS_GAIN, FOCUS_SHARE, LEFT_SHARE, MOST_ZOOM, LEAST_ZOOM = 40, 1.25, 0.55, 0.35, 4.0, 0.05


def focus_view(box: DataFrame, width: float, height: float, zoom: float, unit: float, centre: tuple[float, float], span: float, most: int = FOCUS_NODES, gain: float = FOCUS_GAIN) -> DataFrame:
    """(layout, action, zoom, x, y): how a view should turn to the nodes in each ``box`` (``boxes``).

    ``unit``: pixels of one unit of the world at the present ``zoom``; ``centre``: the
    middle of the view; ``span``: the larger side of the whole graph.  The nodes
    should fill 55 % of the view, but at least 35 % of the graph should stay in it.
    Nodes out of sight are always moved to, without a change of zoom where there
    are more than ``most``; nodes in sight only if that makes them ``gain`` times
    larger and they fill less than a third, or if they spread too wide.
    """
    side = lambda c: F.greatest(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(1.0))
    w, h = side("x"), side("y")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    short = min(width, height)
    want = F.least(width * FOCUS_SHARE / w, height * FOCUS_SHARE / h) / unit
    pixels = F.greatest(w, h) * unit
    shrinks = (want < zoom) & (pixels > short * 0.92)
    cap = short / (max(span, 1.0) * unit * LEFT_SHARE) * zoom
    target = F.when(shrinks, F.greatest(F.lit(LEAST_ZOOM), F.least(want, F.lit(zoom)))).otherwise(F.least(F.greatest(want, F.lit(zoom)), F.lit(MOST_ZOOM), F.lit(max(zoom, cap))))
    better = F.when(shrinks, target <= zoom / gain).otherwise(target >= zoom * gain)
    outside = (F.abs(cx - centre[0]) + w / 2 > width / 2 / unit * 0.9) | (F.abs(cy - centre[1]) + h / 2 > height / 2 / unit * 0.9)
    few = F.col("n") <= most
    moves = outside | (few & better & (shrinks | (pixels < short / 3)))
    zooms = F.when(outside, few & better).otherwise(moves)
    asked = box.where("n > 0")
    return asked.select("layout", F.when(zooms, "zoom").when(moves, "move").otherwise("stay").alias("action"), F.round(F.when(zooms, target).otherwise(F.lit(zoom)), 6).alias("zoom"), F.round(F.when(moves, cx).otherwise(F.lit(centre[0])), 6).alias("x"), F.round(F.when(moves, cy).otherwise(F.lit(centre[1])), 6).alias("y"))
