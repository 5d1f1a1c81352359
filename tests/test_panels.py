"""Locks, filters by place, lookups, digests, curves, cards, canonical parents and more rules on small fixtures."""

import math
import random

from pyspark.sql import functions as F

from taleweave.functions import scalars
from taleweave.operators import graph, panels, validate
from taleweave.operators.panels import Lock
from taleweave.operators.view import ViewState

REL = "ord int, src string, dst string, type string, style string, kin string, ch int, from_ch int, to_ch int, derived boolean"


def line(spark, n):
    nodes = spark.createDataFrame([(f"n{i}", i) for i in range(n)], "id string, ord int")
    rels = spark.createDataFrame([(i, f"n{i}", f"n{i + 1}", "t", "solid", None, i, 1, None, False) for i in range(n - 1)], REL)
    return nodes, rels


def test_depth_of_locks():
    assert Lock.on("x", ("a",), True).depth == 1 and Lock.on("x", ("a",), True, saved=9).depth == 3
    assert Lock.on("x", ("a",), True, "relation", saved=3).depth == 1 and Lock.on("x", ("a",), False, saved=3).depth == 0
    assert Lock.on("x", ("a",), True).with_depth(7).depth == 3 and Lock.on("x", ("a",), True).with_depth(None).depth == 1
    assert Lock.on("x", ("a",), False).with_depth(2).depth == 0


def test_locks_grow_side_by_side(spark):
    nodes, rels = line(spark, 8)
    locks = [Lock.on("a", ("n0",), True, saved=2), Lock.on("b", ("n0", "n5"), False, "faction"), Lock.on("c", ("zz",), True), Lock.on("d", ("n3", "n4"), True, "relation")]
    members = panels.expanded(panels.seeds_of(spark, locks), nodes, graph.adjacency(rels, nodes))
    got = {}
    for r in members.collect():
        got.setdefault(r.lock, {})[r.id] = r.hops
    assert got == {0: {"n0": 0, "n1": 1, "n2": 2}, 1: {"n0": 0, "n5": 0}, 3: {"n3": 0, "n4": 0, "n2": 1, "n5": 1}}
    pairs = {(r.lock, r.pair) for r in panels.locked_edges(members, rels, ViewState(20, progress=3)).collect()}
    assert pairs == {(0, "n0|n1"), (0, "n1|n2"), (3, "n2|n3"), (3, "n3|n4")}


def test_places(spark):
    scope = spark.createDataFrame([("x", "a"), ("x", "a"), ("x", "b")], "place string, id string")
    asked = spark.createDataFrame([("x",), ("y",)], "place string")
    assert {tuple(r) for r in panels.place_filter(scope, asked).collect()} == {("x", "filter", 2), ("y", "empty", 0)}
    chosen = spark.createDataFrame([("x", "a"), ("x", "c"), ("y", "a")], "place string, id string")
    assert {(r.place, r.id): r.keeps for r in panels.keeps_place(scope, chosen).collect()} == {("x", "a"): True, ("x", "c"): False, ("y", "a"): False}


def test_people(spark):
    rows = [("a", 1, "刘备", ["玄德"], "main", 9), ("b", 2, "玄德公", None, "minor", 1), ("c", 3, "玄德子", None, "main", 2), ("d", 4, "曹操", ["孟德"], "main", 30), ("e", 5, "孟德府", [], "minor", 1)]
    chars = spark.createDataFrame(rows, "id string, ord int, name string, aliases array<string>, tier string, first_ch int")
    asked = spark.createDataFrame([(x,) for x in (" 玄德", "曹", "孟德", "谁", " ", "公")], "asked string")
    state = ViewState(40, progress=10, show_minor=False)
    found = panels.find_people(chars, asked, ~state.not_yet(F.col("first_ch")), state.hidden(F.col("tier")), state.locked(F.col("first_ch")))
    assert {r.asked: (r.status, r.id) for r in found.collect()} == {" 玄德": ("found", "a"), "曹": ("locked", None), "孟德": ("hidden", "e"), "谁": ("nobody", None), " ": ("nobody", None), "公": ("hidden", "b")}
    ranked = chars.withColumn("degree", F.col("ord") % 3)
    assert [r.id for r in panels.candidates(ranked, "德").collect()] == ["b", "e", "a", "d", "c"]
    assert [r.id for r in panels.candidates(ranked, " ", 2).collect()] == ["b", "e"]


def test_chapters_of_relations(spark):
    chars = spark.createDataFrame([("a", 2), ("b", 9), ("c", None)], "id string, first_ch int")
    schema = "src string, dst string, events array<struct<chapter: string>>"
    rels = spark.createDataFrame([("a", "b", [("第 12 回",), ("7",), (None,), ("",)]), ("a", "b", [("",), (None,)]), ("a", "b", []), ("b", "c", None), ("a", "zz", None)], schema)
    assert sorted(r.ch for r in panels.relation_chapters(rels, chars).collect()) == [0, 0, 2, 2, 7]
    events = spark.createDataFrame([(14,), (None,)], "ch int")
    assert panels.last_chapter(chars, events).first()["last"] == 14 and panels.last_chapter(chars, events, 20).first()["last"] == 20
    assert panels.last_chapter(chars.limit(0), events.limit(0)).first()["last"] == 1


def test_digest(spark):
    events = spark.createDataFrame([(1, 2, "e1", "E", "s", ["a", "b"], "text", "q"), (2, 2, "e2", "F", None, ["a"], "", None), (3, 9, "e9", "G", "x", ["z"], None, "q")], "ord int, ch int, id string, name string, summary string, chars array<string>, evidence string, quote string")
    rels = spark.createDataFrame([("诛杀", [("第2回",), ("9",), ("x",)]), ("盟友", [("3",)])], "type string, events array<struct<chapter: string>>")
    chars = spark.createDataFrame([("a", 2), ("b", 3), ("z", 9)], "id string, first_ch int")
    found = panels.digest(events, rels, chars, 1, 4, ("诛杀",), most=1)
    got = {(r.section, r.key): r.n for r in found.collect()}
    assert got == {("events", "2"): 2, ("relations", "2"): 1, ("relations", "3"): 1, ("deaths", "2"): 1, ("debuts", "2"): 1, ("debuts", "3"): 1, ("people", "a"): 2, ("evidence", "text"): 1, ("evidence", "none"): 1, ("quoted", "all"): 1, ("missing", "1"): 1, ("missing", "3"): 1, ("missing", "4"): 1, ("without chapter", "all"): 1}
    lines = {r.ch: r.text for r in panels.digest_lines(events, found, 1, 3).collect()}
    assert lines[2] == "### chapter 2\n2 events, 1 relations, 1 deaths, 1 debuts\n- `e1` E: s\n- `e2` F: " and lines[1].endswith("no events") and set(lines) == {1, 2, 3}


def test_canonical_parents(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("c", "a", 2), ("x", "y", 3), ("y", "x", 4), ("p", "q", 5)], "parent string, child string, ord int")
    canon = spark.createDataFrame([("a", "b"), ("a", "c"), ("x", "y"), ("m", "n")], "parent string, child string")
    assert {tuple(r) for r in panels.oriented_parents(edges, canon).collect()} == {("a", "b", 1), ("a", "c", 2), ("x", "y", 3), ("p", "q", 5)}
    chars = spark.createDataFrame([("a", 5), ("b", 2), ("p", 4), ("q", 2), ("c", None)], "id string, first_ch int")
    assert [tuple(r) for r in panels.suspicious_parents(edges, chars).collect()] == [("a", "b", 5, 2)]


def test_nearest_curve(spark):
    rng = random.Random(4)
    spots = {f"n{i}": (rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(12)}
    rels = [(k, *rng.sample(sorted(spots), 2)) for k in range(40)]
    points = spark.createDataFrame([(i, *p) for i, p in spots.items()], "id string, x double, y double")
    df = spark.createDataFrame(rels, "ord int, src string, dst string")
    for x, y in ((50.0, 50.0), (10.0, 80.0), (500.0, 0.0)):
        seen, best = {}, None
        for k, s, d in sorted(rels):
            n = seen.get(frozenset((s, d)), 0)
            seen[frozenset((s, d))] = n + 1
            curve = 0.08 if n == 0 else (-1 if n % 2 else 1) * (0.08 + 0.12 * (n // 2))
            (ax, ay), (bx, by) = spots[s], spots[d]
            length = math.hypot(ay - by, bx - ax) or 1
            cx, cy = (ax + bx) / 2 + (ay - by) / length * curve * length * 0.5, (ay + by) / 2 + (bx - ax) / length * curve * length * 0.5
            at = [((1 - t) ** 2 * ax + 2 * (1 - t) * t * cx + t * t * bx, (1 - t) ** 2 * ay + 2 * (1 - t) * t * cy + t * t * by) for t in (i / 12 for i in range(13))]
            far = min(math.hypot(x - p, y - q) for p, q in at)
            if far <= 8 and (best is None or far < best[1]):
                best = (k, far, curve)
        got = panels.nearest_edge(df, points, x, y).collect()
        assert [(r.ord, round(r.d, 5), r.curve) for r in got] == ([(best[0], round(best[1], 5), round(best[2], 6))] if best else [])


def test_cards(spark):
    flat = [("gen-v", f"n{i}", 10.0 * i, 1.0) for i in range(10)] + [("force", f"n{i}", 10.0 * i, 9.0 * i) for i in range(10)]
    positions = spark.createDataFrame(flat, "layout string, id string, x double, y double")
    box = panels.boxes(positions, spark.createDataFrame([("n2",), ("n4",)], "id string"))
    assert {r.layout: (r.x0, r.x1, r.n) for r in box.collect()} == {"gen-v": (20.0, 40.0, 2), "force": (20.0, 40.0, 2)}
    assert panels.card_layout(box, "gen-v").first().layout == "force" and panels.card_layout(box, "force").first().layout == "force"
    nobody = panels.boxes(positions, spark.createDataFrame([("zz",)], "id string"))
    assert {r.x1 for r in nobody.collect()} == {90.0}
    fit = {r.layout: (r.scale, r.tx, r.ty) for r in panels.card_fit(nobody, 220.0, 160.0).collect()}
    assert fit["gen-v"] == (2.0, 20.0, 78.0)


def test_more_rules(spark):
    chars = spark.createDataFrame([("a", "f", "t", "d", "x"), ("b", "zz", None, "", "x"), ("c", None, "t", "d", "x")], "id string, faction string, title string, desc string, fate string")
    factions = spark.createDataFrame([("f",)], "faction string")
    assert {(r.kind, r.subject) for r in validate.report(validate.profiles(chars, factions)).collect()} == {("faction missing", "c"), ("title missing", "b"), ("desc missing", "b"), ("faction unknown", "b")}
    schema = "ord int, from_ch int, to_ch int, events array<struct<text: string, chapter: string>>"
    rels = spark.createDataFrame([(1, 3, 9, [("x", "第9回"), ("x", "3"), ("", "1"), ("x", "later"), ("x", None)]), (2, None, None, [("x", "99")]), (3, 1, None, []), (4, None, 5, None)], schema)
    assert sorted((r.kind, r.subject) for r in validate.report(validate.evidence(rels)).collect()) == [("evidence chapter without number", "1"), ("evidence outside period", "1 1"), ("evidence outside period", "1 9"), ("evidence without text", "1"), ("relation without evidence", "3"), ("relation without evidence", "4")]
    edges = spark.createDataFrame([(1, "a", "b", "父子", "sworn"), (2, "b", "a", "母女", "blood"), (3, "a", "c", "盟友", "odd")], "ord int, src string, dst string, type string, kin string")
    got = {(r.severity, r.kind, r.subject) for r in validate.report(validate.kinship(edges)).collect()}
    assert got == {("error", "kin: blood term", "1"), ("warning", "kin: mismatch", "1"), ("error", "kin: illegal", "3"), ("warning", "parent cycle", "a"), ("warning", "parent cycle", "b")}


def test_text_marks(spark):
    df = spark.createDataFrame([("a<'\"&> **b** **",), (None,)], "t string")
    got = [tuple(r) for r in df.select(scalars.escape_html(F.col("t")), scalars.escape_xml(F.col("t")), scalars.bold_html(F.col("t")), scalars.unbold(F.col("t"))).collect()]
    assert got[0] == ("a&lt;&#39;&quot;&amp;&gt; **b** **", "a&lt;&apos;&quot;&amp;&gt; **b** **", "a&lt;&#39;&quot;&amp;&gt; <strong>b</strong> **", "a<'\"&> b ")
    assert got[1] == ("", "", "", "")
    runs = spark.createDataFrame([("父子（亲生）/ 师徒", ""), (None, "dashed")], "type string, style string")
    assert [r[0] for r in runs.select(scalars.run_key(F.col("type"), F.col("style"))).collect()] == ["父子师徒|solid", "|dashed"]


def test_focus(spark):
    rows = [("tiny", -1.0, 1.0, -1.0, 1.0, 2), ("far", 900.0, 940.0, 0.0, 10.0, 2), ("crowd", 900.0, 940.0, 0.0, 10.0, 90), ("wide", -390.0, 390.0, -240.0, 240.0, 9), ("good", -100.0, 100.0, -60.0, 60.0, 9), ("none", None, None, None, None, 0)]
    box = spark.createDataFrame(rows, "layout string, x0 double, x1 double, y0 double, y1 double, n int")
    got = {r.layout: (r.action, r.zoom, r.x, r.y) for r in panels.focus_view(box, 800.0, 500.0, 1.0, 1.0, (0.0, 0.0), 700.0).collect()}
    assert got["tiny"] == ("zoom", round(500 / (700 * 0.35), 6), 0.0, 0.0)  # no further than leaves enough of the graph
    assert got["far"][0] == "zoom" and got["far"][2:] == (920.0, 5.0)
    assert got["crowd"] == ("move", 1.0, 920.0, 5.0) and got["good"] == ("stay", 1.0, 0.0, 0.0)
    assert got["wide"][0] == "zoom" and got["wide"][1] < 1 and "none" not in got
