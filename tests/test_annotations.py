"""Annotations and relaxed positions on small fixtures."""

import math
import random

from taleweave.operators import annotations, layout, validate

ITEM = "book string, item int, ch int, title string, body string, basis string, events array<string>, chars array<string>, places array<string>"


def test_citations(spark):
    rows = [
        ("b", 1, 2, "t", "见 e1、e-2-1、e1 与 e9", "", ["e1", "e3"], None, None),
        ("b", 2, 2, "t", "e3 e4 e5", "", ["e7", "e8", "e0"], None, None),
        ("c", 1, 2, "t", None, "", None, None, None),
    ]
    items = spark.createDataFrame(rows, ITEM)
    events = spark.createDataFrame([("b", "e1", 2), ("b", "e-2-1", 5), ("b", "e3", 2), ("b", "e4", 2), ("b", "e5", 9), ("b", "e7", 3), ("b", "e8", 4), ("c", "e9", 1)], "book string, event string, ch int")
    reviewed = spark.createDataFrame([("b", 2, "e8")], "book string, ch int, event string")
    got = {tuple(r) for r in annotations.citations(items, events, reviewed).collect()}
    assert got == {
        ("b", 1, "e-2-1", "cited across chapters"), ("b", 1, "e9", "no such event"), ("b", 1, "e3", "uncited"), ("b", 2, "e3", "declared elsewhere"), ("b", 2, "e4", "unclaimed"), ("b", 2, "e5", "cited across chapters"),
        ("b", 2, "e7", "uncited"), ("b", 2, "e7", "across chapters"), ("b", 2, "e8", "uncited"), ("b", 2, "e8", "across, reviewed"), ("b", 2, "e0", "declared, no such event"),
    }


def test_rules_of_annotations(spark):
    good = ("b", 1, 2, "桃园", "**结义**见 e1", "原文「甲」", ["e1"], ["p"], ["x"])
    bad = [
        ("b", 2, 9, "待补", "说（一半 word e7", None, ["e7"], ["late", "zz"], ["zz"]),
        ("b", 3, None, "桃园 ", "**甲", "……", ["e1"], ["late"], None),
        ("b", 4, 2, "桃园", "乙", "原文", None, None, None),
    ]
    items = spark.createDataFrame([good, *bad], ITEM)
    globals_ = spark.createDataFrame([("b", 90, "总", "e1 与 e8", ""), ("b", 91, "……", "丙", "原文")], "book string, item int, title string, body string, basis string")
    events = spark.createDataFrame([("b", "e1", 2)], "book string, id string, ch int")
    chars = spark.createDataFrame([("b", "p", 7), ("b", "late", 8)], "book string, id string, first_ch int")
    places = spark.createDataFrame([("b", "x")], "book string, id string")
    last = spark.createDataFrame([("b", 5)], "book string, last int")
    got = {(r.kind, r.subject) for r in validate.report(annotations.field_rules(items, globals_, events, chars, places, last)).collect()}
    assert got == {
        ("basis missing", "2"), ("basis missing", "90"), ("title to come", "2"), ("body with foreign words", "2 word"), ("body with unpaired marks", "2"), ("body with unpaired marks", "3"),
        ("chapter outside the book", "2"), ("chapter outside the book", "3"), ("events unknown", "2 e7"), ("chars unknown", "2 zz"), ("places unknown", "2 zz"), ("reference to nothing", "2 e7"), ("reference to nothing", "90 e8"),
        ("person before their time", "3 e1 late"), ("title repeated", "2 桃园"),
    }


def test_positions_are_pushed_apart(spark):
    rng = random.Random(2)
    rows = [(f"n{i}", i, rng.uniform(0, 150), rng.uniform(0, 150), 10.0 + i % 3) for i in range(20)] + [(f"s{i}", 100 + i, 75.0, 75.0, 12.0) for i in range(3)]
    points = spark.createDataFrame(rows, "id string, ord int, x double, y double, size double")
    out = layout.relaxed(points, rounds=5).collect()
    near = lambda ps: sum(max(0.0, (a[4] + b[4]) / 2 + 12 - math.hypot(a[2] - b[2], a[3] - b[3])) for k, a in enumerate(ps) for b in ps[:k])
    assert len(out) == len(rows) and near([tuple(r) for r in out]) < 0.4 * near(rows)
    far = points.where("id IN ('n0', 'n1')").selectExpr("id", "ord", "ord * 500.0D AS x", "y", "size")
    assert sorted(map(tuple, layout.relaxed(far).collect())) == sorted(map(tuple, far.collect()))
    two = spark.createDataFrame([("a", 1, 5.0, 5.0, 8.0), ("b", 2, 5.0, 5.0, 10.0)], points.schema)
    (a, b) = sorted(map(tuple, layout.relax_step(two).collect()))
    assert abs(math.hypot(a[2] - b[2], a[3] - b[3]) - 21) < 1e-9 and abs(a[2] - (5 - math.cos(math.radians(137)) * 10.5)) < 1e-9
