"""Pairs by classes against all pairs one by one."""

import random

from pyspark.sql import functions as F

from taleweave.operators import alike, kin, kinship, periods


def _members(spark, of):
    rows = spark.createDataFrame(list(of.items()), "id string, cls string")
    return rows.select("cls", F.struct("id").alias("item"))


def test_expand_writes_every_pair_once_and_leaves_out_what_is_given(spark):
    rng = random.Random(3)
    of = {f"p{i}": rng.choice("xyz") for i in range(60)}
    pairs = spark.createDataFrame([("x", "x", 1), ("x", "y", 2), ("y", "x", 3), ("z", "y", 4)], "ca string, cb string, v int")
    want = {(a, b, v) for a in of for b in of if a < b for ca, cb, v in [("x", "x", 1), ("x", "y", 2), ("y", "x", 3), ("z", "y", 4)] if (of[a], of[b]) == (ca, cb)}
    but = rng.sample(sorted({(a, b) for a, b, _ in want}), 9)
    for left_out, given in (([], None), (but, spark.createDataFrame(but, "a string, b string"))):
        got = sorted((r.a.id, r.b.id, r.v) for r in alike.expand(pairs, _members(spark, of), given, block=7).collect())
        assert got == sorted(w for w in want if w[:2] not in left_out)


def test_counts_without_writing_out(spark):
    of = {f"p{i:02}": "xyz"[i % 3] for i in range(20)}
    pairs = [("x", "x", "k"), ("x", "y", "k"), ("y", "x", "k"), ("z", "x", "l"), ("y", "z", "k"), ("z", "y", "l")]
    want = {}
    for a in of:
        for b in of:
            for ca, cb, v in pairs:
                if a < b and (of[a], of[b]) == (ca, cb):
                    want[v] = want.get(v, 0) + 1
    got = alike.count_pairs(spark.createDataFrame(pairs, "ca string, cb string, v string"), _members(spark, of), "v")
    assert {r.v: r.n for r in got.collect()} == want


def test_one_large_family_is_dealt_over_tasks(spark):
    """Children of one parent are a single key; their pairs still go to several tasks."""
    edges = spark.range(5000).select(F.lit("n").alias("parent"), F.concat(F.lit("s"), "id").alias("child"))
    pairs = kin.sibling_pairs(edges)
    assert pairs.count() == 5000 * 4999 // 2
    assert min(pairs.groupBy(F.spark_partition_id()).count().toPandas()["count"]) > 0 and pairs.groupBy(F.spark_partition_id()).count().count() >= 5


def test_no_task_holds_all_pairs_of_a_unit(spark):
    """Members of the first block come one by one: their loop isn't compiled, in which all rows of a unit would be made at a time."""
    plan = alike.expand(*(spark.createDataFrame(r, s) for r, s in (([("x", "x")], "ca string, cb string"), ([("x", ("p1",)), ("x", ("p2",))], "cls string, item struct<id: string>"))))
    plan.collect()
    loops = [line.strip(" :+-") for line in plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Generate " in line]
    assert [loop.startswith("*") for loop in loops] == [True, False]


def test_tasks_grow_with_very_many_pairs():
    assert alike.tasks(0) == 1 and alike.tasks(alike.TASK * 500) == 501 and alike.tasks(1 << 37) < 5000


def test_nearest_by_classes_in_both_orders(spark):
    """Two lines of unlike length meet in two ancestors: which is nearest depends on the order of the ids, not of the classes."""
    edges = [("u", "a"), ("x", "u"), ("y", "v"), ("v", "w"), ("w", "a"), ("x", "p"), ("p", "q"), ("q", "b"), ("y", "b"), ("u", "c"), ("w", "c"), ("q", "0"), ("y", "0")]
    closed = kin.closure(spark.createDataFrame(edges, "parent string, child string")).cache()
    classes = kin.alike(closed).cache()
    got = {(r.a.id, r.b.id): (r.da + r.db, r.da, r.ancestor, r.db) for r in alike.expand(kin.nearest_classes(closed, classes, 9), kin.members(classes)).collect()}
    up = {}
    for r in closed.collect():
        up.setdefault(r.node, {})[r.ancestor] = r.dist
    want = {(a, b): min((up[a][x] + up[b][x], up[a][x], x, up[b][x]) for x in up[a].keys() & up[b].keys()) for a in up for b in up if a < b and up[a].keys() & up[b].keys()}
    assert got == want and classes.select("cls").distinct().count() < classes.count()


def test_children_alike_are_judged_once(spark):
    """Four hundred children of two parents, told apart by the order of birth alone: few rows are judged, all pairs come out."""
    edges = spark.range(400).select(F.explode(F.array(F.lit("f"), F.lit("m"))).alias("parent"), F.concat(F.lit("s"), "id").alias("child"), F.lit(False).alias("adoptive"), F.col("id").alias("ord"))
    chars = spark.range(400).select(F.concat(F.lit("s"), "id").alias("id"), F.when(F.col("id") % 2 == 0, "m").otherwise("f").alias("gender"), F.when(F.col("id") % 5 > 0, F.col("id").cast("int")).alias("birth_rank"))
    chars = chars.unionByName(spark.createDataFrame([("f", "m", None), ("m", "f", None)], chars.schema))
    classes, _ = kinship.compute_classes(edges, chars)
    assert classes.count() <= 20
    got = {r.term: r.n for r in kinship.compute(edges, chars).where("kind = 'sibling'").groupBy("term").agg(F.count("*").alias("n")).collect()}
    want = {}
    for i in range(400):
        for j in range(400):
            if f"s{i}" < f"s{j}":
                word = ("兄弟", "姐妹")[i % 2] if i % 2 == j % 2 else "同胞" if i % 5 == 0 or j % 5 == 0 else "兄妹" if (i < j) == (i % 2 == 0) else "姐弟"
                want[word] = want.get(word, 0) + 1
    assert got == want


def test_first_shared_event_of_all_pairs(spark):
    """As for asked pairs; pairs of one large event go to several tasks and aren't made twice."""
    ec = spark.createDataFrame([("e1", 1), ("e1", 2), ("e2", 1), ("e2", 2), ("e2", 3), ("e3", 3), ("e3", 1), ("shut", 2), ("shut", 4)], "event string, char long")
    events = spark.createDataFrame([("e1", None, 1), ("e2", 2, 9), ("e3", 2, 4)], "event string, phase int, ord long")
    asked = spark.createDataFrame([(a, b) for a in range(1, 5) for b in range(a + 1, 5)], "a long, b long")
    got = sorted(map(tuple, periods.first_shared_events(ec, events).collect()))
    assert got == sorted(map(tuple, periods.shared_events(asked, ec, events).collect())) == [(1, 2, "e2"), (1, 3, "e3"), (2, 3, "e2")]


def test_first_shared_events_shuffle_no_pairs(spark):
    """Three hundred characters in thirty events, many of them together often: each pair comes once, with its first event, and nothing is grouped by pairs."""
    rng = random.Random(8)
    there = {e: rng.sample(range(300), 60) for e in range(30)}
    ec = spark.createDataFrame([(f"e{e}", c) for e, cs in there.items() for c in cs] + [("e3", there[3][0])], "event string, char long")
    events = spark.createDataFrame([(f"e{e}", e % 4 or None, e) for e in there], "event string, phase int, ord long")
    want = {}
    for e in sorted(there, key=lambda e: (e % 4 or 99, e)):
        for a in there[e]:
            for b in there[e]:
                if a < b:
                    want.setdefault((a, b), f"e{e}")
    got = periods.first_shared_events(ec, events)
    assert sorted(map(tuple, got.collect())) == sorted((*ab, e) for ab, e in want.items())
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
