"""Ordinals without one sort for all rows."""

import random

from pyspark.sql import functions as F

from taleweave.functions.ordinals import with_place
from taleweave.sources import bridge


def test_places_within_groups(spark):
    rng = random.Random(5)
    rows = list({(rng.choice("xy"), rng.randrange(9), rng.randrange(40)) for _ in range(300)})
    df = with_place(spark.createDataFrame(rows, "book string, a int, b int"), "book", ["a", "b"], "k")
    want = {r: k for book in "xy" for k, r in enumerate(sorted(x for x in rows if x[0] == book), 1)}
    assert {(r.book, r.a, r.b): r.k for r in df.collect()} == want
    windows = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in line]
    assert windows and all("[book#" in w and ", a#" in w for w in windows)  # no window holds a whole book


def test_items_are_numbered_over_ranges_and_orders_given_twice(spark):
    orders = [(k, k) for k in (-3, 0, 1, 65535, 65536, 65537, 400000, 7)] + [(7, 99)]
    items = [(k, n, n % 3) for k, n in [(0, 2), (0, 1), (65536, 1), (-3, 5), (7, 1), (7, 2), (400000, 1), (5, 1)] for _ in range(1)]
    i = spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey int").withColumns({"l_suppkey": F.lit(1), "l_quantity": F.lit(1.0), "l_extendedprice": F.lit(1.0)})
    got = sorted((r.ord, r.l_orderkey, r.l_linenumber) for r in bridge.numbered_items(i, spark.createDataFrame(orders, "o_orderkey long, o_custkey long")).collect())
    want = sorted((k, n) for k, n, _ in items for o, _ in orders if o == k)
    assert got == [(at, k, n) for at, (k, n) in enumerate(want, 1)]


def test_relations_without_ordinals_are_the_same_rows(spark):
    from compare import SF

    plain, full = bridge.relations(spark, SF, ordered=False), bridge.relations(spark, SF)
    assert "ord" not in plain.columns and plain.exceptAll(full.drop("ord")).isEmpty() and plain.count() == full.count()
    assert "Window" not in plain._jdf.queryExecution().optimizedPlan().toString()
