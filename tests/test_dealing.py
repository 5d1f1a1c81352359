"""Partitions that number with the rows."""

import pytest
from compare import SF, rows_of, rows_of_sql

from taleweave.functions import dealing
from taleweave.operators import periods
from taleweave.plans import registry


def test_few_rows_are_left_to_spark(spark):
    assert dealing.parts_of(0) is None and dealing.parts_of(dealing.FEW * dealing.ROWS) is None
    assert dealing.parts_of(dealing.FEW * dealing.ROWS + 1) == dealing.FEW + 1
    df = spark.range(9)
    assert dealing.dealt(df, None, "id") is df and dealing.dealt(df, 7, "id").rdd.getNumPartitions() == 7


@pytest.mark.parametrize("name", ["rule_repeats", "merge_relations", "period_segments"])
def test_more_relations_make_more_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(dealing, "ROWS", 200)
    df = registry.queries()[name](spark, SF)
    parts = dealing.parts_of(spark.read.parquet(f"{SF}/lineitem.parquet").count())
    assert parts > 20 and df.rdd.getNumPartitions() == parts
    assert rows_of(df) == rows_of_sql(registry.oracle_sql()[name])


def test_equal_periods_need_no_order(spark):
    rows = [("k", 5, 3), ("k", 5, 3), ("k", 1, 2), ("k", 1, 2), ("k", 2, 4)]
    df = spark.createDataFrame(rows, "k string, from_ch int, to_ch int")
    got = sorted((r.island, r.n, r.from_ch, r.to_ch) for r in periods.islands(df, ["k"]).collect())
    assert got == [(0, 3, 1, 4), (1, 1, 5, 3), (2, 1, 5, 3)]


def test_dealt_relations_are_numbered_alike(spark, monkeypatch):
    monkeypatch.setattr(dealing, "ROWS", 200)
    assert rows_of(registry.queries()["event_phase_assign"](spark, SF)) == rows_of_sql(registry.oracle_sql()["event_phase_assign"])
