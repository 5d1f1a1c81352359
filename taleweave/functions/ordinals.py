"""Dense ordinals without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_ord(df: DataFrame, bucket: Column, order: list, name: str = "ord") -> DataFrame:
    """Number rows from 1 by ``order``, whose first column must grow with ``bucket``.

    Rows are counted by bucket, only the bucket counts meet in one window, and
    rows are numbered within their bucket.
    """
    rows = df.withColumn("__bucket", bucket)
    counts = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return rows.withColumn("__nth", nth).join(counts, "__bucket").withColumn(name, (F.col("__before") + F.col("__nth")).cast("long")).drop("__bucket", "__nth", "__before")


def with_place(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Number rows from 1 within ``group`` by ``order``; neither the group nor the first of ``order`` is null.

    Rows are numbered within their group and first key; only the counts of those
    keys meet in a window a group.
    """
    first, *rest = order
    counts = df.groupBy(group, first).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy(first).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(group, first, F.coalesce(before, F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(group, first).orderBy(*rest))
    return df.withColumn("__nth", nth).join(counts, [group, first]).withColumn(name, F.col("__before") + F.col("__nth")).drop("__nth", "__before")
