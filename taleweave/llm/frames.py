"""Joins on keys that may be null, without clashing column names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", merge: bool = False) -> DataFrame:
    """Equi-join in which null keys are equal; the keys are taken from the left side.

    ``merge`` asks for a sort-merge join: for sides that an explode has made
    larger than the sizes by which Spark would choose a broadcast.
    """
    other = right.select(*[F.col(c).alias(f"right_{c}" if c in keys else c) for c in right.columns])
    if merge:
        left, other = left.hint("merge"), other.hint("merge")
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys])
    return left.join(other, match, how).drop(*[f"right_{k}" for k in keys])


#: Two hashes that, beside its id, tell a row's text from others.
KEY = ("__text_key", "__text_sum")


def with_key(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the KEY of its text; a null text and an empty one differ."""
    return df.withColumn(KEY[0], F.xxhash64(text_col)).withColumn(KEY[1], F.xxhash64(F.lit("sum"), text_col))
