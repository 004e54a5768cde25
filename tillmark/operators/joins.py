"""Joins and rankings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join many rows to a lookup that has one row per key.

    Nothing is broadcast by hint: adaptive execution knows the real size of the lookup once it is there, and otherwise cuts
    the facts of a key that holds a large share of them into several tasks.
    """
    if how in ("left_semi", "left_anti"):
        lookup = lookup.select(*keys).distinct()
    return facts.join(lookup, keys, how)


def absent_from(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not in ``existing``."""
    hits = existing.select(*keys).join(incoming.select(*keys).distinct(), keys, "left_semi").distinct()
    return incoming.join(hits, keys, "left_anti")


def rank_in_slices(df: DataFrame, keys: list[str], slice_of: Column, order: list[Column], out: str) -> DataFrame:
    """0-based position of a row inside its key without sorting a whole key in one task.

    ``slice_of`` must not decrease along ``order`` inside a key. Each (key, slice) is numbered on its own
    and shifted by the row counts of the earlier slices of that key.
    """
    sliced = df.withColumn("_slice", slice_of)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_rank", F.row_number().over(inside))
        .join(shifts, [*keys, "_slice"])
        .withColumn(out, (F.col("_shift") + F.col("_rank") - 1).cast("int"))
        .drop("_slice", "_rank", "_shift")
    )
