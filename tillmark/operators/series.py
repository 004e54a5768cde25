"""Summaries of a daily series, top lists, snapshots and hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark import fixed


def series_summary(daily: DataFrame, value: str, date: str = "date") -> DataFrame:
    """AG15: points, mean, peak, date of the last peak, axis maximum and whether the axis is clipped.

    Both branches reduce to one row: totals, and the two largest values as a top-k.
    """
    totals = daily.agg(
        F.count(F.lit(1)).alias("points"),
        F.avg(value).cast("decimal(38,6)").alias("mean"),
        F.max(value).alias("largest"),
        F.max(F.struct(value, date))[date].alias("last_largest"),
    )
    second = daily.orderBy(F.desc(value)).limit(2).agg(F.min(value).alias("second"))
    one = totals.unionByName(second, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("points", "mean", "largest", "last_largest", "second")]
    )
    floor = F.lit(fixed.SCALE_FLOOR).cast("decimal(4,3)")
    peak = F.greatest("largest", floor)
    clipped = (
        (F.col("points") >= 3)
        & (F.col("second") > 0)
        & (peak > F.col("second").cast("decimal(28,6)") * F.lit(fixed.OUTLIER_RATIO).cast("decimal(2,1)"))
    )
    scale = F.when(clipped, F.col("second").cast("decimal(28,6)") * F.lit(fixed.CLIP_HEADROOM).cast("decimal(3,2)")).otherwise(peak)
    return one.filter(F.col("points") > 0).select(
        "points",
        "mean",
        peak.cast("decimal(38,6)").alias("peak"),
        F.when(F.col("largest") >= floor, F.col("last_largest")).alias("peak_date"),
        scale.cast("decimal(38,6)").alias("scale_max"),
        clipped.alias("clipped"),
    )


def with_leader_share(top: DataFrame, value: str = "revenue") -> DataFrame:
    """AG16: bar width against the leader, at least 4. Runs on a top list, so one partition holds a few rows."""
    leader = F.max(value).over(Window.partitionBy())
    return top.withColumn("share", leader_share(F.col(value), leader))


def leader_share(value: Column, leader: Column) -> Column:
    ratio = value.cast("double") / F.greatest(leader.cast("double"), F.lit(float(fixed.SCALE_FLOOR))) * F.lit(100.0)
    return F.greatest(F.lit(4.0), ratio)


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """WN5: newest snapshot per product code by import time; order by ``numeric_code`` to show."""
    others = [c for c in snapshots.columns if c not in ("product_code", "imported_at")]
    newest = snapshots.groupBy("product_code").agg(F.max(F.struct("imported_at", *others)).alias("s"))
    return newest.select(
        "product_code",
        *[F.col(f"s.{c}").alias(c) for c in ("imported_at", *others)],
        F.col("product_code").try_cast("decimal(38,0)").alias("numeric_code"),
    )


def snapshot_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AG17: quantity, revenue and distinct tickets per snapshot, or over all rows for no keys."""
    zero = F.lit(0)
    return rows.groupBy(*keys).agg(
        F.coalesce(F.sum("exits"), zero).alias("quantity"),
        F.coalesce(F.sum("total_item"), zero).alias("revenue"),
        F.count_distinct("sale_number").alias("tickets"),
    )


def hour_histogram(rows: DataFrame) -> DataFrame:
    """AG18: quantity per hour, hours without rows between the first and the last one as zero."""
    hours = rows.filter(F.col("hour").isNotNull()).groupBy("hour").agg(
        F.sum(F.coalesce(F.col("exits"), F.lit(0))).alias("quantity")
    )
    span = hours.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).filter(F.col("lo").isNotNull())
    every = span.select(F.explode(F.sequence("lo", "hi")).alias("hour"))
    return every.join(hours, "hour", "left").select("hour", F.coalesce(F.col("quantity"), F.lit(0)).alias("quantity"))
