"""Snapshot views: newest report per product, their totals, and sales by hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.operators.joins import lookup_join
from tillmark.operators.series import hour_histogram, latest_snapshots, snapshot_stats


def latest_rows(snapshots: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the newest snapshot of each product. Both hold ``snapshot_id``."""
    newest = latest_snapshots(snapshots).select("snapshot_id")
    return lookup_join(rows, newest, ["snapshot_id"], "left_semi")


def latest_snapshot_list(snapshots: DataFrame, rows: DataFrame) -> DataFrame:
    """QY9: newest snapshots with their totals, by numeric product code."""
    stats = snapshot_stats(latest_rows(snapshots, rows), ["snapshot_id"])
    return latest_snapshots(snapshots).join(stats, "snapshot_id", "left").orderBy("numeric_code", "product_code")


def hourly_sales(snapshots: DataFrame, rows: DataFrame) -> DataFrame:
    """QY9: quantity by hour over the newest snapshots."""
    return hour_histogram(latest_rows(snapshots, rows)).orderBy(F.col("hour"))
