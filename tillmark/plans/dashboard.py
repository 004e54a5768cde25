"""The dashboard: totals, daily series and leading products over what is published."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.fixed import TOP_PRODUCTS
from tillmark.functions.numbers import plain_text, stripped_text
from tillmark.functions.times import day_text, in_bounds, iso_text
from tillmark.operators.joins import lookup_join
from tillmark.operators.published import (
    QUANTITIES, REVENUE, of_product, product_totals, ratio_to_cents, sale_totals, sales_between, visible_items,
)


@dataclass(frozen=True)
class Dashboard:
    kpis: DataFrame
    daily: DataFrame
    top_products: DataFrame


def _days(timed: DataFrame) -> DataFrame:
    return timed.groupBy(F.to_date("occurred_at").alias("date")).agg(
        F.sum("quantity").cast(QUANTITIES).alias("quantity"),
        F.sum("revenue").cast(REVENUE).alias("revenue"),
        F.count(F.lit(1)).alias("sales"),
        F.sum("items").alias("items"),
        F.min("occurred_at").alias("first_at"),
        F.max("occurred_at").alias("last_at"),
    )


def kpis_of_days(days: DataFrame) -> DataFrame:
    """AG1 and AG2. A sale lies on one day, so per-day counts of sales add up to the distinct count."""
    zero = F.lit(0)
    return days.agg(
        F.coalesce(F.sum("revenue"), zero).cast(REVENUE).alias("revenue_total"),
        F.coalesce(F.sum("quantity"), zero).cast(QUANTITIES).alias("quantity_total"),
        F.coalesce(F.sum("sales"), zero).alias("sales_count"),
        F.coalesce(F.sum("items"), zero).alias("item_count"),
        F.min("first_at").alias("first_movement_at"),
        F.max("last_at").alias("last_movement_at"),
    ).withColumn("average_ticket", ratio_to_cents(F.col("revenue_total"), F.col("sales_count")))


def dashboard(
    tables: dict[str, DataFrame],
    product_id: str | None = None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> Dashboard:
    """QY1. tables: sale_item, sale, product, artifact_publication.

    Items are summed per sale before they meet the sale table: what is shuffled shrinks, and a sale
    that holds a large share of all items arrives as one row per task.
    """
    visible = visible_items(of_product(tables["sale_item"], product_id), tables["artifact_publication"])
    times = sales_between(tables["sale"], start, end).select(F.col("id").alias("sale_id"), "occurred_at")
    days = _days(sale_totals(visible).join(times, "sale_id"))
    per_pair = visible.groupBy("sale_id", "product_id").agg(
        F.sum("quantity").cast(QUANTITIES).alias("quantity"), F.sum("total").cast(REVENUE).alias("revenue")
    )
    products = product_totals(lookup_join(per_pair, times.select("sale_id"), ["sale_id"], "left_semi"))
    return Dashboard(kpis_of_days(days), daily_series(days), top_products(products, tables["product"]))


def maintained_dashboard(
    parts: DataFrame,
    products: DataFrame,
    product_id: str | None = None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> Dashboard:
    """QY1 from the ledger of sums that batches keep (``sold_part``); no item, sale or pointer is read.

    What replaced attempts had added cancels out, so a sale or product counts while items of it are left.
    """
    rows = of_product(parts, product_id).filter(in_bounds(F.col("occurred_at"), start, end))
    sums = [F.sum(c).cast(t).alias(c) for c, t in (("quantity", QUANTITIES), ("revenue", REVENUE), ("items", "bigint"))]
    days = _days(rows.groupBy("sale_id").agg(F.max("occurred_at").alias("occurred_at"), *sums).filter("items > 0"))
    sold = rows.groupBy("product_id").agg(*sums).filter("items > 0").drop("items")
    return Dashboard(kpis_of_days(days), daily_series(days), top_products(sold, products))


def daily_series(days: DataFrame) -> DataFrame:
    """AG3."""
    return days.select("date", "quantity", "revenue").orderBy("date")


def top_products(totals: DataFrame, products: DataFrame, count: int = TOP_PRODUCTS) -> DataFrame:
    """TK1 and JN7: leading products by revenue, then id; only these few rows meet the product table."""
    leaders = totals.orderBy(F.desc("revenue"), "product_id").limit(count)
    names = products.select(F.col("id").alias("product_id"), "name", "external_id")
    return names.join(F.broadcast(leaders), "product_id").orderBy(F.desc("revenue"), "product_id")


def as_text(result: Dashboard) -> Dashboard:
    """The same results in the texts the interface returns."""
    stripped = lambda name: stripped_text(F.col(name)).alias(name)
    return Dashboard(
        result.kpis.select(
            stripped("revenue_total"), stripped("quantity_total"), "sales_count", "item_count",
            plain_text(F.col("average_ticket")).alias("average_ticket"),
            iso_text(F.col("first_movement_at")).alias("first_movement_at"),
            iso_text(F.col("last_movement_at")).alias("last_movement_at"),
        ),
        result.daily.select(day_text(F.col("date")).alias("date"), stripped("quantity"), stripped("revenue")),
        result.top_products.select("product_id", "name", "external_id", stripped("quantity"), stripped("revenue")),
    )
