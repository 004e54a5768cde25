"""What is visible: rows of active attempts, and the aggregates the read queries share."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions.times import in_bounds
from tillmark.operators.joins import lookup_join

REVENUE = "decimal(38,2)"
QUANTITIES = "decimal(38,6)"


def visible_items(items: DataFrame, publication: DataFrame) -> DataFrame:
    """Items of active attempts. The pointer table is broadcast only while it fits; else hot attempts are split."""
    pointer = publication.select(F.col("active_parse_attempt_id").alias("parse_attempt_id"))
    return lookup_join(items, pointer, ["parse_attempt_id"], "left_semi")


def of_product(items: DataFrame, product_id: str | None) -> DataFrame:
    """PF2: one product's items, or all of them."""
    return items if product_id is None else items.filter(F.col("product_id") == product_id)


def sales_between(sales: DataFrame, start: dt.datetime | None, end: dt.datetime | None) -> DataFrame:
    """PF1."""
    return sales.filter(in_bounds(F.col("occurred_at"), start, end))


def published_items(
    items: DataFrame,
    sales: DataFrame,
    publication: DataFrame,
    product_id: str | None = None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> DataFrame:
    """JN1: visible items with the time of their sale."""
    timed = sales_between(sales, start, end).select(F.col("id").alias("sale_id"), "occurred_at")
    return lookup_join(visible_items(of_product(items, product_id), publication), timed, ["sale_id"])


def amounts() -> list[Column]:
    return [
        F.sum("quantity").cast(QUANTITIES).alias("quantity"),
        F.sum("total").cast(REVENUE).alias("revenue"),
        F.count(F.lit(1)).alias("items"),
    ]


def sale_totals(visible: DataFrame) -> DataFrame:
    """AG5: one row per visible sale. Rows are summed before the shuffle, so a hot sale costs one row per task."""
    return visible.groupBy("sale_id").agg(*amounts())


def product_totals(rows: DataFrame) -> DataFrame:
    """AG4."""
    return rows.groupBy("product_id").agg(
        F.sum("quantity").cast(QUANTITIES).alias("quantity"), F.sum("revenue").cast(REVENUE).alias("revenue")
    )


def published_sales(sales: DataFrame, visible: DataFrame) -> DataFrame:
    """JN2: sales with at least one visible item."""
    return sales.join(visible.select(F.col("sale_id").alias("id")).distinct(), "id", "left_semi")


def published_products(products: DataFrame, visible: DataFrame) -> DataFrame:
    """JN3: products with at least one visible item."""
    return products.join(visible.select(F.col("product_id").alias("id")).distinct(), "id", "left_semi")


def ratio_to_cents(amount: Column, count: Column) -> Column:
    """AG2: amount / count to two decimals, half away from zero, in whole cents; null for no count."""
    # Taking the remainder off first makes the division exact, so nothing is rounded twice.
    doubled = F.abs(amount).cast("decimal(34,2)") * F.lit(200).cast("decimal(3,0)")
    parts = doubled.cast("decimal(37,0)") + count.cast("decimal(20,0)")
    unit = F.when(count > 0, count.cast("decimal(20,0)") * F.lit(2).cast("decimal(1,0)"))
    cents = ((parts - parts % unit) / unit).cast("decimal(30,0)")
    return (F.signum(amount).cast("decimal(1,0)") * cents * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(32,2)")
