"""Sales: paged list and detail of one sale."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.fixed import RECENT_SALES
from tillmark.functions.numbers import plain_text
from tillmark.functions.times import iso_text
from tillmark.operators.paging import Page, take_page
from tillmark.operators.published import REVENUE, published_sales, sales_between, visible_items


@dataclass(frozen=True)
class SaleDetail:
    sale: DataFrame
    lines: DataFrame


def sale_rows(
    tables: dict[str, DataFrame],
    product_id: str | None = None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> DataFrame:
    """JN2, JN4, JN5: published sales in range with the total of their whole published sale.

    One grouping by sale gives visibility, the total and whether the product occurs, so the sale table
    is joined once.
    """
    wanted = F.lit(True) if product_id is None else F.bool_or(F.col("product_id") == product_id)
    visible = visible_items(tables["sale_item"], tables["artifact_publication"])
    per_sale = visible.groupBy(F.col("sale_id").alias("id")).agg(
        F.sum("total").cast(REVENUE).alias("total"), wanted.alias("_wanted")
    )
    return sales_between(tables["sale"], start, end).join(per_sale.filter("_wanted").drop("_wanted"), "id")


def sales_page(
    tables: dict[str, DataFrame],
    product_id: str | None = None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    page: int | None = None,
    size: int | None = None,
) -> Page:
    """QY2: newest first, then by external id as text."""
    order = [F.desc("occurred_at"), F.desc("external_sale_id")]
    found = take_page(sale_rows(tables, product_id, start, end), order, page, size)
    return Page(sale_summary(found.content), found.info)


def sale_summary(rows: DataFrame) -> DataFrame:
    """PF9."""
    return rows.select(
        "id", "external_source", "external_sale_id", iso_text(F.col("occurred_at")).alias("occurred_at"),
        plain_text(F.col("total")).alias("total"),
    )


def recent_sales(tables: dict[str, DataFrame], count: int = RECENT_SALES) -> DataFrame:
    """TK8."""
    return sales_page(tables, size=count).content


def sale_detail(tables: dict[str, DataFrame], sale_id: str) -> SaleDetail:
    """QY3: header and lines of one published sale; both are empty when it is not published.

    The id filter reaches both scans, so what is joined is one sale's rows.
    """
    items = tables["sale_item"].filter(F.col("sale_id") == sale_id)
    visible = visible_items(items, tables["artifact_publication"])
    header = published_sales(tables["sale"].filter(F.col("id") == sale_id), visible).select(
        "id", "external_source", "external_sale_id", iso_text(F.col("occurred_at")).alias("occurred_at")
    )
    return SaleDetail(header, sale_lines(visible, tables["product"]))


def sale_lines(visible: DataFrame, products: DataFrame) -> DataFrame:
    """JN6, PF9 and TK6: items with their product, in record order."""
    names = products.select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), F.col("external_id").alias("product_external_id")
    )
    amounts = ("quantity", "unit_price", "discount_percentage", "total", "previous_stock", "resulting_stock")
    return (
        visible.join(names, "product_id")
        .orderBy("source_record_index", "parse_attempt_id")
        .select(
            "id", "product_id", "product_name", "product_external_id", "source_record_index",
            *[plain_text(F.col(c)).alias(c) for c in amounts],
        )
    )
