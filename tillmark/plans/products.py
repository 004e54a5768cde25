"""Products: search, detail and the page of one product."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.operators.paging import Page, take_page
from tillmark.operators.published import published_products, visible_items
from tillmark.plans.dashboard import Dashboard, dashboard


@dataclass(frozen=True)
class ProductPage:
    product: DataFrame
    dashboard: Dashboard


def blank_to_none(query: str | None) -> str | None:
    """PF4: trimmed text, none when blank."""
    return query.strip() or None if query is not None else None


def contains_pattern(query: str) -> str:
    """PF3: ``%`` and ``_`` in the query stay wildcards; a backslash quotes the character after it."""
    return re.sub(r"\\([^%_\\])", r"\1", f"%{query}%")


def search_products(products: DataFrame, query: str | None) -> DataFrame:
    """PF3 and PF4: name or external id contains the query, whatever the case."""
    wanted = blank_to_none(query)
    if wanted is None:
        return products
    pattern = contains_pattern(wanted)
    return products.filter(F.col("name").ilike(pattern) | F.col("external_id").ilike(pattern))


def products_page(
    tables: dict[str, DataFrame], query: str | None = None, page: int | None = None, size: int | None = None
) -> Page:
    """QY4: published products by name, then external id."""
    visible = visible_items(tables["sale_item"], tables["artifact_publication"])
    found = published_products(search_products(tables["product"], query), visible)
    result = take_page(found, [F.col("name"), F.col("external_id")], page, size)
    return Page(result.content.select("id", "external_source", "external_id", "name", _no_unit()), result.info)


def _no_unit():
    return F.lit(None).cast("string").alias("unit")


def product_detail(tables: dict[str, DataFrame], product_id: str) -> DataFrame:
    """QY5: one published product, or no row."""
    items = tables["sale_item"].filter(F.col("product_id") == product_id)
    visible = visible_items(items, tables["artifact_publication"])
    return published_products(tables["product"].filter(F.col("id") == product_id), visible).select(
        "id", "external_source", "external_id", "name", _no_unit(), "first_seen_parse_attempt_id"
    )


def product_page(
    tables: dict[str, DataFrame], product_id: str, start: dt.datetime | None = None, end: dt.datetime | None = None
) -> ProductPage:
    """QY8: detail and dashboard of one product."""
    return ProductPage(product_detail(tables, product_id), dashboard(tables, product_id, start, end))
