"""Offset pages with a total, as the query interface returns them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.fixed import DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE
from tillmark.session import durable

#: Rows up to which a page is one top-k, ranges a longer way is cut into, and rows of a range that is small enough to sort.
SHALLOW, RANGES, SMALL = 10_000, 256, 100_000


@dataclass(frozen=True)
class Page:
    """content: the rows of the page in order; info: page, size, total_elements, total_pages."""

    content: DataFrame
    info: DataFrame


def page_number(page: int | None) -> int:
    value = 0 if page is None else page
    if value < 0:
        raise ValueError("page must be >= 0")
    return value


def page_size(size: int | None) -> int:
    value = DEFAULT_PAGE_SIZE if size is None else size
    if not 1 <= value <= MAX_PAGE_SIZE:
        raise ValueError(f"size must be between 1 and {MAX_PAGE_SIZE}")
    return value


def total_pages(total: Column, size: int) -> Column:
    return F.lit(0) if size <= 0 else F.ceil(total / F.lit(size)).cast("int")


def narrowed(rows: DataFrame, order: list[Column], offset: int, length: int) -> tuple[DataFrame, int]:
    """Rows around the places ``offset`` to ``offset + length`` of an order, and how many of them come before.

    Rows are dealt to ranges of the order and written; counts of the ranges tell which ones hold the places, and only these
    are dealt again, until they are few. Equal rows of an order share a range, so ties stay together.
    """
    total = None
    while True:
        dealt = durable(rows.repartitionByRange(RANGES, *order).withColumn("_range", F.spark_partition_id()))
        counts = sorted(dealt.groupBy("_range").count().collect())  # one row per range
        before, kept, held = 0, [], 0
        for number, count in counts:
            if before + count <= offset:
                before += count
            elif before + held < offset + length:
                kept.append(number)
                held += count
        rows, offset = dealt.filter(F.col("_range").isin(kept)).drop("_range"), offset - before
        if held <= SMALL or held == total:  # what does not shrink is equal in the order
            return rows, offset
        total = held


def take_page(rows: DataFrame, order: list[Column], page: int | None, size: int | None) -> Page:
    """TK3: near pages are one top-k; far ones are looked for by :func:`narrowed`. The total is a separate count."""
    number, length = page_number(page), page_size(size)
    info = rows.agg(F.count(F.lit(1)).alias("total_elements")).select(
        F.lit(number).alias("page"),
        F.lit(length).alias("size"),
        "total_elements",
        total_pages(F.col("total_elements"), length).alias("total_pages"),
    )
    offset = number * length
    if offset + length > SHALLOW:
        rows, offset = narrowed(rows, order, offset, length)
    return Page(rows.orderBy(*order).offset(offset).limit(length), info)
