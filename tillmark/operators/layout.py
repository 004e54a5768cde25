"""Text runs to movements.

A report is at most 32 MiB, so it holds a bounded number of runs and every window below runs over the
runs or lines of one report. Lines are grouped before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark import fixed
from tillmark.functions.marks import direction, locator_text, moved_quantity
from tillmark.functions.numbers import parse_brazilian_decimal
from tillmark.functions.times import parse_report_time, report_time_text
from tillmark.operators.joins import lookup_join
from tillmark.schemas import MONEY

CELL_NAMES = ("price", "discount", "total", "date", "time", "exits", "entries", "previous", "resulting")


@dataclass(frozen=True)
class Layout:
    """movements: one row per sale line; reports: one row per report that had text runs."""

    movements: DataFrame
    reports: DataFrame


def _position() -> Column:
    return F.struct("page_index", "seq")


def header_positions(runs: DataFrame) -> DataFrame:
    """AG13: x of each column header per page; the last occurrence counts, the text has to be exact."""
    return (
        runs.filter(F.col("text").isin(*fixed.COLUMN_HEADERS))
        .groupBy("sha256", "page_index", F.col("text").alias("header"))
        .agg(F.max_by("x", "seq").alias("x"))
    )


def _first_texts(runs: DataFrame, patterns: dict[str, str], prefixes: tuple[str, ...]) -> DataFrame:
    """Per report the first text that matches each pattern. Reports without any of the prefixes are absent."""
    lower = F.lower("text")
    likely = F.lit(False)
    for prefix in prefixes:
        likely = likely | F.startswith(lower, F.lit(prefix))
    # min_by skips rows whose ordering is null, so only matching runs compete.
    return runs.filter(likely).groupBy("sha256").agg(
        *[F.min_by("text", F.when(F.col("text").rlike(p), _position())).alias(name) for name, p in patterns.items()]
    )


def report_fields(runs: DataFrame) -> DataFrame:
    """WN8: product and manufacturer from the first run that matches, per report."""
    found = _first_texts(
        runs, {"product": fixed.PRODUCT_PATTERN, "manufacturer": fixed.MANUFACTURER_PATTERN}, fixed.FIELD_PREFIXES
    )
    return found.select("sha256", *_product_columns(F.col("product")), _manufacturer(F.col("manufacturer")).alias("manufacturer"))


def _product_columns(text: Column) -> list[Column]:
    return [
        F.regexp_extract(text, fixed.PRODUCT_PATTERN, 1).alias("external_product_id"),
        F.trim(F.regexp_extract(text, fixed.PRODUCT_PATTERN, 2)).alias("product_name"),
    ]


def _manufacturer(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, fixed.MANUFACTURER_PATTERN, 1))


def _declared_after_marker() -> Column:
    """WN9: first readable decimal in the runs right after a marker run; null elsewhere."""
    in_order = Window.partitionBy("sha256").orderBy("page_index", "seq")
    following = [F.lead("text", n).over(in_order) for n in range(1, fixed.DECLARED_TOTAL_LOOKAHEAD + 1)]
    is_marker = F.lower("text") == fixed.DECLARED_TOTAL_MARKER
    return F.when(is_marker, F.coalesce(*[parse_brazilian_decimal(text) for text in following]))


def declared_totals(runs: DataFrame) -> DataFrame:
    """WN9: declared quantity per report, from the first marker that is followed by one.

    Runs are put in order once; what is read as a number are the few that follow a marker.
    """
    in_order = Window.partitionBy("sha256").orderBy("page_index", "seq")
    is_marker = F.lower("text") == fixed.DECLARED_TOTAL_MARKER
    placed = runs.select("sha256", "page_index", "seq", "text").withColumn("_place", F.row_number().over(in_order))
    latest = F.last(F.when(is_marker, F.col("_place")), ignorenulls=True).over(in_order)
    near = placed.withColumn("_latest", latest).filter(
        F.col("_place") - F.col("_latest") <= fixed.DECLARED_TOTAL_LOOKAHEAD
    )
    marked = near.withColumn("declared", _declared_after_marker()).filter(F.col("declared").isNotNull())
    return marked.groupBy("sha256").agg(F.min_by("declared", _position()).alias("source_quantity_total"))


def from_first_marker(runs: DataFrame, gathered: bool = False) -> DataFrame:
    """Runs of a report from its first total marker on, all that :func:`declared_totals` needs.

    Worth a second pass over runs that lie in a table: the others are not shuffled. ``gathered`` says that the runs of a
    report lie in one partition.
    """
    markers = runs.filter(F.lower("text") == fixed.DECLARED_TOTAL_MARKER)
    starts = markers.groupBy("sha256").agg(F.min(_position()).alias("_start"))
    if gathered:
        starts = starts.hint("shuffle_hash")
    narrow = runs.select("sha256", "page_index", "seq", "text")
    return lookup_join(narrow, starts, ["sha256"]).filter(_position() >= F.col("_start")).drop("_start")


def _page_headers(runs: DataFrame) -> DataFrame:
    """AG13 as one row per report: a map from page to the x of each header, the last occurrence.

    The key is the report alone, so runs that lie together by report meet it without being moved.
    """
    last_x = [
        F.max(F.when(F.col("text") == header, F.struct("seq", "x")))["x"].alias(f"_h{i}")
        for i, header in enumerate(fixed.COLUMN_HEADERS)
    ]
    pages = runs.filter(F.col("text").isin(*fixed.COLUMN_HEADERS)).groupBy("sha256", "page_index").agg(*last_x)
    places = F.struct(*[f"_h{i}" for i in range(len(fixed.COLUMN_HEADERS))])
    return pages.groupBy("sha256").agg(F.map_from_entries(F.collect_list(F.struct("page_index", places))).alias("_pages"))


def _with_nearest_header(runs: DataFrame, gathered: bool) -> DataFrame:
    """JN9: number of the nearest header of the page, if closer than the tolerance; the earlier one on a tie."""
    # Distance and header number in one whole number: the least of them is the nearest, then earliest, header.
    slots = 16
    ranked = [
        F.abs(F.col("x").cast("long") - F.col(f"_page._h{i}")) * slots + i for i in range(len(fixed.COLUMN_HEADERS))
    ]
    headers = _page_headers(runs)
    if gathered:  # a row per report of the partition in a hash table; otherwise both sides would be sorted
        headers = headers.hint("shuffle_hash")
    placed = lookup_join(runs, headers, ["sha256"], "left").withColumn(
        "_page", F.try_element_at("_pages", F.col("page_index"))
    )
    near = placed.select("sha256", "page_index", "seq", "y", "text", F.least(*ranked).alias("_near"))
    return near.withColumn(
        "_header", F.when(F.col("_near") < fixed.COLUMN_TOLERANCE * slots, (F.col("_near") % slots).cast("int"))
    ).drop("_near")


def sale_lines(runs: DataFrame, gathered: bool = False) -> DataFrame:
    """PF10, WN6, WN7, JN9 and AG14: one row per line that has a sale marker, with its cells.

    The last run of a column wins. The first marker of a line names the sale; a later one is a cell. A
    line is put together by one grouping, so runs are reduced to lines before anything is shuffled.
    ``gathered`` says that the runs of a report lie in one partition.
    """
    marked = _with_nearest_header(runs, gathered).withColumn(
        "_marker", F.startswith(F.lower("text"), F.lit(fixed.SALE_PREFIX)) & F.col("text").rlike(fixed.SALE_PATTERN)
    )
    columns = range(len(CELL_NAMES))
    run, marker = F.struct("seq", "text"), F.col("_marker")
    of = [F.col("_header") == i for i in columns]
    grouped = (
        marked.groupBy("sha256", "page_index", "y")
        .agg(
            F.min(F.when(marker, run)).alias("_first"),
            F.min("seq").alias("_line_seq"),
            *[F.max(F.when(~marker & of[i], run)).alias(f"_c{i}") for i in columns],
            *[F.max(F.when(marker & of[i], run)).alias(f"_m{i}") for i in columns],
        )
        .filter(F.col("_first").isNotNull())
    )

    def cell(i: int) -> Column:
        later = F.when(F.col(f"_m{i}.seq") != F.col("_first.seq"), F.col(f"_m{i}"))
        return F.greatest(F.col(f"_c{i}"), later)["text"]

    cells = [cell(i).alias(name) for i, name in enumerate(CELL_NAMES)]
    in_order = Window.partitionBy("sha256").orderBy("page_index", "_line_seq")
    return grouped.select(
        "sha256",
        "page_index",
        "y",
        F.regexp_extract(F.col("_first.text"), fixed.SALE_PATTERN, 1).alias("external_sale_id"),
        *cells,
        (F.row_number().over(in_order) - 1).cast("int").alias("source_record_index"),
    )


def movements_from_lines(lines: DataFrame) -> DataFrame:
    """SF1 to SF4 and SF14 over the cells of each line. Money keeps its read scale until it is stored."""
    amounts = {
        name: parse_brazilian_decimal(F.col(name))
        for name in ("price", "discount", "total", "exits", "entries", "previous", "resulting")
    }
    times = {
        "_said": report_time_text(F.col("date"), F.col("time")),
        "occurred_at": parse_report_time(F.col("date"), F.col("time")),
    }
    read = lines.withColumns({**amounts, **times})
    return read.select(
        "sha256",
        "source_record_index",
        direction(F.col("exits"), F.col("entries")).alias("direction"),
        "external_sale_id",
        "occurred_at",
        moved_quantity(F.col("exits"), F.col("entries")).alias("quantity"),
        F.col("price").alias("unit_price"),
        F.col("discount").alias("discount_percentage"),
        "total",
        F.col("previous").alias("previous_stock"),
        F.col("resulting").alias("resulting_stock"),
        F.struct(
            (F.col("page_index") + 1).alias("page"),
            F.col("source_record_index").alias("record_index"),
            F.lit(None).cast("long").alias("byte_offset"),
            F.concat(F.lit("y="), F.col("y").cast("string")).alias("detail"),
        ).alias("locator"),
        F.when(F.col("_said").isNotNull() & F.col("occurred_at").isNull(), F.concat_ws(" ", "date", "time")).alias(
            "invalid_time"
        ),
    )


def read_layout(runs: DataFrame, gathered: bool = True) -> Layout:
    """All movements and the per-report fields. A report without product field has no movements.

    Runs are taken to lie by report, as the cuts of their readers do.
    """
    fields = report_fields(runs)
    has_product = F.col("external_product_id").isNotNull()
    reports = fields.join(declared_totals(from_first_marker(runs, gathered)), "sha256", "left").withColumn(
        "source_quantity_total", F.when(has_product, F.col("source_quantity_total"))
    )
    movements = movements_from_lines(sale_lines(runs, gathered)).join(fields.filter(has_product), "sha256")
    return Layout(movements, reports)


def stored_movements(movements: DataFrame) -> DataFrame:
    """Movement columns at the scales of the table, with the locator as text."""
    loc = F.col("locator")
    return movements.withColumns(
        {
            "unit_price": F.col("unit_price").cast(MONEY),
            "total": F.col("total").cast(MONEY),
            "source_locator": locator_text(loc["page"], loc["record_index"], loc["byte_offset"], loc["detail"]),
        }
    )


def report_totals(movements: DataFrame, key: str = "sha256") -> DataFrame:
    """AG6 and AG8: parsed totals of OUT rows, first and last time over every direction, and counts."""
    out = F.col("direction") == "OUT"
    zero_quantity, zero_money = F.lit(0).cast("decimal(29,6)"), F.lit(0).cast("decimal(29,6)")
    return movements.groupBy(key).agg(
        F.coalesce(F.sum(F.when(out, F.col("quantity"))), zero_quantity).alias("parsed_quantity_total"),
        F.coalesce(F.sum(F.when(out, F.col("total"))), zero_money).alias("parsed_revenue_total"),
        F.min("occurred_at").alias("first_movement_at"),
        F.max("occurred_at").alias("last_movement_at"),
        F.count(F.lit(1)).alias("lines"),
        F.count_distinct("external_sale_id").alias("unique_sales"),
        F.count_if(F.col("direction") == "IN").alias("entries"),
        F.count_if(out).alias("exits"),
    )


def header_snapshot(runs: DataFrame) -> DataFrame:
    """SF28: export stamp and current stock from the report header, per report."""
    found = _first_texts(
        runs, {"stamp": fixed.EXPORT_STAMP_PATTERN, "stock": fixed.CURRENT_STOCK_PATTERN}, fixed.SNAPSHOT_PREFIXES
    )
    return found.select("sha256", *export_stamp(F.col("stamp")), current_stock(F.col("stock")).alias("current_stock"))


def export_stamp(text: Column) -> list[Column]:
    pattern = r"([0-9]{2}/[0-9]{2}/[0-9]{4})\s+([0-9]{2}:[0-9]{2}:[0-9]{2})"
    return [
        F.coalesce(F.regexp_extract(text, pattern, 1), F.lit("")).alias("export_date"),
        F.coalesce(F.regexp_extract(text, pattern, 2), F.lit("")).alias("export_time"),
    ]


def current_stock(text: Column) -> Column:
    return parse_brazilian_decimal(F.regexp_replace(text, fixed.CURRENT_STOCK_PATTERN, ""))
