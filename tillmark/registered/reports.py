"""From report bytes and text runs to movements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillmark import fixed
from tillmark import testbed as tb
from tillmark.functions.marks import direction, locator_text, moved_quantity
from tillmark.functions.numbers import plain_text
from tillmark.functions.times import iso_text
from tillmark.operators import layout
from tillmark.registered.base import iso, movement_cte, query
from tillmark.session import durable_by
from tillmark.sources.readers import pages_of, read_reports, runs_of

# Reports of the test views: 4000 lines each, 400 per page; cells of lines 6 and 7 lie outside the tolerance.
LINES = f"""{movement_cte(True)},
ln as (select *, 'r-'||parse_attempt_id||'-'||(source_record_index // 4000) report, source_record_index % 4000 idx,
 cast((source_record_index % 4000) // 400 as int) page_index, source_record_index % 400 line, line_number <= 5 near from mv),
rows_read as (select report, cast(idx as int) source_record_index, page_index, line, attempt_key, external_sale_id,
 case when not near then 'UNKNOWN' when direction = 'IN' then 'IN' else 'OUT' end direction,
 case when near and line_number <> 5 then occurred_at + to_minutes(line_number) + to_hours(10) end occurred_at,
 case when near then quantity end quantity, case when near then unit_price end unit_price,
 case when near then discount_percentage end discount_percentage, case when near then total end total,
 case when near then previous_stock end previous_stock, case when near then resulting_stock end resulting_stock,
 near and line_number = 5 bad_time from ln)"""

NUMBER = "replace(replace(replace(format('{{:,.{d}f}}', cast({x} as double)), ',', ';'), '.', ','), ';', '.')"


def _br(expression: str, digits: int) -> str:
    return NUMBER.replace("{{", "{").replace("}}", "}").replace("{d}", str(digits)).replace("{x}", expression)


_CELLS = [
    ("'Venda Numero: '||external_sale_id", "100"),
    ("'R$ '||" + _br("unit_price", 2), "1000"),
    (_br("discount_percentage", 2), "1200"),
    (_br("total", 2), "1400"),
    ("case when line_number = 5 then '31/02/2026' else strftime(occurred_at, '%d/%m/%Y') end", "1600"),
    ("'10:0'||line_number||':00'", "1800"),
    (f"case when direction <> 'IN' then {_br('quantity', 3)} end", "2000"),
    (f"case when direction <> 'OUT' then {_br('quantity', 3)} end", "2200"),
    (_br("previous_stock", 0), "2400"),
    (_br("resulting_stock", 0), "2600"),
]
_SHIFT = "+(line_number-1)*15"
_OF_LINES = " union all ".join(
    f"select report, page_index, 13+line*10+{k} seq, {x}{_SHIFT if k else ''} x, 100+line*20 y, {text} as text from ln"
    for k, (text, x) in enumerate(_CELLS)
)
_HEADS = " union all ".join(
    f"select report, page_index, {4 + i}, {1000 + 200 * i}, 50, '{name}' from pg" for i, name in enumerate(fixed.COLUMN_HEADERS)
)
_TITLES = " union all ".join(
    f"select report, 0, {i}, 10, {10 + i}, {text} from pg where page_index = 0"
    for i, text in enumerate(
        ("'Produto: '||a||' - PRODUTO '||a", "'Fabricante: CASA'", "'Data/Hora: 07/08/2026 12:22:13'", "'Estoque Atual: '||a||',50'")
    )
)
_DECLARED = "(select report, min(attempt_key) a, coalesce(sum(case when direction='OUT' then quantity end),0) q from rows_read group by 1)"
RUNS = f"""{LINES}, pg as (select report, page_index, min(attempt_key) a from ln group by 1, 2),
runs as (select * from ({_OF_LINES}) where text is not null union all {_TITLES} union all {_HEADS}
 union all select report, 0, 4013, 10, 90000, 'TOTAL DE VENDAS:' from {_DECLARED}
 union all select report, 0, 4014, 20, 90000, 'unidades' from {_DECLARED}
 union all select report, 0, 4015, 30, 90000, {_br('q + a % 3', 3)} from {_DECLARED})"""


def _runs(spark, sf_dir):
    """The text runs as a reader leaves them, those of a report in one partition."""
    return tb.text_runs(spark, sf_dir)


def _read_back(spark, sf_dir):
    files = tb.report_files(spark, sf_dir).select(
        F.regexp_extract("path", r"/([^/]*)\.QRP$", 1).alias("sha256"), "content", F.lit("QRP").alias("detected_type"),
        F.col("path").alias("original_filename"),
    )
    return read_reports(files)


@query("sc5_page_segmentation", f"""with {RUNS}, s as (select report, page_index, sum(case when text is null then 0 else 76 + 2*length(text) end) b from runs group by 1, 2),
p as (select report, page_index, cast(108 + b + 20 as bigint) length from s)
select report as sha256, page_index, cast(3 + coalesce(sum(length + 2) over (partition by report order by page_index rows between unbounded preceding and 1 preceding), 0) as bigint) as start,
 length from p""")
def sc5_page_segmentation(spark, sf_dir):
    pages = pages_of(_read_back(spark, sf_dir))
    return pages.select("sha256", "page_index", F.col("start").cast("long"), F.col("length").cast("long"))


@query("sc6_text_runs", f"""with {RUNS}
select report as sha256, page_index, cast(row_number() over (partition by report, page_index order by seq) - 1 as int) seq,
 cast(x as int) x, cast(y as int) y, text from runs""")
def sc6_text_runs(spark, sf_dir):
    """Report bytes put together by Spark, read back by the reader: every run in record order."""
    return runs_of(_read_back(spark, sf_dir))


@query("ud1_reader_counts", f"""with {RUNS}
select report as sha256, count(distinct page_index) pages, count(*) runs from runs group by 1""")
def ud1_reader_counts(spark, sf_dir):
    return _read_back(spark, sf_dir).groupBy("sha256").agg(
        F.count_if(F.col("kind") == "page").alias("pages"), F.count_if(F.col("kind") == "run").alias("runs")
    )


@query("so2_runs_in_order", f"""with {RUNS}
select report as sha256, cast(row_number() over (partition by report order by page_index, seq) - 1 as int) as place, text from runs""")
def so2_runs_in_order(spark, sf_dir):
    order = Window.partitionBy("sha256").orderBy("page_index", "seq")
    return _runs(spark, sf_dir).select("sha256", (F.row_number().over(order) - 1).alias("place"), "text")


_MOVEMENT_TEXTS = f"""report as sha256, source_record_index, direction, external_sale_id, {iso('occurred_at')} occurred_at,
 cast(quantity as varchar) quantity, cast(cast(unit_price as decimal(19,6)) as varchar) unit_price,
 cast(discount_percentage as varchar) discount_percentage, cast(cast(total as decimal(19,6)) as varchar) total,
 cast(previous_stock as varchar) previous_stock, cast(resulting_stock as varchar) resulting_stock"""


def _movement_texts(rows):
    amounts = ("quantity", "unit_price", "discount_percentage", "total", "previous_stock", "resulting_stock")
    return [
        "sha256", "source_record_index", "direction", "external_sale_id", iso_text(F.col("occurred_at")).alias("occurred_at"),
        *[plain_text(F.col(c)).alias(c) for c in amounts],
    ]


@query("jn9_nearest_column", f"with {LINES} select {_MOVEMENT_TEXTS} from rows_read")
def jn9_nearest_column(spark, sf_dir):
    """Cells placed by distance to the headers of their page and read as movements."""
    rows = layout.movements_from_lines(layout.sale_lines(_runs(spark, sf_dir), gathered=True))
    return rows.select(*_movement_texts(rows))


@query("layout_movements", f"""with {LINES} select {_MOVEMENT_TEXTS}, cast(attempt_key as varchar) external_product_id,
 'PRODUTO '||attempt_key product_name, 'CASA' manufacturer,
 'SourceLocator[page='||(page_index+1)||', recordIndex='||source_record_index||', byteOffset=null, detail=y='||(100+line*20)||']' source_locator from rows_read""")
def layout_movements(spark, sf_dir):
    """From report bytes to stored movements. The stored runs lie by report, as their bytes did, and are not shuffled again."""
    runs = runs_of(durable_by(_read_back(spark, sf_dir), "sha256"))
    rows = layout.stored_movements(layout.read_layout(runs, gathered=True).movements)
    wide = rows.withColumns({c: F.col(c).cast("decimal(19,6)") for c in ("unit_price", "total")})
    return wide.select(*_movement_texts(wide), "external_product_id", "product_name", "manufacturer", "source_locator")


@query("pf10_sale_marker", f"with {LINES} select report as sha256, page_index, cast(100+line*20 as int) y, external_sale_id from ln")
def pf10_sale_marker(spark, sf_dir):
    return layout.sale_lines(_runs(spark, sf_dir), gathered=True).select("sha256", "page_index", "y", "external_sale_id")


@query("wn6_record_index", f"with {LINES} select report as sha256, page_index, cast(100+line*20 as int) y, cast(idx as int) source_record_index from ln")
def wn6_record_index(spark, sf_dir):
    return layout.sale_lines(_runs(spark, sf_dir), gathered=True).select("sha256", "page_index", "y", "source_record_index")


@query("wn7_second_marker", f"with {LINES} select report as sha256, cast(idx as int) source_record_index, external_sale_id, 'Venda Numero: 1' price from ln")
def wn7_second_marker(spark, sf_dir):
    """Every line gets a second marker on its price column: the first names the sale, the second is a cell."""
    runs = _runs(spark, sf_dir)
    markers = runs.filter(F.col("text").rlike(fixed.SALE_PATTERN))
    second = markers.withColumns({"seq": F.col("seq") + 9, "x": F.lit(1000), "text": F.lit("Venda Numero: 1")})
    return layout.sale_lines(runs.unionByName(second)).select("sha256", "source_record_index", "external_sale_id", "price")


@query("wn8_report_fields", f"""with {LINES} select distinct report as sha256, cast(attempt_key as varchar) external_product_id,
 'PRODUTO '||attempt_key product_name, 'CASA' manufacturer from ln""")
def wn8_report_fields(spark, sf_dir):
    return layout.report_fields(_runs(spark, sf_dir))


@query("wn9_declared_total", f"with {LINES} select report as sha256, cast(cast(q + a % 3 as decimal(19,6)) as varchar) source_quantity_total from {_DECLARED}")
def wn9_declared_total(spark, sf_dir):
    totals = layout.declared_totals(_runs(spark, sf_dir))
    return totals.withColumn("source_quantity_total", plain_text(F.col("source_quantity_total")))


_HEADER_ROWS = " union all ".join(
    f"select distinct report as sha256, page_index, '{name}' header, {1000 + 200 * i} x from ln" for i, name in enumerate(fixed.COLUMN_HEADERS)
)


@query("ag13_header_positions", f"with {LINES} {_HEADER_ROWS}")
def ag13_header_positions(spark, sf_dir):
    return layout.header_positions(_runs(spark, sf_dir))


@query("ag14_line_cells", f"""with {LINES} select report as sha256, cast(idx as int) source_record_index,
 case when near then 'R$ '||{_br('unit_price', 2)} end price, case when near then {_br('total', 2)} end total,
 case when near then case when line_number = 5 then '31/02/2026' else strftime(occurred_at, '%d/%m/%Y') end end as date,
 case when near and direction <> 'IN' then {_br('quantity', 3)} end exits, case when near and direction <> 'OUT' then {_br('quantity', 3)} end entries from ln""")
def ag14_line_cells(spark, sf_dir):
    return layout.sale_lines(_runs(spark, sf_dir), gathered=True).select(
        "sha256", "source_record_index", "price", "total", "date", "exits", "entries"
    )


_TOTALS = f"""select report as sha256, cast(coalesce(sum(case when direction='OUT' then quantity end),0) as decimal(29,6)) q,
 cast(coalesce(sum(case when direction='OUT' then total end),0) as decimal(29,6)) r, min(occurred_at) f, max(occurred_at) t,
 count(*) lines, count(distinct external_sale_id) u, count_if(direction='IN') i, count_if(direction='OUT') o from rows_read group by 1"""


@query("ag6_report_totals", f"""with {LINES}, k as ({_TOTALS}) select sha256, cast(q as varchar) parsed_quantity_total, cast(r as varchar) parsed_revenue_total,
 {iso('f')} first_movement_at, {iso('t')} last_movement_at from k""")
def ag6_report_totals(spark, sf_dir):
    rows = layout.movements_from_lines(layout.sale_lines(_runs(spark, sf_dir), gathered=True))
    totals = layout.report_totals(rows)
    return totals.select(
        "sha256", plain_text(F.col("parsed_quantity_total").cast("decimal(29,6)")).alias("parsed_quantity_total"),
        plain_text(F.col("parsed_revenue_total").cast("decimal(29,6)")).alias("parsed_revenue_total"),
        iso_text(F.col("first_movement_at")).alias("first_movement_at"), iso_text(F.col("last_movement_at")).alias("last_movement_at"),
    )


@query("ag8_report_stats", f"""with {LINES}, k as ({_TOTALS}) select sha256, lines, u unique_sales, cast(i as bigint) entries, cast(o as bigint) exits from k""")
def ag8_report_stats(spark, sf_dir):
    rows = layout.movements_from_lines(layout.sale_lines(_runs(spark, sf_dir), gathered=True))
    return layout.report_totals(rows).select("sha256", "lines", "unique_sales", "entries", "exits")


@query("sf2_invalid_times", f"""with {LINES} select report as sha256, source_record_index, {iso('occurred_at')} occurred_at,
 case when bad_time then '31/02/2026 10:05:00' end invalid_time from rows_read""")
def sf2_invalid_times(spark, sf_dir):
    rows = layout.movements_from_lines(layout.sale_lines(_runs(spark, sf_dir), gathered=True))
    return rows.select("sha256", "source_record_index", iso_text(F.col("occurred_at")).alias("occurred_at"), "invalid_time")


@query("sf3_sf4_direction_quantity", f"""with {movement_cte(False)}, e as (select *, case when line_number % 3 <> 0 then quantity end ex, case when line_number >= 3 and line_number < 6 then total end en from mv)
select sale_key, product_key, attempt_key, line_number, case when ex is not null then 'OUT' when en is not null then 'IN' else 'UNKNOWN' end moved,
 cast(coalesce(ex, cast(en as decimal(19,6))) as varchar) moved_quantity from e""")
def sf3_sf4_direction_quantity(spark, sf_dir):
    n = F.col("line_number")
    rows = tb.movements(spark, sf_dir).withColumns(
        {"exits": F.when(n % 3 != 0, F.col("quantity")), "entries": F.when((n >= 3) & (n < 6), F.col("total").cast("decimal(19,6)"))}
    )
    ex, en = F.col("exits"), F.col("entries")
    return rows.select(
        "sale_key", "product_key", "attempt_key", "line_number", direction(ex, en).alias("moved"),
        plain_text(moved_quantity(ex, en)).alias("moved_quantity"),
    )


@query("sf14_locator_text", f"""with {movement_cte(True)} select parse_attempt_id, source_record_index,
 'SourceLocator[page='||case when line_number > 3 then cast(line_number as varchar) else 'null' end||', recordIndex='||source_record_index||', byteOffset=null, detail=y='||line_number||']' source_locator from mv""")
def sf14_locator_text(spark, sf_dir):
    rows = tb.movements(spark, sf_dir, indexed=True)
    text = locator_text(
        F.when(F.col("line_number") > 3, F.col("line_number")), F.col("source_record_index"), F.lit(None).cast("long"),
        F.concat(F.lit("y="), F.col("line_number").cast("string")),
    )
    return rows.select("parse_attempt_id", "source_record_index", text.alias("source_locator"))


@query("sf28_header_snapshot", f"""with {LINES} select distinct report as sha256, '07/08/2026' export_date, '12:22:13' export_time,
 cast(cast(attempt_key + 0.5 as decimal(19,6)) as varchar) current_stock from ln""")
def sf28_header_snapshot(spark, sf_dir):
    rows = layout.header_snapshot(_runs(spark, sf_dir))
    return rows.withColumn("current_stock", plain_text(F.col("current_stock")))
