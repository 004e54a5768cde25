"""Dashboard, sales and product queries over the visible rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillmark import testbed as tb
from tillmark.functions.numbers import plain_text, stripped_text
from tillmark.functions.times import iso_text
from tillmark.operators import maintained
from tillmark.operators.joins import lookup_join
from tillmark.operators.paging import take_page
from tillmark.operators.published import (
    REVENUE, of_product, product_totals, published_items, published_products, published_sales, ratio_to_cents,
    sale_totals, sales_between, visible_items,
)
from tillmark.plans.dashboard import as_text, dashboard, maintained_dashboard, top_products
from tillmark.plans.products import product_detail, product_page, products_page, search_products
from tillmark.plans.sales import recent_sales, sale_detail, sale_lines, sale_rows, sale_summary, sales_page
from tillmark.registered.base import PRODUCT, SALE, iso, query, stripped, visible
from tillmark.session import durable

START, END = dt.datetime(1995, 1, 1), dt.datetime(1997, 12, 31, 23, 59, 59)
RANGE = "occurred_at between timestamp '1995-01-01 00:00:00' and timestamp '1997-12-31 23:59:59'"
ANY = "occurred_at between timestamp '0001-01-01 00:00:00' and timestamp '9999-12-31 23:59:59'"
PRODUCT_ID = "7"


def _timed(condition: str, product: str | None = None) -> str:
    only = f" and v.product_id = '{product}'" if product else ""
    return f"""with {visible()},
timed as (select v.sale_id, v.product_id, v.quantity, v.total, s.occurred_at from vis v join sale s on v.sale_id = s.id
 where s.{condition}{only})"""


def _kpis(condition: str, product: str | None = None) -> str:
    cents = "cast(coalesce(sum(total),0)*100 as hugeint)"
    return f"""{_timed(condition, product)},
k as (select cast(coalesce(sum(total),0) as decimal(38,2)) r, cast(coalesce(sum(quantity),0) as decimal(38,6)) q,
 count(distinct sale_id) n, count(*) i, min(occurred_at) f, max(occurred_at) t, {cents} c from timed)
select {stripped('r')} revenue_total, {stripped('q')} quantity_total, n sales_count, i item_count,
 case when n > 0 then cast(cast((2*c+n)//(2*n) as decimal(30,0)) * cast(0.01 as decimal(3,2)) as varchar) end average_ticket,
 {iso('f')} first_movement_at, {iso('t')} last_movement_at from k"""


def _daily(condition: str, product: str | None = None) -> str:
    return f"""{_timed(condition, product)}
select cast(cast(occurred_at as date) as varchar) as date, {stripped('cast(sum(quantity) as decimal(38,6))')} quantity,
 {stripped('cast(sum(total) as decimal(38,2))')} revenue from timed group by cast(occurred_at as date)"""


def _top(condition: str, product: str | None = None) -> str:
    return f"""{_timed(condition, product)}
select t.product_id, p.name, p.external_id, {stripped('q')} quantity, {stripped('r')} revenue
from (select product_id, cast(sum(quantity) as decimal(38,6)) q, cast(sum(total) as decimal(38,2)) r from timed
 group by product_id order by r desc, product_id limit 5) t join product p on p.id = t.product_id"""


@query("qy1_dashboard_kpis", _kpis(RANGE))
def qy1_dashboard_kpis(spark, sf_dir):
    return as_text(dashboard(tb.read_tables(spark, sf_dir), start=START, end=END)).kpis


@query("qy1_daily", _daily(RANGE))
def qy1_daily(spark, sf_dir):
    return as_text(dashboard(tb.read_tables(spark, sf_dir), start=START, end=END)).daily


@query("qy1_top_products", _top(RANGE))
def qy1_top_products(spark, sf_dir):
    return as_text(dashboard(tb.read_tables(spark, sf_dir), start=START, end=END)).top_products


def _maintained(spark, sf_dir, product=None, start=START, end=END):
    """The dashboard of a ledger: every published artifact first sold half as much under another attempt, which was replaced."""
    t = tb.read_tables(spark, sf_dir)
    pointers = t["artifact_publication"].select(F.col("active_parse_attempt_id").alias("parse_attempt_id"))
    old = lambda c: F.concat(F.lit("old-"), c)
    earlier = t["sale_item"].filter("line_number <= 4").withColumns(
        {"parse_attempt_id": old(F.col("parse_attempt_id")), "product_id": F.reverse("product_id")}
    )
    replaced = pointers.select(old(F.col("parse_attempt_id")).alias("parse_attempt_id"))
    ledger = durable(maintained.sold_parts(lookup_join(earlier, replaced, ["parse_attempt_id"], "left_semi"), t["sale"]))
    added = maintained.sold_parts(visible_items(t["sale_item"], t["artifact_publication"]), t["sale"])
    ledger = ledger.unionByName(added).unionByName(maintained.withdrawn_parts(ledger, replaced))
    return as_text(maintained_dashboard(ledger, t["product"], product, start, end))


@query("qy1_maintained_kpis", _kpis(RANGE))
def qy1_maintained_kpis(spark, sf_dir):
    return _maintained(spark, sf_dir).kpis


@query("ag1_maintained_product_kpis", _kpis(ANY, PRODUCT_ID))
def ag1_maintained_product_kpis(spark, sf_dir):
    return _maintained(spark, sf_dir, PRODUCT_ID, None, None).kpis


@query("ag3_maintained_daily", _daily(ANY))
def ag3_maintained_daily(spark, sf_dir):
    return _maintained(spark, sf_dir, None, None, None).daily


@query("ag4_maintained_top_products", _top(RANGE))
def ag4_maintained_top_products(spark, sf_dir):
    return _maintained(spark, sf_dir).top_products


@query("ag1_kpis", _kpis(ANY))
def ag1_kpis(spark, sf_dir):
    return as_text(dashboard(tb.read_tables(spark, sf_dir))).kpis


@query("ag2_average_ticket", f"""{_timed(ANY)},
k as (select product_id, cast(sum(total)*100 as hugeint) c, count(distinct sale_id) n from timed group by 1)
select product_id, cast(cast((2*c+n)//(2*n) as decimal(30,0)) * cast(0.01 as decimal(3,2)) as varchar) average_ticket from k""")
def ag2_average_ticket(spark, sf_dir):
    t = tb.read_tables(spark, sf_dir)
    rows = published_items(t["sale_item"], t["sale"], t["artifact_publication"])
    per_pair = rows.groupBy("product_id", "sale_id").agg(F.sum("total").cast(REVENUE).alias("total"))
    per_product = per_pair.groupBy("product_id").agg(
        F.sum("total").cast(REVENUE).alias("total"), F.count(F.lit(1)).alias("n")
    )
    return per_product.select(
        "product_id", plain_text(ratio_to_cents(F.col("total"), F.col("n"))).alias("average_ticket")
    )


@query("ag3_daily_series", _daily(ANY))
def ag3_daily_series(spark, sf_dir):
    return as_text(dashboard(tb.read_tables(spark, sf_dir))).daily


@query("ag4_product_totals", f"""with {visible()}
select product_id, cast(sum(quantity) as varchar) quantity, cast(sum(total) as varchar) revenue from vis group by 1""")
def ag4_product_totals(spark, sf_dir):
    t = tb.read_tables(spark, sf_dir)
    rows = visible_items(t["sale_item"], t["artifact_publication"]).withColumnRenamed("total", "revenue")
    return product_totals(rows).select(
        "product_id", plain_text(F.col("quantity")).alias("quantity"), plain_text(F.col("revenue")).alias("revenue")
    )


@query("ag5_sale_totals", f"""with {visible()}
select s.id, cast(coalesce(sum(v.total), 0) as varchar) total from sale s left join vis v on v.sale_id = s.id group by 1""")
def ag5_sale_totals(spark, sf_dir):
    t = tb.read_tables(spark, sf_dir)
    totals = sale_totals(visible_items(t["sale_item"], t["artifact_publication"]))
    joined = t["sale"].select("id").join(totals.withColumnRenamed("sale_id", "id"), "id", "left")
    return joined.select("id", plain_text(F.coalesce("revenue", F.lit(0).cast("decimal(38,2)"))).alias("total"))


@query("pf1_time_range", f"with {SALE} select id, {iso('occurred_at')} occurred_at from sale where {RANGE}")
def pf1_time_range(spark, sf_dir):
    rows = sales_between(tb.sales(spark, sf_dir), START, END)
    return rows.select("id", iso_text(F.col("occurred_at")).alias("occurred_at"))


@query("pf1_open_range", f"with {SALE} select id, {iso('occurred_at')} occurred_at from sale where {ANY}")
def pf1_open_range(spark, sf_dir):
    rows = sales_between(tb.sales(spark, sf_dir), None, None)
    return rows.select("id", iso_text(F.col("occurred_at")).alias("occurred_at"))


@query("pf2_product_filter", f"""with {visible()}
select sale_id, parse_attempt_id, cast(quantity as varchar) quantity, cast(total as varchar) total from vis where product_id = '{PRODUCT_ID}'""")
def pf2_product_filter(spark, sf_dir):
    t = tb.read_tables(spark, sf_dir)
    rows = visible_items(of_product(t["sale_item"], PRODUCT_ID), t["artifact_publication"])
    return rows.select(
        "sale_id", "parse_attempt_id", plain_text(F.col("quantity")).alias("quantity"), plain_text(F.col("total")).alias("total")
    )


@query("pf3_search", f"with {PRODUCT} select id, name from product where name ilike '%R_d%i%' or external_id ilike '%R_d%i%'")
def pf3_search(spark, sf_dir):
    return search_products(tb.products(spark, sf_dir), "R_d%i").select("id", "name")


@query("pf4_blank_query", f"""with {visible()}
select id, name from product where id in (select product_id from vis)""")
def pf4_blank_query(spark, sf_dir):
    t = tb.read_tables(spark, sf_dir)
    visible_rows = visible_items(t["sale_item"], t["artifact_publication"])
    return published_products(search_products(t["product"], "   "), visible_rows).select("id", "name")


@query("pf7_point_lookup", f"""with {visible()}
select id, external_sale_id, {iso('occurred_at')} occurred_at from sale
where id = (select max(sale_id) from vis)""")
def pf7_point_lookup(spark, sf_dir):
    t = tb.read_tables(spark, sf_dir, indexed=True)
    return sale_detail(t, _highest_sale(spark, sf_dir)).sale.select("id", "external_sale_id", "occurred_at")


def _highest_sale(spark, sf_dir) -> str:
    """A sale id that exists at every scale: the highest visible one, as text."""
    t = tb.read_tables(spark, sf_dir)
    return visible_items(t["sale_item"], t["artifact_publication"]).agg(F.max("sale_id")).first()[0]


@query("pf9_sale_summaries", f"""with {visible()}
select s.id, 'POS' external_source, s.external_sale_id, {iso('s.occurred_at')} occurred_at, cast(t.total as varchar) total
from sale s join (select sale_id, cast(sum(total) as decimal(38,2)) total from vis group by 1) t on t.sale_id = s.id
where s.{ANY}""")
def pf9_sale_summaries(spark, sf_dir):
    return sale_summary(sale_rows(tb.read_tables(spark, sf_dir)))


@query("jn1_published_items", f"""{_timed(RANGE)}
select sale_id, product_id, cast(quantity as varchar) quantity, cast(total as varchar) total, {iso('occurred_at')} occurred_at from timed""")
def jn1_published_items(spark, sf_dir):
    t = tb.read_tables(spark, sf_dir)
    rows = published_items(t["sale_item"], t["sale"], t["artifact_publication"], start=START, end=END)
    return rows.select(
        "sale_id", "product_id", plain_text(F.col("quantity")).alias("quantity"),
        plain_text(F.col("total")).alias("total"), iso_text(F.col("occurred_at")).alias("occurred_at"),
    )


@query("jn2_published_sales", f"with {visible()} select id, {iso('occurred_at')} occurred_at from sale where id in (select sale_id from vis)")
def jn2_published_sales(spark, sf_dir):
    t = tb.read_tables(spark, sf_dir)
    rows = published_sales(t["sale"], visible_items(t["sale_item"], t["artifact_publication"]))
    return rows.select("id", iso_text(F.col("occurred_at")).alias("occurred_at"))


@query("jn3_published_products", f"with {visible()} select id, name from product where id in (select product_id from vis)")
def jn3_published_products(spark, sf_dir):
    t = tb.read_tables(spark, sf_dir)
    return published_products(t["product"], visible_items(t["sale_item"], t["artifact_publication"])).select("id", "name")


@query("jn4_sales_of_product", f"""with {visible()}
select s.id, cast((select sum(total) from vis where sale_id = s.id) as varchar) total from sale s
where s.{ANY} and s.id in (select sale_id from vis where product_id = '{PRODUCT_ID}')""")
def jn4_sales_of_product(spark, sf_dir):
    rows = sale_rows(tb.read_tables(spark, sf_dir), PRODUCT_ID)
    return rows.select("id", plain_text(F.col("total")).alias("total"))


@query("jn5_sale_total_attach", f"""with {visible()}
select s.id, {iso('s.occurred_at')} occurred_at, cast(t.total as varchar) total
from sale s join (select sale_id, sum(total) total from vis group by 1) t on t.sale_id = s.id where s.{RANGE}""")
def jn5_sale_total_attach(spark, sf_dir):
    rows = sale_rows(tb.read_tables(spark, sf_dir), start=START, end=END)
    return rows.select("id", iso_text(F.col("occurred_at")).alias("occurred_at"), plain_text(F.col("total")).alias("total"))


_LINES = """select v.parse_attempt_id||'#'||v.source_record_index id, v.product_id, p.name product_name,
 p.external_id product_external_id, v.source_record_index, cast(quantity as varchar) quantity, cast(unit_price as varchar) unit_price,
 cast(discount_percentage as varchar) discount_percentage, cast(total as varchar) total,
 cast(previous_stock as varchar) previous_stock, cast(resulting_stock as varchar) resulting_stock
from vis v join product p on p.id = v.product_id"""


@query("jn6_item_products", f"with {visible(True)} {_LINES}")
def jn6_item_products(spark, sf_dir):
    t = tb.read_tables(spark, sf_dir, indexed=True)
    return sale_lines(visible_items(t["sale_item"], t["artifact_publication"]), t["product"])


@query("jn7_top_enrichment", _top(ANY))
def jn7_top_enrichment(spark, sf_dir):
    return as_text(dashboard(tb.read_tables(spark, sf_dir))).top_products


@query("tk1_top_products", f"""with {visible()}, t as (select product_id, cast(sum(quantity) as decimal(38,6)) q,
 cast(sum(total) as decimal(38,2)) r from vis group by 1 order by r desc, product_id limit 5)
select product_id, p.external_id, cast(r as varchar) revenue, cast(rank() over (order by r desc, product_id) = 1 as boolean) featured
from t join product p on p.id = t.product_id""")
def tk1_top_products(spark, sf_dir):
    t = tb.read_tables(spark, sf_dir)
    rows = visible_items(t["sale_item"], t["artifact_publication"]).withColumnRenamed("total", "revenue")
    top = top_products(product_totals(rows), t["product"])
    first = F.row_number().over(Window.orderBy(F.desc("revenue"), "product_id")) == 1  # five rows
    return top.select("product_id", "external_id", plain_text(F.col("revenue")).alias("revenue"), first.alias("featured"))


def _page(order: str, size: int, page: int, condition: str) -> str:
    return f"""with {visible()}
select s.id, 'POS' external_source, s.external_sale_id, {iso('s.occurred_at')} occurred_at, cast(t.total as varchar) total
from sale s join (select sale_id, cast(sum(total) as decimal(38,2)) total from vis group by 1) t on t.sale_id = s.id
where s.{condition} order by {order} limit {size} offset {size * page}"""


@query("tk2_sales_order", _page("s.occurred_at desc, s.external_sale_id desc", 100, 0, ANY))
def tk2_sales_order(spark, sf_dir):
    return sales_page(tb.read_tables(spark, sf_dir), size=100).content


@query("qy2_sales_page", _page("s.occurred_at desc, s.external_sale_id desc", 20, 3, RANGE))
def qy2_sales_page(spark, sf_dir):
    return sales_page(tb.read_tables(spark, sf_dir), start=START, end=END, page=3).content


@query("tk3_page_info", f"""with {visible()}, n as (select count(*) n from sale where {RANGE} and id in (select sale_id from vis))
select 3 as page, 20 as size, n as total_elements, cast(ceil(n / 20.0) as int) total_pages from n""")
def tk3_page_info(spark, sf_dir):
    return sales_page(tb.read_tables(spark, sf_dir), start=START, end=END, page=3).info


@query("tk4_products_by_name", f"""with {visible()}
select id, external_id, name from product where id in (select product_id from vis) order by name, external_id limit 100 offset 100""")
def tk4_products_by_name(spark, sf_dir):
    return products_page(tb.read_tables(spark, sf_dir), page=1, size=100).content.select("id", "external_id", "name")


@query("tk6_lines_in_order", f"""with {visible(True)} select * from ({_LINES}) order by source_record_index, id limit 100""")
def tk6_lines_in_order(spark, sf_dir):
    t = tb.read_tables(spark, sf_dir, indexed=True)
    rows = sale_lines(visible_items(t["sale_item"], t["artifact_publication"]), t["product"])
    return take_page(rows, [F.col("source_record_index"), F.col("id")], 0, 100).content


@query("tk8_recent_sales", _page("s.occurred_at desc, s.external_sale_id desc", 5, 0, ANY))
def tk8_recent_sales(spark, sf_dir):
    return recent_sales(tb.read_tables(spark, sf_dir))


@query("qy3_sale_lines", f"""with {visible(True)} {_LINES} where v.sale_id = (select max(sale_id) from vis)""")
def qy3_sale_lines(spark, sf_dir):
    return sale_detail(tb.read_tables(spark, sf_dir, indexed=True), _highest_sale(spark, sf_dir)).lines


@query("qy4_products_page", f"""with {visible()}
select id, 'POS' external_source, external_id, name, cast(null as varchar) unit from product
where id in (select product_id from vis) and (name ilike '%an%' or external_id ilike '%an%') order by name, external_id limit 20""")
def qy4_products_page(spark, sf_dir):
    return products_page(tb.read_tables(spark, sf_dir), " an ").content


@query("qy5_product", f"""with {visible()}
select id, 'POS' external_source, external_id, name, cast(null as varchar) unit, '0' first_seen_parse_attempt_id
from product where id in (select product_id from vis) and id = '{PRODUCT_ID}'""")
def qy5_product(spark, sf_dir):
    return product_detail(tb.read_tables(spark, sf_dir), PRODUCT_ID)


@query("qy8_product_kpis", _kpis(ANY, PRODUCT_ID))
def qy8_product_kpis(spark, sf_dir):
    return as_text(product_page(tb.read_tables(spark, sf_dir), PRODUCT_ID).dashboard).kpis


@query("qy8_product_daily", _daily(ANY, PRODUCT_ID))
def qy8_product_daily(spark, sf_dir):
    return as_text(product_page(tb.read_tables(spark, sf_dir), PRODUCT_ID).dashboard).daily


@query("sf10_sf11_decimal_texts", f"""with {visible()}
select sale_id, product_id, cast(total as varchar) plain, {stripped('total')} stripped, {stripped('quantity')} stripped_quantity from vis""")
def sf10_sf11_decimal_texts(spark, sf_dir):
    t = tb.read_tables(spark, sf_dir)
    rows = visible_items(t["sale_item"], t["artifact_publication"])
    return rows.select(
        "sale_id", "product_id", plain_text(F.col("total")).alias("plain"), stripped_text(F.col("total")).alias("stripped"),
        stripped_text(F.col("quantity")).alias("stripped_quantity"),
    )


@query("tk3_far_page", """with r as (select l_orderkey, l_linenumber, l_shipdate, row_number() over (order by l_shipdate desc, l_orderkey, l_linenumber) - 1 i, count(*) over () n from lineitem)
select l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') l_shipdate, i - (n // 200) * 100 as place from r where i // 100 = n // 200""")
def tk3_far_page(spark, sf_dir):
    """The page of a hundred lines in the middle of all lines, latest first."""
    rows = tb.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    order = [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]
    page = take_page(rows, order, rows.count() // 200, 100).content
    place = F.row_number().over(Window.orderBy(*order)) - 1  # at most a hundred rows
    return page.select("l_orderkey", "l_linenumber", F.substring(F.col("l_shipdate").cast("string"), 1, 10).alias("l_shipdate"), place.cast("long").alias("place"))
