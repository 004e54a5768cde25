"""Series summaries, top-list shares, snapshots and hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillmark import testbed as tb
from tillmark.functions.numbers import plain_text
from tillmark.functions.times import iso_text
from tillmark.operators.published import product_totals, visible_items
from tillmark.operators.series import (
    hour_histogram, latest_snapshots, series_summary, snapshot_stats, with_leader_share,
)
from tillmark.plans.dashboard import dashboard, top_products
from tillmark.plans.snapshots import hourly_sales, latest_rows, latest_snapshot_list
from tillmark.registered.base import iso, query, visible

DAILY = f"""{visible()}, timed as (select v.*, s.occurred_at o from vis v join sale s on v.sale_id = s.id where s.occurred_at is not null),
daily as (select cast(o as date) as date, cast(sum(total) as decimal(38,2)) revenue, cast(sum(quantity) as decimal(38,6)) quantity from timed group by 1)"""


# Mean to six decimals, half away from zero, in whole micro-units.
MEAN = "cast(cast((2 * cast(total * 1000000 as hugeint) + points) // (2 * points) as decimal(30,0)) * cast(0.000001 as decimal(7,6)) as varchar)"


def _summary(value: str) -> str:
    return f"""with {DAILY}, m as (select count(*) points, max({value}) mx, cast(sum({value}) as decimal(38,6)) total from daily),
s as (select min({value}) sec2 from (select {value} from daily order by {value} desc limit 2))
select points, {MEAN} mean, cast(cast(greatest(mx, 0.001) as decimal(38,6)) as varchar) peak, cast((select max(date) from daily where {value} = mx) as varchar) peak_date,
 cast(cast(case when points >= 3 and sec2 > 0 and mx > cast(sec2 as decimal(28,6)) * cast(2.2 as decimal(2,1)) then cast(sec2 as decimal(28,6)) * cast(1.25 as decimal(3,2)) else cast(greatest(mx, 0.001) as decimal(28,6)) end as decimal(38,6)) as varchar) scale_max,
 points >= 3 and sec2 > 0 and mx > cast(sec2 as decimal(28,6)) * cast(2.2 as decimal(2,1)) clipped from m, s"""


def _summary_rows(spark, sf_dir, value):
    daily = dashboard(tb.read_tables(spark, sf_dir)).daily
    rows = series_summary(daily, value)
    return rows.select(
        "points", plain_text(F.col("mean")).alias("mean"), plain_text(F.col("peak")).alias("peak"),
        F.col("peak_date").cast("string").alias("peak_date"), plain_text(F.col("scale_max")).alias("scale_max"), "clipped",
    )


@query("ag15_revenue_summary", _summary("revenue"))
def ag15_revenue_summary(spark, sf_dir):
    return _summary_rows(spark, sf_dir, "revenue")


@query("ag15_clipped_summary", """with daily as (select cast(ts as date) as date, cast(sum(cast(value as decimal(15,2))) as decimal(38,2)) v from events group by 1),
d as (select date, case when date = (select max(date) from daily) then v * 100 else v end v from daily), m as (select count(*) points, max(v) mx from d),
s as (select min(v) sec2 from (select v from d order by v desc limit 2))
select points, cast(cast(mx as decimal(38,6)) as varchar) peak, cast((select max(date) from d where v = mx) as varchar) peak_date,
 cast(cast(case when mx > cast(sec2 as decimal(28,6)) * cast(2.2 as decimal(2,1)) then cast(sec2 as decimal(28,6)) * cast(1.25 as decimal(3,2)) else cast(mx as decimal(28,6)) end as decimal(38,6)) as varchar) scale_max,
 mx > cast(sec2 as decimal(28,6)) * cast(2.2 as decimal(2,1)) clipped from m, s""")
def ag15_clipped_summary(spark, sf_dir):
    """Daily event values with an outlier on the last day."""
    daily = tb.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(
        F.sum(F.col("value").cast("decimal(15,2)")).cast("decimal(28,2)").alias("v")
    )
    last = daily.agg(F.max("date").alias("date")).withColumn("_last", F.lit(True))
    raised = daily.join(F.broadcast(last), "date", "left").select(
        "date", F.when(F.col("_last"), F.col("v") * 100).otherwise(F.col("v")).cast("decimal(28,2)").alias("v")
    )
    rows = series_summary(raised, "v")
    return rows.select(
        "points", plain_text(F.col("peak")).alias("peak"), F.col("peak_date").cast("string").alias("peak_date"),
        plain_text(F.col("scale_max")).alias("scale_max"), "clipped",
    )


@query("ag16_leader_share", f"""with {visible()}, t as (select product_id, cast(sum(total) as decimal(38,2)) r from vis group by 1 order by r desc, product_id limit 5)
select product_id, greatest(4.0::double, cast(r as double) / greatest(cast((select max(r) from t) as double), 0.001::double) * 100.0::double) as share from t""")
def ag16_leader_share(spark, sf_dir):
    t = tb.read_tables(spark, sf_dir)
    rows = visible_items(t["sale_item"], t["artifact_publication"]).withColumnRenamed("total", "revenue")
    return with_leader_share(top_products(product_totals(rows), t["product"])).select("product_id", "share")


SNAPSHOTS = """ev as (select cast(user_id as varchar) product_code, user_id||'@'||cast(ts as date) snapshot_id, ts, event_type, cast(value as decimal(15,2)) v,
 regexp_extract(props, '([0-9]+)', 1) sale_number, cast(hour(ts) as int) as hour from events),
snap as (select snapshot_id, product_code, max(ts) imported_at, count(*) pages from ev group by 1, 2),
latest as (select distinct on (product_code) * from snap order by product_code, imported_at desc),
lr as (select * from ev where snapshot_id in (select snapshot_id from latest))"""


def _snapshots(spark, sf_dir):
    """A snapshot per user and day; its rows are that day's events."""
    rows = tb.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("product_code"),
        F.concat(F.col("user_id").cast("string"), F.lit("@"), F.to_date("ts").cast("string")).alias("snapshot_id"),
        "ts",
        F.col("value").cast("decimal(15,2)").alias("exits"),
        F.col("value").cast("decimal(15,2)").alias("total_item"),
        F.regexp_extract("props", "([0-9]+)", 1).alias("sale_number"),
        F.hour("ts").alias("hour"),
    )
    snapshots = rows.groupBy("snapshot_id", "product_code").agg(F.max("ts").alias("imported_at"), F.count(F.lit(1)).alias("pages"))
    return snapshots, rows


@query("wn5_latest_snapshots", f"with {SNAPSHOTS} select product_code, snapshot_id, {iso('imported_at')} imported_at, pages from latest")
def wn5_latest_snapshots(spark, sf_dir):
    rows = latest_snapshots(_snapshots(spark, sf_dir)[0])
    return rows.select("product_code", "snapshot_id", iso_text(F.col("imported_at")).alias("imported_at"), "pages")


@query("ag17_snapshot_stats", f"""with {SNAPSHOTS} select snapshot_id, cast(sum(v) as varchar) quantity, cast(sum(v) as varchar) revenue, count(distinct sale_number) tickets from ev group by 1""")
def ag17_snapshot_stats(spark, sf_dir):
    stats = snapshot_stats(_snapshots(spark, sf_dir)[1], ["snapshot_id"])
    return stats.withColumns({c: plain_text(F.col(c)) for c in ("quantity", "revenue")})


@query("ag17_latest_totals", f"""with {SNAPSHOTS} select cast(sum(v) as varchar) quantity, cast(sum(v) as varchar) revenue, count(distinct sale_number) tickets from lr""")
def ag17_latest_totals(spark, sf_dir):
    stats = snapshot_stats(latest_rows(*_snapshots(spark, sf_dir)), [])
    return stats.withColumns({c: plain_text(F.col(c)) for c in ("quantity", "revenue")})


@query("ag18_hour_histogram", f"""with {SNAPSHOTS}, h as (select hour, sum(v) q from ev where hour not in (9, 10, 14) group by 1)
select cast(r.hour as int) as hour, cast(cast(coalesce(q, 0) as decimal(25,2)) as varchar) quantity from (select unnest(range((select min(hour) from h), (select max(hour) + 1 from h))) as hour) r left join h on h.hour = r.hour""")
def ag18_hour_histogram(spark, sf_dir):
    rows = _snapshots(spark, sf_dir)[1].filter(~F.col("hour").isin(9, 10, 14))
    return hour_histogram(rows).withColumn("quantity", plain_text(F.col("quantity").cast("decimal(25,2)")))


@query("qy9_latest_snapshots", f"""with {SNAPSHOTS}, st as (select snapshot_id, sum(v) q, count(distinct sale_number) t from ev group by 1)
select product_code, snapshot_id, cast(q as varchar) quantity, t tickets from latest join st using (snapshot_id)""")
def qy9_latest_snapshots(spark, sf_dir):
    rows = latest_snapshot_list(*_snapshots(spark, sf_dir))
    return rows.select("product_code", "snapshot_id", plain_text(F.col("quantity")).alias("quantity"), "tickets")


@query("qy9_hourly_sales", f"""with {SNAPSHOTS}, h as (select hour, sum(v) q from lr group by 1)
select cast(r.hour as int) as hour, cast(cast(coalesce(q, 0) as decimal(25,2)) as varchar) quantity from (select unnest(range((select min(hour) from h), (select max(hour) + 1 from h))) as hour) r left join h on h.hour = r.hour""")
def qy9_hourly_sales(spark, sf_dir):
    return hourly_sales(*_snapshots(spark, sf_dir)).withColumn("quantity", plain_text(F.col("quantity").cast("decimal(25,2)")))
