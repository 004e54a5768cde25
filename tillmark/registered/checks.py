"""Validation rules, outcomes, overlap and publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillmark import testbed as tb
from tillmark.fixed import DEFAULT_PROFILE
from tillmark.functions.marks import message_number, message_pairs, message_value, provenance, validation_status
from tillmark.functions.numbers import line_total, plain_text
from tillmark.functions.times import iso_text
from tillmark.operators import layout, maintained, publishing, validation
from tillmark.registered.base import iso, movement_cte, query
from tillmark.session import durable

RULE = DEFAULT_PROFILE.rule_version
VERSION = DEFAULT_PROFILE.parser_version

CHECKED = f"""{movement_cte(True)},
calc as (select *, round(cast(quantity as decimal(9,2)) * cast(unit_price as decimal(12,2)) * (cast(1 as decimal(6,4)) - cast(cast(discount_percentage as decimal(6,2)) * cast(0.01 as decimal(3,2)) as decimal(6,4))), 2) calculated from mv),
chk as (select *, abs(calculated - total) difference, abs(calculated - total) <= 0.01 fits, abs(previous_stock - quantity - resulting_stock) > 0.001 and direction = 'OUT' broken from calc)"""
LOCATOR = "'SourceLocator[page=1, recordIndex='||source_record_index||', byteOffset=null, detail=y='||line_number||']'"
EMPTY_LOCATOR = "'SourceLocator[page=null, recordIndex=null, byteOffset=null, detail=null]'"


def _six(expression: str) -> str:
    return f"cast(cast({expression} as decimal(19,6)) as varchar)"


def _issues(spark, sf_dir):
    return validation.movement_issues(tb.movements_with_locator(spark, sf_dir), "parse_attempt_id")


def _numbers(rows):
    names = ("source_value", "calculated_value", "difference", "tolerance")
    return rows.withColumns({n: plain_text(F.col(n)) for n in names})


def _report_summary(spark, sf_dir):
    """One row per supplier; nation keys choose which reports lack pages, texts, product or rows."""
    totals = layout.report_totals(tb.movements(spark, sf_dir), "parse_attempt_id")
    supplier = tb.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("parse_attempt_id"), F.col("s_nationkey").alias("n"))
    key = F.col("parse_attempt_id").cast("long")
    return totals.join(supplier, "parse_attempt_id").withColumns(
        {
            "pages": F.when(F.col("n") == 0, 0).otherwise(1),
            "runs": F.when(F.col("n") <= 1, 0).otherwise(5),
            "external_product_id": F.when(F.col("n") != 2, F.lit("1")),
            "lines": F.when(F.col("n") == 3, 0).otherwise(F.col("lines")),
            "source_quantity_total": F.when(
                F.col("n") != 4, F.col("parsed_quantity_total").cast("decimal(19,6)") + (key % 4).cast("decimal(2,0)") * F.lit("0.0005").cast("decimal(5,4)")
            ).cast("decimal(19,6)"),
        }
    )


SUMMARY = f"""{movement_cte(False)}, sm as (select parse_attempt_id, s_nationkey n, coalesce(sum(case when direction='OUT' then quantity end),0) parsed,
 case when s_nationkey <> 4 then coalesce(sum(case when direction='OUT' then quantity end),0) + (attempt_key % 4) * cast(0.0005 as decimal(5,4)) end declared
 from mv join supplier on s_suppkey = attempt_key group by parse_attempt_id, attempt_key, s_nationkey),
qty as (select *, abs(parsed - declared) diff, abs(parsed - declared) <= 0.001 fits from sm where n > 2 and declared is not null)"""


@query("vr1_quantity_reconciliation", f"""with {SUMMARY}
select parse_attempt_id, case when fits then 'SOURCE_QUANTITY_MATCH' else 'SOURCE_QUANTITY_MISMATCH' end code, case when fits then 'Info' else 'Error' end severity,
 {_six('declared')} source_value, {_six('parsed')} calculated_value, {_six('diff')} difference, '0.001000' tolerance, '{RULE}' rule_version from qty""")
def vr1_quantity_reconciliation(spark, sf_dir):
    rows = validation.report_issues(_report_summary(spark, sf_dir), "parse_attempt_id").filter("phase = 1")
    return _numbers(rows).select(
        "parse_attempt_id", "code", "severity", "source_value", "calculated_value", "difference", "tolerance", "rule_version"
    )


@query("vr2_line_total", f"""with {CHECKED}
select parse_attempt_id, source_record_index record_index, case when fits then 'LINE_TOTAL_MATCH' else 'LINE_TOTAL_MISMATCH' end code,
 case when fits then 'Info' else 'Warning' end severity, {_six('total')} source_value, {_six('calculated')} calculated_value, {_six('difference')} difference from chk""")
def vr2_line_total(spark, sf_dir):
    rows = _issues(spark, sf_dir).filter(F.col("code").startswith("LINE_TOTAL"))
    return _numbers(rows).select(
        "parse_attempt_id", F.col("locator.record_index").alias("record_index"), "code", "severity", "source_value",
        "calculated_value", "difference",
    )


@query("vr3_stock_continuity", f"""with {CHECKED}
select parse_attempt_id, source_record_index record_index, 'previous='||previous_stock||' quantity='||quantity||' resulting='||resulting_stock||' expected='||(previous_stock - quantity) message,
 cast(null as varchar) source_value from chk where broken""")
def vr3_stock_continuity(spark, sf_dir):
    rows = _issues(spark, sf_dir).filter("code = 'STOCK_CONTINUITY_MISMATCH'")
    return rows.select(
        "parse_attempt_id", F.col("locator.record_index").alias("record_index"), "message", plain_text(F.col("source_value")).alias("source_value")
    )


@query("vr4_pf6_validation_rows", f"""with {CHECKED}
select parse_attempt_id, case when fits then 'LINE_TOTAL_MATCH' else 'LINE_TOTAL_MISMATCH' end code, case when fits then 'VALID' else 'WARNING' end status,
 {_six('total')} source_value, {_six('calculated')} calculated_value, {_six('difference')} difference, '0.010000' tolerance, '{RULE}' rule_version, {LOCATOR} source_locator from chk
union all select parse_attempt_id, 'STOCK_CONTINUITY_MISMATCH', 'WARNING', null, null, null, null, '{VERSION}', {LOCATOR} from chk where broken""")
def vr4_pf6_validation_rows(spark, sf_dir):
    """Stored rows of all issues; unreadable times are issues too, but are not of the validation stage."""
    return _numbers(validation.validation_rows(_issues(spark, sf_dir))).drop("id")


@query("vr5_fatal_outcomes", f"""with {SUMMARY}
select parse_attempt_id, case n when 0 then 'NO_EMF_PAGES' when 1 then 'NO_EMF_TEXT' when 2 then 'PRODUCT_FIELD_MISSING' else 'NO_SALE_ROWS' end code,
 case n when 3 then 'Error' else 'Fatal' end severity, case n when 0 then 'Container' when 1 then 'Emf' else 'Layout' end stage from sm where n <= 3""")
def vr5_fatal_outcomes(spark, sf_dir):
    rows = validation.report_issues(_report_summary(spark, sf_dir), "parse_attempt_id").filter("phase = 0")
    return rows.select("parse_attempt_id", "code", "severity", "stage")


@query("so1_issue_list", f"""with {CHECKED},{SUMMARY.replace(movement_cte(False) + ',', '')}
select parse_attempt_id, 0 phase, -1 record, 1 step, case n when 0 then 'NO_EMF_PAGES' when 1 then 'NO_EMF_TEXT' when 2 then 'PRODUCT_FIELD_MISSING' else 'NO_SALE_ROWS' end code from sm where n <= 3
union all select parse_attempt_id, 1, -1, 0, case when fits then 'SOURCE_QUANTITY_MATCH' else 'SOURCE_QUANTITY_MISMATCH' end from qty
union all select parse_attempt_id, 0, source_record_index, 0, 'INVALID_DATETIME' from chk where line_number = 5
union all select parse_attempt_id, 2, source_record_index, 0, case when fits then 'LINE_TOTAL_MATCH' else 'LINE_TOTAL_MISMATCH' end from chk
union all select parse_attempt_id, 2, source_record_index, 1, 'STOCK_CONTINUITY_MISMATCH' from chk where broken""")
def so1_issue_list(spark, sf_dir):
    rows = validation.all_issues(
        validation.report_issues(_report_summary(spark, sf_dir), "parse_attempt_id"), _issues(spark, sf_dir)
    )
    return rows.select("parse_attempt_id", "issue_order.*", "code")


@query("ag11_severity_flags", f"""with {CHECKED},{SUMMARY.replace(movement_cte(False) + ',', '')},
i as (select parse_attempt_id, case n when 3 then 'Error' else 'Fatal' end s from sm where n <= 3
 union all select parse_attempt_id, case when fits then 'Info' else 'Error' end from qty
 union all select parse_attempt_id, 'Warning' from chk where line_number = 5 or not fits or broken
 union all select parse_attempt_id, 'Info' from chk where fits)
select parse_attempt_id, bool_or(s='Fatal') has_fatal, bool_or(s='Error') has_error, bool_or(s='Warning') has_warning, bool_or(s in ('Fatal','Error')) has_fatal_or_error from i group by 1""")
def ag11_severity_flags(spark, sf_dir):
    rows = validation.all_issues(
        validation.report_issues(_report_summary(spark, sf_dir), "parse_attempt_id"), _issues(spark, sf_dir)
    )
    return validation.severity_flags(rows, "parse_attempt_id")


@query("vr6_outcome", """with o as (select o_orderkey, o_orderstatus = 'P' fatal, o_orderpriority like '1%' error, o_orderpriority like '2%' overlap,
 o_orderstatus = 'F' warning, o_custkey % 3 > 0 product from orders)
select o_orderkey, case when fatal then 'FAILED' when error then 'INVALID' when overlap or warning then 'WARNING' else 'VALID' end status,
 not fatal and not error and not overlap and product publishes from o""")
def vr6_outcome(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "orders")
    fatal, error = F.col("o_orderstatus") == "P", F.col("o_orderpriority").startswith("1")
    overlap, warning = F.col("o_orderpriority").startswith("2"), F.col("o_orderstatus") == "F"
    return rows.select(
        "o_orderkey",
        validation.parse_outcome(fatal, error, warning, overlap).alias("status"),
        validation.publishes(fatal, error, overlap, F.col("o_custkey") % 3 > 0).alias("publishes"),
    )


@query("vr6_overlap_rows", f"""select cast(s_suppkey as varchar) parse_attempt_id, 'OVERLAPPING_REPORT' code, 'WARNING' status, 'identity-v1' rule_version,
 'canonical publication blocked' source_locator from supplier where s_acctbal < 0""")
def vr6_overlap_rows(spark, sf_dir):
    blocked = tb.table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("parse_attempt_id"))
    return validation.overlap_rows(blocked).select("parse_attempt_id", "code", "status", "rule_version", "source_locator")


@query("sf6_line_total", f"""with {CHECKED} select parse_attempt_id, source_record_index, cast(cast(calculated as decimal(24,2)) as varchar) calculated from chk""")
def sf6_line_total(spark, sf_dir):
    rows = tb.movements(spark, sf_dir, indexed=True)
    value = line_total(F.col("quantity"), F.col("unit_price"), F.col("discount_percentage"))
    return rows.select("parse_attempt_id", "source_record_index", plain_text(value).alias("calculated"))


@query("sf6_fine_prices", """with l as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) * 1000 + l_linenumber q,
 cast(cast(l_extendedprice as decimal(15,2)) * 100 as bigint) * 10000 // 7 p, 10000 - 125 * l_linenumber f from lineitem)
select l_orderkey, l_linenumber, cast(cast((cast(q as hugeint) * p * f + 50000000000) // 100000000000 as decimal(22,0)) * cast(0.01 as decimal(3,2)) as varchar) calculated from l""")
def sf6_fine_prices(spark, sf_dir):
    """Line totals of quantities with three decimals, prices with six and discounts with two."""
    rows = tb.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        "cast(cast(cast(l_quantity as bigint) * 1000 + l_linenumber as decimal(13,0)) * 0.001 as decimal(19,6)) quantity",
        "cast(cast(cast(cast(l_extendedprice as decimal(15,2)) * 100 as bigint) * 10000 div 7 as decimal(18,0)) * 0.000001 as decimal(19,6)) unit_price",
        "cast(l_linenumber * 1.25 as decimal(19,6)) discount",
    )
    value = line_total(F.col("quantity"), F.col("unit_price"), F.col("discount"))
    return rows.select("l_orderkey", "l_linenumber", plain_text(value).alias("calculated"))


@query("sf7_validation_status", """select event_id, case event_type when 'view' then 'VALID' when 'click' then 'WARNING' else 'INVALID' end status from events""")
def sf7_validation_status(spark, sf_dir):
    severity = F.expr("case event_type when 'view' then 'Info' when 'click' then 'Warning' when 'error' then 'Error' when 'purchase' then 'Fatal' else 'Strange' end")
    return tb.table(spark, sf_dir, "events").select("event_id", validation_status(severity).alias("status"))


@query("sf9_message_values", f"""with {CHECKED} select parse_attempt_id, source_record_index, {_six('total')} source_value, {_six('calculated')} calculated_value,
 cast(null as varchar) difference, 'v'||line_number rule_version from chk""")
def sf9_message_values(spark, sf_dir):
    """Numbers read off messages with repeated and unknown keys; the last value of a key counts."""
    rows = tb.movements(spark, sf_dir, indexed=True)
    calculated = line_total(F.col("quantity"), F.col("unit_price"), F.col("discount_percentage"))
    message = F.concat(
        F.lit("sourceValue=1 ruleVersion=v"), F.col("line_number").cast("string"), F.lit(" extra=sourceValue=7 calculatedValue="),
        calculated.cast("string"), F.lit(" difference= sourceValue="), F.col("total").cast("string"),
    )
    said = rows.withColumn("message", message).withColumn("pairs", message_pairs(F.col("message")))
    m, pairs = F.col("message"), F.col("pairs")
    return said.select(
        "parse_attempt_id", "source_record_index", plain_text(message_number(m, "sourceValue", pairs)).alias("source_value"),
        plain_text(message_number(m, "calculatedValue", pairs)).alias("calculated_value"),
        plain_text(message_number(m, "difference", pairs)).alias("difference"), message_value(m, "ruleVersion", pairs).alias("rule_version"),
    )


@query("ag12_out_sale_ids", f"with {movement_cte(False)} select distinct parse_attempt_id, external_sale_id from mv where direction = 'OUT'")
def ag12_out_sale_ids(spark, sf_dir):
    return publishing.out_sale_ids(tb.movements(spark, sf_dir))


INCOMPLETE = f"""{movement_cte(True)}, inc as (select *, case when line_number <> 1 then external_sale_id end sid, case when line_number <> 2 then quantity end qty,
 case when line_number <> 3 then unit_price end price, case when line_number <> 4 then total end tot from mv)"""


def _incomplete(spark, sf_dir):
    n = F.col("line_number")
    gaps = {"external_sale_id": 1, "quantity": 2, "unit_price": 3, "total": 4}
    return tb.movements(spark, sf_dir, indexed=True).withColumns({c: F.when(n != at, F.col(c)) for c, at in gaps.items()})


@query("pf5_publishable_rows", f"""with {INCOMPLETE} select parse_attempt_id, source_record_index from inc
where direction = 'OUT' and sid is not null and qty is not null and price is not null and tot is not null""")
def pf5_publishable_rows(spark, sf_dir):
    return publishing.publishable(_incomplete(spark, sf_dir)).select("parse_attempt_id", "source_record_index")


def _key(kind: str) -> str:
    return f"substr(sha256('POS'||chr(31)||{kind}), 1, 32)"


@query("vr9_sale_items", f"""with {INCOMPLETE} select substr(sha256(parse_attempt_id||chr(31)||source_record_index), 1, 32) id, {_key('sid')} sale_id, {_key('external_product_id')} product_id,
 parse_attempt_id, source_record_index, cast(qty as varchar) quantity, cast(price as varchar) unit_price, cast(tot as varchar) total from inc
where direction = 'OUT' and sid is not null and qty is not null and price is not null and tot is not null""")
def vr9_sale_items(spark, sf_dir):
    rows = publishing.sale_items(_incomplete(spark, sf_dir))
    texts = [plain_text(F.col(c)).alias(c) for c in ("quantity", "unit_price", "total")]
    return rows.select("id", "sale_id", "product_id", "parse_attempt_id", "source_record_index", *texts)


def _reports_by_part(spark, sf_dir):
    """Parts as reports: one turn each, their OUT and other sale ids; small parts are published before."""
    rows = tb.movements(spark, sf_dir)
    part = tb.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    name = lambda c: F.concat(F.lit("raw-"), F.col(c).cast("string")).alias("raw_artifact_id")
    reports = part.select(
        name("p_partkey"), F.col("p_partkey").alias("turn"), (F.col("p_size") % 5 != 0).alias("accepted"),
        (F.col("p_size") % 7 != 0).alias("has_product"),
    )
    sales = rows.groupBy(name("product_key"), "external_sale_id").agg(F.bool_or(F.col("direction") == "OUT").alias("is_out"))
    small = part.filter("p_size = 50").select(name("p_partkey"))
    held = sales.join(small, "raw_artifact_id").select("raw_artifact_id", "external_sale_id")
    return reports, sales, held


@query("jn8_overlap", f"""with {movement_cte(False)}, held as (select distinct product_key k, external_sale_id s from mv where product_key in (select p_partkey from part where p_size = 50))
select distinct 'raw-'||product_key raw_artifact_id from mv join held on s = external_sale_id and k <> product_key where direction = 'OUT'""")
def jn8_overlap(spark, sf_dir):
    _, sales, held = _reports_by_part(spark, sf_dir)
    incoming = sales.filter("is_out").select("raw_artifact_id", "external_sale_id")
    return publishing.overlapping_artifacts(incoming, held)


@query("jn8_maintained_holders", f"""with {movement_cte(False)}, own as (select distinct product_key k, external_sale_id s from mv),
held as (select k, s from own join part on k = p_partkey where p_size = 50 or (p_size = 49 and s::bigint % 2 = 0))
select s external_sale_id, min('raw-'||k) lowest, max('raw-'||k) highest, count(*) holders from held group by 1""")
def jn8_maintained_holders(spark, sf_dir):
    """Who holds each sale id after a second batch: parts of size 50 came, those of 49 published again with half their sales, those of 48 with none."""
    rows = tb.movements(spark, sf_dir).withColumn("raw_artifact_id", F.concat(F.lit("raw-"), F.col("product_key").cast("string")))
    size = tb.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_key"), "p_size").filter("p_size >= 48")
    pairs = durable(rows.join(size, "product_key").select("raw_artifact_id", "external_sale_id", "p_size").distinct())
    ledger = durable(pairs.filter("p_size < 50").select(*maintained.HOLDING, F.lit(True).alias("held"), F.lit(0).alias("batch")))
    gained = maintained.holdings(pairs.filter("p_size = 50 or (p_size = 49 and cast(external_sale_id as bigint) % 2 = 0)"))
    moved = pairs.filter("p_size < 50").select("raw_artifact_id").distinct()
    changes = maintained.held_changes(maintained.holders(ledger, "batch"), gained, moved).withColumn("batch", F.lit(1))
    now = maintained.holders(ledger.unionByName(changes), "batch")
    return now.groupBy("external_sale_id").agg(
        F.min("raw_artifact_id").alias("lowest"), F.max("raw_artifact_id").alias("highest"), F.count(F.lit(1)).alias("holders")
    )


@query("vr6_turn_by_turn_publication", f"""with recursive {movement_cte(False)},
own as (select product_key k, external_sale_id s, bool_or(direction = 'OUT') is_out from mv group by 1, 2),
rival as (select a.k, list(distinct b.k) ks from own a join own b on a.s = b.s and a.k <> b.k where a.is_out group by 1),
rep as materialized (select p_partkey k, row_number() over (order by p_partkey) n, p_size % 5 <> 0 accepted, p_size % 7 <> 0 has_product, coalesce(ks, []) ks
 from part left join rival on k = p_partkey),
walk as (select 0::bigint n, (select list(p_partkey) from part where p_size = 50) active, 0::bigint k, false overlap, false published
 union all select r.n, case when r.accepted and r.has_product and not list_has_any(w.active, r.ks) then list_append(w.active, r.k) else w.active end,
 r.k, r.accepted and list_has_any(w.active, r.ks), r.accepted and r.has_product and not list_has_any(w.active, r.ks)
 from walk w join rep r on r.n = w.n + 1)
select 'raw-'||k raw_artifact_id, overlap, published from walk where n > 0""")
def vr6_turn_by_turn_publication(spark, sf_dir):
    """Which of all parts' reports publish when they take their turns; the SQL walks the turns one by one."""
    reports, sales, held = _reports_by_part(spark, sf_dir)
    return publishing.decide_publication(reports, sales, held).select("raw_artifact_id", "overlap", "published")


OBSERVED = """obs as (select cast(l_partkey as varchar) pid, l_orderkey turn, case when min(l_linenumber) >= 3 then 'N'||min(l_suppkey) end nm, cast(min(l_suppkey) as varchar) att
 from lineitem group by l_partkey, l_orderkey),
seen as (select pid, arg_max(nm, turn) filter (nm is not null) nm, arg_min(att, turn) att from obs group by 1),
old as (select cast(p_partkey as varchar) pid, p_name, 'old' att from part where p_partkey % 2 = 0)"""


def _product_changes(spark, sf_dir):
    seen = tb.table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(
        F.min("l_linenumber").alias("n"), F.min("l_suppkey").cast("string").alias("parse_attempt_id")
    )
    published = seen.select(
        F.col("l_partkey").cast("string").alias("external_product_id"), F.col("l_orderkey").alias("turn"), "parse_attempt_id",
        F.when(F.col("n") >= 3, F.concat(F.lit("N"), "parse_attempt_id")).alias("product_name"),
    )
    existing = tb.products(spark, sf_dir).filter("cast(id as bigint) % 2 = 0").withColumn("first_seen_parse_attempt_id", F.lit("old"))
    return existing, published


@query("jn14_product_upsert", f"""with {OBSERVED} select coalesce(s.pid, o.pid) external_id, coalesce(s.nm, o.p_name, s.pid) as name, coalesce(o.att, s.att) first_seen_parse_attempt_id
from seen s full outer join old o on s.pid = o.pid""")
def jn14_product_upsert(spark, sf_dir):
    existing, published = _product_changes(spark, sf_dir)
    return publishing.upsert_products(existing, published).select("external_id", "name", "first_seen_parse_attempt_id")


@query("jn14_changed_products", f"""with {OBSERVED} select s.pid external_id, coalesce(s.nm, o.p_name, s.pid) as name, o.pid is null is_new
from seen s left join old o on s.pid = o.pid where o.pid is null or coalesce(s.nm, o.p_name) <> o.p_name""")
def jn14_changed_products(spark, sf_dir):
    existing, published = _product_changes(spark, sf_dir)
    return publishing.changed_products(existing, published).select("external_id", "name", "is_new")


@query("jn15_sale_insert", f"""with {movement_cte(True)}, r as (select *, row_number() over (partition by external_sale_id order by attempt_key, source_record_index) rn from mv where direction = 'OUT')
select external_sale_id, {iso('occurred_at + to_minutes(line_number)')} occurred_at, parse_attempt_id first_seen_parse_attempt_id
from r where rn = 1 and sale_key not in (select o_orderkey from orders where o_orderstatus = 'F')""")
def jn15_sale_insert(spark, sf_dir):
    rows = tb.movements(spark, sf_dir, indexed=True).withColumns(
        {"turn": F.col("attempt_key"), "occurred_at": F.expr("occurred_at + make_dt_interval(0, 0, line_number)")}
    )
    existing = tb.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(
        F.lit(DEFAULT_PROFILE.source).alias("external_source"), F.col("o_orderkey").cast("string").alias("external_sale_id")
    )
    return publishing.new_sales(rows, existing).select(
        "external_sale_id", iso_text(F.col("occurred_at")).alias("occurred_at"), "first_seen_parse_attempt_id"
    )


@query("jn16_pointer_upsert", """select 'raw-'||s_suppkey raw_artifact_id, case when s_nationkey < 3 then 'm-'||s_suppkey when s_nationkey < 10 then 'n-'||s_suppkey
 else cast(s_suppkey as varchar) end active_parse_attempt_id from supplier where s_acctbal >= 0 or s_nationkey < 10""")
def jn16_pointer_upsert(spark, sf_dir):
    supplier = tb.table(spark, sf_dir, "supplier")

    def moved(below: int, mark: str, later: int):
        return supplier.filter(F.col("s_nationkey") < below).select(
            F.concat(F.lit("raw-"), F.col("s_suppkey").cast("string")).alias("raw_artifact_id"),
            F.concat(F.lit(mark), F.col("s_suppkey").cast("string")).alias("active_parse_attempt_id"),
            F.lit("2026-02-01 00:00:00").cast("timestamp").alias("published_at"),
            (F.col("s_suppkey") + later).alias("turn"),
        )

    published = moved(10, "n-", 0).unionByName(moved(3, "m-", 1_000_000))
    return publishing.upsert_publication(tb.publication(spark, sf_dir), published).drop("published_at")


@query("sf15_provenance", f"""with {movement_cte(False)} select parse_attempt_id, 'SOURCE_DATA' total_kind, 'CALCULATED_DATA' sum_kind, 'INFERRED_DATA' hint_kind, cast(sum(total) as varchar) total from mv group by 1""")
def sf15_provenance(spark, sf_dir):
    rows = tb.movements(spark, sf_dir).groupBy("parse_attempt_id").agg(F.sum("total").alias("total"))
    return rows.select(
        "parse_attempt_id", provenance("SOURCE_DATA").alias("total_kind"), provenance("CALCULATED_DATA").alias("sum_kind"),
        provenance("INFERRED_DATA").alias("hint_kind"), plain_text(F.col("total")).alias("total"),
    )
