"""Column functions over texts made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillmark import fixed
from tillmark import testbed as tb
from tillmark.functions import hints, numbers, times
from tillmark.registered.base import query

CENTS = "cast(l_extendedprice as decimal(15,2))"


def _lineitem(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "lineitem")
    return rows.withColumn("amount", F.col("l_extendedprice").cast("decimal(15,2)"))


def _keys():
    return ["l_orderkey", "l_linenumber", "l_partkey"]


@query("sf1_brazilian_decimal", f"""select l_orderkey, l_linenumber, l_partkey,
 cast(case l_linenumber when 5 then cast(-{CENTS} as decimal(19,6)) when 6 then null when 7 then null else cast({CENTS} as decimal(19,6)) end as varchar) as value from lineitem""")
def sf1_brazilian_decimal(spark, sf_dir):
    """Each line number writes its amount another way; 6 and 7 are unreadable."""
    shown = F.translate(F.format_number("amount", 2), ",.", ".,")
    plain = F.col("amount").cast("string")
    text = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("R$ "), shown))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("  r$"), F.translate(plain, ".", ","), F.lit(" ")))
        .when(F.col("l_linenumber") == 3, plain)
        .when(F.col("l_linenumber") == 4, F.concat(F.lit("+"), shown, F.lit(" kg")))
        .when(F.col("l_linenumber") == 5, F.concat(shown, F.lit("-")))
        .when(F.col("l_linenumber") == 6, F.concat(F.lit("1,"), shown, F.lit(",3")))
        .otherwise(F.lit("not-a-number"))
    )
    return _lineitem(spark, sf_dir).select(*_keys(), numbers.plain_text(numbers.parse_brazilian_decimal(text)).alias("value"))


NAMES = """nm as (select l_orderkey, l_linenumber, l_partkey, strftime(o_orderdate, '%d') d1, strftime(o_orderdate, '%m') m1,
 strftime(l_shipdate, '%d') d2, strftime(l_shipdate, '%m') m2 from lineitem join orders on l_orderkey = o_orderkey),
fn as (select *, case l_linenumber when 1 then 'AUDITORIA '||l_partkey||', '||d1||'_'||m1||'-'||d2||'_'||m2||'.QRP'
 when 2 then 'folder/auditoria  '||l_partkey||' '||d1||'/'||m1||'-'||d2||'/'||m2||'.QRP' when 3 then 'dir\\relatorio_'||d1||'_'||m1||'.x.qrp'
 when 4 then '/a/b/relatorio '||d1||'/'||m1 when 5 then 'AUDITORIA x'||l_partkey||'.QRP' when 6 then 'r_32_'||m1||'-'||d2||'_'||m2||' '||d1||'/'||m1||'.qrp'
 else 'relatorio_'||d1||'_'||m1||'.QRP/' end as name,
 case when l_linenumber in (1, 2) then cast(l_partkey as varchar) end code, l_linenumber in (1, 2) has_period, l_linenumber in (3, 4) has_single from nm)"""


def _names(spark, sf_dir):
    """File names from part keys and dates: both period forms, both single forms, none, out of range, a bare folder."""
    orders = tb.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = tb.table(spark, sf_dir, "lineitem").join(orders, "l_orderkey")
    day = lambda c, s: F.concat(F.date_format(c, "dd"), F.lit(s), F.date_format(c, "MM"))
    code = F.col("l_partkey").cast("string")
    n = F.col("l_linenumber")
    name = (
        F.when(n == 1, F.concat(F.lit("AUDITORIA "), code, F.lit(", "), day("o_orderdate", "_"), F.lit("-"), day("l_shipdate", "_"), F.lit(".QRP")))
        .when(n == 2, F.concat(F.lit("folder/auditoria  "), code, F.lit(" "), day("o_orderdate", "/"), F.lit("-"), day("l_shipdate", "/"), F.lit(".QRP")))
        .when(n == 3, F.concat(F.lit("dir\\relatorio_"), day("o_orderdate", "_"), F.lit(".x.qrp")))
        .when(n == 4, F.concat(F.lit("/a/b/relatorio "), day("o_orderdate", "/")))
        .when(n == 5, F.concat(F.lit("AUDITORIA x"), code, F.lit(".QRP")))
        .when(
            n == 6,
            F.concat(F.lit("r_32_"), F.date_format("o_orderdate", "MM"), F.lit("-"), day("l_shipdate", "_"), F.lit(" "), day("o_orderdate", "/"), F.lit(".qrp")),
        )
        .otherwise(F.concat(F.lit("relatorio_"), day("o_orderdate", "_"), F.lit(".QRP/")))
    )
    return rows.select(*_keys(), name.alias("name"))


@query("sf16_sf17_basename_stem", f"""with {NAMES} select l_orderkey, l_linenumber, l_partkey,
 case l_linenumber when 2 then substr(name, 8) when 3 then substr(name, 5) when 4 then substr(name, 6) when 7 then '' else name end base,
 case l_linenumber when 2 then substr(name, 8, length(name) - 11) when 3 then substr(name, 5, length(name) - 8) when 4 then substr(name, 6) when 7 then ''
  else substr(name, 1, length(name) - 4) end stem from fn""")
def sf16_sf17_basename_stem(spark, sf_dir):
    base = hints.basename(F.col("name"))
    return _names(spark, sf_dir).select(*_keys(), base.alias("base"), hints.stem(base).alias("stem"))


@query("sf18_product_code_hint", f"with {NAMES} select l_orderkey, l_linenumber, l_partkey, code from fn")
def sf18_product_code_hint(spark, sf_dir):
    return _names(spark, sf_dir).select(*_keys(), hints.product_code_hint(hints.stem(hints.basename(F.col("name")))).alias("code"))


@query("sf19_period_hint", f"""with {NAMES} select l_orderkey, l_linenumber, l_partkey, case when has_period then cast(d1 as int) end start_day, case when has_period then cast(m1 as int) end start_month,
 case when has_period then cast(d2 as int) end end_day, case when has_period then cast(m2 as int) end end_month from fn""")
def sf19_period_hint(spark, sf_dir):
    period = hints.period_hint(hints.stem(hints.basename(F.col("name"))))
    return _names(spark, sf_dir).select(*_keys(), period.alias("p")).select(
        *_keys(), F.col("p.start.day").alias("start_day"), F.col("p.start.month").alias("start_month"),
        F.col("p.end.day").alias("end_day"), F.col("p.end.month").alias("end_month"),
    )


@query("sf20_single_date_hint", f"""with {NAMES} select l_orderkey, l_linenumber, l_partkey,
 case when has_single then cast(d1 as int) end as day, case when has_single then cast(m1 as int) end as month from fn""")
def sf20_single_date_hint(spark, sf_dir):
    single = hints.single_date_hint(hints.stem(hints.basename(F.col("name"))))
    return _names(spark, sf_dir).select(*_keys(), single.alias("s")).select(*_keys(), F.col("s.day").alias("day"), F.col("s.month").alias("month"))


@query("sf21_hints_empty", f"with {NAMES} select l_orderkey, l_linenumber, l_partkey, l_linenumber in (5, 6, 7) empty from fn")
def sf21_hints_empty(spark, sf_dir):
    return _names(spark, sf_dir).select(*_keys(), hints.hints_empty(hints.filename_hints(F.col("name"))).alias("empty"))


_DATE_JSON = "'{\"day\":'||cast(%s as int)||',\"month\":'||cast(%s as int)||',\"year\":null}'"
_HINT_JSON = (
    "'{\"originalFilename\":\"'||replace(name, chr(92), chr(92)||chr(92))||'\",\"provenance\":\"INFERRED_DATA\",\"productCodeHint\":'||coalesce('\"'||code||'\"', 'null')"
    "||',\"periodHint\":'||case when has_period then '{\"start\":'||" + _DATE_JSON % ("d1", "m1") + "||',\"end\":'||" + _DATE_JSON % ("d2", "m2")
    + "||'}' else 'null' end||',\"singleDateHint\":'||case when has_single then " + _DATE_JSON % ("d1", "m1")
    + " else 'null' end||'}'"
)


@query("sk3_hints_json", f"with {NAMES} select l_orderkey, l_linenumber, l_partkey, {_HINT_JSON} as hints from fn")
def sk3_hints_json(spark, sf_dir):
    return _names(spark, sf_dir).select(*_keys(), hints.hints_json(hints.filename_hints(F.col("name"))).alias("hints"))


@query("sk4_hints_read", f"""with {NAMES} select l_orderkey, l_linenumber, l_partkey, case when l_linenumber = 5 then name when l_linenumber = 4 then null else code end code,
 case when has_period then cast(m2 as int) end end_month from fn""")
def sk4_hints_read(spark, sf_dir):
    """Stored hints read back: line 4 stored nothing, line 5 stored text that is no JSON."""
    n = F.col("l_linenumber")
    stored = F.when(n == 5, F.col("name")).when(n != 4, hints.hints_json(hints.filename_hints(F.col("name"))))
    rows = _names(spark, sf_dir).withColumn("stored", stored)
    read, typed = hints.read_hints(F.col("stored")), hints.typed_hints(F.col("stored"))
    code = F.when(n == 5, read).otherwise(F.get_json_object(read, "$.productCodeHint"))
    return rows.select(*_keys(), code.alias("code"), typed["periodHint"]["end"]["month"].alias("end_month"))


DE = "replace(replace(replace(format('{{:,.{d}f}}', cast({x} as double)), ',', ';'), '.', ','), ';', '.')"


def _grouped(expression: str, digits: int) -> str:
    return DE.replace("{{", "{").replace("}}", "}").replace("{d}", str(digits)).replace("{x}", expression)


@query("sf5_report_patterns", """select p_partkey, case when p_size % 4 <> 3 then cast(p_partkey as varchar) end code, case when p_size % 4 <> 3 then p_name end as name,
 p_brand manufacturer, case when p_size % 4 <> 2 then cast(p_size as varchar) end sale from part""")
def sf5_report_patterns(spark, sf_dir):
    """Product, manufacturer and sale marker texts in changing case and spacing, some of them no field at all."""
    part = tb.table(spark, sf_dir, "part")
    kind = F.col("p_size") % 4
    code = F.col("p_partkey").cast("string")
    product = (
        F.when(kind == 0, F.concat(F.lit("Produto: "), code, F.lit(" - "), "p_name"))
        .when(kind == 1, F.concat(F.lit("PRODUTO:"), code, F.lit("-"), "p_name", F.lit("  ")))
        .when(kind == 2, F.concat(F.lit("produto:  "), code, F.lit("  -  "), "p_name"))
        .otherwise(F.concat(F.lit("Produto: "), "p_name"))
    )
    sale = F.concat(F.when(kind == 1, F.lit("VENDA numero:")).otherwise(F.lit("Venda Numero: ")), F.col("p_size").cast("string"), F.when(kind == 2, F.lit("a")).otherwise(F.lit("")))
    rows = part.withColumns({"product": product, "maker": F.concat(F.lit("fabricante: "), "p_brand", F.lit(" ")), "marker": sale})
    none = lambda text: F.nullif(text, F.lit(""))
    return rows.select(
        "p_partkey",
        none(F.regexp_extract("product", fixed.PRODUCT_PATTERN, 1)).alias("code"),
        none(F.trim(F.regexp_extract("product", fixed.PRODUCT_PATTERN, 2))).alias("name"),
        none(F.trim(F.regexp_extract("maker", fixed.MANUFACTURER_PATTERN, 1))).alias("manufacturer"),
        none(F.regexp_extract("marker", fixed.SALE_PATTERN, 1)).alias("sale"),
    )


@query("sf24_money_text", f"""select l_orderkey, l_linenumber, l_partkey, case l_linenumber when 6 then '—' when 7 then '—' when 5 then 'R$ -'||{_grouped(CENTS, 2)} else 'R$ '||{_grouped(CENTS, 2)} end shown from lineitem""")
def sf24_money_text(spark, sf_dir):
    n, text = F.col("l_linenumber"), F.col("amount").cast("string")
    given = F.when(n == 5, F.concat(F.lit("-"), text)).when(n == 6, F.lit("junk")).when(n != 7, text)
    return _lineitem(spark, sf_dir).select(*_keys(), numbers.money_text(given).alias("shown"))


@query("sf25_quantity_text", f"""with q as (select *, cast({CENTS} * 100 as bigint) t from lineitem)
select l_orderkey, l_linenumber, l_partkey, {_grouped('t // 1000', 0)}||case when t % 1000 = 0 then '' else rtrim(','||lpad(cast(t % 1000 as varchar), 3, '0'), '0') end shown from q""")
def sf25_quantity_text(spark, sf_dir):
    """A tenth of the amount, so three decimals with and without trailing zeros occur."""
    three = (F.col("amount") * F.lit("0.1").cast("decimal(2,1)")).cast("string")
    return _lineitem(spark, sf_dir).select(*_keys(), numbers.quantity_text(three).alias("shown"))


@query("sf26_percent_text", """with p as (select l_orderkey, l_linenumber, l_partkey, cast(cast(l_discount as decimal(4,2)) * 1000 as bigint) t from lineitem)
select l_orderkey, l_linenumber, l_partkey, case when t % 10 = 0 then cast(t // 10 as varchar) else (t // 10)||'.'||(t % 10) end||'%' shown from p""")
def sf26_percent_text(spark, sf_dir):
    """Discounts in tenths of a percent; whole percents keep their zeros."""
    tenths = F.expr("cast(cast(l_discount as decimal(4,2)) * 1000 as bigint)")
    text = (tenths.cast("decimal(10,0)") * F.lit("0.10").cast("decimal(3,2)")).cast("string")
    return _lineitem(spark, sf_dir).select(*_keys(), numbers.percent_text(text).alias("shown"))


@query("sf27_integer_text", f"select event_id, case when event_id % 2 = 1 then '-' else '' end||{_grouped('event_id * 977', 0)} shown from events")
def sf27_integer_text(spark, sf_dir):
    signed = F.when(F.col("event_id") % 2 == 1, -F.col("event_id") * 977).otherwise(F.col("event_id") * 977)
    return tb.table(spark, sf_dir, "events").select("event_id", numbers.integer_text(signed).alias("shown"))


@query("sf27_local_time_texts", """select event_id, strftime(ts, '%d/%m/%Y %H:%M:%S') local_time, strftime(ts, '%d/%m/%Y') local_date,
 strftime(ts, '%d/%m/%Y %H:%M:%S') input_text, props unreadable from events""")
def sf27_local_time_texts(spark, sf_dir):
    text = times.iso_text(F.col("ts"))
    return tb.table(spark, sf_dir, "events").select(
        "event_id", times.local_time_text(text).alias("local_time"), times.local_date_text(text).alias("local_date"),
        times.time_input_text(text).alias("input_text"), times.local_time_text(F.col("props")).alias("unreadable"),
    )


@query("sf12_iso_text", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as text from events")
def sf12_iso_text(spark, sf_dir):
    return tb.table(spark, sf_dir, "events").select("event_id", times.iso_text(F.col("ts")).alias("text"))


_TYPED = """t as (select event_id, user_id % 6 k, ts, case user_id % 6 when 0 then strftime(ts, '%-d/%-m/%Y %-H:%-M') when 1 then strftime(ts, '%d/%m/%Y %H:%M:%S')
 when 2 then strftime(ts, '%Y-%m-%dT%H:%M') when 3 then '31/02/'||strftime(ts, '%Y %H:%M') when 4 then '' else props end txt from events)"""
_PARSED = """case k when 0 then strftime(ts, '%Y-%m-%dT%H:%M')||e when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S') when 2 then strftime(ts, '%Y-%m-%dT%H:%M')||e when 4 then '' end"""


def _typed(spark, sf_dir):
    k, ts = F.col("user_id") % 6, F.col("ts")
    text = (
        F.when(k == 0, F.date_format(ts, "d/M/yyyy H:m")).when(k == 1, F.date_format(ts, "dd/MM/yyyy HH:mm:ss"))
        .when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm")).when(k == 3, F.concat(F.lit("31/02/"), F.date_format(ts, "yyyy HH:mm")))
        .when(k == 4, F.lit("")).otherwise(F.col("props"))
    )
    return tb.table(spark, sf_dir, "events").withColumn("text", text)


@query("sf22_time_input", f"""with {_TYPED} select event_id, {_PARSED.replace('||e', '')} parsed, {_PARSED.replace('||e', "||':59'")} end_of_minute from t""")
def sf22_time_input(spark, sf_dir):
    text = F.col("text")
    return _typed(spark, sf_dir).select(
        "event_id", times.parse_time_input(text).alias("parsed"), times.parse_time_input(text, True).alias("end_of_minute")
    )


@query("sf23_time_filter", f"""with {_TYPED}, n as (select event_id, coalesce({_PARSED.replace('||e', '')}, '') start, strftime(ts, '%Y-%m-%dT%H:%M') as until from t)
select event_id, start, start <> '' and start > until inverted from n""")
def sf23_time_filter(spark, sf_dir):
    start = times.normalize_time_filter(F.col("text"))
    until = times.normalize_time_filter(F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))
    rows = _typed(spark, sf_dir).select("event_id", start.alias("start"), until.alias("until"))
    return rows.select("event_id", "start", times.range_inverted(F.col("start"), F.col("until")).alias("inverted"))


@query("ag19_sum_of_texts", f"""select l_suppkey, cast(cast(coalesce(sum(case when l_linenumber < 6 then {CENTS} end), 0) as decimal(38,10)) as varchar) total from lineitem group by 1""")
def ag19_sum_of_texts(spark, sf_dir):
    n = F.col("l_linenumber")
    text = F.when(n < 6, F.col("amount").cast("string")).when(n == 6, F.lit("junk"))
    rows = _lineitem(spark, sf_dir).withColumn("text", text)
    return rows.groupBy("l_suppkey").agg(numbers.sum_of_texts(F.col("text")).cast("decimal(38,10)").alias("total")).withColumn(
        "total", numbers.plain_text(F.col("total"))
    )
