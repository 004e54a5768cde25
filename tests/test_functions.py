"""Column functions on the literal cases they have to satisfy."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillmark.functions import hints, marks, numbers, times
from tillmark.operators.paging import page_number, page_size, take_page
from tillmark.operators.published import ratio_to_cents
from tillmark.plans.products import blank_to_none, contains_pattern


def values(spark, texts, column, kind="string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, x {kind}")
    return [r[1] for r in rows.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def check(spark, cases, column, kind="string"):
    got = values(spark, [c[0] for c in cases], column, kind)
    assert got == [c[1] for c in cases]


def test_brazilian_decimal(spark):
    cases = [
        ("R$ 4,05", "4.05"), ("87.654,32", "87654.32"), ("6,125", "6.125"), ("0.75", "0.75"), (None, None), ("", None), ("\t", None),
        ("+-", None), ("abc", None), ("71-", "-71"), ("4,5,6,7", None), ("-8-", None), ("r$9,1", "9.1"), ("2 000,25 un", "2000.25"),
        ("3e2", "32"), ("+64", "64"), ("total R$ 15", "15"),
    ]
    check(spark, [(t, None if v is None else Decimal(v).quantize(Decimal("0.000001"))) for t, v in cases], numbers.parse_brazilian_decimal)


def test_display_texts(spark):
    check(spark, [("45210.9", "R$ 45.210,90"), ("7.05", "R$ 7,05"), ("-320.4", "R$ -320,40"), (None, "—"), ("", "—"), ("x1", "—")], numbers.money_text)
    check(
        spark,
        [("7.125", "7,125"), ("0.008", "0,008"), ("25000", "25.000"), ("3.400", "3,4"), ("-6.05", "-6,05"), (None, "—")],
        numbers.quantity_text,
    )
    check(spark, [("15", "15%"), ("15.000", "15%"), ("2.250", "2.25%"), ("30", "30%"), (None, "—")], numbers.percent_text)
    check(spark, [(987654, "987.654"), (-5, "-5"), (0, "0")], numbers.integer_text, "bigint")
    check(spark, [("2025-11-30T06:45:09", "30/11/2025 06:45:09"), ("2025-11-30T06:45", "30/11/2025 06:45"), (None, "—"), ("yesterday", "yesterday")], times.local_time_text)
    check(spark, [("2025-11-30", "30/11/2025"), (None, "—"), ("soon", "soon")], times.local_date_text)
    check(spark, [("2025-11-30T06:45", "30/11/2025 06:45"), (None, ""), ("soon", "soon")], times.time_input_text)


def test_plain_and_stripped(spark):
    rows = spark.sql("select 1 i, cast(7.250 as decimal(19,3)) a, cast(40 as decimal(19,0)) b, cast(2.30 as decimal(3,2)) c, cast(300 as decimal(19,6)) d")
    got = rows.select(*[numbers.stripped_text(F.col(c)) for c in "abcd"]).first()
    assert list(got) == ["7.25", "40", "2.3", "300"]
    assert rows.select(numbers.plain_text(F.col("d"))).first()[0] == "300.000000"


def test_sum_of_texts(spark):
    rows = spark.createDataFrame([("1.250",), ("0.305",), (None,), ("n/a",), (" 8",)], "x string")
    assert rows.agg(numbers.sum_of_texts(F.col("x"))).first()[0] == Decimal("1.555")
    assert rows.limit(0).agg(numbers.sum_of_texts(F.col("x"))).first()[0] == 0


def test_time_input(spark):
    cases = [
        ("30/11/2025 06:45", "2025-11-30T06:45"), ("30/11/2025 06:45:09", "2025-11-30T06:45:09"), ("5/3/2025 4:7:1", "2025-03-05T04:07:01"),
        ("2025-11-30T06:45", "2025-11-30T06:45"), ("", ""), ("\t", ""), ("30/11/2025", None), ("30/02/2025 06:45", None),
        ("29/02/2028 23:59", "2028-02-29T23:59"), ("29/02/2100 06:45", None), ("31/06/2025 06:45", None), ("30/11/2025 24:30", None),
        ("30/11/2025 06:61", None), ("30/11/2025 06:45:75", None), ("30/11/2025 06:45 h", None), ("2025-1-30T06:45", None),
    ]
    check(spark, cases, times.parse_time_input)
    check(
        spark, [("30/11/2025 06:45", "2025-11-30T06:45:59"), ("30/11/2025 06:45:09", "2025-11-30T06:45:09")],
        lambda c: times.parse_time_input(c, True),
    )
    check(spark, [("tomorrow", ""), (None, ""), ("30/11/2025 06:45", "2025-11-30T06:45")], times.normalize_time_filter)
    pairs = spark.createDataFrame(
        [("2025-05-10T08:00", "2025-05-10T07:59:59", True), ("2025-05-10T08:00", "2025-05-10T08:00:59", False), ("", "2025-05-10T08:00:59", False)],
        "a string, b string, w boolean",
    )
    assert all(r[0] == r[1] for r in pairs.select(times.range_inverted(F.col("a"), F.col("b")), "w").collect())


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo"])
def test_report_time_has_no_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        cases = [("30/11/2025 06:45:09", "2025-11-30T06:45:09"), ("04/11/2018 00:15:00", "2018-11-04T00:15:00"), ("30/02/2025 10:00:00", None), ("3/1/2025 06:45:09", None), ("30/11/2025 06:45:61", None)]
        split = lambda c: times.iso_text(times.parse_report_time(F.split(c, " ")[0], F.split(c, " ")[1]))
        check(spark, cases, split)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_open_bounds(spark):
    rows = spark.sql("select timestamp_ntz'0001-01-01 00:00:00' t union all select timestamp_ntz'9999-12-31 23:59:59' union all select null")
    assert rows.filter(times.in_bounds(F.col("t"), None, None)).count() == 2
    assert rows.filter(times.in_bounds(F.col("t"), dt.datetime(2020, 1, 1), None)).count() == 1


def test_filename_hints(spark):
    names = [
        "AUDITORIA 872, 05_03-18_04.QRP", "AUDITORIA.qrp", "AUDITORIA ANUAL.QRP", None, "###", "fechamento_18_04.QRP",
        "AUDITORIA 05/03-18/04.QRP", "fechamento 18/04.QRP", "dir/AUDITORIA 05/03-18/04.QRP", "dir\\fechamento_18_04.QRP",
        "/fechamento_18_04.QRP", "fechamento_18_04.QRP/", "y_00_04.QRP", "y_05_00.QRP", "y_40_04.QRP", "y_05_14.QRP", "AUDITORIA", ".QRP",
    ]
    got = values(spark, names, hints.filename_hints)
    empty = values(spark, names, lambda c: hints.hints_empty(hints.filename_hints(c)))
    shown = [
        (h.productCodeHint, h.periodHint and (h.periodHint.start.day, h.periodHint.start.month, h.periodHint.end.day, h.periodHint.end.month),
         h.singleDateHint and (h.singleDateHint.day, h.singleDateHint.month)) for h in got
    ]
    period, day = (5, 3, 18, 4), (18, 4)
    none = (None, None, None)
    assert shown == [
        ("872", period, None), none, none, none, none, (None, None, day), ("05", period, None), (None, None, day),
        ("05", period, None), (None, None, day), (None, None, day), none, none, none, none, none, none, none,
    ]
    assert empty == [s == none for s in shown]
    assert got[3].originalFilename == "" and got[0].provenance == "INFERRED_DATA"
    assert got[0].periodHint.start.year is None


def test_hints_document(spark):
    text = values(spark, ["z_18_04.QRP"], lambda c: hints.hints_json(hints.filename_hints(c)))[0]
    assert text == (
        '{"originalFilename":"z_18_04.QRP","provenance":"INFERRED_DATA","productCodeHint":null,"periodHint":null,'
        '"singleDateHint":{"day":18,"month":4,"year":null}}'
    )
    check(spark, [("plain", "plain"), (None, None), ('{"k": [2]}', '{"k":[2]}'), ("[3, 4]", "[3,4]")], hints.read_hints)
    assert values(spark, [text], hints.typed_hints)[0].singleDateHint.month == 4


def test_statuses_and_marks(spark):
    check(spark, [("Info", "VALID"), ("Warning", "WARNING"), ("Error", "INVALID"), ("Fatal", "INVALID"), ("99", "INVALID")], marks.validation_status)
    check(spark, [("VALID", "IMPORTED"), ("WARNING", "WARNING"), ("INVALID", "INVALID"), ("FAILED", "FAILED"), ("PENDING", "FAILED")], marks.file_status)
    message = "sourceValue=5 calculatedValue=4 difference=1 tolerance=0.02 ruleVersion=r7 note=2"
    check(spark, [(message, "r7"), ("plain words", None)], lambda c: marks.message_value(c, "ruleVersion"))
    check(spark, [(message, Decimal("0.020000"))], lambda c: marks.message_number(c, "tolerance"))
    check(spark, [("a" * 64, "aa/aa/" + "a" * 64), ("abc", None)], marks.storage_key)
    row = spark.sql("select cast(null as int) n, 1 p, 2 r, 3L b, 'y=9' d, cast(null as string) e")
    assert row.select(marks.locator_text(*[F.col(c) for c in "nnne"])).first()[0] == "SourceLocator[page=null, recordIndex=null, byteOffset=null, detail=null]"
    assert row.select(marks.locator_text(*[F.col(c) for c in "prbd"])).first()[0] == "SourceLocator[page=1, recordIndex=2, byteOffset=3, detail=y=9]"
    with pytest.raises(ValueError):
        marks.provenance("OTHER")


def test_average_rounds_half_away_from_zero(spark):
    cases = [("10.00", 4, "2.50"), ("0.25", 2, "0.13"), ("-0.25", 2, "-0.13"), ("1250.55", 36, "34.74"), ("100.00", 3, "33.33"), ("0.00", 5, "0.00"), ("5.00", 0, None)]
    rows = spark.createDataFrame([(i, Decimal(a), n) for i, (a, n, _) in enumerate(cases)], "i int, a decimal(38,2), n bigint")
    got = [r[0] for r in rows.orderBy("i").select(ratio_to_cents(F.col("a"), F.col("n")).cast("string")).collect()]
    assert got == [w for _, _, w in cases]


def test_paging(spark):
    assert page_number(None) == 0 and page_number(2) == 2 and page_size(None) == 20 and page_size(10) == 10
    for bad in (lambda: page_number(-1), lambda: page_size(0), lambda: page_size(101)):
        with pytest.raises(ValueError):
            bad()
    page = take_page(spark.range(45), [F.col("id")], 2, 20)
    assert [r[0] for r in page.content.collect()] == [40, 41, 42, 43, 44]
    assert tuple(page.info.first()) == (2, 20, 45, 3)
    assert tuple(take_page(spark.range(0), [F.col("id")], 0, 20).info.first()) == (0, 20, 0, 0)


def test_search_text():
    assert blank_to_none(None) is None and blank_to_none("  ") is None and blank_to_none(" x ") == "x"
    assert contains_pattern("a%b") == "%a%b%" and contains_pattern(r"a\b") == "%ab%" and contains_pattern(r"a\%") == r"%a\%%"
