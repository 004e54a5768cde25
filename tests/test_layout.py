"""Report bytes and layouts against a plain row-by-row model."""

import random
import re
from decimal import Decimal

import pytest

from tests.reports import HEADER_X, header_runs, page_bytes, report_bytes, sale_line
from tillmark import fixed
from tillmark import testbed as tb
from tillmark.operators import layout
from tillmark.sources.readers import page_ranges, read_reports, text_runs

RUN = "sha256 string, page_index int, seq int, x int, y int, text string"


def runs_frame(spark, reports):
    """reports: {key: [pages of (x, y, text)]}"""
    rows = [
        (key, p, seq, x, y, text)
        for key, pages in reports.items() for p, page in enumerate(pages) for seq, (x, y, text) in enumerate(page)
    ]
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), RUN).repartition(3)


def model_lines(pages):
    """What the lines of one report have to be, found by walking the runs in order."""
    walked = [(p, x, y, t) for p, page in enumerate(pages) for x, y, t in page]
    heads = {}
    for p, x, _, t in walked:
        if t in fixed.COLUMN_HEADERS:
            heads.setdefault(p, {})[t] = x
    lines = {}
    for run in walked:
        lines.setdefault((run[0], run[2]), []).append(run)
    found = []
    for (p, y), members in lines.items():
        first = next((i for i, m in enumerate(members) if re.match(r"^Venda Numero:\s*([0-9]+)$", m[3], re.I)), None)
        if first is None:
            continue
        cells = {}
        for i, (_, x, _, t) in enumerate(members):
            if i != first and heads.get(p):
                distance, _, name = min((abs(x - hx), fixed.COLUMN_HEADERS.index(h), h) for h, hx in heads[p].items())
                if distance < 75:
                    cells[name] = t
        number = re.match(r"^Venda Numero:\s*([0-9]+)$", members[first][3], re.I)[1]
        found.append((p, y, number, *[cells.get(h) for h in fixed.COLUMN_HEADERS], len(found)))
    return found


def random_report(rng):
    pages = []
    for _ in range(rng.randint(1, 3)):
        page = []
        for _ in range(rng.randint(0, 60)):
            text = rng.choice(
                [*fixed.COLUMN_HEADERS, "preço", "Venda Numero: 12", "venda numero:7", "VENDA NUMERO: 99", "Venda Numero: x1", "1,50", "2", "x", "07/08/2026"]
            )
            page.append((rng.choice([0, 10, 40, 74, 75, 76, 100, 150, 149, 151, 225]), rng.randint(0, 6), text))
        pages.append(page)
    return pages


def test_lines_match_the_model(spark):
    rng = random.Random(42)
    reports = {f"r{i}": random_report(rng) for i in range(40)}
    got = layout.sale_lines(runs_frame(spark, reports)).select(
        "sha256", "page_index", "y", "external_sale_id", *layout.CELL_NAMES, "source_record_index"
    ).collect()
    want = {(key, *line) for key, pages in reports.items() for line in model_lines(pages)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_declared_total_looks_five_runs_ahead_and_over_pages(spark):
    marker = (0, 0, "Total de Vendas:")
    junk = [(0, 0, t) for t in "abcdef"]
    reports = {
        "near": [[marker, *junk[:4], (0, 0, "4,5")]],
        "far": [[marker, *junk[:5], (0, 0, "4,5")]],
        "second": [[marker, *junk[:5], (0, 0, "9"), (0, 0, "TOTAL DE VENDAS:"), (0, 0, "x"), (0, 0, "7")]],
        "next page": [[(0, 0, "1"), marker], [(0, 0, "a"), (0, 0, "8")]],
        "none": [[(0, 0, "5")]],
    }
    got = {r[0]: r[1] for r in layout.declared_totals(runs_frame(spark, reports)).collect()}
    assert got == {"near": Decimal("4.5"), "second": Decimal("7"), "next page": Decimal("8")}


def test_report_fields_take_the_first_match(spark):
    reports = {
        "a": [[(0, 0, "Produto: x"), (0, 0, "produto: 41 - MOLHO "), (0, 0, "Produto: 42 - OTHER"), (0, 0, "FABRICANTE: CASA ")]],
        "b": [[(0, 0, "nothing")]],
        "c": [[(0, 0, "Fabricante:")]],
    }
    got = {r.sha256: (r.external_product_id, r.product_name, r.manufacturer) for r in layout.report_fields(runs_frame(spark, reports)).collect()}
    assert got == {"a": ("41", "MOLHO", "CASA"), "c": (None, None, "")}


def test_header_snapshot(spark):
    reports = {"a": [[(0, 0, "Data/Hora: 07/08/2026  12:22:13"), (0, 0, "Estoque Atual: 1.234,5")]], "b": [[(0, 0, "Data/Hora: soon")]]}
    got = {r[0]: (r.export_date, r.export_time, r.current_stock) for r in layout.header_snapshot(runs_frame(spark, reports)).collect()}
    assert got == {"a": ("07/08/2026", "12:22:13", Decimal("1234.5")), "b": ("", "", None)}


def test_bytes_to_movements(spark):
    cells = {"Preço": "R$ 56,90", "Desconto": "8", "Total Item": "21,78", "Data": "19/07/2026", "Hora": "13:07:03", "Saidas": "0,416", "Anterior": "10", "Posterior": "9,584"}
    page = [(0, 0, "Produto: 41 - MOLHO POMODORO"), (0, 1, "Fabricante: CASA"), *header_runs(), *sale_line(100, "134409", cells, 74), *sale_line(110, "9", cells, 75)]
    content = report_bytes([page, [*header_runs(), *sale_line(100, "134410", {"Entradas": "2", "Data": "31/02/2026", "Hora": "10:00:00"})]])
    files = spark.createDataFrame(
        [("k", bytearray(content), "QRP", "a.QRP"), ("g", bytearray(b"garbage"), "QRP", "g.QRP"), ("skip", bytearray(content), "PDF", "a.pdf")],
        "sha256 string, content binary, detected_type string, original_filename string",
    )
    rows = read_reports(files)
    assert {r[0] for r in rows.select("sha256").collect()} == {"k"}
    moved = {r.source_record_index: r for r in layout.stored_movements(layout.read_layout(rows.filter("kind = 'run'").drop("kind", "start", "length")).movements).collect()}
    first = moved[0]
    assert (first.direction, first.external_sale_id, str(first.occurred_at), first.quantity, first.unit_price, first.discount_percentage, first.total) == (
        "OUT", "134409", "2026-07-19 13:07:03", Decimal("0.416"), Decimal("56.90"), Decimal("8"), Decimal("21.78"))
    assert (first.product_name, first.manufacturer, first.source_locator) == ("MOLHO POMODORO", "CASA", "SourceLocator[page=1, recordIndex=0, byteOffset=null, detail=y=100]")
    assert (moved[1].direction, moved[1].quantity, moved[1].total) == ("UNKNOWN", None, None)
    assert (moved[2].direction, moved[2].quantity, moved[2].occurred_at, moved[2].invalid_time) == ("IN", Decimal("2"), None, "31/02/2026 10:00:00")


def test_page_ranges():
    one, two = page_bytes([(1, 2, "a")]), page_bytes([(1, 2, "b")])
    data = b"xx" + one + b"y" + two
    assert page_ranges(data) == [(2, len(one)), (3 + len(one), len(two))]
    assert len(page_ranges(one * 600)) == 600
    assert page_ranges(b"") == [] and page_ranges(one[:90]) == [] and page_ranges(b" EMF" * 30) == []
    inner = one[:108] + two + one[108:]
    assert len(page_ranges(inner)) == 1


@pytest.mark.parametrize("cut", range(0, 400, 23))
def test_damaged_bytes_never_fail(cut):
    rng = random.Random(cut)
    data = report_bytes([[(1, 2, "text"), (3, 4, "more")]])
    for sample in (data[:cut], bytes(rng.randrange(256) for _ in range(cut)), data[:200] + bytes(rng.randrange(256) for _ in range(cut)) + data[200:]):
        for start, length in page_ranges(sample):
            list(text_runs(sample, start, length))


def test_run_text_rules():
    page = page_bytes([(-5, 7, "\x00 a b　\x00"), (1, 1, "  "), (1, 2, "x" * 10_000), (1, 3, "y" * 10_001)])
    assert [(x, y, t[:5]) for x, y, t in text_runs(page, 0, len(page))] == [(-5, 7, "a b"), (1, 2, "xxxxx"), (1, 3, "yyyyy")]
    assert HEADER_X["Preço"] == 1000


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_lines_of_undivided_reports_are_not_moved_again(spark):
    runs = tb.text_runs(spark, "/root/testdata/sf0.001")
    once = plan_of(runs).count("Exchange hashpartitioning(report")
    lines = plan_of(layout.sale_lines(runs))
    assert once == 1 and "hashpartitioning(sha256" not in lines and "page_index" not in "".join(
        line for line in lines.splitlines() if "Exchange hashpartitioning" in line
    )


def test_report_bytes_are_made_after_the_last_shuffle(spark):
    plan = plan_of(tb.report_files(spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange hashpartitioning(report") == 1 and "hashpartitioning(report#" in plan
    assert plan.index("unhex") < plan.index("Exchange hashpartitioning(report") and "hex(encode" not in plan[plan.index("Exchange hashpartitioning(report"):]


def test_stored_runs_are_not_moved_by_their_layout(spark, monkeypatch):
    from tillmark.registered import reports

    monkeypatch.setattr(reports, "_read_back", lambda spark, sf_dir: read_reports(spark.createDataFrame(
        [(key, report_bytes([[(100, 100, "Venda Numero: 1")]]), "QRP", f"{key}.QRP") for key in "abc"],
        "sha256 string, content binary, detected_type string, original_filename string",
    )))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(reports.layout_movements(spark, ""))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan


def test_headers_are_met_without_sorting_runs(spark):
    lines = plan_of(layout.sale_lines(tb.text_runs(spark, "/root/testdata/sf0.001"), gathered=True))
    assert "ShuffledHashJoin [sha256" in lines and "collect_list(CASE" not in lines
