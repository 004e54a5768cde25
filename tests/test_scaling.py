"""Work that has to be done once per row or once per query, read off the plans."""

import datetime as dt
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.reports import page_bytes, simple_report, text_record
from tillmark import report_bytes
from tillmark import testbed as tb
from tillmark.functions import hints
from tillmark.operators import layout
from tillmark.plans.ingestion import ingest_batch
from tillmark.registered import runners
from tillmark.sources import audits, readers
from tillmark.sources.store import ReportStore

SF_DIR = "/root/testdata/sf0.001"


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_hints_of_a_name_look_at_it_once(spark):
    names = spark.createDataFrame([("a/AUDITORIA 7, 01_02-03_04.QRP",)], "x string")
    plan = optimized(names.select(hints.hints_empty(hints.filename_hints(F.col("x"))).alias("empty")))
    assert plan.count(hints.BASENAME) == 1 and plan.count(hints.EXTENSION) == 1


def test_pairs_of_a_message_are_found_once(spark):
    assert optimized(runners()["sf9_message_values"](spark, SF_DIR)).count("regexp_extract_all") == 1


def test_writes_of_a_batch_rank_the_lines_once(spark, monkeypatch):
    plans, write = [], ReportStore.write

    def noting(self, table, rows, batch_seq):
        plans.append(optimized(rows))
        write(self, table, rows, batch_seq)

    monkeypatch.setattr(ReportStore, "write", noting)
    runners()["sk1_table_sink"](spark, SF_DIR)
    assert len(plans) == 4 and not any("row_number" in plan for plan in plans)


def test_runs_are_passed_once_for_declared_totals(spark):
    texts = ["TOTAL DE VENDAS:", "x", "total de vendas:", "a", "b", "c", "d", "7,5", "TOTAL DE VENDAS:", "9"]
    rows = [("r", n // 4, n % 4, text) for n, text in enumerate(texts)] + [("s", 0, n, t) for n, t in enumerate([texts[0], *"abcde", "8"])]
    runs = spark.createDataFrame(rows, "sha256 string, page_index int, seq int, text string").repartition(3)
    totals = layout.declared_totals(runs)
    assert [(r[0], float(r[1])) for r in totals.collect()] == [("r", 7.5)]
    assert "Join" not in optimized(totals)
    assert layout.declared_totals(layout.from_first_marker(runs)).collect() == totals.collect()


def test_unique_values_are_dealt_over_partitions_that_follow_the_rows(spark, monkeypatch):
    made, durable = [], audits.durable

    def noting(frame):
        made.append(optimized(frame))
        return durable(frame)

    monkeypatch.setattr(audits, "durable", noting)
    monkeypatch.setattr(audits, "ROWS_PER_TASK", 10)
    sales = spark.range(100).selectExpr("'POS' external_source", "cast(id % 99 as string) external_sale_id", "cast(id as string) id")
    broken = audits.constraint_audit({"sale": sales})
    assert [tuple(row) for row in broken.collect()] == [("uq_sale_external", "POS|0")]
    assert "RepartitionByExpression [space" in made[0] and ", 10" in made[0]


def test_bytes_of_reports_are_not_held_by_an_aggregate(spark):
    plan = tb.report_files(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan


def test_records_of_lines_are_those_of_single_runs():
    rng = random.Random(3)
    texts = [[rng.choice([None, "", "1,50", "Preço", "中x", "\U0001f600a", "Venda"]) for _ in range(40)] for _ in range(3)]
    x, y = np.arange(120).reshape(40, 3) * 7, np.arange(40) * 70_000
    sliced = [pa.array(["before", *column])[1:] for column in texts]
    body, begins = report_bytes.line_records(sliced, x, y)

    def record(n, cell):
        text = texts[cell][n]
        if text is None:
            return b""
        whole = bytearray(text_record(int(x[n, cell]), int(y[n]), text))[: 76 + len(text.encode("utf-16-le"))]
        struct.pack_into("<I", whole, 4, len(whole))
        return bytes(whole)

    lines = [b"".join(record(n, cell) for cell in range(3)) for n in range(40)]
    assert [body[a:b] for a, b in zip(begins, begins[1:], strict=False)] == lines


def test_runs_of_a_page_are_read_as_arrays():
    alphabet = ["a", ",", " ", "\0", "\u3000", "\x85", "é", "中", "\U0001f600", "\ud800", "\udc00"]
    for seed in range(60):
        rng = random.Random(seed)
        letters = alphabet[: 8 if seed % 2 else None]
        raw = [("".join(rng.choice(letters) for _ in range(rng.randint(0, 5)))) for _ in range(rng.randint(0, 8))]
        encoded = [text.encode("utf-16-le", "surrogatepass") for text in raw]
        page = page_bytes([(n, -n, "x" * (len(text) // 2)) for n, text in enumerate(encoded)])
        for at, text in zip(readers._record_starts(page, 0, len(page)), encoded, strict=True):
            page = page[: at + 76] + text + page[at + 76 + len(text) :]
        plain = [(n, -n, text.decode("utf-16-le", "replace").replace("\0", "").strip(readers.BLANKS)) for n, text in enumerate(encoded)]
        x, y, texts = readers._page_runs(page, 0, len(page))
        assert list(zip(x.tolist(), y.tolist(), texts.to_pylist(), strict=True)) == [run for run in plain if run[2]]


def test_runs_of_a_batch_lie_by_report_and_its_cuts_go(spark, tmp_path, monkeypatch):
    plans, read = [], layout.read_layout

    def noting(runs):
        plans.append(read(runs).movements._jdf.queryExecution().executedPlan().toString())
        raise InterruptedError

    monkeypatch.setattr(layout, "read_layout", noting)
    content = simple_report("41", "MOLHO", [("101", "1.5", "10.00")], "1,500")
    files = spark.createDataFrame([("/in/a.QRP", len(content), bytearray(content))], "path string, length bigint, content binary")
    store = ReportStore(spark, str(tmp_path / "store"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with pytest.raises(InterruptedError):
            ingest_batch(store, files, 0, dt.datetime(2026, 1, 1, tzinfo=dt.UTC))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plans[0] and "SortMergeJoin [sha256#" not in plans[0].split("SortAggregate")[-1]
    assert not [row for row in spark.sql("show tables like 'cut_ingest*'").collect()]
    assert list((tmp_path / "store" / "raw_content" / "batch_seq=0").glob("*.zstd.parquet"))
