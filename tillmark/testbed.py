"""The given star-schema tables seen as report data: movements, sales, products, files, text runs, report bytes.

Attempts and artifacts are suppliers, sales are orders, products are parts, import files are documents.
Nothing is sampled: every view covers its whole source table.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillmark.fixed import COLUMN_HEADERS, DEFAULT_PROFILE
from tillmark.operators.joins import lookup_join, rank_in_slices
from tillmark.report_bytes import FILE_SCHEMA, files_of_lines

SOURCE = DEFAULT_PROFILE.source
ORDERS_PER_SLICE = 65_536
LINES_PER_REPORT = 4_000
LINES_PER_PAGE = 400
RUNS_PER_LINE = 10
FIRST_LINE_SEQ = 13
HEADER_GAP = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _timed_lines(spark: SparkSession, sf_dir: str, indexed: bool) -> DataFrame:
    """lineitem with the time of its order and, if asked, the record index inside its supplier."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    if indexed:
        order = [
            "o_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_shipdate", "l_returnflag", "l_linestatus",
        ]
        lines = rank_in_slices(
            lines, ["l_suppkey"], F.expr(f"o_orderkey div {ORDERS_PER_SLICE}"), [F.col(c) for c in order],
            "source_record_index",
        )
    return lookup_join(lines, table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderkey"])


def _movement_columns() -> list[str]:
    cents = "cast(cast(l_extendedprice as decimal(15,2)) * 100 as bigint)"
    units = "cast(l_quantity as bigint)"
    return [
        "cast(l_suppkey as string) as parse_attempt_id",
        "case when l_returnflag = 'R' then 'IN' when l_returnflag = 'A' and l_linestatus = 'F' then 'UNKNOWN'"
        " else 'OUT' end as direction",
        "cast(l_partkey as string) as external_product_id",
        "cast(o_orderkey as string) as external_sale_id",
        "o_orderdate as occurred_at",
        f"cast({units} as decimal(19,6)) as quantity",
        f"cast(cast(cast((2 * {cents} + {units}) div (2 * {units}) as decimal(15,0)) * cast(0.01 as decimal(3,2))"
        " as decimal(15,2)) as decimal(19,2)) as unit_price",
        "cast(cast(l_discount as decimal(4,2)) * 100 as decimal(19,6)) as discount_percentage",
        "cast(round(cast(l_extendedprice as decimal(15,2)) * (cast(1 as decimal(4,2)) - cast(l_discount as decimal(4,2))), 2)"
        " as decimal(19,2)) as total",
        "cast(1000 - 10 * l_linenumber as decimal(19,6)) as previous_stock",
        f"cast(1000 - 10 * l_linenumber - {units} - case when l_linenumber = 7 then 1 else 0 end as decimal(19,6))"
        " as resulting_stock",
        "l_linenumber as line_number",
        "o_orderkey as sale_key",
        "l_partkey as product_key",
        "l_suppkey as attempt_key",
    ]


def movements(spark: SparkSession, sf_dir: str, indexed: bool = False) -> DataFrame:
    """lineitem as parsed movements of one attempt per supplier; the record index costs a ranking."""
    return _timed_lines(spark, sf_dir, indexed).selectExpr(
        *_movement_columns(), *(["source_record_index"] if indexed else [])
    )


def movements_with_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements as the validation rules take them."""
    return movements(spark, sf_dir, indexed=True).withColumns(
        {
            "locator": F.struct(
                F.lit(1).alias("page"),
                F.col("source_record_index").alias("record_index"),
                F.lit(None).cast("long").alias("byte_offset"),
                F.concat(F.lit("y="), F.col("line_number").cast("string")).alias("detail"),
            ),
            "invalid_time": F.when(F.col("line_number") == 5, F.concat_ws(" ", F.lit("31/02/2026"), "external_sale_id")),
        }
    )


def sale_items(spark: SparkSession, sf_dir: str, indexed: bool = False) -> DataFrame:
    """OUT movements as fact rows."""
    out = movements(spark, sf_dir, indexed).filter(F.col("direction") == "OUT")
    renamed = out.withColumnsRenamed({"external_sale_id": "sale_id", "external_product_id": "product_id"}).drop(
        "occurred_at"
    )
    if indexed:
        renamed = renamed.withColumn("id", F.concat_ws("#", "parse_attempt_id", F.col("source_record_index").cast("string")))
    return renamed


def publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in credit are published."""
    return table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") >= 0).select(
        F.concat(F.lit("raw-"), F.col("s_suppkey").cast("string")).alias("raw_artifact_id"),
        F.col("s_suppkey").cast("string").alias("active_parse_attempt_id"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("published_at"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.lit(SOURCE).alias("external_source"),
        F.col("o_orderkey").cast("string").alias("external_sale_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("occurred_at"),
        F.lit("0").alias("first_seen_parse_attempt_id"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.lit(SOURCE).alias("external_source"),
        F.col("p_partkey").cast("string").alias("external_id"),
        F.col("p_name").alias("name"),
        F.lit(None).cast("string").alias("unit"),
        F.lit("0").alias("first_seen_parse_attempt_id"),
    )


def read_tables(spark: SparkSession, sf_dir: str, indexed: bool = False) -> dict[str, DataFrame]:
    """What the dashboard, sales and product queries read."""
    return {
        "sale_item": sale_items(spark, sf_dir, indexed),
        "sale": sales(spark, sf_dir),
        "product": products(spark, sf_dir),
        "artifact_publication": publication(spark, sf_dir),
    }


# --- import bookkeeping ------------------------------------------------------------------------


def import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploaded files: content is the text, the job is the source, the time follows the id."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.octet_length("text").cast("long").alias("byte_size"),
        F.col("source").alias("import_job_id"),
        file_time(F.col("doc_id")).alias("created_at"),
        F.expr("concat('doc-', doc_id, case lang when 'en' then '.QRP' when 'fr' then '.qrp' when 'de' then '.pdf' else '.Qrp' end)").alias("path"),
        "lang",
    )


def file_time(doc_id: Column) -> Column:
    return F.timestamp_seconds(F.lit(1_767_225_600) + doc_id)


def settled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import files with a status by language, one attempt per content, and labels as duplicates' marks."""
    status = F.expr("case lang when 'en' then 'IMPORTED' when 'fr' then 'WARNING' when 'de' then 'INVALID' else 'FAILED' end")
    return import_files(spark, sf_dir).select(
        F.col("file_id").alias("id"),
        "import_job_id",
        F.col("sha256").alias("raw_artifact_id"),
        F.concat(F.lit("a-"), "sha256").alias("parse_attempt_id"),
        F.col("path").alias("original_filename"),
        status.alias("status"),
        "byte_size",
        "created_at",
        file_time(F.col("file_id") + F.col("byte_size") % 7).alias("completed_at"),
        "lang",
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as parse attempts: the artifact is the customer, the count is the order's rank by key."""
    status = "case o_orderstatus when 'F' then 'FAILED' when 'O' then 'VALID' else 'WARNING' end"
    return table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as id",
        "concat('raw-', o_custkey) as raw_artifact_id",
        f"'{DEFAULT_PROFILE.parser_name}' as parser_name",
        f"case when o_orderpriority like '5%' then 'older' else '{DEFAULT_PROFILE.parser_version}' end as parser_version",
        f"{status} as status",
        "cast(o_orderkey + 1 as int) as attempt_count",
    )


# --- import history ---------------------------------------------------------------------------------


def history_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Jobs are document sources, files are documents, attempts are suppliers, rows are lineitem."""
    files = import_files(spark, sf_dir)
    status = F.expr("case lang when 'en' then 'IMPORTED' when 'fr' then 'WARNING' when 'de' then 'INVALID' else 'FAILED' end")
    import_file = files.select(
        F.concat(F.lit("f-"), F.col("file_id").cast("string")).alias("id"),
        "import_job_id",
        F.col("sha256").alias("raw_artifact_id"),
        F.when(F.col("lang") != "es", (F.col("file_id") % 97).cast("string")).alias("parse_attempt_id"),
        F.col("path").alias("original_filename"),
        F.lit(SOURCE).alias("source"),
        F.when(F.col("lang") == "en", F.concat(F.lit('{"n": '), F.col("file_id").cast("string"), F.lit("}")))
        .when(F.col("lang") == "fr", F.col("path")).alias("filename_hints"),
        status.alias("status"),
        (F.col("lang") == "fr").alias("deduplicated"),
        F.lit(None).cast("string").alias("duplicate_of_import_file_id"),
        "created_at",
        F.col("created_at").alias("completed_at"),
    )
    import_job = files.groupBy(F.col("import_job_id").alias("id")).agg(
        F.lit("SUCCEEDED").alias("status"), F.min("created_at").alias("created_at"), F.max("created_at").alias("completed_at")
    )
    supplier = table(spark, sf_dir, "supplier")
    attempt = supplier.selectExpr(
        "cast(s_suppkey as string) as id", "concat('raw-', s_suppkey) as raw_artifact_id",
        f"'{DEFAULT_PROFILE.parser_name}' as parser_name", f"'{DEFAULT_PROFILE.parser_version}' as parser_version",
        "case when s_nationkey < 12 then 'VALID' else 'WARNING' end as status", "s_nationkey as records_found",
        "1 as attempt_count",
    )
    number = "cast({} as decimal(19,6))"
    quantity_rows = supplier.selectExpr(
        "cast(s_suppkey as string) as parse_attempt_id",
        "case when s_nationkey < 12 then 'SOURCE_QUANTITY_MATCH' else 'SOURCE_QUANTITY_MISMATCH' end as code",
        "case when s_nationkey < 12 then 'VALID' else 'INVALID' end as status",
        f"{number.format('s_suppkey')} as source_value", f"{number.format('s_suppkey + s_nationkey')} as calculated_value",
        f"{number.format('s_nationkey')} as difference", f"{number.format('0.001')} as tolerance",
        "'rule' as rule_version", "'report' as source_locator",
    )
    rows = movements(spark, sf_dir, indexed=True)
    line_rows = rows.selectExpr(
        "parse_attempt_id", "'LINE_TOTAL_MATCH' as code", "'VALID' as status", f"{number.format('total')} as source_value",
        f"{number.format('total')} as calculated_value", f"{number.format('0')} as difference",
        f"{number.format('0.01')} as tolerance", "'rule' as rule_version",
        "concat('line ', source_record_index) as source_locator",
    )
    named = rows.withColumn(
        "product_name", F.when(F.col("line_number") > 2, F.concat(F.lit("P"), F.col("external_product_id")))
    )
    artifact = files.groupBy("sha256").agg(F.min("byte_size").alias("byte_size")).withColumn("id", F.col("sha256"))
    return {
        "import_job": import_job, "import_file": import_file, "parse_attempt": attempt,
        "validation_result": quantity_rows.unionByName(line_rows), "parsed_movement": named, "raw_artifact": artifact,
    }


# --- reports --------------------------------------------------------------------------------------


def _brazilian(value: Column, digits: int) -> Column:
    """A decimal without more than ``digits`` decimals; what needs no dots between thousands is spelled directly."""
    plain = F.replace(value.cast(f"decimal(19,{digits})").cast("string"), F.lit("."), F.lit(","))
    grouped = F.translate(F.format_number(value, digits), ",.", ".,")
    return F.when((value >= 0) & (value < 1000), plain).otherwise(grouped)


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements laid out on report pages: every supplier fills reports of a bounded number of lines.

    The lines of a report lie in one partition, in their order. The given columns are shuffled and sorted; what is made of
    them is made afterwards.
    """
    number = f"cast(source_record_index div {LINES_PER_REPORT} as string)"
    timed = _timed_lines(spark, sf_dir, indexed=True)
    named = timed.withColumn("report", F.expr(f"concat_ws('-', 'r', cast(l_suppkey as string), {number})"))
    placed = named.repartition("report").sortWithinPartitions("report", "source_record_index")
    rows = placed.selectExpr("report", *_movement_columns(), "source_record_index")
    return rows.withColumns(
        {
            "page_index": F.expr(f"(source_record_index % {LINES_PER_REPORT}) div {LINES_PER_PAGE}").cast("int"),
            "line": (F.col("source_record_index") % LINES_PER_PAGE).cast("int"),
            "shift": ((F.col("line_number") - 1) * 15).cast("int"),
        }
    )


def _cells() -> list[tuple[int, Column]]:
    """(header number, text) of a line; the first is the sale marker, which has no header."""
    has_exit, has_entry = F.col("direction") != "IN", F.col("direction") != "OUT"
    quantity = _brazilian(F.col("quantity"), 3)
    day = F.when(F.col("line_number") == 5, F.lit("31/02/2026")).otherwise(
        F.date_format(F.col("occurred_at"), "dd/MM/yyyy")
    )
    return [
        (-1, F.concat(F.lit("Venda Numero: "), F.col("external_sale_id"))),
        (0, F.concat(F.lit("R$ "), _brazilian(F.col("unit_price"), 2))),
        (1, _brazilian(F.col("discount_percentage"), 2)),
        (2, _brazilian(F.col("total"), 2)),
        (3, day),
        (4, F.concat(F.lit("10:0"), F.col("line_number").cast("string"), F.lit(":00"))),
        (5, F.when(has_exit, quantity)),
        (6, F.when(has_entry, quantity)),
        (7, _brazilian(F.col("previous_stock"), 0)),
        (8, _brazilian(F.col("resulting_stock"), 0)),
    ]


def _line_y(line: Column) -> Column:
    return F.lit(100) + line * 20


def _cell_x(header: int) -> tuple[int, int]:
    """x of a cell, and how many times the shift of its line is added."""
    return (100, 0) if header < 0 else (1000 + HEADER_GAP * header, 1)


def _line_runs(texts: list[tuple[int, Column]], line: Column, shift: Column) -> list[Column]:
    """The runs of a line in record order, with null texts for the cells it lacks."""
    y = _line_y(line)
    first = F.lit(FIRST_LINE_SEQ) + line * RUNS_PER_LINE
    return [_run(first + 1 + h, F.lit(x) + shift * shifts, y, text) for h, text in texts for x, shifts in [_cell_x(h)]]


def _title_runs() -> list[Column]:
    """Product, manufacturer, time and stock, at the top of a report's first page."""
    key = F.col("attempt_key").cast("string")
    texts = (
        F.concat(F.lit("Produto: "), key, F.lit(" - PRODUTO "), key),
        F.lit("Fabricante: CASA"),
        F.lit("Data/Hora: 07/08/2026 12:22:13"),
        F.concat(F.lit("Estoque Atual: "), key, F.lit(",50")),
    )
    return [_run(F.lit(i), F.lit(10), F.lit(10 + i), text) for i, text in enumerate(texts)]


def _head_runs() -> list[Column]:
    """The column headers of a page."""
    return [_run(F.lit(4 + i), F.lit(1000 + HEADER_GAP * i), F.lit(50), F.lit(name)) for i, name in enumerate(COLUMN_HEADERS)]


def _counted_quantity() -> Column:
    """What a line adds to the declared total of its report."""
    return F.when((F.col("direction") != "IN") & (F.col("line_number") <= 5), F.col("quantity"))


def _total_runs() -> list[Column]:
    """The declared total, at the end of a report's first page; ``declared`` is the sum over the report's lines."""
    amount = F.coalesce(F.col("declared"), F.lit(0)) + F.col("attempt_key") % 3
    tail = FIRST_LINE_SEQ + LINES_PER_PAGE * RUNS_PER_LINE
    texts = (F.lit("TOTAL DE VENDAS:"), F.lit("unidades"), _brazilian(amount, 3))
    return [_run(F.lit(tail + i), F.lit(10 + 10 * i), F.lit(90_000), text) for i, text in enumerate(texts)]


def _run(seq: Column, x: Column, y: Column, text: Column) -> Column:
    return F.struct(seq.cast("int").alias("seq"), x.cast("int").alias("x"), y.cast("int").alias("y"), text.alias("text"))


def text_runs(spark: SparkSession, sf_dir: str, key: str = "sha256") -> DataFrame:
    """All text runs of all reports, each line as a marker and up to nine cells; the runs of a report lie in one partition.

    The first line of a page brings the page's headers along, the first line of a report its title and total as well.
    """
    whole = Window.partitionBy("report")
    lines = report_lines(spark, sf_dir).withColumn("declared", F.sum(_counted_quantity()).over(whole))
    # Texts are columns of their own first, so each is made once.
    cells = _cells()
    lines = lines.withColumns({f"_text{h}": text for h, text in cells})
    texts = [(h, F.col(f"_text{h}")) for h, _ in cells]
    none = F.array().cast("array<struct<seq:int,x:int,y:int,text:string>>")
    opens_report = (F.col("line") == 0) & (F.col("page_index") == 0)
    runs = F.concat(
        F.array(*_line_runs(texts, F.col("line"), F.col("shift"))),
        F.when(F.col("line") == 0, F.array(*_head_runs())).otherwise(none),
        F.when(opens_report, F.array(*_title_runs(), *_total_runs())).otherwise(none),
    )
    exploded = lines.select(F.col("report").alias(key), "page_index", F.explode(runs).alias("run"))
    return exploded.filter(F.col("run.text").isNotNull()).select(key, "page_index", "run.*")


def _little_endian(value: Column) -> Column:
    """Hexadecimal text of four bytes, the lowest first."""
    byte = lambda n: F.shiftright(value.cast("long"), 8 * n).bitwiseAND(F.lit(255))
    turned = byte(0) * (1 << 24) + byte(1) * (1 << 16) + byte(2) * (1 << 8) + byte(3)
    return F.lpad(F.hex(turned), 8, "0")


def _zeros(n: int) -> str:
    return "00" * n


def _number(n: int) -> str:
    return n.to_bytes(4, "little").hex().upper()


def _records(runs: list[Column]) -> Column:
    """Hexadecimal text of the records of runs, in their order; runs without text have none."""
    present = F.filter(F.array(*runs), lambda r: r["text"].isNotNull())
    spelled = F.transform(
        present, lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), F.hex(F.encode(r["text"], "UTF-16LE")).alias("text"))
    )

    def record(run: Column) -> Column:
        digits = F.length(run["text"])
        return F.concat(
            F.lit(_number(84)), _little_endian(F.lit(76) + F.shiftright(digits, 1)), F.lit(_zeros(28)), _little_endian(run["x"]),
            _little_endian(run["y"]), _little_endian(F.shiftright(digits, 2)), F.lit(_number(76) + _zeros(24)), run["text"],
        )

    return F.array_join(F.transform(spelled, record), "")


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reports as files (path, length, content).

    Lines are dealt by report as the few columns they are made of and put in order; bytes exist in the task that hands the
    report on, those of one report at a time.
    """
    lines = report_lines(spark, sf_dir).withColumn("declared", F.sum(_counted_quantity()).over(Window.partitionBy("report")))
    opens_page = F.col("line") == 0
    opens_report = opens_page & (F.col("page_index") == 0)
    titles, heads, totals = (_records(runs) for runs in (_title_runs(), _head_runs(), _total_runs()))
    before = F.when(opens_report, F.concat(titles, heads)).when(opens_page, heads)
    cells = _cells()
    ordered = lines.sortWithinPartitions("report", "source_record_index").select(
        "report", "page_index", _line_y(F.col("line")).alias("y"), "shift", F.unhex(before).alias("before"),
        F.unhex(F.when(opens_report, totals)).alias("after"), *[text.alias(f"text{h}") for h, text in cells],
    )
    return ordered.mapInArrow(partial(files_of_lines, [_cell_x(h) for h, _ in cells]), FILE_SCHEMA)
