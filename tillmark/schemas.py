"""Explicit table schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

QUANTITY = T.DecimalType(19, 6)
MONEY = T.DecimalType(19, 2)
STRING = T.StringType()
LONG = T.LongType()
INT = T.IntegerType()
NTZ = T.TimestampNTZType()
AUDIT_TIME = T.TimestampType()
BOOL = T.BooleanType()

LOCATOR = "struct<page:int,record_index:int,byte_offset:bigint,detail:string>"


def _table(*columns: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(c[0], c[1], c[2] if len(c) > 2 else True) for c in columns])


TEXT_RUN = _table(
    ("sha256", STRING), ("page_index", INT), ("seq", INT), ("x", INT), ("y", INT), ("text", STRING),
)

# What a report reader emits: text runs, one row per page, or one error row.
READER_OUTPUT = _table(
    ("sha256", STRING), ("kind", STRING), ("page_index", INT), ("seq", INT), ("x", INT), ("y", INT),
    ("text", STRING), ("start", INT), ("length", INT),
)

MOVEMENT_COLUMNS = (
    ("source_record_index", INT), ("direction", STRING), ("external_product_id", STRING),
    ("product_name", STRING), ("external_sale_id", STRING), ("occurred_at", NTZ),
    ("quantity", QUANTITY), ("unit_price", MONEY), ("discount_percentage", QUANTITY),
    ("total", MONEY), ("previous_stock", QUANTITY), ("resulting_stock", QUANTITY),
    ("manufacturer", STRING), ("source_locator", STRING),
)

TABLES: dict[str, T.StructType] = {
    "raw_content": _table(("sha256", STRING), ("storage_key", STRING), ("content", T.BinaryType())),
    "raw_artifact": _table(
        ("id", STRING), ("sha256", STRING), ("byte_size", LONG), ("storage_key", STRING),
        ("detected_type", STRING), ("created_at", AUDIT_TIME),
    ),
    "import_job": _table(
        ("id", STRING), ("status", STRING), ("created_at", AUDIT_TIME), ("completed_at", AUDIT_TIME),
    ),
    "parse_attempt": _table(
        ("id", STRING), ("raw_artifact_id", STRING), ("parser_name", STRING), ("parser_version", STRING),
        ("status", STRING), ("records_found", INT), ("attempt_count", INT), ("started_at", AUDIT_TIME),
        ("completed_at", AUDIT_TIME), ("error_summary", STRING),
    ),
    "import_file": _table(
        ("id", STRING), ("import_job_id", STRING), ("raw_artifact_id", STRING), ("parse_attempt_id", STRING),
        ("original_filename", STRING), ("source", STRING), ("filename_hints", STRING), ("status", STRING),
        ("deduplicated", BOOL), ("duplicate_of_import_file_id", STRING), ("created_at", AUDIT_TIME),
        ("completed_at", AUDIT_TIME),
    ),
    "rejected_file": _table(
        ("original_filename", STRING), ("byte_size", LONG), ("reject_reason", STRING),
    ),
    "artifact_publication": _table(
        ("raw_artifact_id", STRING), ("active_parse_attempt_id", STRING), ("published_at", AUDIT_TIME),
    ),
    "validation_result": _table(
        ("id", STRING), ("parse_attempt_id", STRING), ("code", STRING), ("status", STRING),
        ("source_value", QUANTITY), ("calculated_value", QUANTITY), ("difference", QUANTITY),
        ("tolerance", QUANTITY), ("rule_version", STRING), ("source_locator", STRING),
    ),
    "parsed_movement": _table(("id", STRING), ("parse_attempt_id", STRING), *MOVEMENT_COLUMNS),
    "product": _table(
        ("id", STRING), ("external_source", STRING), ("external_id", STRING), ("name", STRING),
        ("unit", STRING), ("first_seen_parse_attempt_id", STRING), ("created_at", AUDIT_TIME),
        ("updated_at", AUDIT_TIME),
    ),
    "sale": _table(
        ("id", STRING), ("external_source", STRING), ("external_sale_id", STRING), ("occurred_at", NTZ),
        ("first_seen_parse_attempt_id", STRING), ("created_at", AUDIT_TIME),
    ),
    "sale_item": _table(
        ("id", STRING), ("sale_id", STRING), ("product_id", STRING), ("parse_attempt_id", STRING),
        ("source_record_index", INT), ("quantity", QUANTITY), ("unit_price", MONEY),
        ("discount_percentage", QUANTITY), ("total", MONEY), ("previous_stock", QUANTITY),
        ("resulting_stock", QUANTITY),
    ),
    # What became of every file of an upload, and of every file that was to be read again.
    "import_result": _table(
        ("import_file_id", STRING), ("import_job_id", STRING), ("raw_artifact_id", STRING), ("sha256", STRING),
        ("original_filename", STRING), ("previous_attempt_id", STRING), ("parse_attempt_id", STRING),
        ("deduplicated", BOOL), ("published", BOOL), ("job_status", STRING), ("file_status", STRING),
        ("parse_status", STRING), ("records_found", INT), ("parsed_quantity_total", T.DecimalType(29, 6)),
        ("parsed_revenue_total", T.DecimalType(29, 6)), ("refused", STRING),
    ),
    # Counters of an upload; their sums over batches are the running totals.
    "import_counter": _table(
        ("completed", LONG), ("duplicates", LONG), ("warnings", LONG), ("failures", LONG), ("duration_ms", LONG),
        ("raw_storage_bytes", LONG),
    ),
    # Ledgers kept up to date by every batch (operators/maintained.py).
    "held_sale": _table(("external_sale_id", STRING), ("raw_artifact_id", STRING), ("held", BOOL)),
    "sold_part": _table(
        ("parse_attempt_id", STRING), ("sale_id", STRING), ("product_id", STRING), ("occurred_at", NTZ),
        ("quantity", T.DecimalType(38, 6)), ("revenue", T.DecimalType(38, 2)), ("items", LONG),
    ),
}
