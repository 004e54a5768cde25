"""Keys, statuses, locators and other small marks put on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillmark.fixed import ERROR_SUMMARY_CHARS, PROVENANCE, REPORT_EXTENSION, REPORT_TYPE
from tillmark.schemas import QUANTITY


def stable_id(*parts: Column) -> Column:
    """128-bit hexadecimal id of a natural key, the same on every run."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *[p.cast("string") for p in parts]), 256), 1, 32)


def fingerprint(content: Column) -> Column:
    """SC4: lower-case hexadecimal SHA-256 of the bytes."""
    return F.sha2(content, 256)


def storage_key(sha: Column) -> Column:
    """SF13: ``ab/cd/<sha>``; null unless the hash has its 64 characters."""
    return F.when(F.length(sha) == 64, F.concat_ws("/", F.substring(sha, 1, 2), F.substring(sha, 3, 2), sha))


def is_report(detected_type: Column, filename: Column) -> Column:
    """SC7: detected as a report, or named like one."""
    by_type = F.coalesce(F.upper(detected_type) == REPORT_TYPE, F.lit(False))
    return by_type | F.coalesce(F.endswith(F.lower(filename), F.lit(REPORT_EXTENSION)), F.lit(False))


def direction(exits: Column, entries: Column) -> Column:
    """SF3: any exit is OUT, only an entry is IN, neither is UNKNOWN."""
    return F.when(exits.isNotNull(), "OUT").when(entries.isNotNull(), "IN").otherwise("UNKNOWN")


def moved_quantity(exits: Column, entries: Column) -> Column:
    """SF4: the quantity that goes with the direction."""
    return F.coalesce(exits, entries)


def locator_text(page: Column, record_index: Column, byte_offset: Column, detail: Column) -> Column:
    """SF14: missing parts are spelled ``null``."""
    shown = [F.coalesce(c.cast("string"), F.lit("null")) for c in (page, record_index, byte_offset, detail)]
    return F.format_string("SourceLocator[page=%s, recordIndex=%s, byteOffset=%s, detail=%s]", *shown)


def validation_status(severity: Column) -> Column:
    """SF7."""
    return F.when(F.upper(severity) == "INFO", "VALID").when(F.upper(severity) == "WARNING", "WARNING").otherwise(
        "INVALID"
    )


def file_status(parse_status: Column) -> Column:
    """SF8."""
    return (
        F.when(parse_status == "VALID", "IMPORTED")
        .when(parse_status.isin("WARNING", "INVALID"), parse_status)
        .otherwise("FAILED")
    )


def published_file_status(published: Column, parse_status: Column) -> Column:
    """VR7: whatever is published shows as imported."""
    return F.when(published, "IMPORTED").otherwise(file_status(parse_status))


def provenance(kind: str) -> Column:
    """SF15."""
    if kind not in PROVENANCE:
        raise ValueError(f"unknown provenance {kind!r}")
    return F.lit(kind)


def message_pairs(message: Column) -> Column:
    """SF9: the ``key=value`` pairs of a message, in their order."""
    return F.regexp_extract_all(message, F.lit(r"\w+=[^\s]+"), F.lit(0))


def message_value(message: Column, key: str, pairs: Column | None = None) -> Column:
    """SF9: value of the last ``key=value`` pair of a message; ``pairs`` are those of the message, where they are known."""
    known = message_pairs(message) if pairs is None else pairs
    own = F.filter(known, lambda pair: F.substring_index(pair, "=", 1) == key)
    return F.substr(F.try_element_at(own, F.lit(-1)), F.lit(len(key) + 2))


def message_number(message: Column, key: str, pairs: Column | None = None) -> Column:
    return message_value(message, key, pairs).try_cast(QUANTITY)


def error_summary(text: Column) -> Column:
    """PF11."""
    return F.substring(text, 1, ERROR_SUMMARY_CHARS)
