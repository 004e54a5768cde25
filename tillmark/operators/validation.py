"""Deterministic checks of a report's own numbers. Source values are compared, never replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark import fixed
from tillmark.fixed import DEFAULT_PROFILE, ReportProfile
from tillmark.functions.marks import locator_text, message_number, message_value, stable_id, validation_status
from tillmark.functions.numbers import line_total, plain_text
from tillmark.schemas import LOCATOR, QUANTITY

# Order of the issue list: what layout found, then the declared total, then row by row.
PHASE_LAYOUT, PHASE_REPORT, PHASE_ROW = 0, 1, 2

_ISSUE = (
    "struct<phase:int,step:int,code:string,severity:string,stage:string,"
    f"locator:{LOCATOR},message:string,source_value:decimal(19,6),calculated_value:decimal(19,6),"
    "difference:decimal(19,6),tolerance:decimal(19,6),rule_version:string>"
)


def _issue(
    phase: int,
    step: int,
    code: Column,
    severity: Column,
    stage: str,
    message: Column,
    locator: Column | None = None,
    numbers: tuple[Column, Column, Column, Column] | None = None,
    rule: str | None = None,
) -> Column:
    none = F.lit(None)
    source, calculated, difference, tolerance = numbers or (none, none, none, none)
    return F.struct(
        F.lit(phase).alias("phase"),
        F.lit(step).alias("step"),
        code.alias("code"),
        severity.alias("severity"),
        F.lit(stage).alias("stage"),
        (none if locator is None else locator).cast(LOCATOR).alias("locator"),
        message.alias("message"),
        source.try_cast(QUANTITY).alias("source_value"),
        calculated.try_cast(QUANTITY).alias("calculated_value"),
        difference.try_cast(QUANTITY).alias("difference"),
        tolerance.cast(QUANTITY).alias("tolerance"),
        F.lit(rule).alias("rule_version"),
    ).cast(_ISSUE)


def _comparison_message(source: Column, calculated: Column, difference: Column, tolerance: str, rule: str) -> Column:
    return F.concat(
        F.lit("sourceValue="), plain_text(source), F.lit(" calculatedValue="), plain_text(calculated),
        F.lit(" difference="), plain_text(difference), F.lit(f" tolerance={tolerance} ruleVersion={rule}"),
    )


def _as_rows(df: DataFrame, key: str, issues: list[Column]) -> DataFrame:
    return df.select(key, F.explode(F.array_compact(F.array(*issues))).alias("issue")).select(key, "issue.*")


def quantity_check(source: Column, parsed: Column, profile: ReportProfile = DEFAULT_PROFILE) -> Column:
    """VR1: declared against parsed quantity; a difference blocks publication."""
    difference = F.abs(parsed - source)
    fits = difference <= F.lit(fixed.QUANTITY_TOLERANCE).cast("decimal(4,3)")
    return F.when(
        source.isNotNull() & parsed.isNotNull(),
        _issue(
            PHASE_REPORT, 0,
            F.when(fits, "SOURCE_QUANTITY_MATCH").otherwise("SOURCE_QUANTITY_MISMATCH"),
            F.when(fits, "Info").otherwise("Error"),
            "Validation",
            _comparison_message(source, parsed, difference, fixed.QUANTITY_TOLERANCE, profile.rule_version),
            numbers=(source, parsed, difference, F.lit(fixed.QUANTITY_TOLERANCE)),
            rule=profile.rule_version,
        ),
    )


def line_total_check(profile: ReportProfile = DEFAULT_PROFILE) -> Column:
    """VR2: quantity x price less discount against the line's own total, for every direction."""
    quantity, price, total = F.col("quantity"), F.col("unit_price"), F.col("total")
    calculated = line_total(quantity, price, F.col("discount_percentage"))
    difference = F.abs(calculated - total)
    fits = difference <= F.lit(fixed.MONEY_TOLERANCE).cast("decimal(3,2)")
    return F.when(
        quantity.isNotNull() & price.isNotNull() & total.isNotNull(),
        _issue(
            PHASE_ROW, 0,
            F.when(calculated.isNull(), "LINE_TOTAL_OUT_OF_RANGE")
            .when(fits, "LINE_TOTAL_MATCH")
            .otherwise("LINE_TOTAL_MISMATCH"),
            F.when(fits, "Info").otherwise("Warning"),
            "Validation",
            F.coalesce(
                _comparison_message(total, calculated, difference, fixed.MONEY_TOLERANCE, profile.rule_version),
                F.concat(F.lit("quantity="), plain_text(quantity), F.lit(" unitPrice="), plain_text(price)),
            ),
            locator=F.col("locator"),
            numbers=(total, calculated, difference, F.lit(fixed.MONEY_TOLERANCE)),
            rule=profile.rule_version,
        ),
    )


def stock_check() -> Column:
    """VR3: previous - quantity = resulting within an OUT row; only a break is reported."""
    previous, quantity, resulting = F.col("previous_stock"), F.col("quantity"), F.col("resulting_stock")
    expected = previous - quantity
    broken = F.abs(expected - resulting) > F.lit(fixed.QUANTITY_TOLERANCE).cast("decimal(4,3)")
    return F.when(
        (F.col("direction") == "OUT") & broken,
        _issue(
            PHASE_ROW, 1, F.lit("STOCK_CONTINUITY_MISMATCH"), F.lit("Warning"), "Validation",
            F.concat(
                F.lit("previous="), plain_text(previous), F.lit(" quantity="), plain_text(quantity),
                F.lit(" resulting="), plain_text(resulting), F.lit(" expected="), plain_text(expected),
            ),
            locator=F.col("locator"),
        ),
    )


def _invalid_time() -> Column:
    return F.when(
        F.col("invalid_time").isNotNull(),
        _issue(
            PHASE_LAYOUT, 0, F.lit("INVALID_DATETIME"), F.lit("Warning"), "Mapping",
            F.concat(F.lit(fixed.MESSAGES["INVALID_DATETIME"]), F.col("invalid_time")),
            locator=F.struct(
                F.lit(None).cast("int").alias("page"), F.col("source_record_index").alias("record_index"),
                F.lit(None).cast("long").alias("byte_offset"), F.lit(None).cast("string").alias("detail"),
            ),
        ),
    )


def movement_issues(movements: DataFrame, key: str, profile: ReportProfile = DEFAULT_PROFILE) -> DataFrame:
    """VR2, VR3 and unreadable times, straight from each row without a shuffle."""
    return _as_rows(movements, key, [_invalid_time(), line_total_check(profile), stock_check()])


def _fatal(code: str, stage: str, when: Column, severity: str = "Fatal") -> Column:
    return F.when(
        when, _issue(PHASE_LAYOUT, 1, F.lit(code), F.lit(severity), stage, F.lit(fixed.MESSAGES[code]))
    )


def report_issues(summary: DataFrame, key: str, profile: ReportProfile = DEFAULT_PROFILE) -> DataFrame:
    """VR1 and VR5 from one row per report: pages, runs, external_product_id, lines and both totals.

    A report without pages, texts or product field is not checked further; one without sale rows is.
    """
    no_pages = F.col("pages") == 0
    no_text = ~no_pages & (F.col("runs") == 0)
    no_product = (F.col("runs") > 0) & F.col("external_product_id").isNull()
    readable = (F.col("runs") > 0) & F.col("external_product_id").isNotNull()
    return _as_rows(
        summary,
        key,
        [
            _fatal("NO_EMF_PAGES", "Container", no_pages),
            _fatal("NO_EMF_TEXT", "Emf", no_text),
            _fatal("PRODUCT_FIELD_MISSING", "Layout", no_product),
            _fatal("NO_SALE_ROWS", "Layout", readable & (F.col("lines") == 0), "Error"),
            F.when(
                readable, quantity_check(F.col("source_quantity_total"), F.col("parsed_quantity_total"), profile)
            ),
        ],
    )


def all_issues(reports: DataFrame, rows: DataFrame) -> DataFrame:
    """SO1: layout issues, then validation issues; order by ``issue_order`` to get the list."""
    record = F.coalesce(F.col("locator.record_index"), F.lit(-1))
    return reports.unionByName(rows).withColumn("issue_order", F.struct("phase", record.alias("record"), "step"))


def severity_flags(issues: DataFrame, key: str) -> DataFrame:
    """AG11: what an outcome needs to know, one row per report that has issues."""
    return issues.groupBy(key).agg(
        F.bool_or(F.col("severity") == "Fatal").alias("has_fatal"),
        F.bool_or(F.col("severity") == "Error").alias("has_error"),
        F.bool_or(F.col("severity") == "Warning").alias("has_warning"),
        F.bool_or(F.col("severity").isin("Fatal", "Error")).alias("has_fatal_or_error"),
    )


def validation_rows(issues: DataFrame, attempt: str = "parse_attempt_id", profile: ReportProfile = DEFAULT_PROFILE) -> DataFrame:
    """PF6 and VR4: stored rows of validation-stage issues; numbers a reader gives only in words are read off."""
    loc = F.col("locator")
    kept = issues.filter(F.upper("stage") == "VALIDATION")

    def number(name: str, key: str) -> Column:
        return F.coalesce(F.col(name), message_number(F.col("message"), key)).alias(name)

    return kept.select(
        stable_id(F.col(attempt), F.col("code"), F.coalesce(loc["record_index"], F.lit(-1))).alias("id"),
        F.col(attempt).alias("parse_attempt_id"),
        "code",
        validation_status(F.col("severity")).alias("status"),
        number("source_value", "sourceValue"),
        number("calculated_value", "calculatedValue"),
        number("difference", "difference"),
        number("tolerance", "tolerance"),
        F.coalesce(
            F.col("rule_version"), message_value(F.col("message"), "ruleVersion"), F.lit(profile.parser_version)
        ).alias("rule_version"),
        locator_text(loc["page"], loc["record_index"], loc["byte_offset"], loc["detail"]).alias("source_locator"),
    )


def overlap_rows(attempts: DataFrame, attempt: str = "parse_attempt_id") -> DataFrame:
    """VR6: the row that explains why a report was kept out."""
    none = F.lit(None).cast(QUANTITY)
    return attempts.select(
        stable_id(F.col(attempt), F.lit("OVERLAPPING_REPORT"), F.lit(-1)).alias("id"),
        F.col(attempt).alias("parse_attempt_id"),
        F.lit("OVERLAPPING_REPORT").alias("code"),
        F.lit("WARNING").alias("status"),
        *[none.alias(c) for c in ("source_value", "calculated_value", "difference", "tolerance")],
        F.lit(fixed.OVERLAP_RULE).alias("rule_version"),
        F.lit(fixed.OVERLAP_DETAIL).alias("source_locator"),
    )


def parse_outcome(fatal: Column, error: Column, warning: Column, overlap: Column) -> Column:
    """VR6: parse status; the first rule that applies decides."""
    return (
        F.when(fatal, "FAILED").when(error, "INVALID").when(overlap, "WARNING").when(warning, "WARNING").otherwise("VALID")
    )


def publishes(fatal: Column, error: Column, overlap: Column, has_product: Column) -> Column:
    """VR6: whether the report's rows become visible."""
    return ~fatal & ~error & ~overlap & has_product
