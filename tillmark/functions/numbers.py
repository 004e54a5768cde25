"""Decimal columns: reading report texts, line arithmetic, plain and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillmark.schemas import QUANTITY

WIDE = "decimal(38,10)"
NO_VALUE = "—"


def parse_brazilian_decimal(raw: Column) -> Column:
    """SF1: ``R$ 3.013,07`` to 3013.07; null for blank or unreadable text. A trailing sign counts."""
    text = F.when(F.contains(raw, F.lit("$")), F.regexp_replace(raw, r"(?is)^(.*?)R\$\s*", "$1")).otherwise(raw)
    # With a comma present every dot groups thousands; otherwise a dot is the decimal point.
    text = F.when(F.contains(text, F.lit(",")), F.translate(text, ",.", ".")).otherwise(text)
    # Most texts are clean by now and are read without further replacing.
    bare = F.regexp_replace(F.regexp_replace(text, r"[^0-9+\-.]", ""), r"^([0-9.]+)([+-])$", "$2$1")
    return F.when(text.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), text.try_cast(QUANTITY)).otherwise(bare.try_cast(QUANTITY))


def line_total(quantity: Column, unit_price: Column, discount: Column) -> Column:
    """SF6: quantity x price x (1 - discount), rounded half away from zero to cents.

    The product of these widths fits 38 digits exactly, so nothing is rounded before the end. Quantities or prices of ten
    million and more have no total; VR2 says so in an issue of its own.
    """
    factor = F.lit(1).cast("decimal(1,0)") - F.round(
        F.coalesce(discount, F.lit(0).cast(QUANTITY)) * F.lit("0.01").cast("decimal(3,2)"), 8
    ).cast("decimal(14,8)")
    product = quantity.try_cast("decimal(13,6)") * unit_price.try_cast("decimal(13,6)") * factor.try_cast("decimal(10,8)")
    return F.round(product, 2).cast("decimal(24,2)")


def plain_text(value: Column) -> Column:
    """SF10: decimal as text with its scale."""
    return value.cast("string")


def stripped_text(value: Column) -> Column:
    """SF11: decimal as text without trailing zeros; a text without a point is left alone."""
    text = value.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def decimal_of_text(text: Column) -> Column:
    """Decimal of an API text; blank, padded and junk texts are null."""
    return F.when(text.rlike(r"^\S+$"), text.try_cast(WIDE))


def sum_of_texts(text: Column) -> Column:
    """AG19: exact sum of decimal texts, null and junk counting as zero."""
    return F.coalesce(F.sum(F.coalesce(decimal_of_text(text), F.lit(0).cast(WIDE))), F.lit(0).cast(WIDE))


def _grouped(value: Column, digits: int) -> Column:
    return F.translate(F.format_number(value, digits), ",.", ".,")


def _sign(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise(F.lit(""))


def money_text(text: Column) -> Column:
    """SF24: ``R$ 3.013,07``."""
    value = F.round(F.abs(decimal_of_text(text)), 2)
    return F.coalesce(F.concat(F.lit("R$ "), _sign(text), _grouped(value, 2)), F.lit(NO_VALUE))


def quantity_text(text: Column) -> Column:
    """SF25: at most three decimals, trailing zeros dropped, thousands grouped."""
    value = F.round(F.abs(decimal_of_text(text)), 3)
    shown = F.regexp_replace(_grouped(value, 3), r",?0+$", "")
    return F.coalesce(F.concat(_sign(text), shown), F.lit(NO_VALUE))


def percent_text(text: Column) -> Column:
    """SF26: at most two decimals; ``10`` stays ``10%``."""
    return F.coalesce(F.concat(stripped_text(F.round(decimal_of_text(text), 2)), F.lit("%")), F.lit(NO_VALUE))


def integer_text(value: Column) -> Column:
    """SF27: integer grouped by dots."""
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, _grouped(F.abs(value.cast("decimal(38,0)")), 0))
