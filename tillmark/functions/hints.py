"""Hints read from a report's file name. They are inferred data and never fill source fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: file name patterns ---------------------------------------------
BASENAME = r"(?s)^(?:.*(?:(?<![0-9])[/\\]|[/\\](?![0-9])))?(.*)$"
EXTENSION = r"(?s)^(.+)\.[^.]*$"
PRODUCT_CODE = r"(?i)AUDITORIA\s+([0-9]+)\b"
PERIOD_UNDERSCORE = r"(?<![0-9])[0-9]{2}_[0-9]{2}-[0-9]{2}_[0-9]{2}(?![0-9])"
PERIOD_SLASH = r"(?<![0-9])[0-9]{2}/[0-9]{2}-[0-9]{2}/[0-9]{2}(?![0-9])"
SINGLE_UNDERSCORE = r"(?<![0-9])[0-9]{2}_[0-9]{2}(?![0-9])"
SINGLE_SLASH = r"(?<![0-9])[0-9]{2}/[0-9]{2}(?![0-9])"

DATE = "struct<day:int,month:int,year:int>"
HINTS_JSON = (
    "originalFilename string, provenance string, productCodeHint string, "
    f"periodHint struct<start:{DATE},end:{DATE}>, singleDateHint {DATE}"
)


def basename(name: Column) -> Column:
    """SF16: text after the last separator that is not a date slash between two digits."""
    given = F.coalesce(name, F.lit(""))
    has_folder = F.contains(given, F.lit("/")) | F.contains(given, F.lit("\\"))
    return F.when(has_folder, F.regexp_extract(given, BASENAME, 1)).otherwise(given)


def stem(base: Column) -> Column:
    """SF17: without the extension; a leading dot is part of the name."""
    return F.regexp_replace(base, EXTENSION, "$1")


def product_code_hint(stem_text: Column) -> Column:
    """SF18."""
    return _named(F.regexp_extract(stem_text, PRODUCT_CODE, 1), lambda code: F.when(code != "", code))


def _date(text: Column, start: int) -> Column:
    """Day and month of ``dd?MM`` at a position of a matched text; null when out of range."""
    made = F.struct(
        F.substring(text, start, 2).try_cast("int").alias("day"),
        F.substring(text, start + 3, 2).try_cast("int").alias("month"),
        F.lit(None).cast("int").alias("year"),
    )
    return F.when(
        text.isNotNull(), _named(made, lambda d: F.when(d["day"].between(1, 31) & d["month"].between(1, 12), d))
    )


def _first_match(text: Column, underscore: str, slash: str) -> Column:
    """The slash form is tried only where the underscore form does not occur at all; empty without either."""
    found = F.when(F.contains(text, F.lit("_")), F.regexp_extract(text, underscore, 0)).otherwise(F.lit(""))
    other = lambda: F.when(F.contains(text, F.lit("/")), F.regexp_extract(text, slash, 0)).otherwise(F.lit(""))
    return _named(found, lambda first: F.when(first != "", first).otherwise(other()))


def _range(matched: Column) -> Column:
    dates = F.struct(_date(matched, 1).alias("start"), _date(matched, 7).alias("end"))
    return F.when(
        matched != "", _named(dates, lambda d: F.when(d["start"].isNotNull() & d["end"].isNotNull(), d))
    )


def period_hint(stem_text: Column) -> Column:
    """SF19: first match only; a match out of range is no period."""
    return _named(_first_match(stem_text, PERIOD_UNDERSCORE, PERIOD_SLASH), _range)


def single_date_hint(stem_text: Column) -> Column:
    """SF20: only where there is no period."""
    return filename_hints_of_stem(F.lit(""), stem_text)["singleDateHint"]


def filename_hints(name: Column) -> Column:
    """All hints of a file name as one struct, in the shape that is stored."""
    given = F.coalesce(name, F.lit(""))
    return _named(
        given, lambda n: _named(basename(n), lambda base: _named(stem(base), lambda s: filename_hints_of_stem(n, s)))
    )


def filename_hints_of_stem(name: Column, stem_text: Column) -> Column:
    matched = F.struct(
        name.alias("name"),
        product_code_hint(stem_text).alias("code"),
        _first_match(stem_text, PERIOD_UNDERSCORE, PERIOD_SLASH).alias("period"),
        _first_match(stem_text, SINGLE_UNDERSCORE, SINGLE_SLASH).alias("single"),
    )
    return _named(matched, _hints_of_match)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), 0)


def _hints_of_match(found: Column) -> Column:
    return _named(
        _range(found["period"]),
        lambda period: F.struct(
            found["name"].alias("originalFilename"),
            F.lit("INFERRED_DATA").alias("provenance"),
            found["code"].alias("productCodeHint"),
            period.alias("periodHint"),
            F.when(period.isNull() & (found["single"] != ""), _date(found["single"], 1)).alias("singleDateHint"),
        ),
    )


def hints_empty(hints: Column) -> Column:
    """SF21."""
    return _named(
        hints, lambda h: h["productCodeHint"].isNull() & h["periodHint"].isNull() & h["singleDateHint"].isNull()
    )


def hints_json(hints: Column) -> Column:
    """SK3: camelCase document with nulls kept."""
    return F.to_json(hints, {"ignoreNullFields": "false"})


def read_hints(stored: Column) -> Column:
    """SK4: the stored document; text that is no JSON comes back as it is, null stays null."""
    return F.coalesce(F.to_json(F.try_parse_json(stored)), stored)


def typed_hints(stored: Column) -> Column:
    """SK4: the stored document as a struct, null when it is no JSON."""
    return F.from_json(stored, HINTS_JSON)
