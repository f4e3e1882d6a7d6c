"""Date and date-time expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions.text import distinct_digits, hit, ocr_digits, ocr_digits_date, sub

# --- fixed values ---------------------------------------------------------------------------------
FIRST_YEAR, LAST_YEAR = 2020, 2030
DATETIME_YEARS = ("2020", "2023", "2024", "2025", "2026")
CENTURY_PIVOT = 69
# --------------------------------------------------------------------------------------------------


def calendar_date(text: Column) -> Column:
    """``d.m.yyyy`` or ``d.m.yy`` (one separator throughout) to a timestamp, NULL when not a real day."""
    parts = F.split(F.translate(text, "-/", ".."), r"\.")
    year = F.try_element_at(parts, F.lit(3))
    two = year.try_cast("int")
    full = F.when(F.length(year) == 4, year).otherwise(
        F.when(two >= CENTURY_PIVOT, two + 1900).otherwise(two + 2000).cast("string"))
    stamp = F.concat_ws("-", full, F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(1)))
    return F.when(text.rlike(r"^\d{1,2}([./-])\d{1,2}\1(\d{4}|\d{2})$"),
                  F.try_to_timestamp(stamp, F.lit("yyyy-M-d")))


def parse_date_loose(text: Column) -> Column:
    """repaired, real calendar dates as ``dd.MM.yyyy``."""
    cleaned = sub(F.trim(ocr_digits(F.trim(text))), r"\s*([./-])\s*", "$1")
    return F.date_format(calendar_date(cleaned), "dd.MM.yyyy")


def partial_date(text: Column) -> Column:
    """``.MM.yyyy`` without a day counts as the first of the month."""
    piece = hit(text, r"([./-][01O]?[0-9OIlSs][./-][0-9OIlSs]{4})")
    lead = F.when(F.contains(piece, F.lit(".")), "01.").otherwise("01-")
    return parse_date_loose(F.concat(lead, sub(piece, r"^[./-]+")))


def parse_invoice_datetime(text: Column) -> Column:
    """``d.M.yyyy H:mm:ss`` when it is a valid moment of the accepted years, else NULL."""
    s = sub(ocr_digits_date(F.trim(text)), r"\s+", " ")
    shape = r"(\d{1,2})[.\s](\d{1,2})[.\s](\d{4})\s+(\d{1,2}):(\d{2}):(\d{2})"
    moment = F.regexp_replace(F.regexp_extract(s, shape, 0), shape, "$1.$2.$3 $4:$5:$6")
    parsed = F.try_to_timestamp(moment, F.lit("d.M.yyyy H:mm:ss"))
    return F.when(F.year(parsed).between(FIRST_YEAR, LAST_YEAR), moment)


def invoice_date_part(text: Column) -> Column:
    """F7, date-only form."""
    return F.substring_index(parse_invoice_datetime(text), " ", 1)


def datetime_full(text: Column) -> Column:
    """F7, full form used for telling invoices of one day apart (shape only, no range check)."""
    upper = F.upper(text)
    raw = F.coalesce(*[hit(upper, p) for p in LABELLED_DATETIMES])
    s = sub(ocr_digits_date(F.trim(raw)), r"\s+", " ")
    shape = r"(\d{1,2})[.\s](\d{1,2})[.\s](\d{4})\s+(\d{1,2}):(\d{2}):(\d{2})"
    found = F.regexp_extract(s, shape, 0)
    return F.when(raw.isNotNull(), F.when(found != "", F.regexp_replace(found, shape, "$1.$2.$3 $4:$5:$6")).otherwise(s))


# --- fixed values: labels of the invoice date-time -------------------------------------------------
STAMP = r"(\d{1,2}[.\s]+\d{1,2}[.\s]+\d{4}\s+\d{1,2}:\d{2}:\d{2})"
LABELLED_DATETIMES = (
    r"INVOICE\s+DATE\s*/\s*TIME\s*[:.\s]+" + STAMP,
    r"INVOICE\s+DATE\s*[/|I]\s*TIME\s*[:.\s]+" + STAMP,
    r"INVOICE\s+DATE\s*TIME\s*[:.\s]+" + STAMP,
)
DAMAGED_LABEL_DATETIMES = (
    r"INV\w*\s+DATE\s*[/|I]?\s*TIME\s*[:.\s]+" + STAMP,
    r"INVOICE\s+D\w*TE?\s*[/|I]?\s*TIME\s*[:.\s]+" + STAMP,
    r"INVOICE\s+DATE\s*[/|I]?\s*T\w*ME?\s*[:.\s]+" + STAMP,
    r"INV\w*\s+D\w*TE?\s*[:.\s]+" + STAMP,
)
DATETIME_LINE_WORDS = r"INV|INVOICE|DATE|TIME"
# --------------------------------------------------------------------------------------------------


def looks_like_datetime(number: Column) -> Column:
    """F8: does a 12-digit number read as a moment in time (or as a filler pattern)?"""

    def part(start: int, size: int) -> Column:
        return F.substring(number, start, size).try_cast("int")

    def year_ok(start: int) -> Column:
        return part(start, 4).between(FIRST_YEAR, LAST_YEAR)

    clock = part(9, 2).between(0, 23) & part(11, 2).between(0, 59)
    day_first = part(1, 2).between(1, 31) & part(3, 2).between(1, 12) & year_ok(5) & clock
    month_first = part(1, 2).between(1, 12) & part(3, 2).between(1, 31) & year_ok(5) & clock
    year_first = year_ok(1) & part(5, 2).between(1, 12) & part(7, 2).between(1, 31) & clock
    has_year = reduce(lambda a, b: a | b, [F.contains(number, F.lit(y)) for y in DATETIME_YEARS])
    steps = reduce(lambda a, b: a + b, [
        (F.abs(part(i, 1) - part(i + 1, 1)) <= 1).cast("int") for i in range(1, 12)])
    late_year = clock & (F.substring(number, 5, 3) == "202")
    verdict = (day_first | month_first | year_first | has_year
               | (distinct_digits(number) <= 3) | (steps >= 8) | late_year)
    return F.when(number.rlike(r"^\d{12}$"), verdict).otherwise(F.lit(False))


def genuine_eway(number: Column) -> Column:
    """Twelve digits that are neither a moment nor made of three or fewer digits."""
    return ~looks_like_datetime(number) & (distinct_digits(number) > 3)
