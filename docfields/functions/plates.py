"""Vehicle plates: state(2) + district(1-2) + series(1-3) + number(3-4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions.text import let, ocr_digits, ocr_letters, sub

# --- fixed values ---------------------------------------------------------------------------------
STRICT_PLATE = r"^[A-Z]{2}\s*[0-9]{1,2}\s*[A-Z]{1,3}\s*[0-9]{3,4}$"
RELAXED_PLATE = r"(?i)^[A-Z]{2}[0-9OIlSs]{1,2}[A-Z0-9]{1,3}[0-9OIlSs]{3,4}$"
OTHER_LENGTH_1 = r"^([A-Z]{2})([0-9OIlSs]{1,2})([A-Z0-9]{1,3})([0-9OIlSs]{3,4})$"
OTHER_LENGTH_2 = r"^([A-Z]{2})([0-9OIlSsBG]{1,2})([A-Z0-9]{1,3})([0-9OIlSsBG]{3,4})$"
HOME_STATES = r"^(KA|TN|MH|DL|UP|RJ|GJ|AP|TS|KL|PB|HR)"
# a digit beside the letter it is mistaken for: 5-S, 0-O, 0-D, 1-I, 1-L, 8-B
DIGIT_THEN_TWIN = "(?:5(?=S)|0(?=[OD])|1(?=[IL])|8(?=B))"
LETTER_THEN_TWIN = "(?:S(?=5)|[OD](?=0)|[IL](?=1)|B(?=8))"
# --------------------------------------------------------------------------------------------------

_DISTRICT = r"(?>\d{1,2}|[SODILB][0-9SODILB]?|)"


def clean_plate(text: Column) -> Column:
    """F10."""
    return sub(F.upper(text), "[^A-Z0-9]")


def _by_sections(p: Column, digits, series_10, other: str) -> Column:
    def cut(start: int, size: int) -> Column:
        return F.substring(p, start, size)

    def build(district: int, series: int, fix_series) -> Column:
        return F.concat(
            cut(1, 2), digits(cut(3, district)), fix_series(cut(3 + district, series)),
            digits(cut(3 + district + series, 4)))

    by_group = [F.regexp_extract(p, other, i) for i in range(1, 5)]
    return (
        F.when(F.length(p) == 10, build(2, 2, series_10))
        .when((F.length(p) == 9) & p.rlike(r"^..\d\d"), build(2, 1, ocr_letters))
        .when(F.length(p) == 9, build(1, 2, ocr_letters))
        .when(F.length(p) == 11, build(2, 3, ocr_letters))
        .when(p.rlike(other), F.concat(by_group[0], digits(by_group[1]), ocr_letters(by_group[2]), digits(by_group[3])))
        .otherwise(p)
    )


def normalize_plate_v1(plate: Column) -> Column:
    """known misreads of state and district, then repair by position; 10 characters keep the series."""
    p = F.replace(F.upper(plate), F.lit(" "), F.lit(""))
    p = sub(p, "^FN", "TN")
    p = sub(p, r"^(..)11[8B](?=[A-Z])", "$118")
    return let(p, lambda p: _by_sections(p, ocr_digits, lambda series: series, OTHER_LENGTH_1))


def normalize_plate_v2(plate: Column) -> Column:
    """second client; wrong state codes fixed and the series forced to letters at every length."""
    p = F.translate(F.upper(plate), " -", "")
    p = sub(p, r"^[RK]P(?=\d\d)", "AP")
    return let(p, lambda p: _by_sections(p, lambda c: F.translate(c, "ODI|SBGZ", "00115862"), ocr_letters, OTHER_LENGTH_2))


def _shrink_once(p: Column) -> Column:
    head = "^([A-Z]{2}"
    cases = [
        # a third series letter that doubles the district's last digit
        (rf"{head}(?:\d|[SODILB])?{DIGIT_THEN_TWIN})[A-Z]([A-Z]{{2}}.*)$", "$1$2"),
        # a third series letter that doubles the number's first character
        (rf"{head}{_DISTRICT}[A-Z]{{2}})(?:S(?=[5S])|O(?=[0O])|D(?=[0D])|I(?=[1I])|L(?=[1L])|B(?=[8B]))(.{{4,}})$", "$1$2"),
        # a fifth number digit that doubles the series' last letter
        (rf"{head}{_DISTRICT}(?>[A-Z]{{1,3}}))(?:(?<=S)5|(?<=O)0|(?<=I)1|(?<=B)8)(.{{4,}})$", "$1$2"),
        # twins across the district/series boundary, then across the series/number boundary
        (rf"{head}(?:\d|[SODILB])){DIGIT_THEN_TWIN}(.*)$", "$1$2"),
        (rf"{head}{DIGIT_THEN_TWIN})[A-Z](.*)$", "$1$2"),
        (rf"{head}{_DISTRICT}[A-Z]{{1,2}}){LETTER_THEN_TWIN}(.*)$", "$1$2"),
        (rf"{head}{_DISTRICT}{LETTER_THEN_TWIN})\d(.*)$", "$1$2"),
    ]
    chain = F.when(F.length(p) <= 10, p)
    for pattern, keep in cases:
        chain = chain.when(p.rlike(pattern), sub(p, pattern, keep))
    return chain.otherwise(p)


def shrink_plate(plate: Column, rounds: int = 2) -> Column:
    """drop one doubled look-alike per round; two rounds cover the longest accepted plate."""
    p = F.replace(F.upper(plate), F.lit(" "), F.lit(""))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), p, lambda acc, _: _shrink_once(acc))


def valid_plate(text: Column) -> Column:
    """F14."""
    return let(clean_plate(text), lambda p: F.length(p).between(8, 12) & (
        p.rlike(RELAXED_PLATE) | normalize_plate_v1(p).rlike(STRICT_PLATE)))


def finish_plate(text: Column) -> Column:
    """Clean, repair and shrink an accepted plate."""
    return shrink_plate(normalize_plate_v1(clean_plate(text)))
