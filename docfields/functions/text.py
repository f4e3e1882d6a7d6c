"""String repair expressions. Everything here is a native Column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: character repairs -------------------------------------------------------------
DIGIT_REPAIR = ("OoDIlL|iSsZzBgq", "000111115522899")
DATE_REPAIR = ("OoIl|SsB—–‚", "00111558--,")
PLATE_DIGIT_REPAIR = ("ODI|SBGZ", "00115862")
LETTER_REPAIR = ("8015", "BDIS")
EWAY_TAIL_REPAIR = ("OoIlSsBG", "00115586")
RARE_ENDS = r"[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
NAME_EDGE_SYMBOLS = r"""\s!@#$%^&*()`~_+\-={}\[\]:";'<>,.?|"""
# --------------------------------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), 0)


def hit(text: Column, pattern: str | Column, group: int = 1) -> Column:
    """First match of a group, NULL instead of '' when nothing matched; the text is searched once."""
    found = (F.regexp_extract(text, pattern, group) if isinstance(pattern, str)
             else F.call_function("regexp_extract", text, pattern, F.lit(group)))
    return let(found, lambda f: F.when(f != "", f))


def hits(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches of a group as an array."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def sub(text: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(text, pattern, replacement)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def strip_chars(text: Column, chars: str) -> Column:
    """Drop the given characters (a regex class body) from both ends."""
    return sub(text, f"^[{chars}]+|[{chars}]+$")


def squeeze(text: Column) -> Column:
    return F.trim(sub(text, r"\s+", " "))


def lines_of(text: Column, universal: bool = True) -> Column:
    """Text to an array of lines; ``universal`` also breaks on the rarer line terminators."""
    plain = F.split(text, "\n", -1)
    if not universal:
        return plain
    # few texts have the rarer terminators; splitting by a single character needs no pattern
    return F.when(text.rlike(RARE_ENDS), F.split(text, "\r\n|\n|" + RARE_ENDS, -1)).otherwise(plain)


def ocr_digits(text: Column) -> Column:
    """look-alike letters to digits."""
    return F.translate(text, *DIGIT_REPAIR)


def ocr_digits_date(text: Column) -> Column:
    """look-alikes and dashes inside dates."""
    return F.translate(text, *DATE_REPAIR)


def ocr_digits_plate(text: Column) -> Column:
    """look-alikes in the numeric parts of a plate, upper-cased first."""
    return F.translate(F.upper(text), *PLATE_DIGIT_REPAIR)


def ocr_letters(text: Column) -> Column:
    """digits that stand for letters in a plate series."""
    return F.translate(text, *LETTER_REPAIR)


def digits_only(text: Column) -> Column:
    return sub(text, "[^0-9]")


def distinct_digits(text: Column) -> Column:
    """how many different decimal digits occur."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(str(d))).cast("int") for d in range(10)])


def alpha_ratio(text: Column) -> Column:
    """letters over visible characters."""
    return F.length(sub(text, r"[^\p{L}]")) / F.greatest(F.length(sub(text, r"\s")), F.lit(1))


def clean_destination(text: Column) -> Column:
    """label, bracketed parts, damaged DESPATCH tails and stray symbols removed; upper case."""
    s = sub(F.trim(text), r"(?i)^\s*DESTINATION\b[:\-\s]*")
    s = sub(s, r"\([^)]*\)", " ")
    s = sub(s, r"(?i)[\-\.,;:_]*\b[A-Za-z]{0,4}\s*PATCH\b[\-\.,;:_]*", " ")
    s = sub(s, r"(?i)\b(?:JES|YES|ES|JE|YE)\b", " ")
    s = squeeze(sub(s, r"[^A-Za-z0-9\s\-/]", " "))
    s = sub(sub(s, r"\s*-\s*", "-"), r"\s*/\s*", "/")
    return blank_to_null(F.upper(s))


def money(text: Column) -> Column:
    """first number after commas are dropped, as text with two decimals."""
    return let(hit(sub(text, ","), r"(\d+(?:\.\d+)?)"), lambda number: F.when(
        number.isNotNull(), F.format_string("%.2f", number.try_cast("double"))))


def trailing_noise_2(text: Column) -> Column:
    """F27 (second client): symbols off both ends, then a lone last character after a space."""
    s = strip_chars(F.trim(text), NAME_EDGE_SYMBOLS)
    return F.trim(F.when(F.length(s) > 3, sub(s, r"\s+.$")).otherwise(s))


def trailing_noise_1(text: Column) -> Column:
    """F27 (first client): trailing symbols, then one trailing lower-case letter, digit or X."""
    s = sub(F.trim(text), f"[{NAME_EDGE_SYMBOLS}]+$")
    return F.trim(sub(s, r"\s+[a-z0-9xX]$"))


def merge_split_letters(text: Column, flags: str = "(?i)") -> Column:
    """``O P C`` to ``OPC``."""
    s = sub(text, flags + r"(?=[A-Z]\s)\b([A-Z])\s+([A-Z])\s+([A-Z])\b", "$1$2$3")
    return sub(s, flags + r"(?=[A-Z]\s)\b([A-Z])\s+([A-Z])\b", "$1$2")


def flexible_pattern(word: str) -> str:
    """a pattern that lets separators stand between the letters of a word."""
    return r"[\s.\-_,|]*".join(word)


def repair_weight(text: Column) -> Column:
    """comma to dot, a number taken, and a grid-line ``1`` after two decimals read as ``0``."""
    number = hit(F.translate(text, ", ", "."), r"(\d*\.?\d+)")
    return sub(number, r"^(\d*\.\d\d)1$", "$10")


def pan_number(text: Column) -> Column:
    """F32: tax account number of five letters, four digits, one letter."""
    strict = F.upper(hit(text, r"(?i)PAN\s*(?:NO\.?|Number)?[:\s]*([A-Z]{5}[0-9]{4}[A-Z])"))
    loose = F.upper(hit(text, r"(?i)PAN\s*(?:NO\.?)?[:\s]*([A-Z0-9]{10})"))
    return F.coalesce(strict, F.when(loose.rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]$"), loose))


def gst_number(text: Column) -> Column:
    """F32: 15-character registration; the loose form only needs two leading digits."""
    body = r"([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z][Z][0-9A-Z])"
    first = F.upper(hit(text, r"(?i)GST\s*(?:NO\.?|Number|IN)?[:\s]*" + body))
    second = F.upper(hit(text, r"(?i)GSTIN[:\s]*" + body))
    loose = F.upper(hit(text, r"(?i)GST\s*(?:NO\.?)?[:\s]*([0-9A-Z]{15})"))
    return F.coalesce(first, second, F.when(loose.rlike(r"^\d\d"), loose))


def iso_time(ts: Column) -> Column:
    """ISO text; the fraction appears only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def goods_type(text: Column) -> Column:
    """R17."""
    return (F.when(text.rlike(r"(?i)(?=[BL])\b(?:BAGS?|LOOSE)\b"), "BAG")
            .when(text.rlike(r"(?i)(?=B)\bBULK\b"), "BULK"))


# --- fixed values: product keywords, in the order they are tried ---------------------------------
CATEGORY_KEYWORDS = (
    ("BOPP BAG", ("LPP", "L1PP", "1PP", "IPP", "BOPP", "LAMINATED", "LOMINATED", "IAMINATED",
                  "WATERGUARD", "WG-BG")),
    ("GGBS", ("GGBS", "GG8S", "GGB5")),
    ("AD STAR", ("AD STAR", "ADSTAR", "AD-STAR")),
)
UNKNOWN_CATEGORY = "UNKNOWN"
# --------------------------------------------------------------------------------------------------


def category_of(text: Column) -> Column:
    """Category of one text block, UNKNOWN when no keyword occurs."""
    upper = F.upper(text)
    out = F.lit(UNKNOWN_CATEGORY)
    for name, words in reversed(CATEGORY_KEYWORDS):
        found = reduce(lambda a, b: a | b, [F.contains(upper, F.lit(w)) for w in words])
        out = F.when(found, name).otherwise(out)
    return out


def product_category(region: Column, page: Column) -> Column:
    """Region text first, whole page when the region says UNKNOWN."""
    return F.coalesce(F.nullif(category_of(region), F.lit(UNKNOWN_CATEGORY)), category_of(page))


# --- fixed values: material codes -----------------------------------------------------------------
# for upper-cased text; the first form of a code covers its letters written without gaps
_GAP = r"\W*"
MATERIAL_CODES = (
    ("OPC53", rf"O{_GAP}P{_GAP}C{_GAP}[5S]{_GAP}3\b|[5S]{_GAP}3{_GAP}OPC\b"),
    ("OPC43", rf"O{_GAP}P{_GAP}C{_GAP}4{_GAP}3\b|4{_GAP}3{_GAP}OPC\b"),
    ("PPC53", rf"P{_GAP}P{_GAP}C{_GAP}[5S]{_GAP}3\b|[5S]{_GAP}3{_GAP}PPC\b"),
    ("PPC43", rf"P{_GAP}P{_GAP}C{_GAP}4{_GAP}3\b|4{_GAP}3{_GAP}PPC\b"),
    ("OPC", rf"O{_GAP}P{_GAP}C\b"),
    ("PPC", rf"P{_GAP}P{_GAP}C\b"),
    ("SRC", rf"S{_GAP}R{_GAP}C\b"),
)
# the leftmost first form of any code in one search, in list order at one place; and any second form
_GRADE = rf"(?:{_GAP}[5S]{_GAP}3\b|{_GAP}4{_GAP}3\b|\b)"
FIRST_FORMS = rf"(?=[OPS])(?:O{_GAP}P{_GAP}C{_GRADE}|P{_GAP}P{_GAP}C{_GRADE}|S{_GAP}R{_GAP}C\b)"
SECOND_FORMS = rf"[45S]{_GAP}3{_GAP}(?:OPC|PPC)\b"
SQUASHED_CODES = (("OPC53", "OPC53"), ("PPC53", "PPC53"), ("OPC43", "OPC43"), ("PPC43", "PPC43"),
                  ("OPC", "OPC"), ("PPC", "PPC"), ("PSC", "PPC"), ("SRC", "SRC"))
# --------------------------------------------------------------------------------------------------


def material_code(text: Column) -> Column:
    """The code that occurs earliest, list order on ties, squashed text as a fallback."""
    upper = F.upper(text)
    for digit, letter in zip("015", "OIS"):
        upper = F.replace(upper, F.lit(digit), F.lit(letter))
    return let(merge_split_letters(upper, ""), _material_in)


def _material_in(upper: Column) -> Column:
    # alternatives of a code are tried one after the other, each with its own first position
    found = []
    for order, (code, pattern) in enumerate(MATERIAL_CODES):
        at = F.coalesce(*[let(F.regexp_instr(upper, F.lit(p)), lambda n: F.when(n > 0, n)) for p in pattern.split("|")])
        found.append(F.struct(at.alias("at"), F.lit(order).alias("ord"), F.lit(code).alias("code")))
    each = F.array_min(F.filter(F.array(*found), lambda c: c["at"].isNotNull())).getField("code")
    # a second form counts only for a code without a first one, so only texts that have one need every code's place
    leftmost = F.replace(sub(hit(upper, FIRST_FORMS, 0), r"\W+"), F.lit("S3"), F.lit("53"))
    first = F.when(upper.rlike(SECOND_FORMS), each).otherwise(leftmost)
    fallback = let(sub(upper, "[^A-Z0-9]+"), lambda s: F.coalesce(
        *[F.when(F.contains(s, F.lit(seen)), code) for seen, code in SQUASHED_CODES]))
    return F.coalesce(first, fallback)


# --- fixed values: dispatch cities and folded spellings -------------------------------------------
SOURCE_CITIES = (
    "ARAKONAM", "ARAKKONAM", "CHROMPET", "CHENNAI", "TIRUNANIMALI", "TIRUNINRAVELI", "VELLORE",
    "MADURAI", "POONAMALLEE", "SRIPERUMBUDUR", "SRIERUMBUDUR",
)
CITY_FOLD = {"ARAKONAM": "ARAKKONAM"}
# --------------------------------------------------------------------------------------------------


def cities_in(text: Column, cities=SOURCE_CITIES, fold=None) -> Column:
    """G9 in one row: distinct listed cities contained in the text, in list order."""
    fold = CITY_FOLD if fold is None else fold
    return let(F.upper(text), lambda upper: F.array_distinct(F.array_compact(F.array(
        *[F.when(F.contains(upper, F.lit(c)), fold.get(c, c)) for c in cities]))))
