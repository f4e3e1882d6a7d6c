"""Address lines: predicates and cleanup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions.similarity import similarity
from docfields.functions.text import blank_to_null, strip_chars, sub

# --- fixed values: patterns of page furniture, headers and stop words ------------------------------
PAGE_FURNITURE = (
    r"(?i)\b(TAX\s*INVOICE|EWB\s*No|Invoice\s*No|Original\s*for\s*Consignee|Original\s*for|"
    r"Invoice\s*Date|UltraTech|TAX INVOICE|Total\s*Invoice)\b"
)
TABLE_HEADER = r"(?i)^(Particulars|Quantity|Amount|HSN|No of Packages|Total|Tax)"
STOP_TOKENS = (
    r"(?i)\b(?:GSTIN|GST|STATE\s*CODE|PLACE\s*OF\s*SUPPLY|PHONE|MOBILE|EMAIL|PAN|PO\s*NO|"
    r"RECIPIENT\s*CODE|INVOICE|AMOUNT|TOTAL|IRN|EWB|BILL\s*NO|SEGMENT)\b"
)
STOP_STARTS = r"(?i)^\s*(PHONE|STATE|MOB|EMAIL|PH:|PH :)"
COUNTRY_VARIANTS = ("INDIA", "1NDIA", "INDI", "NDIA")
COUNTRY = "INDIA"
DELIVERY_HEADER = (
    r"(?i)(Name\s*[&\-]*\s*Address\s*of\s*(?:D[ie]liv[e]?ry|penvesy)|Name\s*and\s*Address\s*of\s*"
    r"(?:D[ie]liv[e]?ry|penvesy)|Address\s*of\s*(?:D[ie]liv[e]?ry|penvesy)|D[ie]liv[e]?ry\s*Address|"
    r"Deliver\s*to|Ship\s*to|D[ie]liv[e]?ry\s*:|penvesy\s*:|Name.*?(?:D[ie]liv[e]?ry|penvesy))"
)
RECIPIENT_HEADER = (
    r"(?i)(Name\s*&\s*Address\s*of\s*(?:Recipient|Consignee)|Name\s*and\s*Address\s*of\s*(?:Recipient|Consignee))"
)
HEADER_LABEL = (
    r"(?i)(?:Name\s*&\s*Address\s*of\s*(?:Delivery|Recipient|Consignee)|Address\s*of\s*Delivery|"
    r"Delivery\s*Address|Deliver\s*to|Ship\s*to)\s*[:\-]?\s*"
)
HEADER_FRAGMENT = (
    r"(?i)(Name\s*(?:&|and)?\s*Address\s*(?:of|af|ad|o[f])?(?:\s*of)?\s*(?:Delivery|Deliver|Recipient|Consignee)|"
    r"Address\s*of\s*Delivery|Delivery\s*Address|Deliver\s*to|Ship\s*to)"
)
HEADER_ANYWHERE = (
    r"(?i)\b(?:Name(?:\s*[:\-]?)?\s*(?:&|and)?\s*Address(?:\s*(?:of|af|ad|o[f])?)?(?:\s*of)?\s*"
    r"(?:Delivery|Deliver|Recipient|Consignee)?)[\s,:;\-]*"
)
HEADER_WORDS = r"(?i)\b(?:name|of|and|address|delivery|deliver|recipient|consignee|ship|to)\b[\s,:;\-]*"
DATE_LIKE = r"(?i)\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b"
PLACE_ENDINGS = ("puram", "nagar", "malai", "pet")
# --------------------------------------------------------------------------------------------------


def is_noise_line(line: Column) -> Column:
    """R8."""
    return (
        line.isNull() | (F.length(F.trim(line)) < 2) | line.rlike(PAGE_FURNITURE)
        | line.rlike(r"^[-\s\W]+$") | line.rlike(TABLE_HEADER)
    )


def is_stop_line(line: Column) -> Column:
    """R9."""
    code_line = line.rlike(r"(?i)^\s*K\d{3}")
    return line.rlike(STOP_STARTS) | (~code_line & F.contains(F.upper(line), F.lit("STATE CODE")))


def is_country_line(line: Column) -> Column:
    """R10. The substring test decides almost always; only other short lines reach the similarity UDF."""
    letters = sub(F.upper(line), "[^A-Z0-9]")
    listed = F.lit(False)
    for variant in COUNTRY_VARIANTS:
        listed = listed | F.contains(letters, F.lit(variant))
    # 2M/(n+5) > 0.7 needs n <= 9; all other lines send NULL to the scorer, which runs on every row whatever stands around it
    short = F.when(~listed & F.length(letters).between(3, 9), letters)
    return listed | F.coalesce(similarity(short, F.lit(COUNTRY)) > 0.7, F.lit(False))


def strip_line_end(line: Column) -> Column:
    return F.trim(sub(F.trim(line), r"\s*[;|!\\/]+$"))


def fix_address_text(text: Column) -> Column:
    """F25."""
    s = sub(F.translate(text, "|\t", ", "), r"\s{2,}", " ")
    s = sub(s, r"(?i)\bDNO\b", "D NO")
    s = sub(s, r"(?i)\bD\s+(?=\d)", "D NO ")
    s = sub(s, r"(?i)\bNO\s*[:\-]?\s*(?=\w)", "NO: ")
    return strip_chars(sub(s, r"\s*,\s*,+", ", "), " ,;:-")


def strip_header_fragments(text: Column) -> Column:
    """a header on the same line is cut, the rest of the line stays."""
    s = F.trim(sub(F.trim(sub(text, HEADER_LABEL)), HEADER_FRAGMENT))
    s = sub(sub(s, r"^[\s,:\-]+"), r"\s{2,}", " ")
    return blank_to_null(strip_chars(s, r" ,:\-"))


def _three_passes(s: Column, pattern: str) -> Column:
    for _ in range(3):
        s = sub(sub(sub(s, pattern), r"^[\s,:\-]+|[\s,:\-]+$"), r"\s{2,}", " ")
    return blank_to_null(strip_chars(sub(s, r"\s*,\s*,+", ", "), r" ,;:\-"))


def strip_headers_anywhere(text: Column) -> Column:
    """header phrases removed wherever they stand."""
    return _three_passes(text, HEADER_ANYWHERE)


def strip_header_words(text: Column) -> Column:
    """F24, last step: single header words and ``&``."""
    return _three_passes(sub(text, r"\s*&\s*", " "), HEADER_WORDS)


def guess_places(text: Column, learned: dict[str, str] | None = None) -> Column:
    """Joined locality endings and, in stored order, whole-word corrections (J12 in one row)."""
    s = F.lower(text)
    for ending in PLACE_ENDINGS:
        s = sub(s, rf"\b([a-z]{{3,}})\s+({ending})\b", "$1$2")
    s = sub(s, r"\bv\.\s*([a-z]{3,})", "v$1")
    for wrong, right in (learned or {}).items():
        s = sub(s, r"\b\Q" + wrong.lower() + r"\E\b", right.lower().replace("\\", "\\\\").replace("$", "\\$"))
    return s


def capitalize_words(text: Column) -> Column:
    """Upper first letter, lower rest, for every space-separated word."""
    return F.array_join(F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.concat(
        F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def local_address_cleanup(text: Column, learned: dict[str, str] | None = None) -> Column:
    """F26."""
    s = sub(sub(text, r"([A-Za-z])&([A-Za-z])", "$1 & $2"), r"([a-z])([A-Z])", "$1 $2")
    s = sub(sub(s, HEADER_ANYWHERE), r"[,;:\-]{2,}", ",")
    s = strip_chars(sub(s, r"\s{2,}", " "), r" ,;:\-")
    s = guess_places(F.trim(sub(s, r"[\r\n]+", " ")), learned)
    s = sub(sub(s, DATE_LIKE), r"\s{2,}", " ")
    s = sub(sub(s, r"\s*,\s*", ", "), r"\s*,\s*,+", ", ")
    s = guess_places(strip_chars(s, r" ,;:\-"), learned)
    return capitalize_words(strip_chars(sub(s, r"\s{2,}", " "), r" ,;:\-"))

