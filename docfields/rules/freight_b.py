"""Client 1, format 2: invoices with ``Dated``, ``Ship To`` and a TOTAL row (pack P16)."""

from __future__ import annotations

from docfields.rules import numbered, register_rule_pack
from docfields.rules.freight_a import shared_rules

# --- fixed values: patterns in priority order -------------------------------------------------------
INVOICE_NO = [
    r"(?i)Invoice\s*No\s*[:.-]\s*([A-Z]{2}\d{7,10})",
    r"(?i)Invoice\s*No\s*[:.-]?\s*([A-Z0-9]{8,15})",
]
DATED = [
    r"(?i)Dated\s*[:.-]\s*(\d{2}\.\d{2}\.\d{4})",
    r"(?i)Dated\s*[:.-]\s*(\d{2}[./-]\d{2}[./-]\d{4})",
]
EWB_NO = [r"(?i)EWB\s*No\s*[:.-]\s*(\d{12})", r"(?i)E-?Way\s*Bill\s*No\s*[:.-]\s*(\d{12})"]
EWB_DATE = [
    r"(?i)EWB\s*Date\s*[:.-]\s*(\d{2}\.\d{2}\.\d{4})",
    r"(?i)E-?Way\s*Bill\s*Date\s*[:.-]\s*(\d{2}[./-]\d{2}[./-]\d{4})",
]
VEHICLE = [
    r"(?i)Vehicle\s*No\s*[:.-]\s*([A-Z]{2}\d{1,2}[A-Z]{1,3}\d{3,4})",
    r"(?i)Vehicle\s*No\s*[:.-]\s*([A-Z]{2}\s*\d{1,2}\s*[A-Z]{1,3}\s*\d{3,4})",
]
TOTAL = [
    r"(?i)TOTAL.*?(\d+\.\d{3})",
    r"(?i)TOTAL\s+(\d+\.\d+)",
    r"(?im)^.*TOTAL.*\n?.*?\n?.*?(\d+\.\d{3})",
]
SHIP_TO_LINE = r"(?i)Ship\s*To\s*[:.-]"
SHIP_TO_LABEL = r"(?i)Ship\s*To"
SHIP_TO_END = r"(?i)(GST|State|Place|PIN|Floor|Road)"
# --------------------------------------------------------------------------------------------------

RULES = (
    numbered(1, 2, "invoice_no", INVOICE_NO)
    + numbered(1, 2, "invoice_date", DATED, normaliser="date")
    + numbered(1, 2, "eway_no", EWB_NO)
    + numbered(1, 2, "eway_date", EWB_DATE, normaliser="date")
    + numbered(1, 2, "vehicle", VEHICLE, normaliser="upper_no_space")
    + numbered(1, 2, "weight", TOTAL)
    + shared_rules(1, 2)
)

register_rule_pack(1, 2, RULES, finish="freight_b")
