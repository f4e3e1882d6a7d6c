"""Client 2, format 2: multi-page files of invoices and consignment notes (packs P17-P25)."""

from __future__ import annotations

from docfields.functions.dates import DAMAGED_LABEL_DATETIMES, LABELLED_DATETIMES
from docfields.rules import numbered, register_rule_pack

# --- fixed values: patterns in priority order -------------------------------------------------------
KNOWN_BRANCHES = ("POTTANERI", "SALEM", "METTUR", "NANDYAL", "VIJAPUR", "SALBONI", "JAJPUR", "DOLVI")
NOT_A_BRANCH = ("METTUR", "SALEM", "TAMIL", "NADU", "INDIA")
# a first letter that is looked for before the word boundary: boundaries are the dearest test
POST_EXACT = [r"(?=P)\bPOST\s*[:.\s]\s*([A-Z][A-Z]+)", r"(?=P)\bPOST\s*[:.\s]\s*(\w+)"]
POST_DAMAGED = [rf"(?={p})\b{p}\s*[:.\s]\s*([A-Z][A-Z]+)" for p in ("OST", "PT", "PS", "ST", "OT")]
TALUK_LINE = r"(?m)^(?=.*(?:OST|^PT\b|^PS\b|^ST\b)).*?\b([A-Z]{4,20})\s*,\s*TK\s*[:.\s]"
TALUK_ANYWHERE = r"\b([A-Z]{5,20})\s*,\s*TK\s*[:.\s]\s*([A-Z]+)"
TALUK_NEARBY = r"\bTK\s*[:.\s]|TALUK"

VEHICLE = [
    r"(?i)Vehicle\s*No\.?\s*[:\-]?\s*([A-Z]{2}\s*[0-9]{1,2}\s*[A-Z]{1,3}\s*[0-9]{3,4})",
    r"(?i)Vehicle\s*(?:No|Number)\.?\s*[:\-/]?\s*([A-Z]{2}\s*[0-9]{1,2}\s*[A-Z]{1,3}\s*[0-9]{3,4})",
    r"(?i)Vehicle\s*No\.?\s*[:\-]?\s*([A-Z0-9]{2}\s*[0-9]{1,2}\s*[A-Z0-9]{1,3}\s*[0-9]{3,4})",
    r"(?i)Vehicle\s*No\.?\s*([A-Z]{2}[0-9]{1,2}[A-Z]{1,3}[0-9]{3,4})\s+(?:LR|L\s*R)",
    r"""(?i)Vehicle\s*No\.?\s*[/"'\-:=\s]*([A-Za-z]{2}\s*[0-9]{1,2}\s*[A-Za-z]{1,3}\s*[0-9]{3,4})""",
    r"(?i)Vehicle\s*No\b[^A-Za-z0-9]*([A-Za-z]{2}[0-9]{1,2}[A-Za-z0-9]{1,4}[0-9]{2,4})",
    r"(?i)Vehicle\s*No\b[^A-Za-z0-9]*([A-Za-z0-9]{8,12})",
]
PLATE_IN_LINE = r"(?i)([A-Z]{2}\s*[0-9]{1,2}\s*[A-Z]{1,3}\s*[0-9]{3,4})"

EWAY_LABELS = (
    r"E-Way\s*No", r"E-Way\s*Bill\s*No", r"E-Way\s*No/Validity", r"E-WayNo", r"E\s*Way\s*Bill", r"E-Wway\s*No",
    r"E-Way\s*Ne", r"Validity",
)
EWAY_NO = (
    [(rf"(?i)(?:{label})[^0-9\n]*(\d{{12}})", {}) for label in EWAY_LABELS]
    + [(r"(?=\d{12})\b(\d{12})\b", {})]
    + [(rf"(?i)(?:{label})(.{{1,20}})", {"normaliser": "eway_tail"}) for label in EWAY_LABELS]
)
DAY = r"(\d{2}[\.\/\:]\d{2}[\.\/\:]\d{4})"
EWAY_DATE = [
    rf"(?i)E-?Way.*?Validity.*?\d{{12}}\s*[-]\s*{DAY}",
    rf"(?i)\d{{12}}\s*[-]\s*{DAY}",
    rf"(?i)Validity.*?{DAY}",
    rf"(?i)E-?Way.*?No.*?{DAY}",
]
DISPATCH_TO = r"(?i)Dispatch\s*To\s*[:\s]*([A-Za-z][A-Za-z\s\-]*)"
DISPATCH_LINE = r"(?i)dispatch\s*to"
DISPATCH_STOP_WORDS = (
    "incoterms", "for-door", "delivery", "shipment", "dispatch", "from", "invoice", "date", "no", "number",
    "consignee",
)
DISPATCH_FUZZY_STOPS = (
    "dispatch", "from", "invoice", "date", "no", "incoterms", "for-door", "delivery", "shipment",
)
CONSIGNOR_WORDS = ("JSW CEMENT LIMITED", "JSWCL")
CONSIGNOR_TOKENS = (("JSWCL", 0.7), ("JSW", 0.8))
CONSIGNOR_CITIES = (("SALEM", "POTTANERI"), ("NANDYAL", "NANDYAL"))
CONSIGNOR_NAME = "JSW CEMENT LTD"
GC_LABEL = r"(?i)(?:G|5|6)\.?C\.?N"
GST_TYPE = "Unregistered"

MAPPING = tuple((name, name) for name in (
    "Branch", "Date", "ConsignmentNo", "Source", "Destination", "Vehicle", "EWayBillNo", "Consignor",
    "Consignee", "GSTType", "Delivery Address", "Invoice No", "ContentName", "ActualWeight",
    "E-WayBill ValidUpto", "Invoice Date", "E-Way Bill Date", "E-Way Bill NO",
))
PAGE_MAPPING = (
    ("Branch", "branch"), ("Date", "invoice_date"), ("ConsignmentNo", "gc_number"), ("Source", "branch"),
    ("Destination", "destination"), ("Vehicle", "vehicle_no"), ("EWayBillNo", "eway_bill_no"),
    ("Consignor", "consignor"), ("Consignee", "consignee"), ("GSTType", "gst_type"),
    ("Delivery Address", "delivery_address"), ("Invoice No", "invoice_number"),
    ("ContentName", "product_category"), ("ActualWeight", "actual_weight"), ("E-WayBill ValidUpto", "eway_date"),
    ("Invoice Date", "invoice_date"), ("E-Way Bill Date", "invoice_date"), ("E-Way Bill NO", "eway_bill_no"),
)
# --------------------------------------------------------------------------------------------------

RULES = (
    numbered(2, 2, "vehicle_no", VEHICLE, normaliser="plate_2", guard="two_letters")
    + numbered(2, 2, "eway_bill_no", EWAY_NO, normaliser="trim", guard="present")
    + numbered(2, 2, "invoice_date", LABELLED_DATETIMES + DAMAGED_LABEL_DATETIMES,
               normaliser="invoice_day", guard="present", prepare="upper")
)

register_rule_pack(2, 2, RULES, finish="freight_c", mapping=MAPPING)
