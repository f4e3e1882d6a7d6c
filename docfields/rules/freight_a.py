"""Client 1, format 1: labelled tax invoices (packs P1-P15)."""

from __future__ import annotations

from docfields.functions.text import flexible_pattern
from docfields.rules import numbered, register_rule_pack

# --- fixed values: patterns in priority order -------------------------------------------------------
DIGIT = "[0-9OIlSs]"
_UNTIL = r"(?:\s|$|[A-Z])"

INVOICE_NO = [
    (rf"(?is)D[.\s]*[I1L][.\s]*(?:[IL1][.\s]*)?N[O0][.\s]*(?:&\s*DATE)?[:\-\s]*([0-9OIlSs\s]{{6,}})", {}),
    (rf"(?is)(?=D)\bD[.\s]*I[.\s]*N[O0][.\s]*[:\-\s]*([0-9OIlSs\s]{{6,}})", {}),
    (r"(?is)(?=INV)\bINV(?:OICE)?\s*NO[.\s:]*([A-Z0-9OIlSs\-/\s]{6,})", {}),
    (rf"(?is)Invoice\s*No[^0-9OIlSs]*({DIGIT}{{5,}})", {}),
    (rf"(?is)D[.\s]*[I1L][.\s]*(?:[IL1][.\s]*)?N[O0].{{0,30}}?({DIGIT}{{6,}})",
     {"normaliser": "digits", "guard": "six_or_more"}),
]
DATE_SHAPE = r"([0-3O]?[0-9OIlSs][./-][01O]?[0-9OIlSs][./-][0-9OIlSs]{2,4})"
DATE_LINE_WORDS = r"\b(?:date|invoice|d\.?o\.?|d\.?o\.?no)\b"

LR_NO = [
    rf"L\.R\.No/RR\s*No\.?\s*:\s*({DIGIT}{{2,7}})",
    rf"L\.?R\.?\s*No\.?/RR\s*No\.?\s*:\s*({DIGIT}{{2,7}})",
    rf"L\.?R\.?\s*No\.?\s*/?\s*RR\s*No?\.?[:.\s/\\-]*({DIGIT}{{2,7}}){_UNTIL}",
    rf"L\.?R\.?\s*No\.?\s*/\s*RR\s*No?\.?[:.\s]*({DIGIT}{{2,7}}){_UNTIL}",
    rf"L\.?R\.?No\.?/RR\s*No?\.?[:.\s]*({DIGIT}{{2,7}}){_UNTIL}",
    rf"L\.?R\.?[^\n]*RR\s*N[oa]\.?[:.\s/\\-]*({DIGIT}{{2,7}}){_UNTIL}",
    rf"RR\s*N[oa]\.?[:.\s/\\-]*({DIGIT}{{2,7}}){_UNTIL}",
    rf"L\.?R\.?(?>.*?No)(?>.*?[:.\s]+({DIGIT}{{4,7}})(?:\s|$))",
    rf"(?=RR)\bRR\s*[:.\s]+({DIGIT}{{4,7}}){_UNTIL}",
    rf"(?=LR)\bLR\s*[:.\s]+({DIGIT}{{4,7}}){_UNTIL}",
]
IRN = [r"(?is)IRN[:.\s]*([a-zA-Z0-9]+)"]
MOBILE = [rf"(?=[6-9])\b([6-9]{DIGIT}{{9}})\b"]

UNIT = r"(?:MT|M\.?T\.?|TON|TONNE|T|BAG|BAGS|KG|KGS|QUINTAL|QTL|METRIC\s*TON)"
CURRENCY = r"(?:Rs\.?|₹|INR)\s*"
# digits and single separators, each followed by a digit; one character at a time, so that a run of any length needs no recursion
AMOUNT = r"([0-9OIlSs](?:[0-9OIlSs,\.\s](?<=[0-9OIlSs]|[,\.\s](?=[0-9OIlSs])))*(?:\.[0-9OIlSsao]+)?)"
RATE = [
    rf"@\s*{CURRENCY}{AMOUNT}\s*(?:Per|P[a-z]{{0,2}})\s*{UNIT}",
    rf"@\s*{CURRENCY}{AMOUNT}\s*/\s*{UNIT}",
    rf"@\s*(?:{CURRENCY})?{AMOUNT}\s*(?:Per|/)\s*{UNIT}\b",
    rf"(?:Freight|Rate|Price)[^.\n\r]{{0,120}}(?:{CURRENCY})?{AMOUNT}\s*(?:Per|/)\s*{UNIT}\b",
    rf"{CURRENCY}{AMOUNT}\s*(?:Per|/)\s*{UNIT}\b",
    rf"(?:Per|/)\s*{UNIT}\s*[:\-]?\s*{CURRENCY}{AMOUNT}\b",
    rf"\bRate\s*(?:Per|/)\s*{UNIT}\s*[:\-]?\s*(?:{CURRENCY})?{AMOUNT}\b",
    rf"Limited\s*@\s*{CURRENCY}{AMOUNT}\s*(?:Per|/)\s*{UNIT}",
    rf"{CURRENCY}{AMOUNT}[.\s]*(?:Per|/)\s*{UNIT}",
    rf"@\s*{CURRENCY}{AMOUNT}[.\s]*(?:ao|oo|OO)\s*(?:Per|/)\s*{UNIT}",
    rf"{CURRENCY}([0-9OIlSs,.]+).*?{UNIT}",
]

EWB, EWAY, EWAY_BILL = flexible_pattern("EWB"), flexible_pattern("EWAY"), flexible_pattern("EWAYBILL")
EWAY_NO = [
    EWB + r"[\s.\-_,|]*(?:No|Number|N[\s.]*o)?\.?\s*[:\-]?\s*([0-9OIlSs|\s]{12,})",
    EWAY_BILL + r"\s*(?:No|Number|N[\s.]*o)?\.?\s*[:\-]?\s*([0-9OIlSs|\s]{12,})",
    EWAY + r"\s*(?:No|Number)?\.?\s*[:\-]?\s*([0-9OIlSs|\s]{12,})",
    r"EWB\s*No\.?\s*[:\-]?\s*([0-9\s]{12,})",
    r"E[\s\-]*W[\s\-]*B\s*(?:No|Number)\.?\s*[:\-]?\s*([0-9\s]{12,})",
    r"E[\s\-]*Way\s*Bill\s*(?:No|Number)?\.?\s*[:\-]?\s*([0-9\s]{12,})",
]
EWAY_LINE = r"(?i)(?:E-?Way|EWB)\s*(?:No|Number)?"

MOMENT = r"([0-9OIlSs]{1,2}[./-][0-9OIlSs]{1,2}[./-][0-9OIlSs]{2,4}\s+[0-9OIlSs]{1,2}:[0-9OIlSs]{2}(?::[0-9OIlSs]{2})?)"
SHORT_MOMENT = r"([0-9OIlSs]{1,2}[./-][0-9OIlSs]{1,2}[./-][0-9OIlSs]{2,4}\s+[0-9OIlSs]{1,2}:[0-9OIlSs]{2})"
LOOSE_MOMENT = r"([0-9OIlSs./-]+\s+[0-9OIlSs:]{4,})"
EWAY_EXPIRY = [
    r"(?is)" + EWB + r"\s*(?:Exp|Expiry)\.?\s*[:\-]?\s*" + MOMENT,
    r"(?is)" + EWAY_BILL + r"\s*(?:Valid(?:ity)?|Valid\s*Upto)?\s*[:\-]?\s*" + MOMENT,
    r"(?is)" + flexible_pattern("VALID") + r"\s*(?:Till|Upto|Until)?\s*[:\-]?\s*" + MOMENT,
    r"(?is)Valid(?:ity)?\s*[:\-]?\s*" + MOMENT,
    r"(?is)(?:E-?Way\s*Bill\s*(?:Validity|Valid\s*Upto|Exp(?:iry)?)\s*[:\-]?\s*)" + LOOSE_MOMENT,
    r"(?is)(?:EWB\s*Exp\.\s*[:\-]?\s*)" + LOOSE_MOMENT,
    r"(?is)(?:Valid\s*(?:Till|Upto|Until)\s*[:\-]?\s*)" + LOOSE_MOMENT,
    r"(?is)(?:Expires?\s*(?:On|At)?\s*[:\-]?\s*)" + LOOSE_MOMENT,
    r"(?m)^(?=.*(?i:e[\s.\-]*w[\s.\-]*[ab]|valid|expiry|expires)).*?" + MOMENT,
    r"(?m)^(?=.*\b(?i:valid|exp|till|upto)).*?" + SHORT_MOMENT,
]

PLATE = r"([A-Z]{2}[0-9]{1,2}[A-Z]{1,3}[0-9]{3,4})"
SPACED_PLATE = r"([A-Z]{2}\s*[0-9]{1,2}\s*[A-Z]{1,3}\s*[0-9]{3,4})"
DAMAGED_PLATE = r"([A-Z]{2}[OL0-9]{1,2}[A-Z]{1,4}[0-9]{3,4})"
PLATE_LABELS = [
    r"Vehicle\s*No\.?\s*/?\s*Wagon\s*NO?\.?\s*[:\-]?\s*",
    r"Vehicle\s*No\.?\s*[:\-/]?\s*",
    r"Wagon\s*NO?\.?\s*[:\-/]?\s*",
]
VEHICLE = [r"(?i)" + label + PLATE for label in PLATE_LABELS] + [r"(?i)" + label + SPACED_PLATE for label in PLATE_LABELS]
VEHICLE_LINE = r"(?i)\b(vehicle|wagon)\b"
WEIGHT = r"(?=[0-9OIlSs])\b([0-9OIlSs]+\.[0-9OIlSs]{3})\b"
DESTINATION_LABEL = r"(?i)Destination\s*[:\-]\s*([^\n\r]+)"
DESTINATION_LINE = r"(?im)^.*?destination([^\n\r]*)$"
DESTINATION_TAIL = r"(?is)\b(?:DESPATCH|DISPATCH|FROM|BOOKING|STATION|COMMERCIAL|TERMS)\b.*$"

CONSIGNOR_MARK, CONSIGNOR_NAME = "ULTRATECH CEMENT LIMITED", "UltraTech Cement Limited"
GST_TYPE, DEFAULT_MATERIAL = "Unregistered", "PPC"

MAPPING = (
    ("Branch", "Source"), ("Date", "Invoice Date"), ("ConsignmentNo", "Consignment No"), ("Source", "Source"),
    ("Destination", "Destination"), ("Vehicle", "Vehicle"), ("EWayBillNo", "E-Way Bill No"),
    ("Consignor", "Consignor"), ("Consignee", "Consignee"), ("GSTType", "GST Type"),
    ("Delivery Address", "Delivery Address"), ("Invoice No", "Invoice No"),
    ("ContentName", "Content Name (Goods Name)"), ("ActualWeight", "Actual Weight"),
    ("E-WayBill ValidUpto", "E-Way Bill Valid Upto"), ("Invoice Date", "Invoice Date"),
    ("E-Way Bill Date", "E-Way Bill Date"), ("E-Way Bill NO", "E-Way Bill No"), ("Get Rate", "Rate"),
    ("GoodsType", "goods_type"),
)
# --------------------------------------------------------------------------------------------------


def lr_rules(client_id: int, format_id: int):
    """Four-digit values are also tested against the 50 characters on either side of the match."""
    return numbered(client_id, format_id, "lr_no", [f"(?is){p}" for p in LR_NO], take="context",
                    normaliser="digits", guard="consignment_number")


def shared_rules(client_id: int, format_id: int):
    return (
        lr_rules(client_id, format_id)
        + numbered(client_id, format_id, "driver_mobile", MOBILE, normaliser="digits", guard="mobile")
        + numbered(client_id, format_id, "rate", [f"(?is){p}" for p in RATE], normaliser="rate", guard="present")
    )


RULES = (
    numbered(1, 1, "invoice_no", INVOICE_NO, normaliser="longest_digits", guard="present", prepare="upper")
    + numbered(1, 1, "invoice_date", [
        (rf"(?m)^(?=.*(?i:{DATE_LINE_WORDS})).*?{DATE_SHAPE}", {"take": "all", "prepare": "date_lines"}),
        (DATE_SHAPE, {"take": "all", "prepare": "date_lines"}),
        (r"(?s)^(.*)$", {"normaliser": "partial_date"}),
    ], normaliser="date", guard="present", prepare="dates")
    + shared_rules(1, 1)
    + numbered(1, 1, "irn", IRN, normaliser="ocr_digits", guard="present")
    + numbered(1, 1, "eway_expiry", EWAY_EXPIRY, normaliser="ocr_digits", guard="present")
    + numbered(1, 1, "eway_no", [f"(?i){p}" for p in EWAY_NO], normaliser="digits", guard="eway_label")
    + numbered(1, 1, "vehicle", VEHICLE, take="all", normaliser="plate", guard="plate")
    + numbered(1, 1, "weight", [WEIGHT], take="all", normaliser="decimal_digits", guard="three_decimals")
)

register_rule_pack(1, 1, RULES, finish="freight_a", mapping=MAPPING)
