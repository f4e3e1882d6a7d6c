"""Table schemas of the library."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
TS, NTZ = T.TimestampType(), T.TimestampNTZType()

PROCESSING_LOG = _struct(
    ("doc_id", I), ("client_id", I), ("doc_format_id", I), ("doc_file_name", S),
    ("uploaded_on", NTZ), ("uploaded_by", S), ("overall_status", S),
    ("data_extraction_status", S), ("erp_entry_status", S), ("manual_review_status", S),
    ("extracted_json", S), ("corrected_json", S), ("created_at", NTZ), ("updated_at", TS),
    ("saved_path", S), ("file_data", T.BinaryType()), ("file_mime", S), ("file_size", L),
    ("vehicle_hire_status", S), ("owned_market", S), ("unloading_date", T.DateType()),
    ("data_extraction_start_time", NTZ), ("data_extraction_end_time", NTZ),
    ("erp_entry_start_time", NTZ), ("erp_entry_end_time", NTZ),
)

VALUE_RULES = _struct(
    ("id", I), ("field_name", S), ("from_value", S), ("to_value", S), ("created_at", TS), ("updated_at", TS)
)
FIELD_MAPPING = _struct(("client_id", I), ("format_id", I), ("final_field", S), ("raw_field", S), ("ord", I))
EXTRACTION_RULES = _struct(
    ("client_id", I), ("format_id", I), ("field", S), ("rule_no", I), ("take", S),
    ("pattern", S), ("group", I), ("normaliser", S), ("guard", S),
    ("prepare", S),
)
VARIANTS = _struct(("doc_id", L), ("page_no", I), ("variant_no", I), ("text", S))
LINES = _struct(("doc_id", L), ("page_no", I), ("line_no", I), ("line", S))
WORDS = _struct(
    ("doc_id", L), ("page_no", I), ("word_no", I), ("text", S),
    ("left", I), ("top", I), ("w", I), ("h", I), ("conf", D),
)
PAGES = _struct(
    ("doc_id", L), ("page_no", I), ("type", S), ("branch", S),
    ("invoice_date", S), ("datetime_full", S), ("gc_number", S),
)
KNOWN_NAMES = _struct(("kind", S), ("name", S), ("ord", I))
RULE_CHANGES = _struct(
    ("id", I), ("op", S), ("field_name", S), ("from_value", S), ("to_value", S), ("changed_at", TS)
)
STATUS_EVENTS = _struct(("doc_id", L), ("status", S), ("at", TS), ("note", S), ("attempt", I))

CHANGE = _struct(("field", S), ("from", S), ("to", S))
CHANGE_RECORD = T.StructType([
    T.StructField("transformed", T.BooleanType()),
    T.StructField("changes", T.ArrayType(CHANGE)),
])
CORRECTION = _struct(("original", S), ("corrected", S), ("reason", S))
REFINEMENT = T.StructType([
    T.StructField("refined", T.BooleanType()),
    T.StructField("data", T.MapType(S, S)),
    T.StructField("corrections", T.MapType(S, CORRECTION)),
    T.StructField("confidence", D),
    T.StructField("error", S),
])
FAILED_FIELD = _struct(("Field", S), ("Reason", S))
VALIDATION_STATUS = T.StructType([
    T.StructField("FailedFields", T.ArrayType(FAILED_FIELD)),
    T.StructField("SubmitResult", _struct(("Submitted", T.BooleanType()), ("ErrorText", S))),
    T.StructField("Duplicate", _struct(("Detected", T.BooleanType()))),
])

RAW_RECORD_CLIENT1 = (
    "Consignment No", "Source", "Destination", "E-Way Bill No", "E-Way Bill Date",
    "E-Way Bill Valid Upto", "Consignor", "Consignee", "Billing Party", "Delivery Address",
    "Vehicle", "Driver Mobile", "Date (ERP entry date)", "Invoice No", "Invoice Date",
    "Content Name (Goods Name)", "Actual Weight", "E-Way Bill No (Goods)", "Rate", "IRN",
    "GST Type", "goods_type",
)
RAW_RECORD_CLIENT2 = (
    "Branch", "Source", "Date", "Invoice Date", "Invoice No", "Destination", "Vehicle",
    "EWayBillNo", "E-Way Bill NO", "E-WayBill ValidUpto", "E-Way Bill Date", "GSTType",
    "ContentName", "Consignor", "Consignee", "Delivery Address", "ActualWeight", "ConsignmentNo",
)


def typed_view(df):
    """The client-1 record with weight, rate and dates as real types (unparsable text gives NULL)."""
    from pyspark.sql import functions as F

    return (
        df.withColumn("weight_mt", F.col("Actual Weight").try_cast("decimal(12,3)"))
        .withColumn("rate_amount", F.col("Rate").try_cast("decimal(12,2)"))
        .withColumn("invoice_day", F.to_date(F.try_to_timestamp("Invoice Date", F.lit("d.M.yyyy"))))
    )
