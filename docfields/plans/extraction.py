"""Queries for X1 and the rule packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.operators import extract as X
from docfields.plans import query
from docfields.plans.derive import INVOICE_SQL, invoices
from docfields.rules import freight_a as A
from docfields.rules import rule_pack

_RECORD_SQL = f"""
WITH {INVOICE_SQL}
SELECT doc_id, lr_no AS "Consignment No", source AS "Source", destination AS "Destination",
  eway_no AS "E-Way Bill No", invoice_date AS "E-Way Bill Date", expiry AS "E-Way Bill Valid Upto",
  'UltraTech Cement Limited' AS "Consignor", consignee AS "Consignee", consignee AS "Billing Party",
  CAST(NULL AS VARCHAR) AS "Delivery Address", vehicle AS "Vehicle", mobile AS "Driver Mobile",
  invoice_date AS "Date (ERP entry date)", invoice_no AS "Invoice No", invoice_date AS "Invoice Date",
  material AS "Content Name (Goods Name)", weight AS "Actual Weight", eway_no AS "E-Way Bill No (Goods)",
  rate AS "Rate", irn AS "IRN", 'Unregistered' AS "GST Type", goods_type
FROM truth"""


@query("x1_extract_fields", _RECORD_SQL)
def extract_fields(spark, folder):
    return X.extract_fields(invoices(spark, folder), 1, 1)


def _mapped_sql() -> str:
    cols = ", ".join(f'"{raw}" AS "{final}"' for final, raw in A.MAPPING)
    return f"SELECT doc_id, {cols} FROM ({_RECORD_SQL})"


@query("r1_map_fields", _mapped_sql())
def map_fields(spark, folder):
    return X.map_fields(X.extract_fields(invoices(spark, folder), 1, 1), rule_pack(1, 1).mapping)


def _single(name: str, rule_field: str, column: str):
    """One pack of format 1/1 on its own: only that field's rules are compiled."""

    @query(name, f"WITH {INVOICE_SQL} SELECT doc_id, {column} AS value FROM truth")
    def run(spark, folder):
        docs = invoices(spark, folder)
        return docs.select("doc_id", X.compile_field(rule_pack(1, 1).of(rule_field), F.col("text")).alias("value"))

    return run


for _name, _field, _column in (
    ("p1_invoice_no", "invoice_no", "invoice_no"), ("p2_invoice_date", "invoice_date", "invoice_date"),
    ("p3_consignment_no", "lr_no", "lr_no"), ("p4_irn", "irn", "irn"), ("p5_mobile", "driver_mobile", "mobile"),
    ("p9_rate", "rate", "rate"), ("p13_eway_expiry", "eway_expiry", "expiry"),
):
    _single(_name, _field, _column)


def _computed(name: str, column: str, expression):
    @query(name, f"WITH {INVOICE_SQL} SELECT doc_id, {column} AS value FROM truth")
    def run(spark, folder):
        return invoices(spark, folder).select("doc_id", expression(F.col("text")).alias("value"))

    return run


_pack = rule_pack(1, 1)
_computed("p6_consignee", "consignee", X.consignee_a)
_computed("p7_weight", "weight", lambda t: X.weight_near_quantity(t, X.compile_field(_pack.of("weight"), t)))
_computed("p8_material", "material", X.material_code)
_computed("p10_source", "source", lambda t: F.get(X.cities_in(t), 0))
_computed("p11_destination", "destination", X.destination_a)
_computed("p12_eway_no", "eway_no", lambda t: X.eway_number(t, X.compile_field(_pack.of("eway_no"), t)))
_computed("p14_vehicle", "vehicle", lambda t: X.vehicle_number(t, X.compile_field(_pack.of("vehicle"), t)))
_computed("p15_goods_type", "goods_type", X.goods_type)
