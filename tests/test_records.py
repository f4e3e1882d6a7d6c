"""Whole documents of the second client and the first client's delivery address, on hand-made rows."""

import pytest

import __spark_entry__ as entry
from docfields.operators import records as R
from tests.oracle import check, connect

FOLDER = "/root/testdata/sf0.001"
WORDS = "doc_id long, page_no long, word_no int, text string, left int, top int, w int, h int"


@pytest.mark.parametrize("name", ["x1_client2_first", "p22_consignee_address", "p25_gc_number"])
def test_query_matches_sql(spark, name):
    problem, rows = check(spark, connect(FOLDER), entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert problem is None and rows > 0


def test_records_of_odd_documents(spark):
    """No invoice page, more notes than invoices, null and empty texts, no word boxes at all."""
    invoice = "POST: SALEM\nInvoice Date/Time 3.4.2025 06:55:38\nDispatch To Hosur Incoterms"
    pages = [(1, 1, 0, "Consignment note"), (2, 1, 0, None), (2, 1, 1, invoice), (2, 2, 0, "consignment NOTE"), (2, 3, 0, "consignment NOTE"),
             (3, 1, 0, ""), (3, 2, 0, invoice)]
    variants = spark.createDataFrame(pages, "doc_id long, page_no long, ord int, text string")
    out = {(r["doc_id"], r["page_no"]): r for r in R.client2_records(variants, spark.createDataFrame([], WORDS)).collect()}
    assert set(out) == {(2, 1), (3, 1), (3, 2)}
    assert out[2, 1]["Branch"] == "SALEM" and out[2, 1]["Destination"] == "Hosur" and out[2, 1]["ConsignmentNo"] is None
    assert out[3, 1]["Branch"] is None and out[3, 2]["Date"] == "3.4.2025"
    first = R.client2_records(variants, spark.createDataFrame([], WORDS), first_only=True).collect()
    assert sorted((r["doc_id"], r["page_no"]) for r in first) == [(2, 1), (3, 1)]


def test_consignee_block(spark):
    """Country line damaged, missing, directly under the name; a block of the name alone."""
    rows = [(1, 0, ".ABC LTD;"), (1, 1, "Road 1,"), (1, 2, "Town |"), (1, 3, "INDlA"), (1, 4, "never"), (2, 0, "ONLY NAME"),
            (3, 0, "XYZ CO"), (3, 1, "INDIA"), (4, 0, "PQR CO"), (4, 1, "Street"), (4, 2, ";")]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, line string")
    out = {r["doc_id"]: (r["consignee"], r["delivery_address"]) for r in R.consignee_block(lines, ("doc_id",)).collect()}
    assert out == {1: ("ABC LTD", "Road 1, Town, INDIA"), 2: ("ONLY NAME", None), 3: ("XYZ CO", "INDIA"), 4: ("PQR CO", "Street")}


def test_header_row_is_the_median_row(spark):
    """Header words far from the median row and in the left part of the page do not count."""
    rows = [(1, 1, 0, "edge", 1900, 0, 100, 12), (1, 1, 1, "Recipient", 1000, 300, 90, 12), (1, 1, 2, "Consignee", 1100, 304, 100, 12),
            (1, 1, 3, "consignor", 1000, 900, 80, 12), (1, 1, 4, "Consignee", 50, 302, 90, 12), (2, 1, 0, "nothing", 10, 10, 20, 12)]
    out = R.recipient_headers(spark.createDataFrame(rows, WORDS)).collect()
    assert [(r["doc_id"], r["_left"], r["_right"], r["_bottom"]) for r in out] == [(1, 1000, 1200, 316)]
