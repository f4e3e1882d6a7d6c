"""Registered queries against their SQL at the smallest scale (a sample here; ``tests/oracle.py`` runs all)."""

import pytest

import __spark_entry__ as entry
from tests.oracle import check, connect

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "p1_invoice_no", "p3_consignment_no", "p9_rate", "p12_eway_no", "p14_vehicle", "p11_destination", "j1_apply_exact_rules",
    "j13_apply_rule_changes", "j5_pair_pages", "w1_merge_text", "w3_rank_candidates", "w5_collapse_continuations", "w9_until_stop",
    "s4_resolve_paths", "q3_current_status", "g5_field_coverage", "f8_looks_like_datetime", "f13_shrink_plate", "f18_clean_company_line",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, con, name):
    problem, rows = check(spark, con, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert problem is None and rows > 0


def test_every_query_has_sql():
    from docfields.plans import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES) <= set(entry.oracle_sql())


def test_stream_and_batch_agree(spark, tmp_path):
    from docfields.plans.derive import invoices
    from docfields.streaming.jobs import extract_batch, intake_stream, start_extraction
    from pyspark.sql import functions as F

    docs = invoices(spark, FOLDER).filter("doc_id < 40").select(
        "doc_id", F.lit(1).alias("client_id"), F.lit(1).alias("doc_format_id"), "text", F.lit("Not Started").alias("data_extraction_status"))
    docs.write.parquet(str(tmp_path / "in"))
    stream = intake_stream(spark, str(tmp_path / "in"), docs.schema, files_per_trigger=1)
    start_extraction(stream, str(tmp_path / "out"), str(tmp_path / "check"), drain=True).awaitTermination()
    cols = ["doc_id", "extracted_json", "data_extraction_status"]
    streamed = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*cols).collect()))
    assert streamed == sorted(map(tuple, extract_batch(docs, None).select(*cols).collect())) and len(streamed) == 40
