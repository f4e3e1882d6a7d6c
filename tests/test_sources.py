"""Readers and writers on real files, and options that queries leave at their defaults."""

import json

from pyspark.sql import functions as F

from docfields.operators.correct import match_dictionary
from docfields.operators.extract import extract_fields, map_fields
from docfields.rules import rule_pack
from docfields.sources import readers, sinks


def test_mapping_files_give_the_registered_mapping(spark, tmp_path):
    mapping = rule_pack(1, 1).mapping
    (tmp_path / "client1").mkdir()
    (tmp_path / "client1" / "format1_mapping.json").write_text(json.dumps(dict(mapping)))
    rows = readers.read_mapping(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["final_field"], r["raw_field"]) for r in rows] == list(dict(mapping).items())
    docs = spark.createDataFrame([(1, 1, 1), (2, 9, 1)], "doc_id int, client_id int, format_id int")
    error = {r["doc_id"]: r["error"] for r in readers.with_mapping(docs, readers.read_mapping(spark, str(tmp_path))).collect()}
    assert error == {1: None, 2: "Mapping config not found: client9/format1"}


def test_files_are_read_as_bytes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"\x00pdf")
    (tmp_path / "in" / "b.txt").write_bytes(b"no")
    got = readers.read_files(spark, str(tmp_path)).collect()
    assert [(r["path"], bytes(r["content"])) for r in got] == [(str(tmp_path / "in" / "a.pdf"), b"\x00pdf")]
    assert readers.list_files(spark, str(tmp_path)).count() == 2


def test_raw_json_keeps_nulls(spark, tmp_path):
    sinks.write_raw_json(spark.createDataFrame([(1, None), (2, "x")], "doc_id int, Branch string"), str(tmp_path / "raw"))
    lines = sorted(line for p in (tmp_path / "raw").glob("*.json") for line in p.read_text().splitlines())
    assert [json.loads(x) for x in lines] == [{"doc_id": 1, "Branch": None}, {"doc_id": 2, "Branch": "x"}]


def test_report_is_written_in_order(spark, tmp_path):
    pages = spark.createDataFrame([(d, p, "INVOICE" if p % 2 else "CONSIGNMENT") for d in (2, 1) for p in (3, 1, 2)], "doc_id long, page_no int, type string")
    sinks.write_report(sinks.page_report(pages), str(tmp_path / "report"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    heads = [line for line in text.splitlines() if line.startswith("Page ")]
    assert len(heads) == 6 and [h[5:7].strip() for h in heads] == ["1", "2", "3", "1", "2", "3"]


def test_rules_table_is_read_with_its_schema(spark, tmp_path):
    rules = spark.createDataFrame([(1, "Branch", "a", "b")], "id int, field_name string, from_value string, to_value string")
    rules.withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp()).write.parquet(str(tmp_path / "rules"))
    assert readers.read_rules(spark, str(tmp_path / "rules")).first()["to_value"] == "b"


def test_threshold_of_names_is_an_argument(spark):
    names = spark.createDataFrame([("SALEM", 0)], "name string, ord int")
    values = spark.createDataFrame([("SALAN",)], "value string")
    assert match_dictionary(values, names).first()["matched"] == "SALAN"
    assert match_dictionary(values, names, threshold=0.5).first()["matched"] == "SALEM"


def test_plate_belongs_to_the_line_of_its_label(spark):
    docs = spark.createDataFrame([(1, "x V6hic1e No\nHR38WV6123"), (2, "x V6hic1e No one two three four five six seven eight nine ten HR38WV6123")], "doc_id int, text string")
    got = {r["doc_id"]: r["vehicle_no"] for r in extract_fields(docs, 2, 2).select("doc_id", "vehicle_no").collect()}
    assert got == {1: None, 2: "HR38WV6123"}


def test_absent_raw_fields_map_to_null(spark):
    raw = spark.createDataFrame([(1, "x")], "doc_id int, Source string")
    assert map_fields(raw, [("Branch", "Source"), ("From", "Source"), ("Other", "missing")]).first().asDict() == {"doc_id": 1, "Branch": "x", "From": "x", "Other": None}
