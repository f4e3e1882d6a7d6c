"""Queries over the processing log."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.functions.text import iso_time
from docfields.operators import status as S
from docfields.plans import query
from docfields.plans.derive import INVOICE_SQL, LOG_SQL, invoices, processing_log, table
from docfields.sources.readers import mapping_frame, with_mapping

_ISO = "strftime(uploaded_on, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(uploaded_on) % 1000000 != 0 THEN strftime(uploaded_on, '.%f') ELSE '' END"


@query("s1_pending_documents", f"""
WITH {LOG_SQL}
SELECT doc_id, doc_file_name, saved_path, coalesce(client_id, 1) AS client_id, coalesce(doc_format_id, 1) AS doc_format_id
FROM log WHERE data_extraction_status = 'Not Started'
""")
def pending_documents(spark, folder):
    return S.pending_documents(processing_log(spark, folder))


@query("s2_next_documents", f"""
WITH {LOG_SQL}
SELECT doc_id, client_id, doc_format_id, doc_file_name, saved_path, coalesce(file_mime, 'application/pdf') AS file_mime
FROM log WHERE data_extraction_status = 'Not Started' ORDER BY doc_id LIMIT 5
""")
def next_documents(spark, folder):
    return S.next_documents(processing_log(spark, folder), 5)


@query("s3_load_document_bytes", f"""
WITH {LOG_SQL},
b AS (SELECT doc_id, client_id, doc_format_id, saved_path,
    CASE WHEN doc_id % 2 = 0 THEN 'disk ' || CAST(doc_id AS VARCHAR) WHEN doc_id % 3 = 0 THEN 'row ' || CAST(doc_id AS VARCHAR) END AS body FROM log)
SELECT doc_id, client_id, doc_format_id, saved_path, body,
  CASE WHEN client_id IS NULL OR doc_format_id IS NULL THEN 'Failed: Missing IDs' WHEN body IS NULL THEN 'Failed: No File'
    ELSE 'In Progress' END AS status
FROM b
""")
def load_document_bytes(spark, folder):
    d = F.col("doc_id")
    log = processing_log(spark, folder).withColumn(
        "file_data", F.when(d % 3 == 0, F.concat(F.lit("row "), d.cast("string")).cast("binary")))
    # file bytes as a binaryFile source would give them: path and content
    files = table(spark, folder, "events").filter("event_id % 2 = 0").select(
        F.concat(F.lit("/store/"), F.col("event_id").cast("string"), F.lit(".pdf")).alias("path"),
        F.concat(F.lit("disk "), F.col("event_id").cast("string")).cast("binary").alias("content"))
    return S.file_status(log, files).withColumn("body", F.col("content").cast("string")).drop("content")


@query("s4_resolve_paths", f"""
WITH {LOG_SQL},
f AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN saved_path
      WHEN doc_id % 5 = 1 THEN '/in/' || doc_file_name
      WHEN doc_id % 5 = 2 THEN '/in/' || replace(doc_file_name, '_Invoice_', '_')
      WHEN doc_id % 5 = 3 THEN '/in/scan_' || regexp_extract(doc_file_name, '\\d{{8}}_\\d{{6}}') || '_a.pdf' END AS path,
    regexp_extract(doc_file_name, '\\d{{8}}_\\d{{6}}') AS stamp, doc_file_name FROM log),
byname AS (SELECT regexp_extract(path, '\\d{{8}}_\\d{{6}}') AS stamp, min(path) AS path FROM f WHERE path LIKE '/in/%' GROUP BY 1)
SELECT f.doc_id, CASE WHEN doc_id % 5 IN (0, 1, 2) THEN f.path ELSE coalesce(b.path, '/in/' || doc_file_name) END AS path,
  CASE WHEN doc_id % 5 IN (0, 1, 2) THEN doc_id % 5 + 1 WHEN b.path IS NOT NULL THEN 4 ELSE 5 END AS strategy
FROM f LEFT JOIN byname b ON b.stamp = f.stamp
""")
def resolve_paths(spark, folder):
    log = processing_log(spark, folder)
    d = F.col("doc_id")
    base = F.lit("/in/")
    path = (F.when(d % 5 == 0, F.col("saved_path")).when(d % 5 == 1, F.concat(base, "doc_file_name"))
            .when(d % 5 == 2, F.concat(base, F.replace("doc_file_name", F.lit("_Invoice_"), F.lit("_"))))
            .when(d % 5 == 3, F.concat(base, F.lit("scan_"), F.regexp_extract("doc_file_name", r"\d{8}_\d{6}", 0), F.lit("_a.pdf"))))
    files = log.select(path.alias("path")).filter("path is not null")
    return S.resolve_paths(log, files, "/in").withColumn("strategy", F.col("strategy").cast("bigint"))


@query("s6_mapping_or_error", f"""
WITH {LOG_SQL}
SELECT doc_id, coalesce(client_id, 1) AS client_id, coalesce(doc_format_id, 1) AS format_id,
  CASE WHEN coalesce(client_id, 1) = coalesce(doc_format_id, 1) THEN NULL
    ELSE 'Mapping config not found: client' || coalesce(client_id, 1) || '/format' || coalesce(doc_format_id, 1) END AS error,
  CASE WHEN coalesce(client_id, 1) != coalesce(doc_format_id, 1) THEN 0 WHEN coalesce(client_id, 1) = 1 THEN 20 ELSE 18 END AS fields
FROM log
""")
def mapping_or_error(spark, folder):
    docs = S.pending_documents(processing_log(spark, folder).withColumn("data_extraction_status", F.lit(S.NOT_STARTED)), False)
    out = with_mapping(docs.withColumnRenamed("doc_format_id", "format_id"), mapping_frame(spark))
    return out.select("doc_id", "client_id", "format_id", "error", F.coalesce(F.size("mapping"), F.lit(0)).alias("fields"))


@query("s8_result_events", """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 != 0 THEN '{"status":"' || o_orderstatus || '","priority":' ||
    CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderpriority || '"' END || '}' END AS extracted_json,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Failed' ELSE 'Completed' END AS data_extraction_status,
  CASE WHEN o_orderkey % 4 = 0 THEN 'no text' END AS error, o_orderdate AS at
FROM orders
""")
def result_events(spark, folder):
    from docfields.sources.sinks import result_events as events

    k = F.col("o_orderkey")
    records = table(spark, folder, "orders").select(
        k.alias("doc_id"), F.col("o_orderstatus").alias("status"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(k % 4 == 0, "no text").alias("failure"), "o_orderdate")
    return events(records, ("status", "priority"), F.col("o_orderdate"), error="failure")


@query("r2_unwrap_json", f"""
WITH {LOG_SQL}
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '{{"Branch":"Q' || CAST(doc_id % 9 AS VARCHAR) || '"}}' WHEN doc_id % 5 = 1 THEN '{{}}'
  ELSE '{{"Branch":"B' || CAST(doc_id % 9 AS VARCHAR) || '","No":"' || CAST(doc_id AS VARCHAR) || '"}}' END AS payload
FROM log
""")
def unwrap_json(spark, folder):
    return processing_log(spark, folder).select("doc_id", S.unwrap_json(F.col("extracted_json")).alias("payload"))


@query("r3_pick_payload", """
SELECT event_id AS doc_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{"k":1}' ELSE '{"final":{},"raw":' || props || '}' END AS payload
FROM events
""")
def pick_payload(spark, folder):
    e = F.col("event_id")
    raw = (F.when(e % 3 == 0, F.col("props")).when(e % 3 == 1, F.concat(F.lit('{"final_data":{},"final":{"k":1},"raw":'), "props", F.lit("}")))
           .otherwise(F.concat(F.lit('{"final":{},"raw":'), "props", F.lit("}"))))
    return table(spark, folder, "events").select(e.alias("doc_id"), S.pick_payload(raw).alias("payload"))


@query("r4_choose_source_json", f"""
WITH {LOG_SQL}
SELECT doc_id, CASE WHEN upper(trim(erp_entry_status)) = 'FIXED' AND doc_id % 4 = 1 THEN corrected_json ELSE extracted_json END AS source_json FROM log
""")
def choose_source_json(spark, folder):
    return processing_log(spark, folder).select("doc_id", S.choose_source_json(
        F.col("erp_entry_status"), F.col("corrected_json"), F.col("extracted_json")).alias("source_json"))


@query("r5_require_fields", f"""
WITH {LOG_SQL}
SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN '[{{"Field":"Branch","Reason":"Missing value"}}]' ELSE '[]' END AS failed_fields,
  CASE WHEN doc_id % 5 = 1 THEN 'Failed' END AS status
FROM log
""")
def require_fields(spark, folder):
    log = processing_log(spark, folder).select("doc_id", S.unwrap_json(F.col("extracted_json")).alias("j"))
    failed = S.require_fields({"Branch": F.get_json_object("j", "$.Branch")})
    return log.select("doc_id", failed.alias("f")).select(
        "doc_id", F.to_json("f").alias("failed_fields"), F.when(F.size("f") > 0, S.FAILED).alias("status"))


@query("r15_status_predicate", f"WITH {LOG_SQL} SELECT doc_id FROM log WHERE upper(trim(erp_entry_status)) = 'DUPLICATE'")
def status_predicate(spark, folder):
    return processing_log(spark, folder).filter(S.status_is(F.col("erp_entry_status"), "Duplicate")).select("doc_id")


@query("t1_recent_documents", f"""
WITH {LOG_SQL}
SELECT doc_id, doc_file_name AS filename, {_ISO} AS uploaded_on, trim(coalesce(erp_entry_status, '')) AS erp_entry_status, overall_status,
  coalesce(upper(trim(erp_entry_status)) = 'DUPLICATE', false) AS is_duplicate
FROM log ORDER BY log.uploaded_on DESC, doc_id DESC LIMIT 20
""")
def recent_documents(spark, folder):
    return S.recent_documents(processing_log(spark, folder))


@query("t3_claim_oldest", f"""
WITH {LOG_SQL}
SELECT doc_id, doc_file_name, erp_entry_status AS prev_erp_entry_status, extracted_json, corrected_json FROM log
WHERE upper(data_extraction_status) = 'COMPLETED' AND upper(erp_entry_status) IN ('NOT STARTED', 'IN PROGRESS', 'FIXED')
ORDER BY uploaded_on, doc_id LIMIT 1
""")
def claim_oldest(spark, folder):
    return S.claim_oldest(processing_log(spark, folder))


@query("g1_duplicate_count", f"WITH {LOG_SQL} SELECT count(*) AS duplicate_count FROM log WHERE upper(erp_entry_status) = 'DUPLICATE'")
def duplicate_count(spark, folder):
    return S.duplicate_count(processing_log(spark, folder))


@query("g4_batch_tally", """
WITH b AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS batch_id, sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) AS success,
    sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed FROM events GROUP BY 1)
SELECT batch_id, CAST(success AS BIGINT) AS success, CAST(failed AS BIGINT) AS failed,
  CAST(sum(success) OVER (ORDER BY batch_id) AS BIGINT) AS total_success, CAST(sum(failed) OVER (ORDER BY batch_id) AS BIGINT) AS total_failed FROM b
""")
def batch_tally(spark, folder):
    log = processing_log(spark, folder).select(
        F.to_date("uploaded_on").alias("batch_id"), F.col("data_extraction_status").alias("status"))
    return S.batch_tally(log)


_STATUS = "CASE event_type WHEN 'view' THEN 'Not Started' WHEN 'click' THEN 'In Progress' WHEN 'error' THEN 'Failed' ELSE 'Completed' END"


def event_status():
    kind = F.col("event_type")
    return (F.when(kind == "view", S.NOT_STARTED).when(kind == "click", S.IN_PROGRESS).when(kind == "error", S.FAILED)
            .otherwise(S.COMPLETED))


def status_events(spark, folder):
    return table(spark, folder, "events").select(
        F.col("user_id").alias("doc_id"), event_status().alias("status"), F.col("ts").alias("at"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("note "), F.col("event_id").cast("string"))).alias("note"),
        (F.col("event_id") % 4).cast("int").alias("attempt"))


@query("q3_current_status", f"""
SELECT doc_id, status, "at", attempt FROM (SELECT user_id AS doc_id, {_STATUS} AS status, ts AS "at", CAST(event_id % 4 AS INT) AS attempt,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 4 DESC) AS rn FROM events) WHERE rn = 1
""")
def current_status(spark, folder):
    return S.current_status(status_events(spark, folder))


@query("q5_notes", f"""
SELECT user_id AS doc_id, string_agg(chr(10) || '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 != 0 THEN strftime(ts, '.%f') ELSE '' END
  || '] ' || CASE WHEN event_id % 2 = 0 THEN 'note ' || CAST(event_id AS VARCHAR) ELSE {_STATUS} END, '' ORDER BY ts, event_id % 4) AS erp_note
FROM events GROUP BY user_id
""")
def notes(spark, folder):
    return S.notes_of(status_events(spark, folder))


@query("q7_retry_plan", f"""
SELECT doc_id, attempt + 1 AS attempt, "at" + INTERVAL 5 SECOND AS not_before FROM (
  SELECT user_id AS doc_id, {_STATUS} AS status, ts AS "at", CAST(event_id % 4 AS INT) AS attempt,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 4 DESC) AS rn FROM events)
WHERE rn = 1 AND status = 'Failed' AND attempt <= 2
""")
def retry_plan(spark, folder):
    return S.retry_plan(status_events(spark, folder))


@query("q4_erp_status", """
SELECT event_id AS doc_id, s AS erp_entry_status,
  CASE WHEN s = 'Duplicate' THEN 'Failed' WHEN s IN ('Completed', 'Completed AHR') THEN 'Completed' ELSE 'In Progress' END AS overall_status
FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'Duplicate' WHEN event_id % 3 = 0 THEN 'Failed'
  WHEN event_id % 5 != 0 AND event_id % 7 != 0 AND event_id % 2 = 0 THEN 'Completed AHR' WHEN event_id % 5 != 0 AND event_id % 7 != 0 THEN 'Completed'
  ELSE 'In Progress' END AS s FROM events)
""")
def erp_status(spark, folder):
    e = F.col("event_id")
    out = table(spark, folder, "events").select(e.alias("doc_id"), S.erp_status(
        e % 11 == 0, F.when(e % 3 == 0, 2).otherwise(0), e % 5 != 0, e % 7 != 0, e % 2 == 0).alias("erp_entry_status"))
    return out.withColumn("overall_status", S.overall_status(F.col("erp_entry_status"), F.lit(S.IN_PROGRESS)))


@query("d12_validation_status", """
SELECT event_id AS doc_id, CASE WHEN event_id % 11 = 0 THEN '{"FailedFields":[],"SubmitResult":{"Submitted":false,"ErrorText":"Duplicate detected"},"Duplicate":{"Detected":true}}'
  WHEN event_id % 3 = 0 THEN '{"FailedFields":[{"Field":"Branch","Reason":"Missing value"}],"SubmitResult":{"Submitted":false,"ErrorText":"Missing Branch in data"}}'
  ELSE '{"FailedFields":[],"SubmitResult":{"Submitted":true}}' END AS validation_status FROM events
""")
def validation_status(spark, folder):
    e = F.col("event_id")
    branch = F.when(e % 3 != 0, "B1")
    failed = S.require_fields({"Branch": branch})
    error = F.when(branch.isNull(), "Missing Branch in data")
    return table(spark, folder, "events").select(
        e.alias("doc_id"), S.validation_status(failed, branch.isNotNull(), error, e % 11 == 0).alias("validation_status"))


@query("f34_iso_time", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 != 0 THEN strftime(ts, '.%f') ELSE '' END AS at FROM events
""")
def iso(spark, folder):
    return table(spark, folder, "events").select("event_id", iso_time(F.col("ts")).alias("at"))


@query("q2_drain_intake", f"""
WITH {INVOICE_SQL}
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Failed' ELSE 'Completed' END AS data_extraction_status,
  CASE WHEN doc_id % 4 = 0 THEN 'Mapping config not found: client9/format1' END AS error,
  CASE WHEN doc_id % 4 != 0 THEN vehicle END AS vehicle, CASE WHEN doc_id % 4 != 0 THEN lr_no END AS consignment_no,
  CASE WHEN doc_id % 4 != 0 THEN consignee END AS consignee, CASE WHEN doc_id % 4 != 0 THEN rate END AS rate
FROM truth
""")
def drain_intake(spark, folder):
    """Q2: the intake table as a stream, drained once through the batch extraction, read back as events."""
    from uuid import uuid4

    from docfields.session import shared_folder
    from docfields.streaming.jobs import intake_stream, start_extraction

    # a run of its own each time: its stream starts from an empty checkpoint
    root = f"{shared_folder(spark)}/drain-{uuid4().hex}"
    # every fourth client id has no rules, so both outcomes occur
    intake = invoices(spark, folder).select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, 9).otherwise(1).alias("client_id"), F.lit(1).alias("doc_format_id"), "text",
        F.lit("Not Started").alias("data_extraction_status"))
    intake.write.mode("overwrite").parquet(f"{root}/in")
    stream = intake_stream(spark, f"{root}/in", intake.schema)
    start_extraction(stream, f"{root}/out", f"{root}/check", drain=True).awaitTermination()
    names = {"vehicle": "Vehicle", "consignment_no": "ConsignmentNo", "consignee": "Consignee", "rate": "Get Rate"}
    return spark.read.parquet(f"{root}/out").select("doc_id", "data_extraction_status", "error", *[
        F.get_json_object("extracted_json", f"$['{key}']").alias(name) for name, key in names.items()])


_POLL_SQL = f"""
WITH {INVOICE_SQL}
SELECT doc_id, 'Completed' AS data_extraction_status, vehicle FROM truth
"""


@query("q1_poll_intake", _POLL_SQL)
def poll_intake(spark, folder):
    """Q1: the polling form, stopped once everything that is there has been taken up."""
    from uuid import uuid4

    from docfields.session import shared_folder
    from docfields.streaming.jobs import intake_stream, start_extraction

    root = f"{shared_folder(spark)}/poll-{uuid4().hex}"
    intake = invoices(spark, folder).select(
        "doc_id", F.lit(1).alias("client_id"), F.lit(1).alias("doc_format_id"), "text", F.lit("Not Started").alias("data_extraction_status"))
    intake.write.parquet(f"{root}/in")
    running = start_extraction(intake_stream(spark, f"{root}/in", intake.schema), f"{root}/out", f"{root}/check", poll="1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.parquet(f"{root}/out").select("doc_id", "data_extraction_status", F.get_json_object("extracted_json", "$['Vehicle']").alias("vehicle"))


@query("q7_stream_retry", f"""
WITH {INVOICE_SQL}
SELECT doc_id, CASE WHEN doc_id % 8 = 4 THEN 'Failed' ELSE 'Completed' END AS status, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS attempt,
  CAST(CASE WHEN doc_id % 4 = 0 THEN 4 ELSE 2 END AS BIGINT) AS events
FROM truth
""")
def stream_retry(spark, folder):
    """Q3 and Q7 in the stream: failed documents enter again with the next attempt; for half of them the cause is gone by then."""
    from uuid import uuid4

    from docfields.session import shared_folder
    from docfields.streaming.jobs import intake_stream, retry_intake, start_extraction

    root = f"{shared_folder(spark)}/retry-{uuid4().hex}"
    k = F.col("doc_id")
    docs = invoices(spark, folder).select(
        "doc_id", F.when(k % 4 == 0, 9).otherwise(1).alias("client_id"), F.lit(1).alias("doc_format_id"), "text",
        F.lit("Not Started").alias("data_extraction_status"), F.lit(1).alias("attempt"))

    def drain():
        stream = intake_stream(spark, f"{root}/in", docs.schema)
        start_extraction(stream, f"{root}/out", f"{root}/check", drain=True, log=f"{root}/log").awaitTermination()
        return spark.read.parquet(f"{root}/log")

    docs.write.parquet(f"{root}/in")
    again = retry_intake(drain(), docs).withColumn("client_id", F.when(k % 8 == 0, 1).otherwise(F.col("client_id")))
    again.select(docs.columns).write.mode("append").parquet(f"{root}/in")
    events = drain()
    counted = events.groupBy("doc_id").agg(F.count("*").alias("events"))
    return S.current_status(events).join(counted, "doc_id").select("doc_id", "status", "attempt", "events")


_MACHINE_SQL = f"""
WITH RECURSIVE e AS (
  SELECT user_id AS doc_id, event_id, {_STATUS} AS status, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events
), f AS (
  SELECT DISTINCT doc_id, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS TIMESTAMP) AS ts, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS outcome,
    0 AS tried, CAST(NULL AS TIMESTAMP) AS released, CAST(NULL AS VARCHAR) AS now, 0 AS attempt, CAST(NULL AS TIMESTAMP) AS not_before, false AS held FROM e
  UNION ALL
  SELECT doc_id, event_id, status, ts, rn, outcome, CASE WHEN attempt = 0 AND outcome = 'accepted' THEN 1 ELSE attempt END, released,
    CASE WHEN outcome != 'accepted' THEN now WHEN status = 'Failed' AND attempt <= 2 THEN 'Not Started' ELSE status END,
    CASE WHEN outcome != 'accepted' THEN attempt WHEN status = 'Not Started' THEN 1 WHEN status = 'Failed' AND attempt <= 2 THEN attempt + 1 ELSE attempt END,
    CASE WHEN outcome != 'accepted' THEN not_before WHEN status = 'Failed' AND attempt <= 2 THEN ts + INTERVAL 2 DAY END,
    CASE WHEN outcome = 'held' THEN true WHEN outcome = 'accepted' THEN false ELSE held END
  FROM (SELECT *, CASE WHEN status = 'Not Started' AND now IS NULL THEN 'accepted'
      WHEN status = 'In Progress' AND now = 'Not Started' AND (not_before IS NULL OR ts >= not_before) THEN 'accepted'
      WHEN status = 'In Progress' AND now = 'Not Started' AND NOT held THEN 'held'
      WHEN status IN ('Completed', 'Failed') AND now = 'In Progress' THEN 'accepted' ELSE 'rejected' END AS outcome
    FROM (SELECT e.*, f.attempt, CASE WHEN f.held AND e.ts >= f.not_before THEN f.not_before END AS released,
        CASE WHEN f.held AND e.ts >= f.not_before THEN 'In Progress' ELSE f.now END AS now,
        CASE WHEN f.held AND e.ts >= f.not_before THEN NULL ELSE f.not_before END AS not_before, f.held AND e.ts < f.not_before AS held
      FROM f JOIN e ON e.doc_id = f.doc_id AND e.rn = f.rn + 1))
), ended AS (SELECT doc_id, arg_max(held, rn) AS held, arg_max(attempt, rn) AS attempt, max(not_before) AS not_before FROM f GROUP BY doc_id),
machine AS (
  SELECT doc_id, event_id, status, ts AS "at", tried AS attempt, outcome FROM f WHERE rn > 0
  UNION ALL SELECT doc_id, NULL, 'In Progress', released, attempt, 'released' FROM (
    SELECT f.doc_id, f.released, p.attempt FROM f JOIN f p ON p.doc_id = f.doc_id AND p.rn = f.rn - 1) WHERE released IS NOT NULL
  UNION ALL SELECT doc_id, NULL, 'In Progress', not_before, attempt, 'released' FROM ended WHERE held AND not_before <= (SELECT max(ts) FROM events)
)
"""


def machine_rows(spark, folder):
    """The events in two intakes, an earlier and a later one, each drained from the same checkpoint: state and timers live on between them."""
    from uuid import uuid4

    from docfields.session import shared_folder
    from docfields.streaming.machine import drain_transitions

    root = f"{shared_folder(spark)}/machine-{uuid4().hex}"
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("doc_id"), "event_id", event_status().alias("status"), F.col("ts").cast("timestamp").alias("at"))
    first = F.col("at") < F.lit("2024-01-16").cast("timestamp")
    for part in (events.filter(first), events.filter(~first)):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        drain_transitions(stream, f"{root}/out", f"{root}/check", backoff_seconds=2 * 86_400).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("doc_id", "event_id", "status", F.timestamp_micros("us").alias("at"), "attempt", "outcome")


@query("q3_transitions", _MACHINE_SQL + 'SELECT doc_id, event_id, status, "at", attempt, outcome FROM machine')
def transitions(spark, folder):
    """Q3, Q7: every event with its outcome, rejected ones included, and the starts that were held back until their time."""
    return machine_rows(spark, folder)


@query("q7_backoff", _MACHINE_SQL + """
SELECT doc_id, count(*) FILTER (WHERE outcome = 'held') AS held, count(*) FILTER (WHERE outcome = 'released') AS released,
  count(*) FILTER (WHERE outcome = 'accepted' AND status = 'Failed') AS failures,
  coalesce(bool_or(outcome = 'accepted' AND status = 'Failed' AND attempt = 3), false) AS given_up FROM machine GROUP BY doc_id
""")
def backoff(spark, folder):
    """Q7 per document: starts held back and released, failed tries, and whether the third failure ended it."""
    kept, failed = F.col("outcome") == "accepted", F.col("status") == S.FAILED
    return machine_rows(spark, folder).groupBy("doc_id").agg(
        F.count_if(F.col("outcome") == "held").alias("held"), F.count_if(F.col("outcome") == "released").alias("released"),
        F.count_if(kept & failed).alias("failures"), F.max(kept & failed & (F.col("attempt") == 3)).alias("given_up"))
