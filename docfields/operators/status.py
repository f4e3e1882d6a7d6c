"""Processing log: payload choice, status machines, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docfields.functions.text import iso_time

# --- fixed values ---------------------------------------------------------------------------------
NOT_STARTED, IN_PROGRESS, COMPLETED, FAILED = "Not Started", "In Progress", "Completed", "Failed"
DUPLICATE, COMPLETED_AFTER_REVIEW, FIXED = "Duplicate", "Completed AHR", "FIXED"
MISSING_IDS, NO_FILE, EXTRACT_ERROR = "Failed: Missing IDs", "Failed: No File", "Failed: Extract error"
CLAIMABLE = ("NOT STARTED", "IN PROGRESS", "FIXED")
EMPTY_JSON = ("", "{}", "null")
DEFAULT_MIME = "application/pdf"
# --------------------------------------------------------------------------------------------------

PENDING_COLUMNS = ("doc_id", "doc_file_name", "saved_path", "client_id", "doc_format_id")


def pending_documents(log: DataFrame, ordered: bool = True) -> DataFrame:
    """Documents not started yet, oldest upload first. Null client and format count as 1.

    ``ordered=False`` leaves out the global sort for consumers that do not need it (the stream).
    """
    rows = log.filter(F.col("data_extraction_status") == NOT_STARTED)
    if ordered:
        rows = rows.orderBy("uploaded_on", "doc_id")
    return rows.select(
        "doc_id", "doc_file_name", "saved_path",
        F.coalesce(F.nullif("client_id", F.lit(0)), F.lit(1)).alias("client_id"),
        F.coalesce(F.nullif("doc_format_id", F.lit(0)), F.lit(1)).alias("doc_format_id"))


def next_documents(log: DataFrame, n: int = 1) -> DataFrame:
    """S2."""
    return (log.filter(F.col("data_extraction_status") == NOT_STARTED).orderBy("doc_id").limit(n)
            .select("doc_id", "client_id", "doc_format_id", "doc_file_name", "saved_path",
                    F.coalesce("file_mime", F.lit(DEFAULT_MIME)).alias("file_mime")))


def claim_oldest(log: DataFrame, n: int = 1) -> DataFrame:
    """T3."""
    return (log.filter((F.upper("data_extraction_status") == "COMPLETED") & F.upper("erp_entry_status").isin(*CLAIMABLE))
            .orderBy("uploaded_on", "doc_id").limit(n)
            .select("doc_id", "doc_file_name", F.col("erp_entry_status").alias("prev_erp_entry_status"),
                    "extracted_json", "corrected_json"))


def recent_documents(log: DataFrame, k: int = 20) -> DataFrame:
    """T1."""
    status = F.trim(F.coalesce("erp_entry_status", F.lit("")))
    return (log.orderBy(F.col("uploaded_on").desc(), F.col("doc_id").desc()).limit(k)
            .select("doc_id", F.col("doc_file_name").alias("filename"), iso_time(F.col("uploaded_on")).alias("uploaded_on"),
                    status.alias("erp_entry_status"), "overall_status",
                    status_is(F.col("erp_entry_status"), DUPLICATE).alias("is_duplicate")))


def status_is(status: Column, wanted: str) -> Column:
    """Case-insensitive comparison of a trimmed status; NULL is no match."""
    return F.coalesce(F.upper(F.trim(status)) == wanted.upper(), F.lit(False))


def duplicate_count(log: DataFrame) -> DataFrame:
    """G1."""
    return log.agg(F.count_if(F.upper("erp_entry_status") == DUPLICATE.upper()).alias("duplicate_count"))


def batch_tally(results: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Success and failure per pass with running totals over passes (one row per pass)."""
    per_batch = results.groupBy(batch).agg(
        F.count_if(F.col("status") == COMPLETED).alias("success"), F.count_if(F.col("status") == FAILED).alias("failed"))
    upto = W.orderBy(batch).rowsBetween(W.unboundedPreceding, 0)
    return per_batch.select(batch, "success", "failed", F.sum("success").over(upto).alias("total_success"),
                            F.sum("failed").over(upto).alias("total_failed"))


def _object(text: Column) -> Column:
    """NULL unless the text is a JSON object."""
    return F.when(F.trim(text).startswith("{"), F.try_parse_json(text))


def unwrap_json(column: Column) -> Column:
    """R2: outer quotes and doubled escapes undone; the ``final_data`` object when there is one; ``{}`` if not JSON."""
    text = F.trim(column)
    text = F.when(text.rlike(r'(?s)^".*"$') & (F.length(text) > 1), text.substr(F.lit(2), F.length(text) - 2)).otherwise(text)
    text = F.replace(F.replace(text, F.lit('\\"'), F.lit('"')), F.lit("''"), F.lit("'"))
    inner = F.get_json_object(text, "$.final_data")
    whole = F.when(_object(text).isNotNull(), text)
    return F.coalesce(F.when(inner.startswith("{"), inner), whole, F.lit("{}"))


def pick_payload(column: Column) -> Column:
    """``final_data``, else ``final``, else the payload; empty objects count as absent."""

    def member(name: str) -> Column:
        value = F.get_json_object(column, f"$.{name}")
        return F.when(~F.coalesce(value, F.lit("")).isin("", "{}", "[]", "null", "0", "false"), value)

    return F.coalesce(member("final_data"), member("final"), column)


def used_corrected(previous_status: Column, corrected: Column) -> Column:
    fixed = F.upper(F.trim(F.coalesce(previous_status, F.lit("")))) == FIXED
    return fixed & ~F.trim(F.coalesce(corrected, F.lit(""))).isin(*EMPTY_JSON)


def choose_source_json(previous_status: Column, corrected: Column, extracted: Column) -> Column:
    """R4."""
    return F.when(used_corrected(previous_status, corrected), corrected).otherwise(extracted)


def require_fields(columns: dict[str, Column]) -> Column:
    """Array of failed fields, each with its reason."""
    return F.array_compact(F.array(*[
        F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.struct(F.lit(name).alias("Field"), F.lit("Missing value").alias("Reason")))
        for name, c in columns.items()]))


def validation_status(failed: Column, submitted: Column, error: Column, duplicate: Column) -> Column:
    """D12 as JSON text."""
    plain = F.to_json(F.struct(failed.alias("FailedFields"), F.struct(
        submitted.alias("Submitted"), error.alias("ErrorText")).alias("SubmitResult")))
    dup = F.to_json(F.struct(
        F.array().cast("array<struct<Field:string,Reason:string>>").alias("FailedFields"),
        F.struct(F.lit(False).alias("Submitted"), F.lit("Duplicate detected").alias("ErrorText")).alias("SubmitResult"),
        F.struct(F.lit(True).alias("Detected")).alias("Duplicate")))
    return F.when(duplicate, dup).otherwise(plain)


def erp_status(duplicate: Column, failed_fields: Column, all_ok: Column, submitted: Column, corrected: Column) -> Column:
    """Q4: next ERP status."""
    return (F.when(duplicate, DUPLICATE).when(failed_fields > 0, FAILED)
            .when(all_ok & submitted & corrected, COMPLETED_AFTER_REVIEW)
            .when(all_ok & submitted, COMPLETED).otherwise(IN_PROGRESS))


def overall_status(erp: Column, current: Column) -> Column:
    """Q4: overall status follows a duplicate and a completed entry, and is left alone otherwise."""
    return F.when(erp == DUPLICATE, FAILED).when(erp.isin(COMPLETED, COMPLETED_AFTER_REVIEW), COMPLETED).otherwise(current)


def file_status(log: DataFrame, files: DataFrame) -> DataFrame:
    """S3: bytes by ``saved_path``, else the stored copy; documents without ids or bytes get their failure text."""
    stored = files.select(F.col("path").alias("saved_path"), F.col("content").alias("_disk"))
    body = F.coalesce(F.when(F.length("_disk") > 0, F.col("_disk")), F.when(F.length("file_data") > 0, F.col("file_data")))
    status = (F.when(F.col("client_id").isNull() | F.col("doc_format_id").isNull(), MISSING_IDS)
              .when(F.col("_body").isNull(), NO_FILE).otherwise(IN_PROGRESS))
    return (log.join(stored, "saved_path", "left").withColumn("_body", body)
            .select("doc_id", "client_id", "doc_format_id", "saved_path", F.col("_body").alias("content"), status.alias("status")))


def resolve_paths(log: DataFrame, files: DataFrame, base: str) -> DataFrame:
    """The file of each document by the first strategy that finds one, else the expected path.

    Each strategy is an equi join; the candidates are stacked and the best one is kept by ``min``. Files that share
    a time stamp are first reduced to the smallest name, so a popular stamp does not multiply rows.
    """
    base = base.rstrip("/")
    names = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    in_base = names.filter(F.col("path") == F.concat(F.lit(base + "/"), F.col("name")))
    stamp = r"(\d{8}_\d{6})"
    docs = log.select("doc_id", "saved_path", "doc_file_name")

    def found(keyed: DataFrame, key: Column, order: int, source: DataFrame) -> DataFrame:
        return keyed.withColumn("_key", key).join(source, "_key").select("doc_id", F.lit(order).alias("o"), "path")

    exact = in_base.select(F.col("name").alias("_key"), "path")
    by_stamp = (in_base.filter(F.endswith("name", F.lit(".pdf")))
                .withColumn("_key", F.explode(F.regexp_extract_all("name", F.lit("(?=" + stamp + ")"), F.lit(1))))
                .groupBy("_key").agg(F.min("path").alias("path")))
    parts = [
        found(docs.filter(F.startswith("saved_path", F.lit("/"))), F.col("saved_path"), 1,
              names.select(F.col("path").alias("_key"), "path")),
        found(docs, F.col("doc_file_name"), 2, exact),
        found(docs.filter(F.contains("doc_file_name", F.lit("_Invoice_"))),
              F.replace("doc_file_name", F.lit("_Invoice_"), F.lit("_")), 3, exact),
        found(docs.filter(F.col("doc_file_name").rlike(stamp)), F.regexp_extract("doc_file_name", stamp, 1), 4, by_stamp),
        docs.select("doc_id", F.lit(5).alias("o"), F.concat(F.lit(base + "/"), "doc_file_name").alias("path")),
    ]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    best = F.min(F.struct("o", "path"))
    return stacked.groupBy("doc_id").agg(best.alias("b")).select("doc_id", F.col("b.path").alias("path"), F.col("b.o").alias("strategy"))


def current_status(events: DataFrame) -> DataFrame:
    """Q3: latest event per document."""
    last = F.max_by(F.struct("status", "at", "attempt"), F.struct("at", "attempt"))
    return events.groupBy("doc_id").agg(last.alias("s")).select("doc_id", "s.status", "s.at", "s.attempt")


def notes_of(events: DataFrame) -> DataFrame:
    """Q5: note history as one text per document, oldest first."""
    entry = F.concat(F.lit("\n["), iso_time(F.col("at")), F.lit("] "), F.coalesce("note", "status"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "attempt", entry.alias("entry"))))
    return events.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["entry"]), "").alias("erp_note"))


def retry_plan(events: DataFrame, retries: int = 2, backoff_seconds: int = 5) -> DataFrame:
    """Q7: failed documents that may be tried again, with the attempt number and the earliest time."""
    return (current_status(events).filter((F.col("status") == FAILED) & (F.col("attempt") <= retries))
            .select("doc_id", (F.col("attempt") + 1).alias("attempt"),
                    (F.col("at") + F.make_dt_interval(secs=F.lit(backoff_seconds))).alias("not_before")))
