"""Inputs derived from the given tables, once as Spark plans and once as SQL text.

The given tables hold no invoices, so invoice text, word boxes, pages, rules and a processing log are computed
from their keys and columns. Everything grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.functions.text import let, lines_of
from docfields.session import spread

SMUDGED, SMUDGE = "015", "OlS"
KEY_DIGITS, KEY_LETTERS = "0123456789", "BCDFGHJKLM"
HEX, HEX_LETTERS = "0123456789abcdef", "BCDFGHJKLMNPQRST"
STATES = ("TN", "KA", "AP", "KL", "MH", "GJ")
PLACES = ("VILLUPURAM", "HOSUR", "KARUR", "ERODE", "NAMAKKAL")
CITIES = ("CHENNAI", "MADURAI", "VELLORE", "ARAKONAM", "CHROMPET")
MATERIALS = ("OPC 53 GRADE", "OPC 43 GRADE", "PPC 53 GRADE", "PPC 43 GRADE", "P P C", "S R C", "O P C")
MATERIAL_CODES = ("OPC53", "OPC43", "PPC53", "PPC43", "PPC", "SRC", "OPC")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(values, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def pick_sql(values, key: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({key} % {len(values)} + 1 AS INT))"


def padded(c: Column, width: int, fill: str = "0") -> Column:
    return F.lpad(c.cast("string"), width, fill)


def smudge(c: Column) -> Column:
    return F.translate(c, SMUDGED, SMUDGE)


# ---- invoices of format 1/1 --------------------------------------------------------------------------

def invoice_values(spark: SparkSession, folder: str) -> DataFrame:
    """The true values of every order's invoice, as text."""
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint") % 90000 + 10000
    return table(spark, folder, "orders").select(
        k.alias("doc_id"),
        padded(k, 10, "3").alias("invoice_no"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("invoice_date"),
        F.concat(F.translate(padded(F.col("o_custkey"), 6), KEY_DIGITS, KEY_LETTERS), F.lit(" TRADERS")).alias("consignee"),
        (k % 9000 + 1000).cast("string").alias("lr_no"),
        ((k * 982451653 + 12345678901) % 400000000000 + 500000000000).cast("string").alias("eway_no"),
        F.concat(pick(STATES, k), padded(k % 99 + 1, 2), F.translate(padded(k % 89 + 10, 2), KEY_DIGITS, KEY_LETTERS),
                 padded((k * 37 + 11) % 10000, 4)).alias("vehicle"),
        F.concat(F.lit("9"), padded((k * 7 + 1234567) % 1000000000, 9)).alias("mobile"),
        F.concat(F.floor(cents / 100).cast("string"), F.lit("."), padded(cents % 100, 2)).alias("rate"),
        F.concat((k % 40 + 5).cast("string"), F.lit("."), padded((k * 13) % 1000, 3)).alias("weight"),
        pick(PLACES, k).alias("destination"),
        pick(CITIES, k).alias("city"),
        pick(MATERIALS, k).alias("material_text"),
        F.md5(k.cast("string")).alias("irn"),
        F.concat(padded(k % 28 + 1, 2), F.lit("."), padded(k % 12 + 1, 2), F.lit(".2025 "), padded(k % 24, 2),
                 F.lit(":"), padded(k % 60, 2)).alias("expiry"),
        F.when(k % 3 == 0, "PACKED IN BAGS").when(k % 3 == 1, "BULK LOAD").otherwise("LOAD").alias("goods_text"),
    )


INVOICE_SQL = f"""
inv AS (
  SELECT o_orderkey AS doc_id,
    lpad(CAST(o_orderkey AS VARCHAR), 10, '3') AS invoice_no,
    strftime(o_orderdate, '%d.%m.%Y') AS invoice_date,
    translate(lpad(CAST(o_custkey AS VARCHAR), 6, '0'), '{KEY_DIGITS}', '{KEY_LETTERS}') || ' TRADERS' AS consignee,
    CAST(o_orderkey % 9000 + 1000 AS VARCHAR) AS lr_no,
    CAST((o_orderkey * 982451653 + 12345678901) % 400000000000 + 500000000000 AS VARCHAR) AS eway_no,
    {pick_sql(STATES, 'o_orderkey')} || lpad(CAST(o_orderkey % 99 + 1 AS VARCHAR), 2, '0')
      || translate(lpad(CAST(o_orderkey % 89 + 10 AS VARCHAR), 2, '0'), '{KEY_DIGITS}', '{KEY_LETTERS}')
      || lpad(CAST((o_orderkey * 37 + 11) % 10000 AS VARCHAR), 4, '0') AS vehicle,
    '9' || lpad(CAST((o_orderkey * 7 + 1234567) % 1000000000 AS VARCHAR), 9, '0') AS mobile,
    CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 90000 + 10000 AS BIGINT) AS cents,
    CAST(o_orderkey % 40 + 5 AS VARCHAR) || '.' || lpad(CAST((o_orderkey * 13) % 1000 AS VARCHAR), 3, '0') AS weight,
    {pick_sql(PLACES, 'o_orderkey')} AS destination,
    {pick_sql(CITIES, 'o_orderkey')} AS city,
    {pick_sql(MATERIAL_CODES, 'o_orderkey')} AS material,
    md5(CAST(o_orderkey AS VARCHAR)) AS irn,
    lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0')
      || '.2025 ' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS expiry,
    CASE WHEN o_orderkey % 3 = 0 THEN 'BAG' WHEN o_orderkey % 3 = 1 THEN 'BULK' END AS goods_type
  FROM orders),
truth AS (
  SELECT * EXCLUDE (lr_no, city, cents, irn),
    CASE WHEN substr(lr_no, 1, 2) NOT IN ('19', '20') THEN lr_no END AS lr_no,
    CASE city WHEN 'ARAKONAM' THEN 'ARAKKONAM' ELSE city END AS source,
    CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS rate,
    translate(irn, 'OoDIlL|iSsZzBgq', '000111115522899') AS irn
  FROM inv)
"""


def invoices(spark: SparkSession, folder: str) -> DataFrame:
    """Invoice text per order, with look-alike letters in place of some digits."""
    c = F.col

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value)

    text = F.concat_ws(
        "\n",
        F.lit("TAX INVOICE"),
        line("Invoice No: ", smudge(c("invoice_no"))),
        line("Date: ", smudge(c("invoice_date"))),
        F.lit("Name & Address of Recipient:"),
        c("consignee"),
        F.lit("14 MAIN ROAD"),
        F.lit("GSTIN: 33ABCDE1234F1Z5"),
        line("L.R.No/RR No.: ", smudge(c("lr_no"))),
        line("EWB No: ", c("eway_no")),
        line("Vehicle No: ", c("vehicle")),
        line("Driver Mobile ", smudge(c("mobile"))),
        F.concat(F.lit("@ Rs."), smudge(c("rate")), F.lit(" Per MT")),
        F.lit("Particulars Quantity MT"),
        smudge(c("weight")),
        F.concat(F.lit("Destination: "), c("destination"), F.lit(" FROM "), c("city")),
        line("CEMENT ", c("material_text")),
        c("goods_text"),
        line("IRN: ", c("irn")),
        line("Valid Upto: ", smudge(c("expiry"))),
        F.lit("UltraTech Cement Limited"),
    )
    return spread(invoice_values(spark, folder), "doc_id").select("doc_id", text.alias("text"))


# ---- processing log and pages, from events -----------------------------------------------------------

LOG_STATUS = {"view": "Not Started", "click": "Completed", "signup": "In Progress", "purchase": "Completed", "error": "Failed"}
ERP_STATUS = ("Duplicate", " duplicate ", "Fixed", "Not Started", "In Progress", "Completed")


def processing_log(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    status = F.create_map(*[F.lit(x) for kv in LOG_STATUS.items() for x in kv])
    payload = F.concat(F.lit('{"final_data":{"Branch":"B'), (e % 9).cast("string"), F.lit('","No":"'), e.cast("string"), F.lit('"}}'))
    quoted = F.concat(F.lit('"{\\"Branch\\":\\"Q'), (e % 9).cast("string"), F.lit('\\"}"'))
    bare = F.lit("not json")
    return table(spark, folder, "events").select(
        e.alias("doc_id"),
        F.when(e % 10 != 0, (F.col("user_id") % 2 + 1)).cast("int").alias("client_id"),
        F.when(e % 11 != 0, (e % 2 + 1)).cast("int").alias("doc_format_id"),
        F.concat(F.lit("doc_"), e.cast("string"), F.lit("_Invoice_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".pdf")).alias("doc_file_name"),
        F.col("ts").alias("uploaded_on"),
        F.when(e % 4 == 0, "Completed").otherwise("In Progress").alias("overall_status"),
        status[F.col("event_type")].alias("data_extraction_status"),
        F.when(e % 7 < 6, pick(ERP_STATUS, e % 7)).alias("erp_entry_status"),
        F.when(e % 5 == 0, quoted).when(e % 5 == 1, bare).otherwise(payload).alias("extracted_json"),
        F.when(e % 4 == 0, "{}").when(e % 4 == 1, F.lit('{"Branch":"FIXED"}')).when(e % 4 == 2, "").alias("corrected_json"),
        F.when(e % 3 == 0, "image/png").alias("file_mime"),
        F.concat(F.lit("/store/"), e.cast("string"), F.lit(".pdf")).alias("saved_path"),
    )


def _log_case() -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LOG_STATUS.items()) + " END"


LOG_SQL = f"""
log AS (
  SELECT event_id AS doc_id,
    CASE WHEN event_id % 10 != 0 THEN CAST(user_id % 2 + 1 AS INT) END AS client_id,
    CASE WHEN event_id % 11 != 0 THEN CAST(event_id % 2 + 1 AS INT) END AS doc_format_id,
    'doc_' || CAST(event_id AS VARCHAR) || '_Invoice_' || strftime(ts, '%Y%m%d_%H%M%S') || '.pdf' AS doc_file_name,
    ts AS uploaded_on,
    CASE WHEN event_id % 4 = 0 THEN 'Completed' ELSE 'In Progress' END AS overall_status,
    {_log_case()} AS data_extraction_status,
    CASE WHEN event_id % 7 < 6 THEN {pick_sql(ERP_STATUS, '(event_id % 7)')} END AS erp_entry_status,
    CASE WHEN event_id % 5 = 0 THEN '"{{\\"Branch\\":\\"Q' || CAST(event_id % 9 AS VARCHAR) || '\\"}}"'
         WHEN event_id % 5 = 1 THEN 'not json'
         ELSE '{{"final_data":{{"Branch":"B' || CAST(event_id % 9 AS VARCHAR) || '","No":"' || CAST(event_id AS VARCHAR) || '"}}}}' END AS extracted_json,
    CASE event_id % 4 WHEN 0 THEN '{{}}' WHEN 1 THEN '{{"Branch":"FIXED"}}' WHEN 2 THEN '' END AS corrected_json,
    CASE WHEN event_id % 3 = 0 THEN 'image/png' END AS file_mime,
    '/store/' || CAST(event_id AS VARCHAR) || '.pdf' AS saved_path
  FROM events)
"""


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page per event of a user: type from the event type, branch and time from its columns."""
    e = F.col("event_id")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("doc_id"), e.alias("page_no"),
        F.when(F.col("event_type").isin("purchase", "error"), "CONSIGNMENT").otherwise("INVOICE").alias("type"),
        F.when(e % 9 != 0, F.concat(F.lit("BR"), (F.floor(F.col("value")) % 2).cast("string"))).alias("branch"),
        F.when(e % 5 != 0, F.date_format("ts", "dd.MM.yyyy")).alias("invoice_date"),
        F.when(e % 13 != 0, F.date_format(F.date_trunc("month", "ts"), "dd.MM.yyyy HH:mm:ss")).alias("datetime_full"),
        padded(e, 7, "1").alias("gc_number"),
    )


PAGES_SQL = """
pg AS (
  SELECT user_id AS doc_id, event_id AS page_no,
    CASE WHEN event_type IN ('purchase', 'error') THEN 'CONSIGNMENT' ELSE 'INVOICE' END AS type,
    CASE WHEN event_id % 9 != 0 THEN 'BR' || CAST(CAST(floor(value) AS BIGINT) % 2 AS VARCHAR) END AS branch,
    CASE WHEN event_id % 5 != 0 THEN strftime(ts, '%d.%m.%Y') END AS invoice_date,
    CASE WHEN event_id % 13 != 0 THEN strftime(date_trunc('month', ts), '%d.%m.%Y %H:%M:%S') END AS datetime_full,
    lpad(CAST(event_id AS VARCHAR), 7, '1') AS gc_number
  FROM events)
"""


# ---- lines and words, from documents -----------------------------------------------------------------

def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES_SQL = """
ln AS (
  SELECT doc_id, source, CAST(i - 1 AS INT) AS line_no, list_extract(ls, i) AS line
  FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)))
"""


def starts(pieces: Column, step: int = 16) -> Column:
    """Where each piece begins in the text that it was split from by one character. Summed by blocks and then inside a block,
    within the row: no shuffle, and no square of a long line's pieces."""
    def total(sizes: Column) -> Column:
        return F.aggregate(sizes, F.lit(0), lambda a, b: a + b)

    def from_blocks(sizes: Column, blocks: Column) -> Column:
        return let(F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b))), lambda begun: F.transform(
            sizes, lambda _, i: F.get(begun, F.floor(i / step).cast("int")) + total(F.slice(sizes, i - i % step + 1, i % step))))

    return let(F.transform(pieces, lambda p: F.length(p) + 1), lambda sizes: let(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / step).cast("int")), lambda b: total(F.slice(sizes, b * step + 1, F.lit(step)))),
        lambda blocks: from_blocks(sizes, blocks)))


def words(spark: SparkSession, folder: str) -> DataFrame:
    """Word boxes of the documents: 18 units per line with a small jitter, 10 units per character."""
    placed = let(F.split("line", " "), lambda ws: F.arrays_zip(ws.alias("text"), starts(ws).alias("at")))
    w = document_lines(spark, folder).select("doc_id", "line_no", F.posexplode(placed).alias("i", "word"))
    w = w.select("doc_id", "line_no", "i", "word.text", "word.at").filter("text != ''")
    return w.select(
        "doc_id", F.lit(1).alias("page_no"), (F.col("line_no") * 100000 + F.col("i")).alias("word_no"), "text",
        (F.col("at") * 10).alias("left"), (F.col("line_no") * 18 + F.col("i") % 5).alias("top"),
        (F.length("text") * 10).alias("w"), F.lit(12).alias("h"))


WORDS_SQL = LINES_SQL + """,
wd AS (
  SELECT doc_id, 1 AS page_no, CAST(line_no * 100000 + i - 1 AS INT) AS word_no, list_extract(ws, i) AS text,
    CAST(10 * (length(array_to_string(list_slice(ws, 1, i - 1), ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END) AS INT) AS "left",
    CAST(line_no * 18 + (i - 1) % 5 AS INT) AS top, CAST(10 * length(list_extract(ws, i)) AS INT) AS w, 12 AS h
  FROM (SELECT doc_id, line_no, ws, unnest(range(1, len(ws) + 1)) AS i
        FROM (SELECT doc_id, line_no, string_split(line, ' ') AS ws FROM ln))
  WHERE list_extract(ws, i) != '')
"""


# ---- value rules, from part --------------------------------------------------------------------------

RULE_FIELDS = ("Branch", "Source", "Destination", "Consignor", "Consignee", "Vehicle")


def coded_name(key: Column) -> Column:
    """A pseudo-random name: unlike any other name, so the closest rule of a damaged copy is its own."""
    return F.translate(F.substring(F.md5(key.cast("string")), 1, 18), HEX, HEX_LETTERS)


def coded_sql(key: str) -> str:
    return f"translate(substr(md5(CAST({key} AS VARCHAR)), 1, 18), '{HEX}', '{HEX_LETTERS}')"


def value_rules(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, folder, "part").select(
        k.alias("id"), pick(RULE_FIELDS, k).alias("field_name"), coded_name(k).alias("from_value"),
        F.concat(F.lit("PLACE "), k.cast("string")).alias("to_value"),
        F.timestamp_seconds(1700000000 + k).alias("created_at"),
        F.when(k % 3 == 0, F.timestamp_seconds(1700000000 + k * 2)).alias("updated_at"))


RULES_SQL = f"""
vr AS (
  SELECT p_partkey AS id, {pick_sql(RULE_FIELDS, 'p_partkey')} AS field_name, {coded_sql('p_partkey')} AS from_value,
    'PLACE ' || CAST(p_partkey AS VARCHAR) AS to_value,
    CAST(make_timestamp(CAST((1700000000 + p_partkey) * 1000000 AS BIGINT)) AS TIMESTAMP) AS created_at,
    CASE WHEN p_partkey % 3 = 0 THEN CAST(make_timestamp(CAST((1700000000 + p_partkey * 2) * 1000000 AS BIGINT)) AS TIMESTAMP) END AS updated_at
  FROM part)
"""


def field_values(spark: SparkSession, folder: str) -> DataFrame:
    """Extracted values: a rule's name as it is, with one character lost, in lower case, or an unknown name."""
    k, part = F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_partkey")
    name = coded_name(part)
    kind = k % 5
    value = (F.when(kind == 0, name)
             .when(kind == 1, F.concat(F.substring(name, 1, 8), F.substring(name, 10, 18)))
             .when(kind == 2, F.lower(name))
             .when(kind == 3, F.concat(F.lit("UNKNOWN "), (part % 50).cast("string"))))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        pick(RULE_FIELDS, part).alias("field"), value.alias("value"), kind.alias("kind"))


VALUES_SQL = f"""
fv AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {pick_sql(RULE_FIELDS, 'l_partkey')} AS field,
    (l_orderkey * 8 + l_linenumber) % 5 AS kind, {coded_sql('l_partkey')} AS name,
    CASE (l_orderkey * 8 + l_linenumber) % 5
      WHEN 0 THEN {coded_sql('l_partkey')}
      WHEN 1 THEN substr({coded_sql('l_partkey')}, 1, 8) || substr({coded_sql('l_partkey')}, 10)
      WHEN 2 THEN lower({coded_sql('l_partkey')})
      WHEN 3 THEN 'UNKNOWN ' || CAST(l_partkey % 50 AS VARCHAR) END AS value
  FROM lineitem)
"""
