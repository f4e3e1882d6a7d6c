"""Queries for the scalar functions and the packs of the second client.

Most use text built from each order's key: a few shapes, each filled with the key as letters (``{K}``) or digits
(``{N}``). What comes out is stated as text filled in the same way, or computed by plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions import address as A
from docfields.functions import dates as D
from docfields.functions import names as N
from docfields.functions import plates as P
from docfields.functions import text as T
from docfields.operators import extract as X
from docfields.plans import query
from docfields.plans.derive import INVOICE_SQL, KEY_DIGITS, KEY_LETTERS, invoice_values, table
from docfields.session import spread


def _quoted(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _filled_sql(shapes) -> str:
    letters = f"translate(lpad(CAST(o_orderkey AS VARCHAR), 6, '0'), '{KEY_DIGITS}', '{KEY_LETTERS}')"
    digits = "lpad(CAST(o_orderkey AS VARCHAR), 6, '0')"
    picked = f"list_extract([{', '.join(_quoted(s) for s in shapes)}], CAST(o_orderkey % {len(shapes)} + 1 AS INT))"
    return f"replace(replace(replace(CAST({picked} AS VARCHAR), '{{K}}', {letters}), '{{N}}', {digits}), '{{D}}', right({digits}, 3))"


def _filled(shapes) -> Column:
    k = F.col("o_orderkey")
    digits = F.lpad(k.cast("string"), 6, "0")
    picked = F.element_at(F.array(*[F.lit(s).cast("string") for s in shapes]), (k % len(shapes) + 1).cast("int"))
    named = F.replace(F.replace(picked, F.lit("{K}"), F.translate(digits, KEY_DIGITS, KEY_LETTERS)), F.lit("{N}"), digits)
    return F.replace(named, F.lit("{D}"), F.right(digits, F.lit(3)))


def cases(name: str, function, pairs) -> None:
    """Register a function query: inputs and the stated outputs, one shape per order."""

    @query(name, f"SELECT o_orderkey, {_filled_sql([p[1] for p in pairs])} AS value FROM orders")
    def run(spark, folder):
        rows = table(spark, folder, "orders").select("o_orderkey", _filled([p[0] for p in pairs]).alias("s"))
        return rows.select("o_orderkey", function(F.col("s")).cast("string").alias("value"))


def computed(name: str, function, sql: str, text=("p_name", "p_type"), source: str = "part", key: str = "p_partkey") -> None:
    """Register a function query over table text, with plain SQL for the result."""
    joined_sql = " || ' ' || ".join(text)

    @query(name, f"SELECT {key}, {sql.format(s=f'({joined_sql})')} AS value FROM {source}")
    def run(spark, folder):
        rows = table(spark, folder, source).select(key, F.concat_ws(" ", *text).alias("s"))
        return rows.select(key, function(F.col("s")).alias("value"))


computed("f1_ocr_digits", T.ocr_digits, "translate({s}, 'OoDIlL|iSsZzBgq', '000111115522899')")
computed("f2_ocr_digits_date", T.ocr_digits_date, "translate({s}, 'OoIl|SsB—–‚', '00111558--,')")
computed("f3_ocr_digits_plate", T.ocr_digits_plate, "translate(upper({s}), 'ODI|SBGZ', '00115862')")
computed("f4_ocr_letters", T.ocr_letters, "translate({s}, '8015', 'BDIS')")
computed("f10_clean_plate", P.clean_plate, "regexp_replace(upper({s}), '[^A-Z0-9]', '', 'g')")


@query("f9_distinct_digits", "SELECT o_orderkey, CAST(len(list_distinct(string_split(CAST(o_orderkey * 982451653 AS VARCHAR), ''))) AS INT) AS value FROM orders")
def distinct_digits(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", T.distinct_digits((F.col("o_orderkey") * 982451653).cast("string")).alias("value"))


@query("f5_parse_date_loose", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN CASE WHEN substr(y, 3, 2) >= '69' THEN d || '19' || substr(y, 3, 2) ELSE d || '20' || substr(y, 3, 2) END ELSE d || y END AS value
FROM (SELECT o_orderkey, strftime(o_orderdate, '%d.%m.') AS d, strftime(o_orderdate, '%Y') AS y FROM orders)
""")
def parse_date_loose(spark, folder):
    k = F.col("o_orderkey") % 6
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    s = (F.when(k == 0, day).when(k == 1, F.translate(day, "015", "OlS")).when(k == 2, F.date_format("o_orderdate", "d - M - yyyy"))
         .when(k == 3, F.date_format("o_orderdate", "d/M/yyyy")).when(k == 4, F.date_format("o_orderdate", "31.02.yyyy"))
         .otherwise(F.date_format("o_orderdate", "dd-MM-yy")))
    return table(spark, folder, "orders").select("o_orderkey", D.parse_date_loose(s).alias("value"))


@query("f6_partial_date", "SELECT o_orderkey, '01.' || strftime(o_orderdate, '%m.%Y') AS value FROM orders")
def partial_date(spark, folder):
    s = F.concat(F.lit("Dt x"), F.when(F.col("o_orderkey") % 2 == 0, ".").otherwise("/"), F.date_format("o_orderdate", "MM"),
                 F.when(F.col("o_orderkey") % 2 == 0, ".").otherwise("-"), F.date_format("o_orderdate", "yyyy"))
    return table(spark, folder, "orders").select("o_orderkey", D.partial_date(s).alias("value"))


_MOMENT_SQL = "strftime(ts, '%-d.%-m.%Y %-H:%M:%S')"


@query("f7_invoice_datetime", f"""
SELECT event_id, CASE event_id % 4 WHEN 2 THEN NULL ELSE {_MOMENT_SQL} END AS value, CASE event_id % 4 WHEN 2 THEN NULL ELSE strftime(ts, '%-d.%-m.%Y') END AS day FROM events
""")
def invoice_datetime(spark, folder):
    e = F.col("event_id") % 4
    s = F.date_format("ts", "d.M.yyyy H:mm:ss")
    text = F.when(e == 0, s).when(e == 1, F.translate(s, "015", "OIS")).when(e == 2, F.regexp_replace(s, r"^\d+\.\d+\.", "31.2.")).otherwise(
        F.replace(s, F.lit(" "), F.lit("   ")))
    return table(spark, folder, "events").select("event_id", D.parse_invoice_datetime(text).alias("value"), D.invoice_date_part(text).alias("day"))


_N12 = "CAST((o_orderkey * 982451653 + 12345678901) % 900000000000 + 100000000000 AS VARCHAR)"


@query("f8_looks_like_datetime", f"""
WITH n AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d%m') || '2025' || lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0')
    WHEN 1 THEN '2022' || strftime(o_orderdate, '%m%d') || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 90 AS VARCHAR), 2, '0') ELSE {_N12} END AS n FROM orders),
p AS (SELECT *, CAST(substr(n, 1, 2) AS INT) a, CAST(substr(n, 3, 2) AS INT) b, CAST(substr(n, 5, 4) AS INT) y, CAST(substr(n, 9, 2) AS INT) h, CAST(substr(n, 11, 2) AS INT) m,
    CAST(substr(n, 1, 4) AS INT) y0, CAST(substr(n, 5, 2) AS INT) m0, CAST(substr(n, 7, 2) AS INT) d0 FROM n)
SELECT o_orderkey, n, (a BETWEEN 1 AND 31 AND b BETWEEN 1 AND 12 AND y BETWEEN 2020 AND 2030 AND h <= 23 AND m <= 59)
  OR (a BETWEEN 1 AND 12 AND b BETWEEN 1 AND 31 AND y BETWEEN 2020 AND 2030 AND h <= 23 AND m <= 59)
  OR (y0 BETWEEN 2020 AND 2030 AND m0 BETWEEN 1 AND 12 AND d0 BETWEEN 1 AND 31 AND h <= 23 AND m <= 59)
  OR contains(n, '2020') OR contains(n, '2023') OR contains(n, '2024') OR contains(n, '2025') OR contains(n, '2026')
  OR len(list_distinct(string_split(n, ''))) <= 3
  OR len(list_filter(range(1, 12), lambda i: abs(CAST(substr(n, i, 1) AS INT) - CAST(substr(n, i + 1, 1) AS INT)) <= 1)) >= 8
  OR (h <= 23 AND m <= 59 AND substr(n, 5, 3) = '202') AS is_datetime
FROM p
""")
def looks_like_datetime(spark, folder):
    k = F.col("o_orderkey")
    n = (F.when(k % 3 == 0, F.concat(F.date_format("o_orderdate", "ddMM"), F.lit("2025"), F.lpad((k % 30).cast("string"), 2, "0"), F.lpad((k % 60).cast("string"), 2, "0")))
         .when(k % 3 == 1, F.concat(F.lit("2022"), F.date_format("o_orderdate", "MMdd"), F.lpad((k % 24).cast("string"), 2, "0"), F.lpad((k % 90).cast("string"), 2, "0")))
         .otherwise(((k * 982451653 + 12345678901) % 900000000000 + 100000000000).cast("string")))
    return table(spark, folder, "orders").select("o_orderkey", n.alias("n")).withColumn("is_datetime", D.looks_like_datetime(F.col("n")))


# plates: numbers come from the key, look-alikes are put where the repair undoes them
_D4 = "lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')"


@query("f11_normalize_plate", f"""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'TN45B8' || {_D4} WHEN 1 THEN 'TN18K' || {_D4} WHEN 2 THEN 'KA1AN' || {_D4} WHEN 3 THEN 'KA01ABS' || {_D4} ELSE 'TN18K' || {_D4} END AS value FROM orders
""")
def normalize_plate(spark, folder):
    k = F.col("o_orderkey")
    d4 = F.lpad((k % 10000).cast("string"), 4, "0")
    bad = F.translate(d4, "015", "OIS")
    s = (F.when(k % 5 == 0, F.concat(F.lit("FN4SB8"), bad)).when(k % 5 == 1, F.concat(F.lit("TN118K"), d4))
         .when(k % 5 == 2, F.concat(F.lit("KA1AN"), bad)).when(k % 5 == 3, F.concat(F.lit("KAOIAB5"), bad)).otherwise(F.concat(F.lit("TN11BK"), d4)))
    return table(spark, folder, "orders").select("o_orderkey", P.normalize_plate_v1(s).alias("value"))


@query("f12_normalize_plate_second", f"""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'AP39BS' || {_D4} WHEN 1 THEN 'AP39W' || {_D4} WHEN 2 THEN 'KA1AN' || {_D4} ELSE 'TN28BKI' || {_D4} END AS value FROM orders
""")
def normalize_plate_second(spark, folder):
    k = F.col("o_orderkey")
    bad = F.translate(F.lpad((k % 10000).cast("string"), 4, "0"), "0158", "OISB")
    s = (F.when(k % 4 == 0, F.concat(F.lit("RP-39-85"), bad)).when(k % 4 == 1, F.concat(F.lit("kp39W"), bad))
         .when(k % 4 == 2, F.concat(F.lit("KAIAN"), bad)).otherwise(F.concat(F.lit("TN28BK1"), bad)))
    return table(spark, folder, "orders").select("o_orderkey", P.normalize_plate_v2(s).alias("value"))


cases("f13_shrink_plate", P.shrink_plate, [
    ("MP01LQR4{D}", "MP01QR4{D}"), ("GJ27XYS5{D}", "GJ27XY5{D}"), ("HR38WV6{D}", "HR38WV6{D}"), ("GJ27XYZ55{D}", "GJ27XYZ55{D}"),
    ("GJ27XS55{D}", "GJ27XS5{D}"), ("MP01LQRD0{D}", "MP01QR0{D}"),
])


@query("f14_valid_plate", """
SELECT o_orderkey, list_extract([true, false, true, false, false, true], CAST(o_orderkey % 6 + 1 AS INT)) AS value FROM orders
""")
def valid_plate(spark, folder):
    k = F.col("o_orderkey")
    d4 = F.lpad((k % 10000).cast("string"), 4, "0")
    s = F.element_at(F.array(
        F.concat(F.lit("TN 45 BQ "), d4), F.concat(F.lit("T4"), d4), F.concat(F.lit("ka01an"), F.translate(d4, "0", "O")),
        F.concat(F.lit("TN45BQXY"), d4, d4), F.lit("INVOICE"), F.concat(F.lit("TN-4S-8Q-"), d4)), (k % 6 + 1).cast("int"))
    return table(spark, folder, "orders").select("o_orderkey", P.valid_plate(s).alias("value"))


cases("f15_clean_destination", T.clean_destination, [
    ("DESTINATION: {K} (near {N}) JESPATCH", "{K}"), (" {K} - south / ward {N}", "{K}-SOUTH/WARD {N}"), ("{K} YES PATCH.", "{K}"), ("(only)", None),
    ("destination {K}*{N}", "{K} {N}"),
])
cases("f16_clean_consignee", N.clean_consignee, [
    ("| - {K} Stores;", "{K} Stores"), ("Pvt. Ltd", None), ("12 34 {N} ab", None), ("Grand {K} Grand {K}", "Grand {K}"), ("#{K}  Mills*", "{K} Mills"),
])
cases("f17_collapse_repeat", N.collapse_repeat, [
    ("Grand {K} Grand {K}", "Grand {K}"), ("AB {K} Mills AB {K} Mills East", "AB {K} Mills"), ("Old {K} House (West", "Old {K} House"),
    ("One {K} Two Three", "One {K} Two Three"), ("x {K} STORES / {K} STORES y", "{K} STORES"),
])
cases("f18_clean_company_line", N.clean_company_line, [
    ("GRAND {K} PRIVATE LIMITED GSTIN 33", "GRAND {K} PRIVATE LIMITED"), ("{K} STORES SL/4D/23-24 ~~", "{K} STORES"), ("T RS {K} FRADERS", "T R S {K} TRADERS"),
    ("{K} AGENCIES PO", "{K} AGENCIES"), ("12", None), ("{K} WORKS I", "{K} WORKS"),
])
cases("f19_simple_cleanup", N.simple_cleanup, [
    ("Grand {K} Stores | AB/12/34 ==", "Grand {K} Stores AB"), ("123 456", None), ("Grand Grand {K} Stores", "Grand {K} Stores"), ("XY Z9 {K} Mills 2024", "Z {K} Mills"),
    ("Old {K} Town Hall near Old {K} Town Hall", "near Old {K} Town Hall"),
])
cases("f21_name_confidence", lambda s: F.round(N.name_confidence(s) * 100).cast("int"), [
    ("{K} LIMITED", "95"), ("{K}", "60"), ("{N}", "0"), ("{K} {K}", "70"),
])
cases("f22_company_score", lambda s: F.round(N.company_score(s) * 10).cast("int"), [
    ("{K} LIMITED", "228"), ("{K} ROAD LTD", "130"), (") {K}", "-184"), ("{K} (INDIA) STEEL", "290"),
])
cases("f23_money", T.money, [("1,234.5", "1234.50"), ("Rs 7{N}.1", "7{N}.10"), ("none", None)])
cases("f24_strip_headers", lambda s: A.strip_header_words(A.strip_headers_anywhere(A.strip_header_fragments(s))), [
    ("Name & Address of Delivery: {K} House", "{K} House"), ("Ship to {K}", "{K}"), ("Delivery Address", None), ("{K} & Co, name, road", "{K} Co, road"),
])
cases("f25_fix_address_text", A.fix_address_text, [
    ("{K}|East\tDNO {N}", "{K},East D NO: {N}"), ("D {N} Road ,,", "D NO: {N} Road"), ("a , , b {K}", "a,  b {K}"),
])
cases("f26_local_cleanup", A.local_address_cleanup, [
    ("Plot7 mettu puram, uppal {N}", "Plot7 Mettupuram, Uppal {N}"), ("lotus nagar 12.05.2025, {N}", "Lotusnagar, {N}"),
    ("Name & Address of Delivery: v. erukkal {N}", "Verukkal {N}"),
])
cases("f27_trailing_noise", T.trailing_noise_2, [("..{K} LIMITED x", "{K} LIMITED"), ("{K} *!", "{K}"), ("ab", "ab"), ("{K}-{N} #", "{K}-{N}")])
cases("f27_trailing_noise_first", T.trailing_noise_1, [("..{K} LIMITED x", "..{K} LIMITED"), ("{K} *!", "{K}"), ("{K} B", "{K} B"), ("{K} 9", "{K}")])
cases("f28_merge_split_letters", T.merge_split_letters, [("O P C {N}", "OPC {N}"), ("P P {N}", "PP {N}"), ("{K} AB", "{K} AB")])
cases("f29_flexible_pattern", lambda s: T.hit(s, "(?i)" + T.flexible_pattern("EWB") + r"\D*(\d+)"), [
    ("E.W.B {N}", "{N}"), ("e w_b: {N}", "{N}"), ("EXB {N}", None), ("EWB{N}", "{N}"),
])
cases("f32_tax_numbers", lambda s: F.concat_ws("/", T.pan_number(s), T.gst_number(s)), [
    ("PAN NO: QWXYZ4821K", "QWXYZ4821K"), ("GSTIN: 33QWXYZ4821K1Z3", "33QWXYZ4821K1Z3"), ("GST NO: 33{K}{N}A", "33{K}{N}A"),
    ("GST NO: ABCDE1234567890 {K}", ""),
])
cases("f33_repair_weight", T.repair_weight, [("12,341", "12.340"), ("x 8.755", "8.755"), ("{N}", "{N}"), (".551 MT", ".550"), ("none", None)])
cases("r12_valid_company", N.is_valid_company, [
    ("{K} LIMITED", "true"), ("{K}", "false"), ("a b c d e f g", "false"), ("{K}{K} (INDIA)", "true"), ("{K} west wing", "true"), ("lower case", "true"),
])
cases("r13_suffix_only", N.is_suffix_only, [("Pvt. Ltd", "true"), ("{K} Ltd", "false"), ("ab co", "true"), ("{K}", "false")])
cases("r14_needs_review", N.needs_review, [
    ("Pvt Ltd {K}", "true"), ("Ab", "true"), (None, "true"), ("Liiimited Mills {N}", "true"), ("Grand Mills {N}", "false"),
])


# ---- format 1/2 and the second client ----------------------------------------------------------------

@query("p16_second_format", f"""
WITH {INVOICE_SQL}
SELECT doc_id, lr_no AS "Consignment No", source AS "Source", destination AS "Destination", eway_no AS "E-Way Bill No",
  CASE WHEN doc_id % 2 = 0 THEN expiry_day ELSE invoice_date END AS "E-Way Bill Date", consignee AS "Consignee", vehicle AS "Vehicle",
  mobile AS "Driver Mobile", 'CN' || substr(invoice_no, 2) AS "Invoice No", invoice_date AS "Invoice Date", material AS "Content Name (Goods Name)",
  weight AS "Actual Weight", rate AS "Rate", 'Unregistered' AS "GST Type", goods_type
FROM (SELECT *, substr(expiry, 1, 10) AS expiry_day FROM truth)
""")
def second_format(spark, folder):
    c = F.col
    text = F.concat_ws(
        "\n", F.concat(F.lit("Invoice No : CN"), F.substring("invoice_no", 2, 10)), F.concat(F.lit("Dated: "), F.translate("invoice_date", ".", "/")),
        F.concat(F.lit("EWB No: "), c("eway_no")), F.when(c("doc_id") % 2 == 0, F.concat(F.lit("EWB Date: "), F.substring("expiry", 1, 10))),
        F.lit("Ship To:"), c("consignee"), F.lit("Road 4"), F.concat(F.lit("Vehicle No: "), c("vehicle")),
        F.concat(F.lit("L.R.No/RR No.: "), c("lr_no")), F.concat(F.lit("Mobile "), c("mobile")), F.concat(F.lit("@ Rs."), c("rate"), F.lit(" Per MT")),
        F.concat(F.lit("TOTAL | "), c("weight"), F.lit(" | (in MT)")), F.concat(F.lit("Destination: "), c("destination"), F.lit(" FROM "), c("city")),
        F.concat(F.lit("CEMENT "), c("material_text")), c("goods_text"))
    docs = spread(invoice_values(spark, folder), "doc_id").select("doc_id", text.alias("text"))
    return X.extract_fields(docs, 1, 2)


_BRANCHES = ("POTTANERI", "NANDYAL", "VIJAPUR", "DOLVI")
_PAGE_SQL = f"""
pv AS (SELECT doc_id, list_extract([{', '.join(repr(b) for b in _BRANCHES)}], CAST(doc_id % 4 + 1 AS INT)) AS branch, destination, vehicle, eway_no, expiry,
  ltrim(substr(expiry, 1, 2), '0') || '.' || ltrim(substr(expiry, 4, 2), '0') || '.2025' AS day FROM truth)
"""


def _pages(spark, folder):
    """Invoice pages of the second client, with labels damaged in several ways."""
    from docfields.plans.derive import pick
    c, k = F.col, F.col("doc_id")
    branch = pick(_BRANCHES, k)
    day = F.concat(F.ltrim(F.substring("expiry", 1, 2), F.lit("0")), F.lit("."), F.ltrim(F.substring("expiry", 4, 2), F.lit("0")), F.lit(".2025"))
    damaged = F.concat(F.substring(branch, 1, 4), F.substring(branch, 6, 20))
    text = F.concat_ws(
        "\n",
        F.when(k % 3 == 0, F.concat(F.lit("POST: "), branch, F.lit(", TK: METTUR"))).when(k % 3 == 1, F.concat(F.lit("OST: "), branch, F.lit(", TK: METTUR")))
        .otherwise(F.concat(F.lit("POST: "), damaged, F.lit(", TK: METTUR"))),
        F.concat(F.when(k % 2 == 0, "Invoice Date/Time").otherwise("Inv Date Time"), F.lit("  "), day, F.lit(" 06:55:38")),
        F.concat(F.lit("Dispatch To "), c("destination"), F.lit(" Incoterms")),
        F.concat(F.when(k % 5 == 0, "V6hicle No ").otherwise("Vehicle No : "), c("vehicle")),
        F.concat(F.when(k % 2 == 0, "E-Way No/Validity : ").otherwise("xx "), c("eway_no"), F.lit(" - "), F.translate(F.substring("expiry", 1, 10), ".", ":")),
        F.lit("JSW CEMENT LIMITED - SALEM works"), F.lit("PAN NO: QWXYZ4821K"), F.lit("GSTIN: 33QWXYZ4821K1Z3"), F.lit("PSC L1PP BAG"))
    return spread(invoice_values(spark, folder), "doc_id").select("doc_id", text.alias("text"))


@query("p17_p24_second_client_pages", f"""
WITH {INVOICE_SQL}, {_PAGE_SQL}
SELECT doc_id, branch, day AS invoice_date, destination,
  vehicle AS vehicle_no, eway_no AS eway_bill_no, substr(expiry, 1, 10) AS eway_date, 'QWXYZ4821K' AS pan_no, '33QWXYZ4821K1Z3' AS gst_no,
  'BOPP BAG' AS product_category, 'JSW CEMENT LTD-POTTANERI' AS consignor
FROM pv
""")
def second_client_pages(spark, folder):
    return X.extract_fields(_pages(spark, folder), 2, 2)


@query("p23_branch", f"""
WITH {INVOICE_SQL}, {_PAGE_SQL} SELECT doc_id, branch FROM pv
""")
def branch(spark, folder):
    return X.extract_fields(_pages(spark, folder), 2, 2).select("doc_id", "branch")


@query("p17_destination_damaged_label", f"""
WITH {INVOICE_SQL} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN destination ELSE 'New ' || destination END AS destination FROM truth
""")
def destination_damaged(spark, folder):
    k = F.col("doc_id")
    text = F.concat(F.when(k % 2 == 0, "x Dispatch To: ").otherwise("goods D1spateh Too New "), F.col("destination"), F.lit(" Incoterms for-door"))
    docs = spread(invoice_values(spark, folder), "doc_id").select("doc_id", text.alias("text"))
    return X.with_similar_labels(docs.withColumn("destination", X.destination_c(F.col("text"))).withColumn("vehicle_no", F.lit("x"))
                                 .withColumn("consignor", F.lit("x"))).select("doc_id", "destination")


# a readable label, a damaged one, a damaged one with the plate on the next line (not its plate), and one with words between
@query("p18_vehicle_damaged_label", f"WITH {INVOICE_SQL} SELECT doc_id, CASE WHEN doc_id % 4 != 2 THEN vehicle END AS vehicle_no FROM truth")
def vehicle_damaged(spark, folder):
    k = F.col("doc_id") % 4
    label = (F.when(k == 0, "Vehicle No. : ").when(k == 1, "x V6hic1e N0 ").when(k == 2, "x V6hic1e N0\n")
             .otherwise("x V6hic1e N0 as seen at the gate of the yard by our own man there "))
    text = F.concat(F.lit("old v1\n"), label, F.col("vehicle"))
    from docfields.rules import rule_pack

    docs = spread(invoice_values(spark, folder), "doc_id").select("doc_id", text.alias("text"))
    labelled = X.compile_field(rule_pack(2, 2).of("vehicle_no"), F.col("text"))
    return X.with_similar_labels(docs.withColumn("vehicle_no", labelled).withColumn("destination", F.lit("x"))
                                 .withColumn("consignor", F.lit("x"))).select("doc_id", "vehicle_no")


@query("p20_consignor_damaged", f"""
WITH {INVOICE_SQL} SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'JSW CEMENT LTD-NANDYAL' WHEN 2 THEN 'JSW CEMENT LTD' WHEN 4 THEN 'JSW CEMENT LTD-NANDYAL' ELSE 'JSW CEMENT LTD-POTTANERI' END AS consignor FROM truth
""")
def consignor_damaged(spark, folder):
    from docfields.plans.derive import pick

    text = pick(("from JSVCL, Salem", "SALEM road\nJSW plant Nandyal", "nothing here", "other works, salem",
                 "JSVCL works Nandyal\nJSW CEMENT LIMITED Salem", "JSWCL Salim"), F.col("doc_id"))
    docs = spread(invoice_values(spark, folder), "doc_id").select("doc_id", text.alias("text"))
    return X.with_similar_labels(docs.withColumn("vehicle_no", F.lit("x")).withColumn("destination", F.lit("x"))
                                 .withColumn("consignor", F.lit(None).cast("string"))).select("doc_id", "consignor")


@query("p19_eway_labels", f"WITH {INVOICE_SQL} SELECT doc_id, eway_no AS value FROM truth")
def eway_labels(spark, folder):
    from docfields.rules import rule_pack

    k = F.col("doc_id")
    n = F.col("eway_no")
    text = (F.when(k % 3 == 0, F.concat(F.lit("E-Wway No : "), n)).when(k % 3 == 1, F.concat(F.lit("number "), n))
            .otherwise(F.concat(F.lit("E-Way Bill No "), F.translate(n, "0158", "OISB"))))
    docs = invoice_values(spark, folder).select("doc_id", text.alias("text"))
    return docs.select("doc_id", X.compile_field(rule_pack(2, 2).of("eway_bill_no"), F.col("text")).alias("value"))


@query("p21_eway_date", f"WITH {INVOICE_SQL} SELECT doc_id, substr(expiry, 1, 10) AS value FROM truth")
def eway_date(spark, folder):
    k = F.col("doc_id")
    day = F.translate(F.substring("expiry", 1, 10), ".", ":")
    text = F.when(k % 2 == 0, F.concat(F.lit("x\nValidity up to "), day)).otherwise(F.concat(F.col("eway_no"), F.lit(" - "), day))
    return invoice_values(spark, folder).select("doc_id", X.eway_day(text).alias("value"))


@query("p22_consignee_address", """
SELECT o_orderkey AS doc_id, 'GRAND ' || t AS consignee, '12 Cross ' || t || ', Hosur, INDIA' AS address FROM (
  SELECT o_orderkey, translate(lpad(CAST(o_orderkey AS VARCHAR), 6, '0'), '0123456789', 'BCDFGHJKLM') AS t FROM orders)
""")
def consignee_address(spark, folder):
    """First line under the header is the name; the rest up to the country line is the address."""
    from docfields.operators.records import consignee_block

    k = F.col("o_orderkey")
    t = F.translate(F.lpad(k.cast("string"), 6, "0"), KEY_DIGITS, KEY_LETTERS)
    rows = F.array(F.concat(F.lit(".GRAND "), t, F.lit(" x")), F.concat(F.lit("12 Cross "), t, F.lit(", ;|")), F.lit("Hosur"),
                   F.when(k % 2 == 0, "INDIA").otherwise("INXIA"), F.lit("State 33"))
    lines = table(spark, folder, "orders").select(k.alias("doc_id"), F.posexplode(rows).alias("line_no", "line"))
    return consignee_block(lines, ("doc_id",)).withColumnRenamed("delivery_address", "address")


@query("v1_registered_pack", """
SELECT o_orderkey AS doc_id, o_orderpriority AS priority FROM orders
""")
def registered_pack(spark, folder):
    """V1/V2: a pack registered by a user runs like the built-in ones."""
    from docfields.rules import numbered, register_rule_pack

    register_rule_pack(7, 1, numbered(7, 1, "priority", [r"Prio: ([^\n]+)"]))
    docs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("x\nPrio: "), "o_orderpriority", F.lit("\ny")).alias("text"))
    return X.extract_fields(docs, 7, 1)
