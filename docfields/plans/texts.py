"""Queries over document lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.functions import address as A
from docfields.functions import names as N
from docfields.functions import text as T
from docfields.operators import extract as X
from docfields.operators import lines as L
from docfields.plans import query
from docfields.plans.derive import LINES_SQL, document_lines, pick, pick_sql, table


@query("s7_text_lines", f"WITH {LINES_SQL} SELECT doc_id, line_no, line FROM ln")
def text_lines(spark, folder):
    return L.to_lines(table(spark, folder, "documents"))


@query("w1_merge_text", f"""
WITH {LINES_SQL},
k AS (SELECT source, doc_id AS variant_no, line_no, rtrim(line) AS line, trim(line) AS key FROM ln WHERE trim(line) != ''),
r AS (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY variant_no, line_no) AS rn FROM k)
SELECT source, variant_no, line_no, line FROM r WHERE rn = 1
""")
def merge_text(spark, folder):
    """Documents of a source as variants of one page: equal lines of any variant are kept once, first place wins."""
    rows = document_lines(spark, folder).withColumnRenamed("doc_id", "variant_no")
    return L.merge_lines(rows, ("source",), ("variant_no", "line_no"))


@query("w2_dedupe_lines", f"""
WITH {LINES_SQL},
k AS (SELECT doc_id, line_no, rtrim(line) AS line, regexp_replace(upper(line), '[^A-Z0-9 ]+', '', 'g') AS key FROM ln),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY line_no) AS rn FROM k WHERE key != '')
SELECT doc_id, line_no, line FROM r WHERE rn = 1
""")
def dedupe_lines(spark, folder):
    return L.dedupe_lines(document_lines(spark, folder))


@query("w1_joined_text", f"""
WITH {LINES_SQL}, r AS (SELECT doc_id, line_no, rtrim(line) AS line, row_number() OVER (PARTITION BY doc_id, trim(line) ORDER BY line_no) AS rn FROM ln WHERE trim(line) != '')
SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM r WHERE rn = 1 GROUP BY doc_id
""")
def joined_text(spark, folder):
    kept = L.merge_lines(document_lines(spark, folder), ("doc_id",), ("line_no",))
    return L.join_lines(kept, ("doc_id",), ("line_no",))


_MARKED = """
mk AS (SELECT doc_id, line_no, CASE WHEN (doc_id * 7 + line_no) % 9 = 4 THEN 'State Code: 33' WHEN (doc_id + line_no) % 5 = 3 THEN 'Total ' || line
    WHEN (doc_id + line_no) % 7 = 2 THEN line || ' ;|' WHEN (doc_id + line_no) % 6 = 1 THEN '--' ELSE line END AS line FROM ln)
"""


def marked_lines(spark, folder):
    d, n = F.col("doc_id"), F.col("line_no")
    return document_lines(spark, folder).select("doc_id", "line_no", (
        F.when((d * 7 + n) % 9 == 4, "State Code: 33").when((d + n) % 5 == 3, F.concat(F.lit("Total "), "line"))
        .when((d + n) % 7 == 2, F.concat("line", F.lit(" ;|"))).when((d + n) % 6 == 1, "--").otherwise(F.col("line"))).alias("line"))


@query("r8_noise_lines", f"""
WITH {LINES_SQL}, {_MARKED}
SELECT doc_id, line_no FROM mk WHERE length(trim(line)) < 2 OR line LIKE 'Total %' OR line = '--' OR regexp_full_match(line, '[^0-9A-Za-z_]+')
  OR regexp_matches(line, '(?i)\\b(TAX\\s*INVOICE|EWB\\s*No|Invoice\\s*No|Original\\s*for|Invoice\\s*Date|Total\\s*Invoice)\\b') OR regexp_matches(line, '(?i)^(Particulars|Quantity|Amount|HSN|No of Packages|Total|Tax)')
""")
def noise_lines(spark, folder):
    return marked_lines(spark, folder).filter(A.is_noise_line(F.col("line"))).select("doc_id", "line_no")


@query("r9_stop_lines", f"""
WITH {LINES_SQL}, {_MARKED}
SELECT doc_id, line_no FROM mk WHERE line = 'State Code: 33' OR regexp_matches(line, '(?i)^\\s*(PHONE|STATE|MOB|EMAIL|PH:|PH :)') OR contains(upper(line), 'STATE CODE')
""")
def stop_lines(spark, folder):
    return marked_lines(spark, folder).filter(A.is_stop_line(F.col("line"))).select("doc_id", "line_no")


# the damaged forms are given with their similarity decided by hand: INDIAN 10/11, INXIA 8/10, IDIAXYZW (4+4)/13 < 0.7
_COUNTRY = ("INDIA", "in dia.", "lNDlA", "INXIA", "IDIAXYZW", "KARUR", "North Indiana", "I")
_COUNTRY_YES = (True, True, False, True, False, False, True, False)


@query("r10_country_lines", f"""
SELECT c_custkey, {pick_sql(_COUNTRY, 'c_custkey')} AS line, list_extract([{', '.join(str(v).lower() for v in _COUNTRY_YES)}], CAST(c_custkey % {len(_COUNTRY)} + 1 AS INT)) AS is_country FROM customer
""")
def country_lines(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", pick(_COUNTRY, F.col("c_custkey")).alias("line"))
    return rows.withColumn("is_country", A.is_country_line(F.col("line")))


@query("r11_company_lines", f"""
WITH {LINES_SQL}, {_MARKED}, t AS (SELECT doc_id, line_no, line, upper(line) AS u FROM mk)
SELECT doc_id, line_no FROM t WHERE length(line) > 0
  AND NOT regexp_matches(u, '\\b(GSTIN|GST|STATE|PLACE\\s+OF\\s+SUPPLY|PO\\s*NO(/DATE)?|DATE|EMAIL|MOBILE|PHONE|PAN)\\b')
  AND NOT regexp_matches(u, 'RECIPIENT|ADDRESS|NAME|CONSIGNEE')
  AND (regexp_matches(u, '\\b(PVT|PRIVATE|LTD|LIMITED|LLP|COMPANY|TRADING|CEMENT|ENGINEERS?|AGENCIES|AGENCY|SOLUTIONS|TECH|ENTERPRISES|LOGISTICS|SYSTEMS)\\b')
    OR (trim(u) = trim(line) AND len(list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda x: x != '')) BETWEEN 1 AND 6 AND length(trim(u)) >= 4)
    OR (regexp_matches(line, '[A-Za-z]') AND NOT regexp_matches(line, '[_\\[\\]{{}}]{{2,}}')))
""")
def company_lines(spark, folder):
    return marked_lines(spark, folder).filter(N.is_company_line(F.col("line"))).select("doc_id", "line_no")


@query("f31_alpha_ratio", f"""
WITH {LINES_SQL}
SELECT doc_id, line_no, length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) / CAST(greatest(length(regexp_replace(line, '\\s', '', 'g')), 1) AS DOUBLE) AS ratio FROM ln
""")
def alpha_ratio(spark, folder):
    return document_lines(spark, folder).select("doc_id", "line_no", T.alpha_ratio(F.col("line")).alias("ratio"))


@query("w9_until_stop", f"""
WITH {LINES_SQL}, {_MARKED},
c AS (SELECT doc_id, min(line_no) FILTER (WHERE regexp_matches(line, '(?i)^\\s*(PHONE|STATE|MOB|EMAIL|PH:|PH :)') OR contains(upper(line), 'STATE CODE')) AS cut FROM mk GROUP BY doc_id)
SELECT doc_id, line_no, trim(regexp_replace(trim(line), '\\s*[;|!\\\\/]+$', '')) AS line FROM mk JOIN c USING (doc_id)
WHERE (cut IS NULL OR line_no < cut) AND trim(regexp_replace(trim(line), '\\s*[;|!\\\\/]+$', '')) != ''
""")
def until_stop(spark, folder):
    return L.until_stop(marked_lines(spark, folder), A.is_stop_line(F.col("line")))


@query("w9_joined_address", f"""
WITH {LINES_SQL}, {_MARKED},
c AS (SELECT doc_id, min(line_no) FILTER (WHERE regexp_matches(line, '(?i)^\\s*(PHONE|STATE|MOB|EMAIL|PH:|PH :)') OR contains(upper(line), 'STATE CODE')) AS cut FROM mk GROUP BY doc_id),
k AS (SELECT doc_id, line_no, trim(regexp_replace(trim(line), '\\s*[;|!\\\\/]+$', '')) AS line FROM mk JOIN c USING (doc_id) WHERE cut IS NULL OR line_no < cut)
SELECT doc_id, replace(replace(string_agg(line, chr(1) ORDER BY line_no), ',' || chr(1), ', '), chr(1), ', ') AS address FROM k WHERE line != '' GROUP BY doc_id
""")
def joined_address(spark, folder):
    return L.join_address(L.until_stop(marked_lines(spark, folder), A.is_stop_line(F.col("line"))))


@query("j9_lines_after", f"""
WITH {LINES_SQL}, {_MARKED}
SELECT h.doc_id, h.line_no AS header_line, l.line_no, l.line FROM mk h JOIN mk l ON l.doc_id = h.doc_id AND l.line_no BETWEEN h.line_no + 1 AND h.line_no + 3 WHERE h.line LIKE 'Total %'
""")
def lines_after(spark, folder):
    return L.lines_after(marked_lines(spark, folder), F.startswith("line", F.lit("Total ")), 3)


_BLOCK = """
bk AS (SELECT doc_id, line_no, CASE WHEN (doc_id * 3 + line_no) % 6 IN (4, 5) AND line_no > doc_id % 4 THEN 'PHONE 12' ELSE 'ROW ' || CAST(line_no AS VARCHAR) END AS line FROM ln)
"""


@query("w10_harvest_block", f"""
WITH {LINES_SQL}, {_BLOCK},
s AS (SELECT *, line = 'PHONE 12' AS stop, lag(line = 'PHONE 12') OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM bk),
c AS (SELECT doc_id, min(line_no) FILTER (WHERE stop AND before) AS cut FROM s GROUP BY doc_id),
o AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS row_no FROM s JOIN c USING (doc_id) WHERE NOT stop AND (cut IS NULL OR line_no < cut))
SELECT * FROM o WHERE row_no <= 14
""")
def harvest_block(spark, folder):
    d, n = F.col("doc_id"), F.col("line_no")
    rows = document_lines(spark, folder).select("doc_id", "line_no", F.when(
        ((d * 3 + n) % 6).isin(4, 5) & (n > d % 4), "PHONE 12").otherwise(F.concat(F.lit("ROW "), n.cast("string"))).alias("line"))
    return L.harvest_block(rows, A.STOP_TOKENS)


def _name_lines(spark, folder):
    k = F.col("o_orderkey")
    letters = F.translate(k.cast("string"), "0123456789", "BCDFGHJKLM")
    rows = F.array(
        F.lit("Recipient Address"), F.concat(F.lit("12 MAIN ROAD "), letters),
        F.concat(F.lit("GRAND "), letters, F.lit(" METALS")), F.concat(F.lit("GRAND "), letters, F.lit(" (INDIA) METALS")))
    return table(spark, folder, "orders").select(k.alias("doc_id"), F.posexplode(rows).alias("line_no", "line"))


# the bracketed form scores 15 more for the brackets and more for its length, the road line is an address
@query("w13_best_company", """
SELECT o_orderkey AS doc_id, 'GRAND ' || translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'BCDFGHJKLM') || ' (INDIA) METALS' AS name,
  least((21 + length(CAST(o_orderkey AS VARCHAR))) / 5.0, 10.0) + 35.0 AS score FROM orders
""")
def best_company(spark, folder):
    return L.best_company(_name_lines(spark, folder))


# two capitals stay beside a word with lower-case letters; the line with the smaller letter ratio comes second
@query("w12_salvage_candidate", """
SELECT o_orderkey AS doc_id, 'Grand ' || translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'BCDFGHJKLM') || 'x Stores AB' AS name FROM orders
""")
def salvage_candidate(spark, folder):
    k = F.col("o_orderkey")
    letters = F.translate(k.cast("string"), "0123456789", "BCDFGHJKLM")
    rows = F.array(
        F.lit("Freight payable by consignee 12/34"), F.lit("99 88 77 a/b 123456"),
        F.concat(F.lit("Grand "), letters, F.lit("x Stores AB/12/34")), F.concat(F.lit("1234567890 0987654321 Far "), letters, F.lit("x Goods 12/34")))
    lines = table(spark, folder, "orders").select(k.alias("doc_id"), F.posexplode(rows).alias("line_no", "line"))
    return L.salvage_candidate(lines)


@query("g9_distinct_sources", f"""
WITH c AS (SELECT unnest(range(1, 12)) AS ord, unnest(['ARAKONAM', 'ARAKKONAM', 'CHROMPET', 'CHENNAI', 'TIRUNANIMALI', 'TIRUNINRAVELI', 'VELLORE', 'MADURAI', 'POONAMALLEE', 'SRIPERUMBUDUR', 'SRIERUMBUDUR']) AS city),
t AS (SELECT o_orderkey AS doc_id, 'from ' || {pick_sql(('Chennai', 'Arakonam', 'Madurai', 'nowhere'), 'o_orderkey')} || ' to ' || {pick_sql(('ARAKKONAM', 'VELLORE', 'KARUR', 'CHENNAI', 'X'), 'o_orderkey')} AS text FROM orders)
SELECT doc_id, CASE min_by(city, ord) WHEN 'ARAKONAM' THEN 'ARAKKONAM' ELSE min_by(city, ord) END AS source,
  CAST(count(DISTINCT CASE city WHEN 'ARAKONAM' THEN 'ARAKKONAM' ELSE city END) AS INT) AS cities
FROM t LEFT JOIN c ON contains(upper(text), city) GROUP BY doc_id
""")
def distinct_sources(spark, folder):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("from "), pick(("Chennai", "Arakonam", "Madurai", "nowhere"), k), F.lit(" to "),
                    pick(("ARAKKONAM", "VELLORE", "KARUR", "CHENNAI", "X"), k))
    return table(spark, folder, "orders").select(k.alias("doc_id"), T.cities_in(text).alias("c")).select(
        "doc_id", F.get("c", 0).alias("source"), F.size("c").alias("cities"))


_CANDS = """
cd AS (SELECT l_orderkey AS doc_id, l_returnflag AS field, l_linenumber AS rule_no, l_partkey AS line_no, l_suppkey * 1000000 + CAST(l_extendedprice * 100 AS BIGINT) % 1000000 AS pos,
   'v' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS value FROM lineitem)
"""


def _candidates(spark, folder):
    c = F.col
    return table(spark, folder, "lineitem").select(
        c("l_orderkey").alias("doc_id"), c("l_returnflag").alias("field"), c("l_linenumber").alias("rule_no"), c("l_partkey").alias("line_no"),
        (c("l_suppkey") * 1000000 + F.round(c("l_extendedprice") * 100).cast("bigint") % 1000000).alias("pos"),
        F.concat(F.lit("v"), c("l_partkey").cast("string"), F.lit("-"), c("l_suppkey").cast("string")).alias("value"))


@query("w3_rank_candidates", f"""
WITH {_CANDS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY rule_no, line_no, pos) AS rn FROM cd)
SELECT doc_id, field, value FROM r WHERE rn = 1
""")
def rank_candidates(spark, folder):
    return X.rank_candidates(_candidates(spark, folder))


@query("u1_union_candidates", """
WITH u AS (SELECT c_nationkey AS doc_id, 0 AS source_no, c_custkey AS pos, c_mktsegment AS value FROM customer
  UNION ALL SELECT s_nationkey, 1, s_suppkey, s_name FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source_no, pos) AS rn FROM u)
SELECT doc_id, value FROM r WHERE rn = 1
""")
def union_candidates(spark, folder):
    a = table(spark, folder, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("value"))
    b = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("value"))
    stacked = X.union_candidates(a, b).select("doc_id", F.col("source_no").alias("rule_no"), F.lit(0).alias("line_no"), "pos", "value")
    return X.rank_candidates(stacked, ("doc_id",))


@query("u2_ordered_distinct", """
SELECT c_nationkey AS doc_id, c_mktsegment AS value, CASE WHEN c_mktsegment LIKE 'B%' OR c_mktsegment LIKE 'M%' THEN 0 ELSE 1 END AS preference, 0 AS source_no, min(c_custkey) AS pos
FROM customer GROUP BY 1, 2
""")
def ordered_distinct(spark, folder):
    rows = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("doc_id"), F.lit(0).alias("source_no"), F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("value"))
    return X.ordered_distinct(rows, prefixes=("B", "M"))


@query("j10_known_value_context", """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN '05.06.2025' ELSE '07.08.2025' END AS eway_date FROM orders
""")
def known_value_context(spark, folder):
    k = F.col("o_orderkey")
    known = (k + 100000000000).cast("string")
    other = (k + 200000000000).cast("string")
    # the known number decides; without it the first general form on the line wins
    line = F.concat(other, F.lit(" - 07:08/2025 and "), known, F.lit(" – 05.06:2025"))
    docs = table(spark, folder, "orders").select(k.alias("doc_id"), line.alias("text"), F.when(k % 3 == 0, known).alias("known"))
    return docs.select("doc_id", X.eway_day(F.col("text"), F.col("known")).alias("eway_date"))


@query("w14_material_code", f"""
SELECT p_partkey, {pick_sql(('OPC53', 'PPC', 'SRC', 'OPC43', None), 'p_partkey')} AS code FROM part
""".replace("None", "NULL"))
def first_material(spark, folder):
    text = pick(("x OPC 53 then PPC", "P P C before OPC 43", "S.R.C grade PPC 43", "bags of 43 OPC", "none"), F.col("p_partkey"))
    return table(spark, folder, "part").select("p_partkey", T.material_code(text).alias("code"))


@query("w15_context_guard", """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 4000 + 3000 AS VARCHAR) END AS lr_no FROM orders
""")
def context_guard(spark, folder):
    from docfields.rules import rule_pack

    k = F.col("o_orderkey")
    number = (k % 4000 + 3000).cast("string")
    # the word HSN is within 50 characters of the number for every third document, far away for the others
    gap = F.when(k % 3 == 0, " HSN ").otherwise(F.concat(F.repeat(F.lit("."), 60), F.lit(" HSN ")))
    docs = table(spark, folder, "orders").select(k.alias("doc_id"), F.concat(F.lit("L.R.No/RR No.: "), number, F.lit("\n"), gap).alias("text"))
    return docs.select("doc_id", X.compile_field(rule_pack(1, 1).of("lr_no"), F.col("text")).alias("lr_no"))


@query("w11_longest_prefix_name", """
SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'GRAND ' || t || ' STORES WEST WING' WHEN 1 THEN 'GRAND ' || t || ' STORES' ELSE NULL END AS name
FROM (SELECT o_orderkey, translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'BCDFGHJKLM') || 'KK' AS t FROM orders)
""")
def longest_prefix_name(spark, folder):
    k = F.col("o_orderkey")
    t = F.concat(F.translate(k.cast("string"), "0123456789", "BCDFGHJKLM"), F.lit("KK"))
    first = F.concat(F.lit("GRAND "), t, F.lit(" STORES"))
    second = F.when(k % 3 == 0, "WEST WING").otherwise("12 345")
    block = F.when(k % 3 == 2, F.lit("po 30/11\n9")).otherwise(F.concat_ws("\n", first, second, F.lit("9 9 9")))
    docs = table(spark, folder, "orders").select(k.alias("doc_id"), F.concat(F.lit("Name & Address of Recipient\n"), block).alias("text"))
    return docs.select("doc_id", X.consignee_a(F.col("text")).alias("name"))


@query("r16_derived_columns", """
SELECT o_orderkey AS doc_id, 'N' || o_custkey AS consignee, 'N' || o_custkey AS billing_party, 'Unregistered' AS gst_type, 'PPC' AS material,
  CASE WHEN o_orderkey % 2 = 0 THEN 'UltraTech Cement Limited' END AS consignor FROM orders
""")
def derived_columns(spark, folder):
    from docfields.rules import freight_a

    k = F.col("o_orderkey")
    text = F.when(k % 2 == 0, "of UltraTech CEMENT Limited").otherwise("other")
    docs = table(spark, folder, "orders").select(k.alias("doc_id"), F.concat(F.lit("N"), F.col("o_custkey").cast("string")).alias("consignee"), text.alias("text"))
    return docs.select(
        "doc_id", "consignee", F.col("consignee").alias("billing_party"), F.lit(freight_a.GST_TYPE).alias("gst_type"),
        F.coalesce(T.material_code(F.col("text")), F.lit(freight_a.DEFAULT_MATERIAL)).alias("material"),
        F.when(F.contains(F.upper("text"), F.lit(freight_a.CONSIGNOR_MARK)), freight_a.CONSIGNOR_NAME).alias("consignor"))


@query("r17_goods_type", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'BAG' WHEN 1 THEN 'BULK' WHEN 2 THEN 'BAG' END AS goods_type FROM part
""")
def goods_type(spark, folder):
    text = pick(("500 Bags", "in bulk", "loose and bulk", "baggage"), F.col("p_partkey"))
    return table(spark, folder, "part").select("p_partkey", T.goods_type(text).alias("goods_type"))


@query("r18_product_category", f"""
SELECT p_partkey, {pick_sql(('BOPP BAG', 'GGBS', 'AD STAR', 'UNKNOWN', 'BOPP BAG'), 'p_partkey')} AS category FROM part
""")
def product_category(spark, folder):
    k = F.col("p_partkey")
    region = pick(("l1pp bag", "ggb5", "plain", "plain", "waterguard ggbs"), k)
    page = pick(("ggbs", "lpp", "x ad-star", "none", "ggbs"), k)
    return table(spark, folder, "part").select("p_partkey", T.product_category(region, page).alias("category"))
