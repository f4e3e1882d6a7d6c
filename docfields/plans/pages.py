"""Queries over pages and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.operators import pages as P
from docfields.operators import quality as Q
from docfields.plans import query
from docfields.plans.derive import INVOICE_SQL, PAGES_SQL, invoice_values, pages, table


@query("r7_classify_page", """
SELECT conv_id, bool_or(contains(upper(t), 'CONSIGNMENT') AND contains(upper(t), 'NOTE')) AS is_note,
  CASE WHEN bool_or(contains(upper(t), 'CONSIGNMENT') AND contains(upper(t), 'NOTE')) THEN 'CONSIGNMENT' ELSE 'INVOICE' END AS type
FROM (SELECT conv_id, CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN 'Consignment ' || text || ' note' WHEN conv_id % 3 = 1 THEN 'consignment ' || text ELSE text END AS t FROM conversations)
GROUP BY conv_id
""")
def classify_page(spark, folder):
    c, t = F.col("conv_id"), F.col("text")
    texts = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when((c % 3 == 0) & (F.col("turn") == 1), F.concat(F.lit("Consignment "), t, F.lit(" note")))
        .when(c % 3 == 1, F.concat(F.lit("consignment "), t)).otherwise(t).alias("text"))
    return P.classify_pages(texts, ("conv_id",)).withColumn("is_note", F.col("type") == "CONSIGNMENT")


@query("w4_best_variant", f"""
WITH {PAGES_SQL},
v AS (SELECT doc_id, page_no // 4 AS page, page_no % 4 AS ord, CASE WHEN page_no % 6 != 0 THEN branch END AS branch,
    CASE WHEN page_no % 3 = 0 THEN invoice_date END AS invoice_date,
    CASE page_no % 5 WHEN 0 THEN 'invoice dispatch' WHEN 1 THEN 'vehicle' WHEN 2 THEN 'invoice dispatch vehicle' ELSE 'plain' END AS text FROM pg),
s AS (SELECT *, 2 * (branch IS NOT NULL)::INT + 2 * (invoice_date IS NOT NULL)::INT + contains(text, 'invoice')::INT + contains(text, 'dispatch')::INT + contains(text, 'vehicle')::INT AS score,
    branch IS NOT NULL AND invoice_date IS NOT NULL AS perfect FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN perfect THEN 0 ELSE 1 END, CASE WHEN perfect THEN ord END, score DESC, ord) AS rn FROM s)
SELECT doc_id, page, ord, branch, invoice_date, text, score FROM r WHERE rn = 1
""")
def best_variant(spark, folder):
    n = F.col("page_no")
    v = pages(spark, folder).select(
        "doc_id", F.floor(n / 4).alias("page"), (n % 4).alias("ord"), F.when(n % 6 != 0, F.col("branch")).alias("branch"),
        F.when(n % 3 == 0, F.col("invoice_date")).alias("invoice_date"),
        F.when(n % 5 == 0, "invoice dispatch").when(n % 5 == 1, "vehicle").when(n % 5 == 2, "invoice dispatch vehicle").otherwise("plain").alias("text"))
    return P.best_variant(v, ("doc_id", "page"))


@query("w5_collapse_continuations", f"""
WITH {PAGES_SQL},
m AS (SELECT doc_id, page_no, branch, invoice_date, datetime_full FROM pg WHERE invoice_date IS NOT NULL OR branch IS NOT NULL),
l AS (SELECT *, lag(page_no) OVER w AS pp, lag(datetime_full) OVER w AS pd, lag(branch) OVER w AS pb FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY page_no)),
c AS (SELECT *, pp IS NOT NULL AND pd IS NOT DISTINCT FROM datetime_full AND pb IS NOT DISTINCT FROM branch AS is_continuation FROM l)
SELECT doc_id, page_no, branch, invoice_date, datetime_full, is_continuation,
  CAST(sum(CASE WHEN is_continuation THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page_no) AS BIGINT) AS invoice_seq FROM c
""")
def collapse_continuations(spark, folder):
    return P.collapse_continuations(pages(spark, folder).drop("type", "gc_number"))


@query("j5_pair_pages", f"""
WITH {PAGES_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY page_no) AS rank FROM pg)
SELECT i.doc_id, i.rank, i.page_no, i.branch, i.invoice_date, i.datetime_full, c.page_no AS consignment_page, c.gc_number AS consignment_no
FROM r i LEFT JOIN r c ON c.doc_id = i.doc_id AND c.rank = i.rank AND c.type = 'CONSIGNMENT' WHERE i.type = 'INVOICE'
""")
def pair_pages(spark, folder):
    return P.pair_pages(pages(spark, folder))


@query("g3_page_counts", """
SELECT l_orderkey AS doc_id, count(*) AS total_pages, count(*) FILTER (WHERE l_linestatus = 'F') AS invoice_pages,
  count(*) FILTER (WHERE l_linestatus != 'F') AS consignment_pages FROM lineitem GROUP BY 1
""")
def page_counts(spark, folder):
    return P.page_counts(table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linestatus") == "F", "INVOICE").otherwise("CONSIGNMENT").alias("type")))


@query("d7_nested_pages", f"""
WITH {PAGES_SQL}
SELECT doc_id, count(*) AS total_pages, string_agg(CAST(page_no AS VARCHAR) || ':' || type, ',' ORDER BY page_no) AS listing FROM pg GROUP BY doc_id
""")
def nested_pages(spark, folder):
    nested = P.nested_pages(pages(spark, folder))
    return nested.select("doc_id", "total_pages", F.array_join(F.transform(
        "pages", lambda p: F.concat(p["page_no"].cast("string"), F.lit(":"), p["type"])), ",").alias("listing"))


@query("s10_page_report", f"""
WITH {PAGES_SQL}
SELECT doc_id, CAST(page_no AS INT) AS page_no, CASE WHEN type = 'CONSIGNMENT'
    THEN 'Page ' || right('  ' || CAST(page_no % 90 AS VARCHAR), 2) || ': CONSIGNMENT' || chr(10) || '         GC Number: ' || gc_number
    ELSE 'Page ' || right('  ' || CAST(page_no % 90 AS VARCHAR), 2) || ': INVOICE' || chr(10) || '         Invoice No: -' || chr(10) || '         Consignor: -' || chr(10) || '         Consignee: -'
      || chr(10) || '         Branch: ' || coalesce(branch, '-') || chr(10) || '         Invoice Date: ' || coalesce(invoice_date, '-')
      || chr(10) || '         Destination: -' || chr(10) || '         Vehicle No: -' || chr(10) || '         E-Way Bill: -' || chr(10) || '         E-Way Date: -'
      || chr(10) || '         PAN NO: -' || chr(10) || '         GST No: -' || chr(10) || '         Product Category: -' || chr(10) || '         Actual Weight: -' || chr(10) || '         Address: -' END AS text
FROM (SELECT * REPLACE (page_no % 90 AS page_no) FROM pg)
UNION ALL
SELECT doc_id, 0, 'EXTRACTION RESULTS - PAGE BY PAGE' || chr(10) || repeat('=', 60) || chr(10) || 'Total Pages: ' || count(*) || chr(10) || 'Invoice Pages: '
  || count(*) FILTER (WHERE type = 'INVOICE') || chr(10) || 'Consignment Pages: ' || count(*) FILTER (WHERE type = 'CONSIGNMENT') FROM pg GROUP BY doc_id
""")
def page_report(spark, folder):
    from docfields.sources.sinks import page_report as report

    return report(pages(spark, folder).withColumn("page_no", F.col("page_no") % 90))


@query("r6_filled_count", """
SELECT o_orderkey AS doc_id, CAST((o_orderkey % 2 = 0)::INT + 1 + (o_orderkey % 5 != 0)::INT AS INT) AS filled, CAST((o_orderkey % 2 = 0)::INT + (o_orderkey % 5 != 0)::INT AS INT) AS filled_no_blank FROM orders
""")
def filled_count(spark, folder):
    k = F.col("o_orderkey")
    rec = table(spark, folder, "orders").select(
        k.alias("doc_id"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("a"), F.lit("").alias("b"),
        F.when(k % 5 != 0, F.col("o_orderpriority")).alias("c"))
    out = Q.filled_count(Q.filled_count(rec, ("a", "b", "c")), ("a", "b", "c"), False, "filled_no_blank")
    return out.select("doc_id", "filled", "filled_no_blank")


@query("g5_field_coverage", f"""
WITH {PAGES_SQL}
SELECT field, count(value) AS found, count(*) - count(value) AS missing, count(value) / CAST(count(*) AS DOUBLE) AS rate FROM (
  SELECT 'branch' AS field, branch AS value FROM pg UNION ALL SELECT 'invoice_date', invoice_date FROM pg UNION ALL SELECT 'datetime_full', datetime_full FROM pg)
GROUP BY field
""")
def field_coverage(spark, folder):
    return Q.field_coverage(pages(spark, folder), ("branch", "invoice_date", "datetime_full"))


@query("g6_plate_profile", f"""
WITH {INVOICE_SQL},
p AS (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN vehicle || '9' ELSE vehicle END AS v, CASE WHEN doc_id % 11 = 0 THEN 'boom' END AS e FROM truth)
SELECT count(*) FILTER (WHERE e IS NULL AND length(v) > 0) AS found, count(*) FILTER (WHERE e IS NULL AND length(v) BETWEEN 1 AND 10) AS standard,
  count(*) FILTER (WHERE e IS NULL AND length(v) > 10) AS oversized, count(*) FILTER (WHERE e IS NULL AND v IS NULL) AS missing, count(*) FILTER (WHERE e IS NOT NULL) AS errors FROM p
""")
def plate_profile(spark, folder):
    k = F.col("doc_id")
    plates = invoice_values(spark, folder).select(
        F.when(k % 7 == 0, None).when(k % 5 == 0, F.concat("vehicle", F.lit("9"))).otherwise(F.col("vehicle")).alias("vehicle"),
        F.when(k % 11 == 0, "boom").alias("failure"))
    return Q.plate_length_profile(plates, error="failure")


@query("d3_typed_record", f"""
WITH {INVOICE_SQL}
SELECT doc_id, CAST(weight AS DECIMAL(12, 3)) AS weight_mt, CAST(rate AS DECIMAL(12, 2)) AS rate_amount, CAST(strptime(invoice_date, '%d.%m.%Y') AS DATE) AS invoice_day FROM truth
""")
def typed_record(spark, folder):
    from docfields.schema import typed_view

    rec = invoice_values(spark, folder).select(
        "doc_id", F.col("weight").alias("Actual Weight"), F.col("rate").alias("Rate"), F.col("invoice_date").alias("Invoice Date"))
    return typed_view(rec).select("doc_id", "weight_mt", "rate_amount", "invoice_day")
