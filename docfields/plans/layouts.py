"""Queries over word boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.functions import address as A
from docfields.functions import text as T
from docfields.operators import extract as X
from docfields.operators import layout as Y
from docfields.operators import records as R
from docfields.plans import query
from docfields.plans.derive import INVOICE_SQL, WORDS_SQL, invoices, table, words

_BANDS = """
tops AS (SELECT DISTINCT doc_id, page_no, top FROM wd),
heads AS (SELECT doc_id, page_no, min(top) AS head FROM tops GROUP BY doc_id, page_no
  UNION ALL SELECT t.doc_id, t.page_no, min(t.top) FROM heads h JOIN tops t ON t.doc_id = h.doc_id AND t.page_no = h.page_no AND t.top > h.head + 20 GROUP BY t.doc_id, t.page_no, h.head),
banded AS (SELECT t.doc_id, t.page_no, t.top, max(h.head) AS band FROM tops t JOIN heads h ON h.doc_id = t.doc_id AND h.page_no = t.page_no AND h.head <= t.top GROUP BY ALL)
"""


@query("g8_median_char_width", f"""
WITH {WORDS_SQL} SELECT doc_id, page_no, coalesce(median(w / CAST(greatest(length(text), 1) AS DOUBLE)), 6.0) AS char_width FROM
  (SELECT * REPLACE (CAST(w + word_no % 7 AS INT) AS w) FROM wd) GROUP BY doc_id, page_no
""")
def median_char_width(spark, folder):
    return Y.median_char_width(words(spark, folder).withColumn("w", F.col("w") + F.col("word_no") % 7))


@query("g10_line_rollup", f"""
WITH {WORDS_SQL} SELECT doc_id, page_no, CAST(top // 8 AS BIGINT) AS row_no, string_agg(text, ' ' ORDER BY "left", word_no) AS line FROM wd GROUP BY ALL
""")
def line_rollup(spark, folder):
    return Y.line_rollup(words(spark, folder))


@query("w6_band_rows", f"""
WITH RECURSIVE {WORDS_SQL}, {_BANDS} SELECT wd.*, band FROM wd JOIN banded USING (doc_id, page_no, top)
""")
def band_rows(spark, folder):
    # a short stretch, so that pages of the test data cross several of them
    return Y.band_rows(words(spark, folder), span=256)


@query("w6_reading_order", f"""
WITH RECURSIVE {WORDS_SQL}, {_BANDS}
SELECT doc_id, page_no, word_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY band, "left", word_no) AS read_no FROM wd JOIN banded USING (doc_id, page_no, top)
""")
def reading_order(spark, folder):
    return Y.reading_order(words(spark, folder)).select("doc_id", "page_no", "word_no", "read_no")


@query("w7_join_split_words", f"""
WITH {WORDS_SQL},
s AS (SELECT doc_id, page_no, word_no, text, CAST("left" - CASE WHEN word_no % 3 = 1 THEN 7 ELSE 0 END AS INT) AS "left", top, w FROM wd),
m AS (SELECT doc_id, page_no, median(w / CAST(greatest(length(text), 1) AS DOUBLE)) AS cw FROM s GROUP BY doc_id, page_no),
g AS (SELECT s.*, top // 8 AS row_no, CASE WHEN "left" - lag("left" + w) OVER o <= greatest(1.0, cw * 0.4) THEN 0 ELSE 1 END AS apart FROM s JOIN m USING (doc_id, page_no)
      WINDOW o AS (PARTITION BY doc_id, page_no, top // 8 ORDER BY "left", word_no)),
t AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, page_no, row_no ORDER BY "left", word_no ROWS UNBOUNDED PRECEDING) AS token_no FROM g)
SELECT doc_id, page_no, CAST(row_no AS BIGINT) AS row_no, CAST(token_no AS BIGINT) AS token_no, string_agg(text, '' ORDER BY "left", word_no) AS text, min("left") AS "left", max("left" + w) AS "right" FROM t GROUP BY ALL
""")
def join_split_words(spark, folder):
    return Y.join_split_words(words(spark, folder).withColumn("left", F.col("left") - F.when(F.col("word_no") % 3 == 1, 7).otherwise(0)))


def _with_headers(spark, folder):
    """Every sixth word position carries a header word."""
    k = F.col("word_no") % 6
    return words(spark, folder).withColumn("text", F.when(k == 0, "Name").when(k == 1, "Address").when(k == 2, F.when(F.col("doc_id") % 2 == 0, "Deliver").otherwise("of"))
                                           .when((k == 3) & (F.col("doc_id") % 2 == 0), "to").otherwise(F.col("text")))


@query("w8_header_score", f"""
WITH RECURSIVE {WORDS_SQL}, {_BANDS},
hw AS (SELECT * REPLACE (CASE word_no % 6 WHEN 0 THEN 'Name' WHEN 1 THEN 'Address' WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'Deliver' ELSE 'of' END
    WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'to' ELSE text END ELSE text END AS text) FROM wd),
o AS (SELECT hw.*, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY band, "left", word_no) AS read_no FROM hw JOIN banded USING (doc_id, page_no, top)),
c AS (SELECT *, array_to_string(list(text) OVER (PARTITION BY doc_id, page_no ORDER BY read_no ROWS BETWEEN 10 PRECEDING AND 11 FOLLOWING), ' ') AS ctx, max("left" + w) OVER (PARTITION BY doc_id, page_no) AS width FROM o),
s AS (SELECT *, CASE WHEN contains(ctx, 'Address') THEN 10 ELSE 0 END + CASE WHEN contains(ctx, 'Name') THEN 5 ELSE 0 END
    + CASE WHEN "left" > width * 0.55 THEN 30 WHEN "left" > width * 0.5 THEN 10 ELSE 0 END + CASE WHEN top < 800 THEN 20 ELSE 0 END AS score
  FROM c WHERE "left" >= width * 0.5 AND regexp_matches(ctx, '(?i)Deliver\\s*to')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY score DESC, read_no) AS rn FROM s)
SELECT doc_id, page_no, word_no, text, "left", top, w, h, score FROM r WHERE rn = 1
""")
def header_score(spark, folder):
    return Y.header_score(_with_headers(spark, folder), r"(?i)Deliver\s*to")


@query("j7_row_extent", f"""
WITH {WORDS_SQL}, h AS (SELECT doc_id, page_no, "left", top, w, h FROM wd WHERE word_no = 1)
SELECT h.doc_id, h.page_no, h."left", h.top, max(wd."left" + wd.w) AS "right", max(wd.top + wd.h) AS bottom
FROM h JOIN wd ON wd.doc_id = h.doc_id AND wd.page_no = h.page_no AND abs(wd.top - h.top) <= greatest(6, h.h // 2) AND wd."left" >= h."left" GROUP BY ALL
""")
def row_extent(spark, folder):
    w = words(spark, folder)
    return Y.row_extent(w, w.filter("word_no = 1"))


@query("j6_nearest_anchor", f"""
WITH {WORDS_SQL},
p AS (SELECT a.doc_id, a.page_no, a.word_no AS a_word_no, b.word_no AS b_word_no, abs(a.top - b.top) + b."left" - (a."left" + a.w) AS distance
  FROM wd a JOIN wd b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.word_no % 5 = 0 AND b.word_no % 5 IN (1, 3)
    AND abs(a.top - b.top) < 15 AND b."left" - (a."left" + a.w) > 0 AND b."left" - (a."left" + a.w) < 100),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY distance, a_word_no, b_word_no) AS rn FROM p)
SELECT doc_id, page_no, a_word_no, b_word_no, distance FROM r WHERE rn = 1
""")
def nearest_anchor(spark, folder):
    n = F.col("word_no") % 5
    return Y.nearest_anchor(words(spark, folder), n == 0, n.isin(1, 3))


@query("j6_internal_number", """
SELECT o_orderkey AS doc_id, lpad(CAST(o_orderkey AS VARCHAR), 10, '4') AS number FROM orders
""")
def internal_number(spark, folder):
    """J6 + P22: the digits to the right of an ``Internal Number`` pair, damaged labels included."""
    k = F.col("o_orderkey")
    digits = F.lpad(k.cast("string"), 10, "4")

    def box(no, text, left, top, w):
        return F.struct(F.lit(no).alias("word_no"), text.alias("text"), F.lit(left).alias("left"), F.lit(top).alias("top"), F.lit(w).alias("w"))

    rows = F.array(
        box(0, F.lit("number"), 10, 100, 60),
        box(1, F.when(k % 2 == 0, "Internal").otherwise("Intemal"), 100, 102, 80),
        box(2, F.when(k % 3 == 0, "Number").otherwise("Nunber"), 190, 100, 60),
        box(3, digits, 260, 101, 100), box(4, F.lit("Number"), 500, 102, 60), box(5, F.lit("1234567890"), 600, 300, 100))
    w = table(spark, folder, "orders").select(k.alias("doc_id"), F.lit(1).alias("page_no"), F.explode(rows).alias("r")).select("doc_id", "page_no", "r.*")
    return R.internal_numbers(w).select("doc_id", F.col("invoice_number").alias("number"))


@query("j8_weight_box", """
SELECT o_orderkey AS doc_id, CAST(o_orderkey % 90 + 10 AS VARCHAR) || '.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '0' AS weight FROM orders
""")
def weight_box(spark, folder):
    """J8 + F33: the number under the column beside the first label; a trailing grid-line 1 becomes 0."""
    k = F.col("o_orderkey")
    value = F.concat((k % 90 + 10).cast("string"), F.when(k % 2 == 0, ",").otherwise("."), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("1"))

    def box(no, text, left, top, w):
        left = left if hasattr(left, "alias") else F.lit(left)
        return F.struct(F.lit(no).alias("word_no"), text.alias("text"), left.alias("left"), F.lit(top).alias("top"), F.lit(w).alias("w"), F.lit(12).alias("h"))

    # value column: left of Rate, right of Packing, left of Amount; one label kind per document
    label = F.when(k % 3 == 0, "Rate").when(k % 3 == 1, "Packing").otherwise("Amount")
    at = F.when(k % 3 == 0, 800).when(k % 3 == 1, 400).otherwise(1200)
    rows = F.array(box(0, F.lit("HSN"), 20, 100, 40), box(1, label, at, 100, 60), box(2, value, 620, 140, 60), box(3, F.lit("99.999"), 620, 400, 60),
                   box(4, F.lit("77"), 100, 140, 20))
    rows = F.transform(rows, lambda r: F.struct(
        r["word_no"].alias("word_no"), r["text"].alias("text"),
        F.when((r["word_no"] == 2) & (k % 3 == 1), 520).otherwise(r["left"]).alias("left"), r["top"].alias("top"), r["w"].alias("w"), r["h"].alias("h")))
    w = table(spark, folder, "orders").select(k.alias("doc_id"), F.lit(1).alias("page_no"), F.explode(rows).alias("r")).select("doc_id", "page_no", "r.*")
    return R.box_weights(w).select("doc_id", F.col("actual_weight").alias("weight"))


@query("p25_gc_number", """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(20000 + o_orderkey % 70000 AS VARCHAR) ELSE CAST(10000 + o_orderkey % 9000 AS VARCHAR) END AS gc_number FROM orders
""")
def gc_number(spark, folder):
    """P25 + J8: five digits near a damaged label, or the 1dddd part of a longer run."""
    k = F.col("o_orderkey")
    number = F.when(k % 2 == 0, (k % 70000 + 20000).cast("string")).otherwise(F.concat(F.lit("99"), (k % 9000 + 10000).cast("string")))
    label = F.when(k % 3 == 0, "G.C.No").when(k % 3 == 1, "6.C.N").otherwise("5CNo")

    def box(no, text, left, top):
        return F.struct(F.lit(no).alias("word_no"), text.alias("text"), F.lit(left).alias("left"), F.lit(top).alias("top"), F.lit(60).alias("w"), F.lit(12).alias("h"))

    rows = F.array(box(0, F.lit("CONSIGNMENT"), 10, 10), box(1, label, 500, 100), box(2, number, 580, 104), box(3, F.lit("55555"), 580, 600))
    w = table(spark, folder, "orders").select(k.alias("doc_id"), F.lit(1).alias("page_no"), F.explode(rows).alias("r")).select("doc_id", "page_no", "r.*")
    return R.gc_numbers(w).select("doc_id", "gc_number")


@query("f30_respace_initials", """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'T R S' ELSE 'TRS' END AS text FROM orders
""")
def respace_initials(spark, folder):
    k = F.col("o_orderkey")
    w = table(spark, folder, "orders").select(k.alias("doc_id"), F.lit(1).alias("page_no"), F.lit(0).alias("word_no"), F.lit("TRS").alias("text"))
    step = F.when(k % 2 == 0, 20).otherwise(11)
    chars = table(spark, folder, "orders").select(k.alias("doc_id"), F.lit(1).alias("page_no"), F.lit(0).alias("word_no"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("char_no"), (step * i).alias("x1"), (step * i + 10).alias("x2")) for i in range(3)])).alias("c")).select(
        "doc_id", "page_no", "word_no", "c.*")
    return Y.respace_initials(w, chars).select("doc_id", "text")


def _delivery_words(spark, folder):
    """Two columns of word boxes per order: a delivery block on the right, a recipient block on the left."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("K"), F.translate(k.cast("string"), "0123456789", "BCDFGHJKLM"), F.lit(" TRADERS"))
    block = [F.lit("Name & Address of Delivery"), name, F.lit("12 Parvath Puram"), F.lit("Hosur 635001"), F.lit("GSTIN 33X"), F.lit("PHONE 99"), F.lit("Never Reached")]
    left_column = [F.lit("Name & Address of Recipient"), F.lit("Other Company"), F.lit("Elsewhere")]

    def boxes(rows, left):
        def row(i, text):
            return F.transform(F.split(text, " "), lambda w, j: F.struct(
                (F.lit(i * 1000 + left) + j).alias("word_no"), w.alias("text"), (F.lit(left) + j * 100).cast("int").alias("left"),
                F.lit(100 + i * 24).alias("top"), (F.length(w) * 10).alias("w"), F.lit(12).alias("h")))

        return [row(i, text) for i, text in enumerate(rows)]

    rows = F.concat(*boxes(block, 900), *boxes(left_column, 50))
    return table(spark, folder, "orders").select(k.alias("doc_id"), F.lit(1).alias("page_no"), F.explode(rows).alias("r")).select("doc_id", "page_no", "r.*")


@query("p27_delivery_address", """
SELECT o_orderkey AS doc_id, t || ' Traders, 12 Parvathpuram, Hosur 635001' AS address FROM (
  SELECT o_orderkey, 'K' || lower(translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'BCDFGHJKLM')) AS t FROM orders)
""")
def delivery_address(spark, folder):
    """Header on the right half, rows under it harvested, joined, cleaned."""
    return R.delivery_addresses(_delivery_words(spark, folder)).select("doc_id", "address")


@query("x1_delivery_address", f"""
WITH {INVOICE_SQL} SELECT doc_id, invoice_no AS "Invoice No", consignee AS "Consignee",
  CASE WHEN doc_id % 7 != 0 THEN 'K' || lower(translate(CAST(doc_id AS VARCHAR), '0123456789', 'BCDFGHJKLM')) || ' Traders, 12 Parvathpuram, Hosur 635001' END AS "Delivery Address"
FROM truth
""")
def record_with_address(spark, folder):
    """X1 + P27: the record of the first client with its delivery address; every seventh document has no word boxes."""
    record = X.extract_fields(invoices(spark, folder), 1, 1)
    return R.with_delivery_address(record, _delivery_words(spark, folder).filter("doc_id % 7 != 0")).select(
        "doc_id", "Invoice No", "Consignee", "Delivery Address")


@query("p26_recipient_code", """
SELECT o_orderkey AS doc_id, 'Recipient Code : ' || CAST(730000 + o_orderkey AS VARCHAR) || 'B27' AS code FROM orders
""")
def recipient_code(spark, folder):
    k = F.col("o_orderkey")
    docs = table(spark, folder, "orders").select(k.alias("doc_id"), F.concat(
        F.lit("Name\nRecipient  Code : "), (k + 730000).cast("string"), F.lit("B27")).alias("text"))
    return docs.select("doc_id", X.recipient_code(F.col("text")).alias("code"))


