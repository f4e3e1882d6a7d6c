"""Queries for value rules, dictionaries and rule maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.operators import correct as C
from docfields.plans import query
from docfields.plans.derive import (
    HEX,
    HEX_LETTERS,
    INVOICE_SQL,
    RULES_SQL,
    VALUES_SQL,
    coded_name,
    field_values,
    invoice_values,
    table,
    value_rules,
)

_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query("s5_read_rules", f"WITH {RULES_SQL} SELECT field_name, from_value, to_value FROM vr")
def read_rules(spark, folder):
    return C.list_rules(value_rules(spark, folder)).select("field_name", "from_value", "to_value")


@query("j1_apply_exact_rules", f"""
WITH {RULES_SQL}, {VALUES_SQL}
SELECT {_KEYS}, fv.field, fv.value, coalesce(vr.to_value, fv.value) AS new_value, vr.to_value IS NOT NULL AS changed
FROM fv LEFT JOIN vr ON vr.field_name = fv.field AND vr.from_value = fv.value
""")
def apply_exact_rules(spark, folder):
    values = field_values(spark, folder).drop("kind")
    return C.apply_exact_rules(values, value_rules(spark, folder))


# kind 0 is exact; a lost character gives 2*17/35 = 0.97, another case gives 1.0 after lower-casing; both need a
# field for which similar values are allowed
@query("j2_apply_fuzzy_rules", f"""
WITH {VALUES_SQL}
SELECT {_KEYS}, field, value,
  CASE WHEN kind = 0 OR (kind IN (1, 2) AND field != 'Vehicle') THEN 'PLACE ' || CAST(l_partkey AS VARCHAR) ELSE value END AS new_value,
  kind = 0 OR (kind IN (1, 2) AND field != 'Vehicle') AS changed,
  CASE WHEN kind = 0 THEN 1.0 WHEN field = 'Vehicle' THEN NULL WHEN kind = 1 THEN 34.0 / 35.0 WHEN kind = 2 THEN 1.0 END AS score
FROM fv
""")
def apply_fuzzy_rules(spark, folder):
    values = field_values(spark, folder).drop("kind")
    return C.apply_fuzzy_rules(values, value_rules(spark, folder))


@query("j3_match_dictionary", f"""
WITH d AS (SELECT o_orderkey, o_custkey, translate(substr(md5(CAST(o_custkey AS VARCHAR)), 1, 18), '{HEX}', '{HEX_LETTERS}') AS name FROM orders)
SELECT o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN name WHEN 1 THEN lower(name) || ' ' WHEN 2 THEN substr(name, 1, 5) || substr(name, 7)
    ELSE 'NEW BRANCH ' || CAST(o_custkey % 20 AS VARCHAR) END AS value,
  CASE WHEN o_orderkey % 4 < 3 THEN name ELSE 'NEW BRANCH ' || CAST(o_custkey % 20 AS VARCHAR) END AS matched,
  CASE WHEN o_orderkey % 4 = 2 THEN 34.0 / 35.0 END AS score
FROM d
""")
def match_dictionary(spark, folder):
    k, name = F.col("o_orderkey") % 4, coded_name(F.col("o_custkey"))
    values = table(spark, folder, "orders").select("o_orderkey", (
        F.when(k == 0, name).when(k == 1, F.concat(F.lower(name), F.lit(" ")))
        .when(k == 2, F.concat(F.substring(name, 1, 5), F.substring(name, 7, 18)))
        .otherwise(F.concat(F.lit("NEW BRANCH "), (F.col("o_custkey") % 20).cast("string")))).alias("value"))
    names = table(spark, folder, "customer").select(coded_name(F.col("c_custkey")).alias("name"), F.col("c_custkey").alias("ord"))
    return C.match_dictionary(values, names)


_RECORD_NAME = "CASE WHEN o_orderkey % 3 = 0 THEN name ELSE substr(name, 1, 4) || substr(name, 6) END"


def _records(spark, folder):
    k = F.col("o_orderkey")
    name = coded_name(F.col("o_custkey"))
    damaged = F.when(k % 3 == 0, name).otherwise(F.concat(F.substring(name, 1, 4), F.substring(name, 6, 18)))
    return table(spark, folder, "orders").select(
        k.alias("doc_id"), F.concat(F.lit("V"), (F.col("o_custkey") % 10).cast("string")).alias("Vehicle"),
        damaged.alias("Destination"), F.when(k % 5 != 0, name).alias("Consignee"))


def _record_rules(spark, folder):
    part = table(spark, folder, "customer")
    c = F.col("c_custkey")
    dest = part.select(c.alias("id"), F.lit("Destination").alias("field_name"), coded_name(c).alias("from_value"),
                       F.concat(F.lit("D"), c.cast("string")).alias("to_value"))
    cons = part.filter(c % 2 == 0).select((c + 10000000).alias("id"), F.lit("Consignee").alias("field_name"),
                                          coded_name(c).alias("from_value"), F.concat(F.lit("C"), c.cast("string")).alias("to_value"))
    plate = part.filter(c < 5).select((c + 20000000).alias("id"), F.lit("Vehicle").alias("field_name"),
                                      F.concat(F.lit("V"), c.cast("string")).alias("from_value"), F.lit("TN01AB0001").alias("to_value"))
    return dest.unionByName(cons).unionByName(plate)


@query("j4_transform_records", f"""
WITH d AS (SELECT o_orderkey, o_custkey, translate(substr(md5(CAST(o_custkey AS VARCHAR)), 1, 18), '{HEX}', '{HEX_LETTERS}') AS name,
    o_custkey IN (SELECT c_custkey FROM customer) AS known,
    (o_custkey % 10) IN (SELECT c_custkey FROM customer WHERE c_custkey < 5) AS plate FROM orders),
r AS (SELECT o_orderkey AS doc_id, 'V' || CAST(o_custkey % 10 AS VARCHAR) AS v, plate,
    {_RECORD_NAME} AS dst, known AS dhit, 'D' || CAST(o_custkey AS VARCHAR) AS dnew,
    CASE WHEN o_orderkey % 5 != 0 THEN name END AS con, known AND o_custkey % 2 = 0 AND o_orderkey % 5 != 0 AS chit,
    'C' || CAST(o_custkey AS VARCHAR) AS cnew FROM d)
SELECT doc_id, CASE WHEN plate THEN 'TN01AB0001' ELSE v END AS "Vehicle", CASE WHEN dhit THEN dnew ELSE dst END AS "Destination",
  CASE WHEN chit THEN cnew ELSE con END AS "Consignee", plate OR dhit OR chit AS transformed,
  CASE WHEN plate THEN 'Vehicle:' || v || '>TN01AB0001;' ELSE '' END || CASE WHEN dhit THEN 'Destination:' || dst || '>' || dnew || ';' ELSE '' END
    || CASE WHEN chit THEN 'Consignee:' || con || '>' || cnew || ';' ELSE '' END AS changes
FROM r
""")
def transform_records(spark, folder):
    out = C.transform_records(_records(spark, folder), _record_rules(spark, folder))
    text = F.array_join(F.transform("changes", lambda c: F.concat(c["field"], F.lit(":"), c["from"], F.lit(">"), c["to"], F.lit(";"))), "")
    return out.withColumn("changes", text)


# a place of one word for even customers, a place of two words for every third, and one that only overlaps it
@query("j12_place_corrections", """
WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT o_orderkey AS doc_id, 'old ' || CASE WHEN o_custkey IN (SELECT k FROM c WHERE k % 3 = 0) THEN 'site ' ELSE 'plot ' END || CAST(o_custkey AS VARCHAR) || ', ' ||
  CASE WHEN o_custkey IN (SELECT k FROM c WHERE k % 2 = 0) THEN 'right' ELSE 'wrong' END || CAST(o_custkey AS VARCHAR) || ' nagar.' AS address
FROM orders
""")
def place_corrections(spark, folder):
    key = F.col("o_custkey").cast("string")
    addresses = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(
        F.lit("Old Plot "), key, F.lit(", Wrong"), key, F.lit(" Nagar.")).alias("address"))
    customers, k, c = table(spark, folder, "customer"), F.col("c_custkey"), F.col("c_custkey").cast("string")

    def places(some, wrong, right, order):
        return customers.filter(some).select(wrong.alias("wrong"), right.alias("correct"), order.alias("ord"))

    learned = (places(k % 2 == 0, F.concat(F.lit("wrong"), c), F.concat(F.lit("Right"), c), k)
               .unionByName(places(k % 3 == 0, F.concat(F.lit("plot "), c), F.concat(F.lit("Site "), c), k))
               .unionByName(places(k % 3 == 0, F.concat(F.lit("old plot "), c), F.lit("never"), k + 1_000_000_000)))
    return C.correct_places(addresses, learned)


def _changes(spark, folder):
    s = F.col("p_partkey")
    op = F.when(s % 4 == 0, "delete").when(s % 4 == 1, "update").when(s % 4 == 2, "create").otherwise("update")
    # update of an id that does not exist for every seventh part
    ident = F.when(s % 4 == 2, s + 50000000).when((s % 4 == 1) & (s % 7 == 0), s + 90000000).otherwise(s)
    return table(spark, folder, "part").select(
        ident.alias("id"), op.alias("op"), F.col("p_brand").alias("field_name"),
        F.when(s % 11 == 0, "").otherwise(F.col("p_name")).alias("from_value"), F.col("p_type").alias("to_value"),
        F.timestamp_seconds(1800000000 + s).alias("changed_at"))


_CHANGES_SQL = """
ch AS (SELECT CASE WHEN p_partkey % 4 = 2 THEN p_partkey + 50000000 WHEN p_partkey % 4 = 1 AND p_partkey % 7 = 0 THEN p_partkey + 90000000
         ELSE p_partkey END AS id,
    CASE p_partkey % 4 WHEN 0 THEN 'delete' WHEN 2 THEN 'create' ELSE 'update' END AS op, p_brand AS field_name,
    CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS from_value, p_type AS to_value,
    make_timestamp(CAST((1800000000 + p_partkey) * 1000000 AS BIGINT)) AS changed_at FROM part),
ok AS (SELECT * FROM ch WHERE op = 'delete' OR from_value != '')
"""


@query("j13_apply_rule_changes", f"""
WITH {RULES_SQL}, {_CHANGES_SQL}
SELECT * FROM vr WHERE id NOT IN (SELECT id FROM ok)
UNION ALL
SELECT ok.id, ok.field_name, ok.from_value, ok.to_value, coalesce(vr.created_at, ok.changed_at), ok.changed_at
FROM ok LEFT JOIN vr ON vr.id = ok.id WHERE ok.op = 'create' OR (ok.op = 'update' AND vr.id IS NOT NULL)
""")
def apply_rule_changes(spark, folder):
    return C.apply_rule_changes(value_rules(spark, folder), _changes(spark, folder))


@query("j13_unknown_rule_changes", f"""
WITH {RULES_SQL}, {_CHANGES_SQL}
SELECT id, op FROM ch WHERE op != 'create' AND id NOT IN (SELECT id FROM vr)
""")
def unknown_rule_changes(spark, folder):
    return C.unknown_rule_changes(value_rules(spark, folder), _changes(spark, folder)).select("id", "op")


@query("g2_rule_stats", f"""
WITH {RULES_SQL} SELECT field_name, count(*) AS rules FROM vr GROUP BY field_name UNION ALL SELECT NULL, count(*) FROM vr
""")
def rule_stats(spark, folder):
    return C.rule_stats(value_rules(spark, folder))


@query("g7_rules_version", f"WITH {RULES_SQL} SELECT max(coalesce(updated_at, created_at)) AS version FROM vr")
def rules_version(spark, folder):
    return C.rules_version(value_rules(spark, folder))


@query("t2_list_rules", f"WITH {RULES_SQL} SELECT * FROM vr WHERE field_name = 'Consignee'")
def list_rules(spark, folder):
    return C.list_rules(value_rules(spark, folder), "Consignee")


@query("v5_learn_place", """
SELECT 'wrong' || CAST(c_custkey AS VARCHAR) AS wrong, 'Right' AS correct FROM customer WHERE c_custkey != 3
UNION ALL SELECT 'wrong3', 'New Place'
""")
def learn_place(spark, folder):
    learned = table(spark, folder, "customer").select(
        F.concat(F.lit("wrong"), F.col("c_custkey").cast("string")).alias("wrong"), F.lit("Right").alias("correct"),
        F.col("c_custkey").alias("ord"))
    return C.learn_place(learned, " WRONG3 ", "new place").select("wrong", "correct")


@query("f20_similarity", f"""
WITH d AS (SELECT c_custkey, translate(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 18), '{HEX}', '{HEX_LETTERS}') AS name FROM customer)
SELECT c_custkey, name AS left_text, substr(name, 1, 8) || substr(name, 10) AS right_text, 34.0 / 35.0 AS score FROM d
""")
def similarity(spark, folder):
    from docfields.functions.similarity import similarity as score

    name = coded_name(F.col("c_custkey"))
    pairs = table(spark, folder, "customer").select(
        "c_custkey", name.alias("left_text"), F.concat(F.substring(name, 1, 8), F.substring(name, 10, 18)).alias("right_text"))
    return pairs.withColumn("score", score(F.col("left_text"), F.col("right_text")))


@query("j11_compare_runs", f"""
WITH {INVOICE_SQL},
a AS (SELECT doc_id, 'vehicle' AS field, vehicle AS value FROM truth UNION ALL SELECT doc_id, 'rate', rate FROM truth WHERE doc_id % 10 != 0),
b AS (SELECT doc_id, 'vehicle' AS field, CASE WHEN doc_id % 4 = 0 THEN translate(vehicle, '0', 'O') ELSE vehicle END AS value FROM truth
      UNION ALL SELECT doc_id, 'rate', CASE WHEN doc_id % 6 != 0 THEN rate END FROM truth)
SELECT doc_id, field, a.value AS a_value, b.value AS b_value, a.value IS NOT DISTINCT FROM b.value AS same
FROM a FULL OUTER JOIN b USING (doc_id, field)
""")
def compare_runs(spark, folder):
    from docfields.operators.quality import compare_runs as compare
    from docfields.operators.quality import long_form

    truth = invoice_values(spark, folder).select("doc_id", "vehicle", "rate")
    first = long_form(truth, ("vehicle", "rate")).filter(~((F.col("field") == "rate") & (F.col("doc_id") % 10 == 0)))
    other = truth.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.translate("vehicle", "0", "O")).otherwise(F.col("vehicle")).alias("vehicle"),
                         F.when(F.col("doc_id") % 6 != 0, F.col("rate")).alias("rate"))
    return compare(first, long_form(other, ("vehicle", "rate")))


