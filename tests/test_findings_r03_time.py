"""Cases of the third round's findings on time: less work per document, the same results."""

import itertools
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from docfields.functions import similarity as S
from docfields.functions import text as T
from docfields.operators import extract as X
from docfields.rules import rule_pack


def test_close_words_agree_with_scoring_every_word(spark):
    random.seed(3)
    pool = ["".join(random.choice("vehiclDSPATCHjswx1") for _ in range(random.randint(1, 18))) for _ in range(3000)]
    docs = spark.createDataFrame([(i, pool[i::300]) for i in range(300)], "id int, ws array<string>")
    for target, limit in (("vehicle", 0.6), ("dispatch", 0.5), ("JSWCL", 0.7), ("JSW", 0.8)):
        near = {r["id"]: r["near"] for r in docs.select("id", S.close_words(F.col("ws"), target, limit).alias("near")).collect()}
        for i in range(300):
            want = {w for w in pool[i::300] if SequenceMatcher(None, w, target).ratio() >= limit}
            assert set(near[i] or []) == want


def test_like_to_agrees_with_the_ratio(spark):
    words = ["".join(p) for n in range(1, 6) for p in itertools.product("tox", repeat=n)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", X._like_to(F.col("w")).alias("like")).collect()
    assert {r["w"] for r in got if r["like"]} == {w for w in words if SequenceMatcher(None, w, "to").ratio() >= 0.6}


def test_closest_name_keeps_the_first_of_equally_close_ones(spark):
    names = ("SALEM", "SALEN", "METTUR")
    rows = [("SALE",), ("SALEN",), ("METUR",), ("OTHER",), (None,)]
    got = spark.createDataFrame(rows, "v string").select("v", S.closest_name(F.col("v"), names, 0.75).alias("n")).collect()
    assert {r["v"]: r["n"] for r in got} == {"SALE": "SALEM", "SALEN": "SALEN", "METUR": "METTUR", "OTHER": None, None: None}


def test_a_pattern_searches_a_text_once(spark):
    docs = spark.createDataFrame([("a",)], "text string")
    found = docs.select(F.coalesce(*[T.hit(F.col("text"), p) for p in ("a(1)", "b(2)", "c(3)")]).alias("v"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 3


def test_only_lines_with_dates_are_repaired(spark):
    docs = spark.createDataFrame([("Date: 23-O4—2O21\nTAX INVOICE",), ("no day\ninvoice .05.2024",), ("x 3l.12.2O20 y\r\ndate l.l.2O21",)], "text string")
    column = X.compile_field(rule_pack(1, 1).of("invoice_date"), F.col("text"))
    assert [r[0] for r in docs.select(column).collect()] == ["23.04.2021", "01.05.2024", "01.01.2021"]
    repaired = docs.select(X.PREPARE["date_lines"](F.col("text")).alias("t")).collect()
    assert [r["t"] for r in repaired][1] == "" and "INV0ICE" not in repaired[0]["t"]


def test_rare_line_ends_still_end_lines(spark):
    texts = ["a\nb", "a\r\nb\rc", "a\x0bb c\x85d\x1de\n", ""]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(T.lines_of(F.col("text")).alias("l")).collect()
    assert [r["l"] for r in got] == [["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d", "e", ""], [""]]


def test_leftmost_material_is_found_in_one_search(spark):
    random.seed(4)
    bits = ["OPC", "PPC", "SRC", "O P C", "P.P.C", "S R C", "53", "43", "5 3", "S3", " ", " ", "-", "x", "0PC", "PSC", "grade", "\n"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 9))) for _ in range(1500)]

    def by_every_place(upper):
        found = [F.struct(F.coalesce(*[F.nullif(F.regexp_instr(upper, F.lit(p)), F.lit(0)) for p in pattern.split("|")]).alias("at"),
                          F.lit(i).alias("ord"), F.lit(code).alias("code")) for i, (code, pattern) in enumerate(T.MATERIAL_CODES)]
        return F.array_min(F.filter(F.array(*found), lambda c: c["at"].isNotNull())).getField("code")

    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    merged = docs.select("t", T.merge_split_letters(F.translate(F.upper("t"), "015", "OIS")).alias("u"))
    rows = merged.select("t", by_every_place(F.col("u")).alias("want"), T.material_code(F.col("t")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in rows if r["want"]) and sum(r["want"] is not None for r in rows) > 500
    plan = docs.select(T.material_code(F.col("t")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" in plan
