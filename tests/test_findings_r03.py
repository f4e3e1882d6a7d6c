"""Cases of the third round's findings."""

from pyspark.sql import functions as F

from docfields.operators import extract as X
from docfields.operators.lines import dedupe_lines
from docfields.rules import rule_pack


def test_labelled_eway_number_of_three_digits_is_read(spark):
    texts = ["EWB No: 555225252425", "EWB No: 555555555555", "EWB No: 555225252425\n531234987650", "555225252425"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = docs.select("doc_id", X.eway_number(F.col("text"), X.compile_field(rule_pack(1, 1).of("eway_no"), F.col("text"))).alias("n"))
    # a genuine number nearby still comes first; one repeated digit and numbers without a label stay fillers
    assert dict(got.collect()) == {0: "555225252425", 1: None, 2: "531234987650", 3: None}


def test_sharp_s_is_no_double_s(spark):
    rows = [(1, i, line) for i, line in enumerate(["Masse 1", "Maße 1", "MASSE, 1", "ß"])]
    got = dedupe_lines(spark.createDataFrame(rows, "doc_id int, line_no int, line string")).collect()
    assert sorted(r["line_no"] for r in got) == [0, 1]


def test_starts_of_pieces_cross_blocks(spark):
    from docfields.plans.derive import starts

    lines = ["", "a", " a  b ", " ".join("w" * (i % 7) for i in range(300))]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", starts(F.split("line", " "), 8).alias("at")).collect()
    for r in got:
        ws = r["line"].split(" ")
        assert r["at"] == [sum(len(w) + 1 for w in ws[:i]) for i in range(len(ws))]


def test_sides_that_outgrow_their_estimate_are_not_broadcast(spark):
    from docfields.operators.fuzzy import best_matches
    from docfields.operators.layout import nearest_anchor, words_in_box
    from docfields.operators.records import delivery_addresses

    few = spark.range(10).select(F.col("id").alias("doc_id"), F.lit(1).alias("page_no"))
    box = F.explode(F.array(*[F.struct(F.lit(i).alias("word_no"), F.lit("Name").alias("text"), F.lit(i * 50).alias("left"), F.lit(5).alias("top"),
                                       F.lit(9).alias("w"), F.lit(9).alias("h")) for i in range(3)])).alias("b")
    words = few.select("doc_id", "page_no", box).select("doc_id", "page_no", "b.*")
    names = few.select(F.lit("f").alias("field"), F.concat(F.lit("some name "), "doc_id").alias("_value"))
    entries = names.select("field", F.col("_value").alias("_entry"), F.lit(1).alias("_rank"))
    for plan in (nearest_anchor(words, F.col("word_no") == 0, F.col("word_no") == 1), delivery_addresses(words), best_matches(names, entries, 0.8),
                 words_in_box(words, few.withColumns({c: F.lit(1) for c in ("x1", "x2", "y1", "y2")}))):
        assert "BroadcastExchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_median_width_counts_every_word(spark):
    from docfields.operators.layout import median_char_width

    rows = [(1, 1, "a", w) for w in (1, 1, 1, 9, 30)] + [(2, 1, "ab", w) for w in (2, 4, 6, 8)] + [(3, 1, "a", None), (4, 1, "", 5)]
    got = median_char_width(spark.createDataFrame(rows, "doc_id int, page_no int, text string, w int")).collect()
    assert {r["doc_id"]: r["char_width"] for r in got} == {1: 1.0, 2: 2.5, 3: 6.0}
