"""Operators against brute force, with chunks small enough to be crossed."""

import random

from pyspark.sql import functions as F

from docfields.functions.plates import shrink_plate
from docfields.operators.layout import band_rows, context_of
from docfields.operators.lines import merge_text
from docfields.operators.ordered import ordinal, previous, running_total


def test_chunked_scans_equal_plain_scans(spark):
    rng = random.Random(3)
    rows = [(g, n, rng.randint(0, 5)) for g in ("hot", "cold") for n in sorted(rng.sample(range(500), 200 if g == "hot" else 7))]
    df = spark.createDataFrame(rows, "g string, n int, v int")
    chunk = F.floor(F.col("n") / 16)
    total = {(r["g"], r["n"]): r["t"] for r in running_total(df, ["g"], ["n"], F.col("v"), chunk, "t").collect()}
    rank = {(r["g"], r["n"]): r["o"] for r in ordinal(df, ["g"], ["n"], chunk, "o").collect()}
    before = {(r["g"], r["n"]): (r["p"], r["any"]) for r in previous(df, ["g"], ["n"], {"p": "v"}, chunk, "any").collect()}
    for g in ("hot", "cold"):
        acc, last = 0, None
        for i, (_, n, v) in enumerate(r for r in rows if r[0] == g):
            acc += v
            assert total[(g, n)] == acc and rank[(g, n)] == i + 1
            assert before[(g, n)] == (last, i > 0)
            last = v


def test_bands_follow_the_head(spark):
    rng = random.Random(5)
    tops = [rng.randint(0, 3000) for _ in range(400)] + list(range(3000, 3400, 7))
    df = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(tops)], "doc_id int, page_no int, word_no int, top int")
    for span in (64, 4096):
        got = {r["word_no"]: r["band"] for r in band_rows(df, 20, span=span).collect()}
        head = None
        for i, t in sorted(enumerate(tops), key=lambda p: p[1]):
            if head is None or t > head + 20:
                head = t
            assert got[i] == head


def test_context_crosses_block_borders(spark):
    words = [f"w{i}" for i in range(1, 101)]
    df = spark.createDataFrame([(1, 1, i + 1, w) for i, w in enumerate(words)], "doc_id int, page_no int, read_no int, text string")
    got = {r["read_no"]: r["context"] for r in context_of(df, block=16).collect()}
    assert len(got) == 100
    for i in range(100):
        assert got[i + 1] == " ".join(words[max(0, i - 10):i + 12])


def test_merge_text_is_idempotent(spark):
    rows = [(1, 1, 0, "a  \nb\n\n a"), (1, 1, 1, "b\nc"), (1, 2, 0, "a")]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, variant_no int, text string")
    merged = merge_text(df)
    got = sorted((r["page_no"], r["variant_no"], r["line_no"], r["line"]) for r in merged.collect())
    assert got == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 1, "c"), (2, 0, 0, "a")]
    again = merge_text(merged.withColumnRenamed("line", "text").withColumn("variant_no", F.col("variant_no") * 100 + F.col("line_no")).drop("line_no"))
    assert again.count() == 4


def test_shrink_never_lengthens(spark):
    rng = random.Random(7)
    plates = ["".join(rng.choice("TNKA015SOILB8D") for _ in range(rng.randint(8, 12))) for _ in range(300)]
    df = spark.createDataFrame([(p,) for p in plates], "p string").withColumn("s", shrink_plate(F.col("p")))
    for r in df.collect():
        assert len(r["s"]) <= len(r["p"])
        assert len(r["p"]) > 10 or r["s"] == r["p"]
