"""Cases of the third round's findings on memory: no task has much more than its share of the rows."""

import random
import re

from pyspark.sql import functions as F

from docfields.operators.correct import correct_places
from docfields.operators.layout import respace_initials


def largest_share(spark, df):
    """The largest part of a stage's shuffled rows that one task reads."""
    sc = spark.sparkContext
    group = f"largest_share {random.random()}"
    sc.setJobGroup(group, group)
    df.write.format("noop").mode("overwrite").save()
    sc.setLocalProperty("spark.jobGroup.id", None)
    store, shares = sc._jsc.sc().statusStore(), [0]
    for stage in {s for job in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(job).stageIds}:
        tasks = store.taskList(stage, 0, 10000)
        read = [m.get().shuffleReadMetrics().recordsRead() for m in (tasks.apply(i).taskMetrics() for i in range(tasks.size())) if m.isDefined()]
        if sum(read) > 1000:
            shares.append(max(read) / sum(read))
    return max(shares)


def test_a_word_of_every_address_is_dealt_over_all_tasks(spark):
    addresses = spark.range(24000).select(F.col("id").alias("doc_id"), F.lit("Salem").alias("address"))
    learned = spark.createDataFrame([("salem", "Selam", 1), ("erode", "Irodu", 2)], "wrong string, correct string, ord int")
    fixed = correct_places(addresses, learned)
    assert [tuple(r) for r in fixed.groupBy("address").count().collect()] == [("selam", 24000)]
    assert 0.2 < largest_share(spark, fixed) < 0.5


def test_places_agree_with_a_plain_search(spark, monkeypatch):
    from docfields.operators import correct

    random.seed(5)
    words, gaps = ["old", "town", "salem", "é1", "x_y", "Hosur"], [" ", ", ", "-", "  "]
    texts = ["".join(random.choice(words) + random.choice(gaps) for _ in range(random.randint(0, 7))) for _ in range(300)] + ["", None, ",", "-old"]
    learned = [("old town", "OT", 5), ("town", "Village", 3), ("salem", "selam", 4), ("Salem, old", "So", 9), ("salem", "Later", 8), (" ", "no", 1), (None, "no", 2)]
    right, first = {}, {}
    for wrong, correct_, at in sorted([x for x in learned if x[0] and x[0].strip()], key=lambda x: x[2]):
        right[wrong.lower()] = correct_.lower()
        first.setdefault(wrong.lower(), at)

    def plain(text):
        if text is None:
            return None
        pieces = re.findall(r"\w+|\W+", text.lower())
        spans = sorted((first[run], i, j) for i in range(len(pieces)) for j in range(i + 1, len(pieces) + 1) if (run := "".join(pieces[i:j])) in right)
        kept = []
        for _, i, j in spans:
            if all(j <= a or b <= i for a, b in kept):
                kept.append((i, j))
        for i, j in sorted(kept, reverse=True):
            pieces[i:j] = [right["".join(pieces[i:j])]]
        return "".join(pieces)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, address string")
    places = spark.createDataFrame(learned, "wrong string, correct string, ord int")
    for rows in (1000, 5):
        monkeypatch.setattr(correct, "SHARE_ROWS", rows, raising=False)
        got = dict(correct.correct_places(docs, places).collect())
        assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_boxes_of_initials_are_not_merged_to_few_tasks(spark):
    words = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(0).alias("word_no"), F.lit("TRS").alias("text"))
    step = F.when(F.col("doc_id") % 2 == 0, 20).otherwise(11)
    chars = words.select("doc_id", "page_no", "word_no", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("char_no")).select(
        "doc_id", "page_no", "word_no", "char_no", (F.col("step") * F.col("char_no")).alias("x1"), (F.col("step") * F.col("char_no") + 10).alias("x2"))
    spaced = respace_initials(words, chars)
    assert {tuple(r) for r in spaced.groupBy("text").count().collect()} == {("T R S", 10000), ("TRS", 10000)}
    assert 0.2 < largest_share(spark, spaced) < 0.3


def test_initials_with_odd_boxes(spark):
    kinds = "doc_id int, page_no int, word_no int"
    words = [(1, 1, 0, "TRS", 7), (1, 1, 1, "TRSX", 7), (1, 1, 2, "AB", 7), (1, 1, 3, "AB", 7), (1, 1, 4, "AB", None), (None, 1, 0, "AB", 7), (1, 1, 5, None, 7),
             (2, 1, 0, "AB", 7), (2, 1, 1, "CDE", 7)]
    wide = [(1, 1, no, i, 20 * i, 20 * i + 10) for no in (0, 1, 2, 5) for i in range(3)]
    # no width counts as no gap; characters of no word, of unknown words and in any order
    odd = [(1, 1, 3, 0, 5, 5), (1, 1, 3, 1, 90, 99), (None, 1, 0, 0, 0, 10), (None, 1, 0, 1, 90, 99), (9, 1, 0, 0, 0, 1), (2, 1, 0, 0, 50, 60),
           (2, 1, 1, 2, 60, 70), (2, 1, 1, 0, 0, 10), (2, 1, 1, 1, 30, 40)]
    got = respace_initials(spark.createDataFrame(words, kinds + ", text string, size int"),
                           spark.createDataFrame(wide + odd, "doc_id long, page_no int, word_no int, char_no int, x1 int, x2 int"))
    assert got.columns == ["doc_id", "page_no", "word_no", "text", "size"]
    key = lambda r: (str(r[0]), r[2])
    assert sorted(((*r[:3], r["text"], r["size"]) for r in got.collect()), key=key) == sorted([
        (1, 1, 0, "T R S", 7), (1, 1, 1, "TRSX", 7), (1, 1, 2, "A B", 7), (1, 1, 3, "AB", 7), (1, 1, 4, "AB", None), (None, 1, 0, "AB", 7), (1, 1, 5, None, 7),
        (2, 1, 0, "AB", 7), (2, 1, 1, "C D E", 7)], key=key)
