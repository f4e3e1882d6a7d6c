"""Cases of the fourth round's findings."""

from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_shuffle_no_text_that_stays(spark):
    from docfields.llm.stages import COLUMNS, near_duplicates

    def text(i, words=60):
        return " ".join(f"w{i}x{j}" for j in range(words))

    rows = [(i, text(i), "en", "a", 1) for i in range(40)]
    # copies: the smallest id stays; of one id the first by its other columns; a null id only where there is no other
    rows += [(100 + i, text(i), "en", "a", 1) for i in range(5)] + [(7, text(7), "de", "a", 1), (7, text(7), "en", "a", 0)]
    rows += [(None, text(3), "en", "a", 1), (None, text(90), "en", "b", 1), (None, text(90), "en", "a", 1), (None, text(90), "en", "a", 1)]
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"), "")
    wanted = [r for r in rows[:40] if r[0] != 7] + [(7, text(7), "de", "a", 1), (None, text(90), "en", "a", 1)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)
    alone = near_duplicates(spark, spark.createDataFrame(rows[:45], got.schema), "")
    assert "Aggregate" not in _plan(alone)
    # of 45 rows only the five that go, and few that the bitmap cannot tell from them, meet the join
    doubtful = alone._jdf.queryExecution().optimizedPlan().children().apply(1)
    assert "LeftAnti" in doubtful.toString()
    assert alone.count() == 40 and [f.name for f in alone.schema] == list(COLUMNS)


def _shuffled(spark, df):
    """Bytes that a query writes to shuffles, with the steps that run while it is planned."""
    sc, group = spark.sparkContext, f"shuffled {df}"
    sc.setJobGroup(group, group)
    df().write.format("noop").mode("overwrite").save()
    sc.setLocalProperty("spark.jobGroup.id", None)
    store = sc._jsc.sc().statusStore()
    stages = {s for job in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(job).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


def test_similar_values_shuffle_texts_and_not_their_keys(spark):
    import random

    from docfields.operators.fuzzy import best_matches

    rng = random.Random(11)
    names = ["".join(rng.choice("bcdfghklmnprstvz") for _ in range(18)) for _ in range(2000)]
    far = ["".join(rng.choice("bcdfghklmnprstvz") for _ in range(18)) for _ in range(2000)]
    values = spark.createDataFrame([("f", w[:7] + w[8:]) for w in names] + [("f", w) for w in far], "field string, _value string")
    entries = spark.createDataFrame([("f", w, i) for i, w in enumerate(names)], "field string, _entry string, _rank int")
    # 1.7 million keys of twelve bytes and more before
    assert _shuffled(spark, lambda: best_matches(values, entries, 0.8)) < 2_000_000


def test_best_matches_agree_at_every_step_and_in_many_tiles(spark, monkeypatch):
    import random
    from difflib import SequenceMatcher

    from docfields.operators import fuzzy

    monkeypatch.setattr(fuzzy, "FEW_VALUES", 0)
    monkeypatch.setattr(fuzzy, "TILE_TEXTS", 16)
    rng = random.Random(12)
    names = sorted({"".join(rng.choice("abcdefgh ") for _ in range(rng.randint(4, 16))) for _ in range(60)} | {"a" * 230, "xy" * 120})
    values = set(names[::3])
    for name in names:
        for damage in (1, 2, 3):
            w = list(name)
            for _ in range(damage):
                w[rng.randrange(len(w))] = rng.choice(["", "q", "a"])
            values.add("".join(w) or "z")
    rows = [(f, v) for f in ("f", "g") for v in sorted(values)]
    known = [("f", n, i) for i, n in enumerate(names)] + [("g", n, i) for i, n in enumerate(names[::2])]
    got = fuzzy.best_matches(spark.createDataFrame(rows, "field string, _value string"),
                             spark.createDataFrame(known, "field string, _entry string, _rank int"), 0.75)
    wanted = {}
    for f, v in rows:
        score, rank = min((-SequenceMatcher(None, v, n).ratio(), i) for g, n, i in known if g == f)
        if -score >= 0.75:
            wanted[f, v] = (rank, -score)
    assert {(r["field"], r["_value"]): (r["_rank"], r["_score"]) for r in got.collect()} == wanted


def _exchanges(df, column):
    """Shuffles of a plan whose rows hold the column."""
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if "Exchange" in node.nodeName():
            found.append(any(a.name() == column for a in _items(node.output())))
        for child in _items(node.children()):
            walk(child)

    def _items(seq):
        return [seq.apply(i) for i in range(seq.size())]

    walk(plan.inputPlan() if hasattr(plan, "inputPlan") else plan)
    return sum(found)


def _page_words(spark):
    rows = [(d, 1, i, w, (i * 37) % 900, (i // 6) * 18 + i % 5, 30, 12) for d in range(3) for i, w in enumerate(["Deliver", "to", "Name", "x", "Address", "y"] * 20)]
    return spark.createDataFrame(rows, "doc_id int, page_no int, word_no int, text string, left int, top int, w int, h int")


def test_words_in_reading_order_are_shuffled_once(spark):
    from docfields.operators.layout import band_rows, header_score, reading_order

    words = _page_words(spark)
    ordered = reading_order(words)
    assert _exchanges(ordered, "text") == 1
    assert _exchanges(header_score(words, "Deliver"), "text") == 1
    banded = {(r["doc_id"], r["word_no"]): r["band"] for r in band_rows(words, span=32).collect()}
    for d in range(3):
        mine = sorted((r for r in ordered.collect() if r["doc_id"] == d), key=lambda r: (r["band"], r["left"], r["word_no"]))
        assert [r["read_no"] for r in mine] == list(range(1, 121)) and all(banded[d, r["word_no"]] == r["band"] for r in mine)


def test_only_flagged_words_are_shuffled_for_the_nearest_anchor(spark):
    from docfields.operators.layout import nearest_anchor

    words, k = _page_words(spark), F.col("word_no") % 5
    near = nearest_anchor(words, k == 0, k.isin(0, 1, 3))
    assert len([x for x in _plan(near).split("\n") if "Exchange" in x]) == 1
    rows = [r for r in words.collect()]
    for got in near.collect():
        a, b = ([r for r in rows if r["doc_id"] == got["doc_id"] and r["word_no"] % 5 in ks] for ks in ((0,), (0, 1, 3)))
        pairs = [(abs(x["top"] - y["top"]) + y["left"] - x["left"] - x["w"], x["word_no"], y["word_no"]) for x in a for y in b
                 if abs(x["top"] - y["top"]) < 15 and 0 < y["left"] - x["left"] - x["w"] < 100]
        assert (got["distance"], got["a_word_no"], got["b_word_no"]) == min(pairs)
    assert near.count() == 3


def test_headers_of_delivery_addresses_are_made_once(spark, monkeypatch):
    from docfields.operators import layout, records

    words, read = _page_words(spark), []
    header = layout.delivery_header

    def counted(words, keys):
        rows = spark.sparkContext.accumulator(0)
        read.append(rows)

        def seen(batches):
            for batch in batches:
                rows.add(len(batch))
                yield batch

        found = header(words, keys)
        return found.mapInArrow(seen, found.schema)

    monkeypatch.setattr(layout, "delivery_header", counted)
    headers = header(words.withColumn("text", F.when(F.col("text") == "Deliver", "Delivery Address").otherwise(F.col("text"))), records.PAGE).count()
    records.delivery_addresses(words.withColumn("text", F.when(F.col("text") == "Deliver", "Delivery Address").otherwise(F.col("text")))).collect()
    assert headers and read[0].value == headers
