"""Operators 6, 8, 9 and 10 and the pipeline against brute force or held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from docfields.llm import imatch, ngram_lm
from docfields.llm.compression import calibration, classify
from docfields.llm.imatch import fingerprint_documents
from docfields.llm.mixing import hypergeometric, mix, mixed_documents, shards, split_quotas
from docfields.llm.ngram_lm import GRID, score_documents
from docfields.llm.stages import COLUMNS
from tests.llm.data import DOCS, documents, empty, words


def size_of(text):
    return len((text or "").encode().split())


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        level = (total - sum(3 * sizes[s] for s in stopped)) / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in stopped else weight[s] * level for s in names}
        stopped |= above


def test_mix_of_odd_documents(spark):
    docs = documents(spark)
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += size_of(r["text"])
    want = targets_by_hand(sizes)
    got = mix(docs, block_words=64, columns=("text",)).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["size"] == size_of(r["text"]) and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["size"] * len(r["draws"]) and len({d["repeat"] for d in r["draws"]}) == len(r["draws"]) <= 3
        taken[r["source"]] += r["taken"]
    # whole documents only: the end of the target is met to within half of the document across it
    largest = {s: max(r["size"] for r in got if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mix(docs.repartition(7), block_words=64).collect()))
    out = mixed_documents(docs, block_words=64).collect()
    assert list(out[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]
    # every row that comes out is a row that went in, as often as it was drawn
    fields = ("doc_id", "text", "source", "n_chars")
    drawn = Counter()
    for r in mix(docs, block_words=64, columns=("text", "n_chars")).collect():
        drawn[tuple(r[f] for f in fields)] += len(r["draws"])
    assert Counter(tuple(r[f] for f in fields) for r in out) == +drawn
    assert mix(empty(spark)).count() == 0 and mix(docs.filter("text IS NULL")).agg(F.sum("taken")).first()[0] == 0
    assert mixed_documents(empty(spark)).count() == 0


def test_shards_take_what_the_tree_deals_them(spark):
    rows = [(i, words(i, 5 + i % 40), "en", "abc"[i % 3], 1, 1, 1) for i in range(600)]
    docs = documents(spark, rows)
    mixed = mix(docs, block_words=16, levels=3, columns=("text",))
    draws = [r.asDict() for r in shards(mixed, "text").collect()]
    # disjoint: no document twice in a pass, and every pass of a source is full before the next begins
    assert len({(d["doc_id"], d["repeat"]) for d in draws}) == len(draws)
    # the tree's own quotas, drawn again: each shard's words of a source differ by a document at either end
    goals = {r["source"]: r["target"] for r in mixed.select("source", "target").distinct().collect()}
    quotas = spark.createDataFrame([(i, math.ceil(math.floor(goals[s] + 0.5) / 16)) for i, s in enumerate("abc")], "place long, blocks long")
    dealt = {("abc"[r["place"]], r["shard"]): r["blocks"] for r in split_quotas(quotas, 3).collect()}
    got = Counter()
    for d in draws:
        got[d["source"], d["shard"]] += size_of(d["text"])
    assert len(dealt) == 24 and all(abs(got[k] - 16 * blocks) <= 2 * 44 + 16 for k, blocks in dealt.items())
    # shards are equal parts of the mix, and another seed deals other blocks
    whole = Counter()
    for (_, shard), n in got.items():
        whole[shard] += n
    assert max(whole.values()) - min(whole.values()) < 0.15 * max(whole.values())
    other = {(d["doc_id"], d["repeat"]): d["shard"] for d in shards(mix(docs, block_words=16, levels=3, seed=1)).collect()}
    assert sum(other.get((d["doc_id"], d["repeat"])) == d["shard"] for d in draws) < 0.5 * len(draws)


def test_documents_come_shard_by_shard_in_random_order(spark):
    docs = documents(spark, [(i, words(i, 30), "en", "a", 1, 1, 1) for i in range(300)])
    out = mixed_documents(docs, levels=1, words_per_slice=10**9)
    parts = out.select("doc_id", F.spark_partition_id().alias("p")).collect()
    shard = {r["doc_id"]: r["shard"] for r in shards(mix(docs, levels=1)).collect()}
    for p in {r["p"] for r in parts}:
        line = [shard[r["doc_id"]] for r in parts if r["p"] == p]
        assert line == sorted(line)
    ids = [r["doc_id"] for r in parts]
    assert sum(a < b for a, b in zip(ids, ids[1:])) < 200


def test_quotas_are_exact_and_follow_the_law(spark):
    quotas = spark.createDataFrame([(0, 100), (1, 37), (2, 0), (3, 1)], "place long, blocks long")
    leaves = split_quotas(quotas, 3, 1).collect()
    per_source, per_shard = Counter(), Counter()
    for r in leaves:
        per_source[r["place"]] += r["blocks"]
        per_shard[r["shard"]] += r["blocks"]
        assert r["blocks"] >= 0
    assert +per_source == Counter({0: 100, 1: 37, 3: 1}) and sum(per_shard.values()) == 138 and max(per_shard.values()) - min(per_shard.values()) <= 1
    # inverse transform over an even grid gives every count its probability
    n, m, d, grid = 30, 12, 9, 20_000
    u = (F.col("id") + 0.5) / grid
    drawn = spark.range(grid).select(hypergeometric(*[F.lit(x).cast("long") for x in (n, m, d)], u).alias("h")).groupBy("h").count().collect()
    found = {r["h"]: r["count"] / grid for r in drawn}
    for h in range(0, 10):
        assert found.get(h, 0) == pytest.approx(math.comb(m, h) * math.comb(n - m, d - h) / math.comb(n, d), abs=2e-4)


def lm_by_hand(rows, order):
    """Scores by the interpolation formula, word by word, with the pair of the grid that fits best without the token itself."""
    tokens = [["<s>", *(r["text"] or "").encode().lower().split(), "</s>"] for r in rows]
    held = [zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 1 for r in rows]
    c = Counter()
    for w, out in zip(tokens, held):
        if not out:
            c.update(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    words = {g[0]: x for g, x in c.items() if len(g) == 1 and g != ("<s>",)}
    n, once = sum(words.values()), sum(x == 1 for x in words.values())
    u = (once + 0.5) / (n + 1)

    def p(gram, mu, kappa, less=0):
        count = c[gram] - less
        if len(gram) == 1:
            return (1 - u) * count / max(n - less, 1) if count > 0 else u
        h = c[gram[:-1]] - less
        part = mu * h / (h + kappa) if h > 0 else 0.0
        return (part * count / h if h > 0 and count > 0 else 0.0) + (1 - part) * p(gram[1:], mu, kappa, less)

    def score(w, *g):
        return sum(math.log10(p(tuple(w[max(0, i - order + 1) : i + 1]), *g)) for i in range(1, len(w)))

    best = max(GRID, key=lambda g: round(sum(score(w, *g, 1) for w, out in zip(tokens, held) if not out), 6))
    return [(r["doc_id"], out, len(w) - 1, sum(x in words for x in w[1:]), n,
             sum(math.log10((words.get(x, 0) + 0.5) / (n + 0.5 * (len(words) + 1))) for x in w[1:]), score(w, *best)) for r, w, out in zip(rows, tokens, held)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores(spark, monkeypatch, order):
    docs = documents(spark)
    rows = docs.collect()
    key = lambda r: (str(r[0]), r[2], r[5])
    want = sorted(lm_by_hand(rows, order), key=key)

    def held_against_hand(got):
        got = sorted(map(tuple, got.collect()), key=key)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert [r[5] for r in got] == pytest.approx([r[5] for r in want]) and [r[6] for r in got] == pytest.approx([r[6] for r in want])

    held_against_hand(score_documents(docs, order=order))
    # neither the cut into chunks nor that into pieces may show
    monkeypatch.setattr(ngram_lm, "TOKENS_PER_CHUNK", 150)
    monkeypatch.setattr(ngram_lm, "TOKENS_PER_PIECE", 3)
    held_against_hand(score_documents(docs.coalesce(1), order=order))


def test_lm_without_training_text(spark):
    docs = documents(spark)
    assert score_documents(empty(spark)).count() == 0
    untaught = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    assert {r["train_tokens"] for r in score_documents(untaught).collect()} <= {0}


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(imatch, "CHARS_PER_RANGE", 500)
    docs = documents(spark)
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    got = fingerprint_documents(docs, rarest=0.05).collect()
    want = []
    for i, r in enumerate(rows):
        text, following = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        half = len(text) // 2
        want.append((str(r["doc_id"]), len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[0] == prints[1] == prints[3] != prints[4] and prints[8] == prints[9]  # case does not count
    assert next(r["near_next"] for r in got if r["doc_id"] == 0) == 1.0
    assert fingerprint_documents(empty(spark)).count() == 0 and fingerprint_documents(docs.limit(1)).first()["near_next"] == 1.0


@given(st.lists(st.integers(0, 2**63), max_size=30, unique=True), st.integers(0, 2**32))
@settings(max_examples=50, deadline=None)
def test_fingerprint_ignores_order_and_counts(terms, seed):
    known = imatch.Fingerprints(np.sort(np.array([2**63 - 5], np.uint64)))
    text = [f"t{t}" for t in terms]
    again = text * 2
    random.Random(seed).shuffle(again)
    assert (known.of(" ".join(text)) == known.of(" ".join(again))).all()


def labelled(spark, n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = words(i, 3) + " " + " ".join(rng.choice(["the", "river", "was", "calm", "and", "people", "walked", "slowly", "home.", "It"]) + rng.choice(["", "s", "ly"]) for _ in range(80))
        rows.append((i, text if good else "!! ".join(text.upper().split()), "en", "abc"[i % 3], len(text), 1, 1))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    truth = dict(labels.select("doc_id", "quality").collect())
    got = classify(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    odd = documents(spark)
    marks = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 0, 0), (77777, 1, 0)], "doc_id long, quality int, toxic int"))
    scored = classify(odd, marks).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] in (5, 6)}) == 1
    assert classify(empty(spark), marks).count() == 0
    for only in (1, 0):  # one class, and no label at all
        assert len({r["score"] for r in classify(docs.limit(20), labels.filter(F.col("quality") == only).limit(60)).collect()}) == 1
    assert {r["score"] for r in classify(docs.limit(5), labels.filter("false")).collect()} == {0.5}


def test_calibration_keeps_the_rate():
    x = np.r_[np.linspace(-1, 1, 200), np.linspace(0, 2, 600)]
    y = np.r_[np.zeros(200, int), np.ones(600, int)]
    slope, intercept = calibration(x, y)
    assert slope > 0 and abs((1 / (1 + np.exp(-(slope * x + intercept)))).mean() - 0.75) < 0.01


def test_sampled_calibration_keeps_the_rate_of_all():
    rng = np.random.default_rng(4)
    x, y = np.r_[rng.normal(-1, 1, 2000), rng.normal(1, 1, 12_000)], np.r_[np.zeros(2000, int), np.ones(12_000, int)]
    some = np.r_[0:1000, 2000:3000]
    want, got = calibration(x, y), calibration(x[some], y[some], totals=(2000, 12_000))
    assert got == pytest.approx(want, abs=0.15)
    assert (1 / (1 + np.exp(-(got[0] * x + got[1])))).mean() == pytest.approx(6 / 7, abs=0.01)
    assert calibration(x[:5], y[:5], totals=(2, 5)) == (0.0, math.log(2))


def test_quality_does_not_depend_on_the_cap(spark):
    """Bad documents are like the good ones in all but some: the class rate decides where the curve lies."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(1400):
        good = rng.random() < 6 / 7
        shout = rng.random() < (0.3 if good else 0.7)
        text = " ".join(rng.choice(["the", "river", "was", "calm", "and", "people", "walked", "slowly", "home.", "It"]) + rng.choice(["", "s", "ly"]) for _ in range(60))
        rows.append((i, "!! ".join(text.upper().split()) if shout else text, "en", "a", len(text), 1, 1))
        labels.append((i, int(good), 0))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rate = labels.agg(F.avg("quality")).first()[0]
    for most in (4000, 100):
        mean, kept = classify(docs, labels, most_documents=most).agg(F.avg("score"), F.avg("predicted")).first()
        assert abs(mean - rate) < 0.06 and kept > 0.98, most


def test_pipeline_stages(spark, tmp_path):
    docs, labels = labelled(spark, 120)
    copies = docs.filter("doc_id < 30").withColumn("doc_id", F.col("doc_id") + 1000)
    docs.unionByName(copies).unionByName(documents(spark).withColumn("doc_id", F.col("doc_id") + 5000)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, now, str(tmp_path))
    truth = dict(labels.select("doc_id", "quality").collect())
    left = {r["doc_id"] for r in good.collect()}
    assert good.columns == list(COLUMNS) and {i for i, q in truth.items() if q} <= left and not {i for i, q in truth.items() if not q} & left
    single = stages["ngram_jaccard"](spark, good, str(tmp_path))
    ids = {r["doc_id"] for r in single.collect()}
    assert single.columns == list(COLUMNS) and not {i + 1000 for i in range(30)} & ids and {i for i in range(30)} & left <= ids
    mixed = stages["mixing"](spark, single, str(tmp_path))
    # whole documents: each source ends within half a document of its target, and no text is new
    drift = sum(size_of(r["text"]) for r in mixed.collect()) - sum(size_of(r["text"]) for r in single.collect())
    largest = max(size_of(r["text"]) for r in single.collect())
    assert mixed.columns == list(COLUMNS) and abs(drift) <= 3 * (largest / 2 + 1)
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in single.collect()}
    packed = stages["best_fit_packing"](spark, mixed, str(tmp_path))
    assert packed.filter("piece = 0").count() == mixed.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0, name


def test_one_row_of_each_group_stays(spark, tmp_path):
    """Repeated ids with different texts, and copies under null ids."""
    a, b, c, d = (words(i, 60) for i in (21, 22, 23, 24))
    texts = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, b), (None, c), (None, c + " z"), (9, c), (None, d), (None, d), (7, ""), (7, ""), (None, None)]
    docs = documents(spark, [(i, t, "en", "a", 1, 1, 1) for i, t in texts])
    got = dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, str(tmp_path))
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted([(1, a), (1, b), (9, c), (None, d), (7, ""), (7, ""), (None, None)], key=key)
