"""Operators 2, 3, 4 and 5 against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docfields.llm.components import components
from docfields.llm.jaccard_join import allocation, band_edges, jaccard_components, most_different
from docfields.llm.preference import branched_pairs, format_preferences
from docfields.llm.topk import exact_top_k
from docfields.llm.url_filter import ALLOW, BLOCK, calibrated_threshold, judge
from tests.llm.data import documents, empty, words

PAIRS = "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string"


def test_preference_pairs(spark):
    u, a, b = ("user", "q"), ("assistant", "yes"), ("assistant", "no")
    rows = [(1, [u, a, u, a], [u, a, u, b], "x"), (2, [u, a], [u, a], None), (3, None, [a], None), (4, [("system", None), a], [(None, "q"), b, u], None),
            (5, [], [], None), (6, [u], [u, b], None), (6, [u], [u, b], None), (7, [(None, None), a], [(None, None), b], None)]
    got = format_preferences(spark.createDataFrame(rows, PAIRS)).orderBy("id").collect()

    def render(turns):
        return "".join(f"<|{r or ''}\n{t or ''}<|end|>\n" for r, t in turns)

    for row, out in zip(rows, got):
        left, right = row[1] or [], row[2] or []
        k = 0
        while k < min(len(left), len(right)) and left[k] == right[k]:
            k += 1
        assert out["prompt_turns"] == k and out["prompt"] == render(left[:k])
        for turns, text, mask in ((left[k:], out["chosen_text"], out["chosen_mask"]), (right[k:], out["rejected_text"], out["rejected_mask"])):
            assert text == render(turns)
            assert [text[m["start"] : m["stop"]] for m in mask] == [f"{t or ''}<|end|>\n" for r, t in turns if r == "assistant"]
    assert format_preferences(empty(spark, PAIRS)).count() == 0


def test_conversation_pairs(spark):
    schema = "conv_id long, turn long, role string, text string, cut int"
    rows = [(0, 0, "user", "a", 1), (0, 1, "assistant", "b", 1), (1, 0, "user", "c", 1), (4, None, None, None, 1), (None, 0, "user", "x", 1), (0, 1, "assistant", "b", 1)]
    got = {r["conv_id"]: r for r in branched_pairs(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {0, 1, 4} and [t["text"] for t in got[0]["chosen"]] == ["a", "b", "b"] and [t["text"] for t in got[0]["rejected"]] == ["c"]
    assert branched_pairs(empty(spark, schema)).count() == 0


RULES = [("com/", ALLOW), ("example.com/en/", BLOCK), ("www.example.com/en/", ALLOW), ("net/es/", BLOCK), ("net/fr/", BLOCK)]


def judged_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(host) :]
    path = next((path[:i] for i, c in enumerate(path) if c in "?#"), path)
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(r), r, v) for r, v in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits)[1] if fits else None


def test_urls(spark):
    odd = [None, "", "no scheme", "http://", "http://COM", "http://com/", "http://xcom/", "http://a.COM/x", "http://Example.com/en/x?y#z", "http://www.example.com/en/", "http://a.www.example.com/en/q",
           "ftp://é.net/es/", "http://net/es/", "http://net/es", "http://a.net/fr/" + "z" * 5000, "a://b://c.com/d", "http://x.com?u=/en/", "http://x.com#/", "http://a.org/\nnew/line", "http://a.org/q://com/"]
    urls = odd + [f"http://good{i % 7}.example.com/fr/{i}" for i in range(60)] + [f"http://spam{i % 5}.example.net/es/{i}" for i in range(60)] + ["http://good1.example.org/de/5", "http://spam1.example.org/es/5"]
    pages = spark.createDataFrame([(i if i else None, u, "x", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, score double")
    got = judge(pages, RULES).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule = judged_by_hand(urls[r["page_id"] or 0])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (dict(RULES)[rule] if rule else r["verdict"]) and r["verdict"] in (ALLOW, BLOCK)
    by_url = {urls[r["page_id"] or 0]: r["verdict"] for r in got}
    assert by_url["http://good1.example.org/de/5"] == ALLOW and by_url["http://spam1.example.org/es/5"] == BLOCK
    assert judge(pages.filter("false"), RULES).count() == 0 and judge(pages.limit(3), []).count() == 3
    assert calibrated_threshold([(1.0, True), (2.0, True)]) == 0.0 and calibrated_threshold([(1.0, False), (3.0, True)]) == 2.0


def brute_components(rows, n, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                top[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return [(d, len(s), ids.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("percent,n", [(85, 4), (80, 5)])
def test_jaccard_groups_against_brute_force(spark, percent, n):
    """Edits right at the threshold over all sizes: the pigeonhole argument must not lose one link."""
    rng = random.Random(percent)
    rows = []
    for size in [1, 2, 3, 4, 5, 6, 8, 10, 12, 14, 17, 20, 25, 30, 40, 55, 80, 120, 200, 400]:
        for copy in range(3):
            base = words(size * 10 + copy, size, 5000).split()
            rows.append(" ".join(base))
            for _ in range(4):
                edited = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    at = rng.randrange(len(edited) + 1)
                    edited[at : at + rng.randint(0, 2)] = [f"e{rng.randrange(999)}"] * rng.randint(0, 2)
                rows.append(" ".join(edited))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, n, percent).collect())
    assert got == sorted(brute_components(rows, n, percent))


def test_jaccard_of_odd_documents(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()), key=key)
    assert got == sorted(brute_components(rows, 4, 85), key=key)
    assert jaccard_components(empty(spark)).count() == 0


def test_segments_cover_the_difference():
    edges = band_edges(85, 5000)
    for band in range(len(edges) - 3):
        h = most_different(edges, band, 85)
        deletions, exact, slack = allocation(h, edges[band + 1], 10**6)
        assert 2 * deletions + exact >= h + 1 + slack
        for r in (edges[band], edges[band + 1] - 1):
            assert r * 100 // 85 < edges[band + 2]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(10, 40)] + [(3, 3), (None, 4), (50, 5), (5, 50)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in [5, 50, *range(10, 40)]} == {5} and set(got) == {*range(100, 141), 5, 50, *range(10, 40)}
    assert components(empty(spark, "a long, b long")).count() == 0


def test_url_ratio_against_a_plain_model(spark):
    """The verdict of unruled URLs from counts kept in plain dictionaries, by the recursion of the smoothed law; a very long URL is fitted too."""
    order, least = 3, 2
    good, bad = [f"http://a{i % 7}.com/x/{i}" for i in range(40)] + ["http://a1.com/" + "qz" * 3000], [f"http://b{i % 5}.net/es/{i * 3}" for i in range(40)]
    others = ["http://q.org/qzqzqz", "http://q.org/es/9", "odd", ""]
    pages = spark.createDataFrame(list(enumerate(good + bad + others)), "page_id long, url string")
    labelled = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "url string, accepted boolean")
    keys = {r["url"]: r["h"] for r in labelled.select("url", F.xxhash64("url").alias("h")).collect()}
    counts = [{}, {}]
    for side, urls in enumerate((good, bad)):
        for u in urls:
            if keys[u] % 5:
                data = u.encode() + b"\0"
                for k in range(order + 1):
                    for i in range(len(data) - k):
                        counts[side][data[i : i + k + 1]] = counts[side].get(data[i : i + k + 1], 0) + 1
    both = {g for g in {*counts[0], *counts[1]} if len(g) <= 3 or counts[0].get(g, 0) + counts[1].get(g, 0) >= least}

    def p(side, context, byte):
        shorter = p(side, context[1:], byte) if context else 1 / 257
        here = {g: c for g, c in counts[side].items() if g in both and g[:-1] == context}
        return (here.get(context + bytes([byte]), 0) + len(here) * shorter) / (sum(here.values()) + len(here)) if here else shorter

    def ratio(url):
        data = url.encode() + b"\0"
        return sum(math.log(p(0, data[max(0, i - order) : i], b) / p(1, data[max(0, i - order) : i], b)) for i, b in enumerate(data)) / len(data)

    cut = calibrated_threshold([(ratio(u), u in good) for u in good + bad if keys[u] % 5 == 0 and len(u) < 1000])
    got = {r["page_id"]: r for r in judge(pages, [("com/", ALLOW), ("net/", BLOCK)], order=order, least_count=least).collect()}
    assert len(got) == len(good + bad + others)
    for i, url in enumerate(others, len(good + bad)):
        assert got[i]["score"] == pytest.approx(ratio(url), abs=1e-9) and got[i]["verdict"] == (ALLOW if ratio(url) >= cut else BLOCK)
    assert all(got[i]["score"] is None and got[i]["rule"] for i in range(len(good + bad)))


def test_repeated_ids_are_rows_of_their_own(spark):
    """Of rows that share an id each counts; a very long vector and its copy."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.25, 0.0]), (10, [0.5] * 5000), (11, [0.5] * 5000)]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 1, 65536), (0, 2, 1, 32768), (10, 1, 11, 128 * 128 * 5000)]


def test_top_k_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.random()]) for _ in range(20)], 1) for i in range(300)]
    rows += [(300 + i, rows[i][1], 1) for i in range(20)]  # ties
    odd = [(1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")] * 20, 1), (1003, [float("inf")] * 20, 1), (None, [1.0] * 20, 1)]
    # rows that share an id with others, queries among them, equal and different vectors
    rows += [(5, rows[5][1], 1), (7, rows[8][1], 1), (10, rows[11][1], 1), (10, rows[11][1], 1), (1010, [1.0, 2.0], 1), (1020, [2.0, 2.0], 1)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, d int")
    got = {}
    for r in exact_top_k(vectors, F.col("vec_id") % 10 == 0, k=5, block_rows=60).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = [(i, [int(256 * x // 1) for x in v]) for i, v, _ in rows]
    want = {}
    for n, (q, own) in enumerate(ints):
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(own, v)), i) for m, (i, v) in enumerate(ints) if m != n and len(v) == len(own))[:5]
            want.setdefault(q, []).extend((r + 1, i, -score) for r, (score, i) in enumerate(best))
    for q, lines in want.items():
        assert sorted(got.pop(q)) == sorted(lines)
    assert not got
    assert exact_top_k(vectors.filter("false"), F.col("vec_id") % 10 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e18]), (1, [1e18]), (2, [-1e18])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in exact_top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]
