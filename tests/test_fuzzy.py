"""The candidate join loses no pair that reaches the threshold."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docfields.operators.correct import apply_fuzzy_rules, match_dictionary
from docfields.operators.fuzzy import best_matches, candidate_pairs, key_plan, met_pairs


def _words(seed, n, alphabet):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(n)]
    out = set(base)
    for w in base:
        chars = list(w)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(chars) + 1)
            chars[at:at + rng.randint(0, 1)] = rng.choice(["", rng.choice(alphabet)])
        if chars:
            out.add("".join(chars))
    return sorted(w for w in out if w)


@pytest.mark.parametrize("threshold,alphabet", [(0.8, "abcd"), (0.75, "abcdefgh"), (0.6, "abc"), (0.9, "ab cd")])
def test_candidates_are_lossless(spark, threshold, alphabet):
    left, right = _words(1, 60, alphabet), _words(2, 60, alphabet) + _words(1, 20, alphabet)
    right = sorted(set(right))
    values = spark.createDataFrame([("f", w) for w in left], "field string, _value string")
    entries = spark.createDataFrame([("f", w) for w in right], "field string, _entry string")
    pairs = [(r["_value"], r["_entry"]) for r in candidate_pairs(values, entries, threshold, "field", "_value", "_entry").collect()]
    assert len(pairs) == len(set(pairs))
    wanted = {(a, b) for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= threshold}
    assert wanted <= set(pairs)
    best = {r["_value"]: r["_rank"] for r in best_matches(values, entries.withColumn("_rank", F.col("_entry")), threshold).collect()}
    for a in left:
        scores = [(-SequenceMatcher(None, a, b).ratio(), b) for b in right]
        top = min(scores)
        assert best.get(a) == (top[1] if -top[0] >= threshold else None)


def test_rules_exact_before_similar_and_last_duplicate_wins(spark):
    rules = spark.createDataFrame(
        [(1, "Branch", "HOSUR", "OLD"), (2, "Branch", "HOSUR", "NEW"), (3, "Vehicle", "TN01", "X"), (4, "Branch", "", "EMPTY")],
        "id int, field_name string, from_value string, to_value string")
    values = spark.createDataFrame(
        [(1, "Branch", "HOSUR"), (2, "Branch", "hosurr"), (3, "Vehicle", "TN01 "), (4, "Branch", ""), (5, "Branch", None)],
        "n int, field string, value string")
    got = {r["n"]: (r["new_value"], r["changed"]) for r in apply_fuzzy_rules(values, rules).collect()}
    assert got == {1: ("NEW", True), 2: ("NEW", True), 3: ("TN01 ", False), 4: ("", False), 5: (None, False)}


def test_dictionary_keeps_unknown_names(spark):
    names = spark.createDataFrame([("POTTANERI", 0), ("SALEM", 1)], "name string, ord int")
    values = spark.createDataFrame([("pottaner1",), (" Salem ",), ("ERODE",), (None,)], "value string")
    got = {r["value"]: r["matched"] for r in match_dictionary(values, names).collect()}
    assert got == {"pottaner1": "POTTANERI", " Salem ": "SALEM", "ERODE": "ERODE", None: None}


# a suffix that all names share is most of what random names have in common
@pytest.mark.parametrize("threshold,suffix,most", [(0.8, "", 0.05), (0.75, "", 0.05), (0.8, " traders", 0.1)])
def test_few_pairs_meet_and_the_share_does_not_grow(spark, threshold, suffix, most):
    rng = random.Random(4)
    shares = []
    for n in (150, 600):
        names = ["".join(rng.choice("bcdfghklmnprstvz") for _ in range(18)) + suffix for _ in range(n)]
        damaged = [w[:7] + w[8:] for w in names]
        values = spark.createDataFrame([("f", w) for w in damaged], "field string, _value string")
        entries = spark.createDataFrame([("f", w) for w in names], "field string, _entry string")
        joined, _, _ = met_pairs(values, entries, threshold, "field", "_value", "_entry")
        met = joined.distinct().count()
        assert met >= n
        shares.append((met - n) / n**2)
    assert max(shares) < most and shares[1] < 1.3 * shares[0] + 0.002


def test_kinds_of_keys_agree_from_both_sides():
    for threshold in (0.6, 0.75, 0.8, 0.95):
        for m in range(1, 40):
            for n in range(1, 40):
                assert key_plan(m, [n], threshold).keys() == key_plan(n, [m], threshold).keys()


def test_long_and_monotonous_texts_meet(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefghij klmnop") for _ in range(150)) for _ in range(6)] + ["a" * 120, "ab" * 70]
    damaged = [w[:20] + w[26:90] + "zzzz" + w[90:] for w in base]
    values = spark.createDataFrame([("f", w) for w in damaged], "field string, _value string")
    entries = spark.createDataFrame([("f", w, w) for w in base], "field string, _entry string, _rank string")
    got = {r["_value"]: r["_rank"] for r in best_matches(values, entries, 0.8).collect()}
    assert got == dict(zip(damaged, base))
