"""Small inputs with everything that can go wrong in them."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, block int"


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, rows=None):
    """Copies, near copies, nulls in every column, empty, one-word and very long texts, repeated rows, clashing extra columns."""
    base = words(1, 120)
    near = base.split()
    near[60] = "other"
    texts = [base, base, " ".join(near), base.upper(), words(2, 50), "", None, " \t\n", "one", "One", "two words", words(3, 20_000), words(4, 90) + " é İ ß 漢字", words(5, 4)]
    out = [(i, t, "en" if i % 3 else None, ("a", "b", None)[i % 3], None if t is None else len(t), 7, 1) for i, t in enumerate(texts)]
    out += [out[4], out[8], (None, words(6, 30), "en", "a", 10, 0, 0), (None, None, None, None, None, None, None), (10**12, words(7, 200), "de", "b", 5, 1, 1)]
    return spark.createDataFrame(out if rows is None else rows, DOCS)


def empty(spark, schema: str = DOCS):
    return spark.createDataFrame([], schema)
