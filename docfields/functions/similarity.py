"""the one string measure Spark lacks, as Arrow-batched UDFs over ``difflib``.

The UDF bodies are nested functions, so they travel to executors by value and the package need not be installed
there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfields.functions.text import let


def _ratio_udf():
    import pandas as pd

    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([
            None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)
        ], dtype="float64")

    ratio.__annotations__ = {"left": pd.Series, "right": pd.Series, "return": pd.Series}
    return F.pandas_udf(ratio, T.DoubleType())


def similarity(left: Column, right: Column, once: bool = False) -> Column:
    """Matched characters over mean length. The argument order matters: the value comes first. With ``once`` the optimizer
    may neither repeat the call nor move it, so a filter on the score does not score a second time."""
    ratio = _ratio_udf()
    return (ratio.asNondeterministic() if once else ratio)(left, right)


def _closeness_udf(target: str, limit: float):
    import pandas as pd

    def close(words: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        known: dict = {}
        matcher = SequenceMatcher(None, "", target)

        def accepted(word):
            if word not in known:
                matcher.set_seq1(word)
                known[word] = matcher.ratio() >= limit
            return known[word]

        return pd.Series([None if ws is None else "\n".join(filter(accepted, ws.split("\n"))) or None for ws in words], dtype="object")

    close.__annotations__ = {"words": pd.Series, "return": pd.Series}
    return F.pandas_udf(close, T.StringType())


def close_words(words: Column, target: str, limit: float) -> Column:
    """The different words of an array that are at least as similar to one fixed word as the limit; none may hold a line break.

    Matched characters are at most those of the word that the target has too; only words for which these could do reach
    the scorer, and rows without such words send NULL and get NULL.
    """
    size = len(target)

    def could(word: Column) -> Column:
        shared = F.length(F.regexp_replace(word, "[^" + "".join(sorted(set(target))) + "]", ""))
        return (F.length(word) <= int(size * (2 - limit) / limit + 1e-6)) & (shared >= (F.length(word) + size) * (limit / 2) - 1e-6)

    joined = F.array_join(F.filter(F.array_distinct(words), could), "\n")
    return F.split(_closeness_udf(target, limit)(let(joined, lambda j: F.when(j != "", j))), "\n")


def _closest_udf(names: tuple[str, ...], limit: float):
    import pandas as pd

    def closest(values: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def best(value):
            top, found = limit, None
            for name in names:
                matcher = SequenceMatcher(None, value, name)
                # the quick ratios are upper bounds
                if matcher.real_quick_ratio() < top or matcher.quick_ratio() < top:
                    continue
                score = matcher.ratio()
                if score > top or (found is None and score >= top):
                    top, found = score, name
            return found

        known = {v: best(v) for v in set(values) if v is not None}
        return pd.Series([known.get(v) for v in values], dtype="object")

    closest.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(closest, T.StringType())


def closest_name(value: Column, names: tuple[str, ...], limit: float) -> Column:
    """The most similar of a few fixed names, the first of equally close ones; NULL when none reaches the limit."""
    return _closest_udf(tuple(names), limit)(value)
