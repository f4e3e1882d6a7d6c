"""URL filter: rules first, then a character language-model ratio for the URLs that no rule decides."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a URL without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), "^[^?#]*", 0)
    none = F.lit("")
    return F.coalesce(F.translate(host, _UPPER, _LOWER), none), F.coalesce(path, none)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest (rule, verdict) that fits the host, itself or a parent of it, and starts the path;
    of equally long ones the last by code point; NULL where none fits. The rules are a short list, part of the plan."""
    fits = []
    for rule, verdict in rules:
        rule_host, slash, rest = rule.partition("/")
        on_host = (host == rule_host) | host.endswith("." + rule_host)
        fits.append(F.when(on_host & path.startswith(slash + rest), F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


class MarkovRatio:
    """Two smoothed variable-order Markov models over bytes, for accepted and for rejected URLs.

    A context (up to ``order`` bytes) is a state if it was seen often enough; P(byte | context) mixes its counts with
    the next shorter context by the Witten-Bell weight, down to a uniform law. Both models share one table.
    """

    def __init__(self, counts: dict[bytes, tuple[int, int]], order: int):
        """``counts``: context + byte -> how often in accepted and in rejected URLs; the end of a URL is byte 0 there."""
        self.order = order
        totals, kinds, after = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), defaultdict(list)
        for gram, both in counts.items():
            for side in (0, 1):
                totals[gram[:-1]][side] += both[side]
                kinds[gram[:-1]][side] += both[side] > 0
            after[gram[:-1]].append(gram[-1])
        self.failure = {c: tuple(math.log(kinds[c][s] / (totals[c][s] + kinds[c][s])) if kinds[c][s] else 0.0 for s in (0, 1)) for c in totals}
        self.arcs: dict[bytes, tuple[float, float]] = {}
        for context in sorted(after, key=len):
            for byte in after[context]:
                shorter = self.log_p(context[1:], byte) if context else (-math.log(257),) * 2
                both = counts[context + bytes([byte])]
                self.arcs[context + bytes([byte])] = tuple(
                    math.log((both[s] + kinds[context][s] * math.exp(shorter[s])) / (totals[context][s] + kinds[context][s])) if kinds[context][s] else shorter[s]
                    for s in (0, 1))

    def log_p(self, context: bytes, byte: int) -> tuple[float, float]:
        a = r = 0.0
        while True:
            arc = self.arcs.get(context + bytes([byte]))
            if arc is not None:
                return a + arc[0], r + arc[1]
            if (weight := self.failure.get(context)) is not None:
                a, r = a + weight[0], r + weight[1]
            if not context:
                return a - math.log(257), r - math.log(257)
            context = context[1:]

    def ratio(self, url: str | None) -> float:
        """Log-likelihood difference, accepted minus rejected, per byte (the end counts as one)."""
        data = (url or "").encode() + b"\0"
        total = 0.0
        for i, byte in enumerate(data):
            a, r = self.log_p(data[max(0, i - self.order) : i], byte)
            total += a - r
        return total / len(data)


def calibrated_threshold(scored: list[tuple[float, bool]]) -> float:
    """The cut with the best mean of the two classes' hit rates, half-way between neighbours; 0 if a class is missing.
    Of equally good cuts the one nearest to 0."""
    good, bad = sum(y for _, y in scored), sum(not y for _, y in scored)
    if not good or not bad:
        return 0.0
    scored = sorted(scored)
    best, below_good, below_bad = [], 0, 0
    for i, (value, y) in enumerate(scored):
        below_good, below_bad = below_good + y, below_bad + (not y)
        if i + 1 < len(scored) and scored[i + 1][0] > value:
            best.append((round((good - below_good) / good + below_bad / bad, 12), -abs((value + scored[i + 1][0]) / 2), (value + scored[i + 1][0]) / 2))
    return max(best)[2] if best else 0.0


def fit(labelled: DataFrame, order: int = 5, most_labelled: int = 20_000, least_count: int = 2) -> tuple[MarkovRatio, float]:
    """Model and threshold from (url, accepted).

    The fit reads a bounded sample: the ``most_labelled`` distinct URLs of each class that come first by hash, whole. A
    fifth of them by hash is held out for the threshold. N-grams of more than three bytes need ``least_count`` sightings.
    The bound on rows bounds what is sent to the executors: at most ``order`` + 1 n-grams per byte of the sample.
    """
    def first(accepted: bool) -> DataFrame:
        mine = labelled.filter(F.col("accepted") == accepted).select("url", "accepted").distinct()
        return mine.withColumn("h", F.xxhash64("url")).orderBy("h", "url").limit(most_labelled)

    sample = first(True).unionByName(first(False)).cache()
    data = F.concat(F.encode("url", "utf-8"), F.unhex(F.lit("00")))
    grams = F.explode(F.flatten(F.transform(
        F.array(*[F.lit(k) for k in range(order + 1)]),
        lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length("data") - k)), lambda i: F.when(i + k <= F.octet_length("data"), F.hex(F.substring("data", i, k + 1)))))))
    counted = (sample.filter(F.pmod("h", F.lit(5)) != 0).withColumn("data", data).select("accepted", grams.alias("gram")).filter("gram IS NOT NULL")
               .groupBy("gram").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
               .filter((F.length("gram") <= 6) | (F.col("a") + F.col("r") >= least_count)))
    model = MarkovRatio({bytes.fromhex(x["gram"]): (x["a"], x["r"]) for x in counted.collect()}, order)
    held = sample.filter(F.pmod("h", F.lit(5)) == 0).collect()
    threshold = calibrated_threshold([(model.ratio(x["url"]), x["accepted"]) for x in held])
    sample.unpersist()
    return model, threshold


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], **fitting) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per row of (page_id, url).

    The longest fitting rule decides; URLs that no rule decides are allowed if their length-normalised log-likelihood
    difference reaches the calibrated threshold. The URLs that rules decide are the labelled ones and have no score. A null or odd URL has
    empty host and path and is scored as the text it is (null as empty). If rules allow or block nothing, the threshold is
    0. Repeated rows stay; an empty table gives an empty table; other columns of the input are ignored.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    ruled = split.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    decided = ruled.filter("found IS NOT NULL AND url IS NOT NULL").select("url", (F.col("found.verdict") == ALLOW).alias("accepted"))
    model, threshold = fit(decided, **fitting)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            yield urls.map(sent.value.ratio, na_action="ignore").astype(float)

    # URLs that a rule decides send NULL to the model
    scored = ruled.withColumn("score", score(F.when(F.col("found").isNull(), F.coalesce("url", F.lit("")))))
    by_model = F.when(F.col("score") >= threshold, ALLOW).otherwise(BLOCK)
    return scored.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), by_model).alias("verdict"), "score")
