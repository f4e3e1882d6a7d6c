"""Compression classifier: which of two zstandard dictionaries, from good or from bad text, makes a text smaller."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import bucket_of_text, in_small_batches


class DictionaryPair:
    """The normalised compressed-size difference of a text under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes, window: int, level: int):
        self.good, self.bad, self.window, self.level = good, bad, window, level
        self._ready = None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def _compressors(self):
        if self._ready is None:
            plain = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
            self._ready = []
            for data in (self.good, self.bad):
                known = {}
                if data:
                    known["dict_data"] = zstandard.ZstdCompressionDict(data)
                    known["dict_data"].precompute_compress(level=self.level)
                self._ready.append(zstandard.ZstdCompressor(level=self.level, **known, **plain))
        return self._ready

    def difference(self, text: bytes) -> float:
        """(size under bad - size under good) / sum of both, over all windows of the text; 0 for an empty text.

        Each window is compressed by itself: the dictionary, not what a long text says earlier, decides its size.
        """
        good, bad = self._compressors()
        g = b = 0
        for at in range(0, len(text), self.window):
            part = text[at : at + self.window]
            g += len(good.compress(part))
            b += len(bad.compress(part))
        return (b - g) / (b + g) if g else 0.0


def calibration(values: np.ndarray, labels: np.ndarray, rounds: int = 100, totals: tuple[float, float] | None = None) -> tuple[float, float]:
    """(slope, intercept) of the logistic curve from difference to probability; labels are drawn in a little, as Platt
    proposed, so that separable classes keep finite values. With one class the slope is 0.

    ``totals`` are the numbers of rows with label 0 and 1 that the given rows were drawn from: each class weighs as much as
    all its rows do, so the probabilities keep their rate and not the sample's.
    """
    good, bad = int((labels == 1).sum()), int((labels == 0).sum())
    all_bad, all_good = totals or (bad, good)
    if not good or not bad:
        return 0.0, math.log((all_good + 1) / (all_bad + 1))
    weight = np.where(labels == 1, all_good / good, all_bad / bad)
    weight *= len(weight) / weight.sum()
    goal = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = values.std() or 1.0
    x = np.stack([values / scale, np.ones_like(values)])
    w = np.array([0.0, math.log((all_good + 1) / (all_bad + 1))])

    def loss(w: np.ndarray) -> float:
        z = w @ x
        return float((weight * (np.logaddexp(0, z) - goal * z)).sum()) + 0.5e-6 * float(w @ w)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(w @ x)))
        slope = x @ (weight * (p - goal)) + 1e-6 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(2), slope)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return float(w[0] / scale), float(w[1])


def _text_bytes(batch: pa.RecordBatch, at: int) -> pa.Array:
    return batch.column(at).cast(pa.binary())


def fit(labelled: DataFrame, most_documents: int = 4000, most_pieces: int = 6000, window: int = 2048, dictionary_bytes: int = 65_536, level: int = 3,
        stands_for: tuple[float, float] = (1.0, 1.0)):
    """A DictionaryPair and its calibration from (doc_id, text, label) with labels 0 and 1.

    The fit reads a bounded sample: of each class the ``most_documents`` that come first by a hash of doc_id. Half of them give
    the dictionaries (of each class the first ``most_pieces`` windows by hash), the other half the calibration,
    in which each class weighs as many rows as it has in ``labelled``, times the rows that each one stands for (``stands_for``, of
    labels 0 and 1). Labels other than 0 and 1 and null texts are left out. With too little text of a class there is no
    dictionary for it.
    """
    h = F.xxhash64("doc_id", "text")
    usable = labelled.filter("label IN (0, 1) AND text IS NOT NULL").select("doc_id", "text", F.col("label").cast("int").alias("label"), h.alias("h"))
    sample = usable.filter("label = 1").orderBy("h").limit(most_documents).unionByName(usable.filter("label = 0").orderBy("h").limit(most_documents)).cache()
    piece = F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / window)), lambda i: F.struct(i.alias("i"), F.substring(F.col("text"), (i * window + 1).cast("int"), F.lit(window)).alias("t"))))
    pieces = sample.filter(F.pmod("h", F.lit(2)) == 0).select("label", "h", piece.alias("p")).filter("p.t <> ''")

    def dictionary(label: int) -> bytes:
        some = pieces.filter(F.col("label") == label).orderBy(F.xxhash64("h", "p.i"), "h", "p.i").select("p.t").limit(most_pieces).collect()
        texts = [r["t"].encode() for r in some]
        size = min(dictionary_bytes, sum(map(len, texts)) // 8)
        try:
            return zstandard.train_dictionary(size, texts).as_bytes() if size >= 512 and len(texts) >= 8 else b""
        except zstandard.ZstdError:
            # too few different substrings to choose from: the texts themselves
            return zstandard.ZstdCompressionDict(b"".join(texts)[:dictionary_bytes], dict_type=zstandard.DICT_TYPE_RAWCONTENT).as_bytes()

    pair = DictionaryPair(dictionary(1), dictionary(0), window, level)
    apart = differences(sample.filter(F.pmod("h", F.lit(2)) == 1).select("label", "text"), pair).toPandas()
    sample.unpersist()
    rows = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    totals = (rows.get(0, 0) * stands_for[0], rows.get(1, 0) * stands_for[1])
    return pair, calibration(apart["difference"].to_numpy(np.float64), apart["label"].to_numpy(np.int64), totals=totals)


def differences(rows: DataFrame, pair: DictionaryPair) -> DataFrame:
    """label, difference of (label, text)."""
    sent = rows.sparkSession.sparkContext.broadcast(pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"label": batch.column(0), "difference": pa.array([sent.value.difference(t.as_py() or b"") for t in _text_bytes(batch, 1)], pa.float64())})

    return rows.mapInArrow(run, "label int, difference double")


def scored(docs: DataFrame, pair: DictionaryPair, curve: tuple[float, float], text: Column) -> DataFrame:
    """The columns of ``docs`` and score. Text, which alone is an input of the score, is read whole."""
    sent = docs.sparkSession.sparkContext.broadcast(pair)
    slope, intercept = curve

    @F.pandas_udf("double")
    def difference(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: sent.value.difference(t.encode("utf-8", "surrogatepass"))).astype(float)

    z = difference(F.coalesce(text.cast("string"), F.lit(""))) * slope + intercept
    return docs.withColumn("score", 1 / (1 + F.exp(-z)))


def quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, most_documents: int = 4000, **fitting):
    """Fit on labels of rows whose crc32(doc_id as text) mod ``folds`` is not 0; only a bounded sample of ids is joined to texts,
    and each of them stands for as many ids as its class has to one drawn."""
    in_small_batches(docs.sparkSession)
    known = (labels.filter(F.col("doc_id").isNotNull() & (bucket_of_text(F.col("doc_id"), folds) != 0))
             .groupBy("doc_id").agg(F.min(label).alias("label")).filter("label IN (0, 1)").withColumn("h", F.xxhash64("doc_id")))
    ids = known.filter("label = 1").orderBy("h").limit(most_documents).unionByName(known.filter("label = 0").orderBy("h").limit(most_documents))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    stands_for = tuple(max(1.0, counts.get(c, 0) / most_documents) for c in (0, 1))
    chosen = ids.select(F.col("doc_id").alias("of"), "label")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("doc_id", "text", "label")
    return fit(texts, most_documents=most_documents, stands_for=stands_for, **fitting)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, least: float = 0.3, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of (doc_id, text).

    ``score`` is the calibrated probability of label 1, ``predicted`` 1 from ``least`` on, ``held_out`` whether the row's label
    was kept from the fit. Null texts are empty; empty texts have difference 0, which is scored like any other; repeated rows
    stay; null ids count as the empty text for ``held_out``. Without labels of one class all scores are the smoothed share
    of the other; an empty table gives an empty table.
    """
    pair, curve = quality_model(docs, labels, label, folds, **fitting)
    out = scored(docs.select("doc_id", F.col("text").alias("_text")), pair, curve, F.col("_text"))
    return out.select("doc_id", (bucket_of_text(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
