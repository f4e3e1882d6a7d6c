"""I-Match document fingerprints over randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency lies in a band, here as bounds on the share of documents that
hold the term. The lower bound also bounds the lexicon: it has at most (mean distinct terms of a document) / ``rarest`` terms,
however many documents there are, which is why it may be broadcast. A fingerprint has one hash for the whole lexicon and for
each of several random subsets of falling size; a small subset's hash survives edits that spare its terms.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import Hashes, ascii_words, from_planes, in_small_batches, key_ranges, mixed, packed_keys, planes, unpacked_keys

ENTRIES_PER_CHUNK = 2_000_000
CHARS_PER_BUCKET = 16_000_000
CHARS_PER_RANGE = 16_000_000
#: Share of the lexicon in each subset: all of it, then random draws; the smaller, the more of them.
SUBSETS = (1.0, *(share for share, draws in ((1 / 4, 3), (1 / 16, 6), (1 / 64, 18), (1 / 128, 18), (1 / 256, 18)) for _ in range(draws)))


def _document_frequencies(docs: DataFrame, bits: int) -> DataFrame:
    """bucket, keys, counts: the distinct terms of a chunk by key range, with the number of its documents that hold them."""

    def flush(chunk: int, terms: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(terms), return_counts=True)
        parts = list(key_ranges(keys, counts, bits))
        if parts:
            yield pa.record_batch({"bucket": pa.array([p[0] for p in parts], pa.int32()), "keys": pa.array([packed_keys(p[1]) for p in parts], pa.binary()),
                                   "counts": pa.array([planes(p[2]) for p in parts], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, hashes, terms, size = TaskContext.get().partitionId() << 24, Hashes(), [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                terms.append(hashes.of(list(set(ascii_words(text.as_py() or b"")))))
                size += len(terms[-1])
                if size >= ENTRIES_PER_CHUNK:
                    yield from flush(chunk, terms)
                    chunk, terms, size = chunk + 1, [], 0
        if terms:
            yield from flush(chunk, terms)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, keys binary, counts binary")


def lexicon(docs: DataFrame, documents: int, chars: int, rarest: float, commonest: float) -> np.ndarray:
    """Sorted 64-bit hashes of the terms that between ``rarest`` and ``commonest`` of all documents hold."""

    def band(group: pa.Table) -> pa.Table:
        keys, inverse = np.unique(np.concatenate([unpacked_keys(x) for x in group["keys"].to_pylist()]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([from_planes(x) for x in group["counts"].to_pylist()]).astype(np.float64))
        keys = keys[(total >= rarest * documents) & (total <= commonest * documents)]
        return pa.table({"term": pa.array(keys.view(np.int64), pa.int64())})

    bits = max(2, math.ceil(math.log2(max(1, chars / CHARS_PER_BUCKET))))
    terms = _document_frequencies(docs, bits).groupBy("bucket").applyInArrow(band, "term long").toPandas()["term"]
    return np.sort(terms.to_numpy(np.int64).view(np.uint64))


def subset_masks(terms: np.ndarray) -> np.ndarray:
    """Bit k of a term's mask tells whether it is in subset k: a function of the term alone."""
    out = np.zeros(len(terms), np.uint64)
    for k, share in enumerate(SUBSETS):
        draw = mixed(terms, np.array([k + 1], np.uint64)) >> np.uint64(11)
        out |= (draw < np.uint64(min(2**53, int(share * 2**53)))).astype(np.uint64) << np.uint64(k)
    return out


class Fingerprints:
    """One 16-bit hash per subset; 0 where a text has no term of the subset."""

    def __init__(self, terms: np.ndarray):
        self.terms, self.masks, self.hashes = terms, subset_masks(terms), Hashes()
        self.places = np.arange(len(SUBSETS), dtype=np.uint64)[:, None]

    def of(self, text: str) -> np.ndarray:
        own = np.sort(self.hashes.of(list(set(ascii_words(text.encode("utf-8", "surrogatepass"))))))
        at = np.searchsorted(self.terms, own)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == own)] if len(self.terms) else at[:0]
        # a text without a term of the lexicon is known by all its terms
        found, masks = (self.terms[at], self.masks[at]) if len(at) else (own, subset_masks(own))
        out = np.zeros(len(SUBSETS), np.uint16)
        inside = (masks >> self.places) & np.uint64(1) == 1
        for k in np.flatnonzero(inside.any(1)):
            out[k] = int.from_bytes(hashlib.blake2b(found[inside[k]].tobytes(), digest_size=2).digest(), "big") or 1
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal hashes among the subsets in which either text has a term; 1 if neither has any."""
    live = (a != 0) | (b != 0)
    return float((a[live] == b[live]).mean()) if live.any() else 1.0


def as_text(codes: np.ndarray) -> str:
    return codes.astype(">u2").tobytes().hex()


def _in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """The rows dealt to ranges of doc_id and sorted; each range also gets, marked ``ahead``, the first row after it.

    Cuts are ids that exist, so the first row after a range is the one with the next cut as id; the last range gets the
    first row of all.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shares = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", shares, 100_000) if shares else F.lit(None)).first()
    least, nulls = found[0], found[1]
    cuts = sorted({c for c in (found[2] or []) if nulls or c != least})
    sent = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent.value, ids.to_numpy(np.int64), side="right"))

    # null ids come first, in range 0
    here = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place(F.coalesce("doc_id", F.lit(0).cast("long")))).cast("long")
    ranged = rows.withColumn("range", here)
    is_first = F.col("doc_id").isNull() if nulls else F.col("doc_id").eqNullSafe(F.lit(least))
    before = F.when(is_first, F.lit(len(cuts))).when(F.col("doc_id").isin(cuts), F.col("range") - 1) if cuts else F.when(is_first, F.lit(0))
    copies = F.filter(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("ahead")), F.struct(before.cast("long").alias("range"), F.lit(True).alias("ahead"))),
                      lambda s: s["range"].isNotNull())
    dealt = ranged.select("doc_id", "text", F.explode(copies).alias("to")).select("to.range", "to.ahead", "doc_id", "text")
    return dealt.repartition(len(cuts) + 1, "range").sortWithinPartitions("range", "ahead", F.col("doc_id").asc_nulls_first(), "text")


def fingerprint_documents(docs: DataFrame, rarest: float = 1 / 1000, commonest: float = 1 / 4) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per row of (doc_id, text).

    A row's edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next row by
    ascending doc_id, the first after the last. Null texts are empty; null ids come first; rows of one id are in order of their
    text; a single row is its own next. Terms are words, A-Z lower-cased, told apart by 64-bit hashes; a text without terms
    of the lexicon is fingerprinted by all its terms, one without terms has all zeros. An empty table gives an empty table.

    Texts are shuffled once, by ranges of doc_id; a task walks its sorted rows and holds two texts.
    """
    in_small_batches(docs.sparkSession)
    documents, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length(F.col("text").cast("string"))), F.lit(0))).first()
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs, documents, chars, rarest, commonest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, now, rows, at_end = Fingerprints(sent.value), None, [], None

        def done(doc_id, text, codes, following, codes_next) -> tuple:
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            edited_codes = prints.of(edited)
            return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(codes), as_text(edited_codes),
                    likeness(codes, edited_codes), likeness(codes, codes_next))

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        for batch in batches:
            for place, ahead, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if ahead and at_end == place:
                    continue
                text = text.as_py()
                codes = prints.of(text)
                if now is not None:
                    rows.append(done(*now, text, codes))
                at_end = place if ahead else None
                now = None if ahead else (doc_id, text, codes)
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    sizes = max(1, math.ceil(chars / CHARS_PER_RANGE))
    return _in_ranges(docs, sizes).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
