"""Best-fit packing of token sequences by hierarchical residual packing."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import in_small_batches, kept

ITEMS_PER_GROUP = 50_000
FAN_IN = 8
_CONTROL = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\x09-\x0d \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class _Places(dict):
    """word -> place in order of appearance; new words wait in ``pending`` to be encoded."""

    def __init__(self):
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.pending.append(word)
        return place


class WordEncoder:
    """Ids of whole texts, word by word: the tokenizer drops white space and never joins across it, so a word's ids do not
    depend on its neighbours. Ids of words seen before are remembered, up to about ``most`` words (200 bytes each)."""

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self._forget()

    @classmethod
    def shared(cls, path: str) -> WordEncoder:
        """The one of this process: a worker's next task goes on with the words of its last."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _forget(self) -> None:
        self.places = _Places()
        self.flat = np.empty(0, np.uint32)
        self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encode words not seen before, all in one call."""
        counts, new = [], []
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            line = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begin = np.cumsum([0, *(len(w) + 1 for w in some[:-1])])
            # a token belongs to the word in which it begins
            owner = np.searchsorted(begin, np.fromiter((o[0] for o in line.offsets), np.int64, len(line.ids)), side="right") - 1
            counts.append(np.bincount(owner, minlength=len(some)))
            new.append(np.array(line.ids, np.uint32))
        counts, new = np.concatenate(counts), np.concatenate(new)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, new])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # str.split() would also cut at four control characters that are no white space to the tokenizer
        split = [t.split() if not _CONTROL.search(t) else [w for w in _WHITE.split(t) if w] for t in texts]
        if len(self.places) > self.most:
            self._forget()
        places = [np.fromiter(map(self.places.__getitem__, words), np.int64, len(words)) for words in split]
        if self.places.pending:
            self._learn(self.places.pending)
            self.places.pending = []
        out = []
        for at in places:
            counts = self.counts[at]
            ends = np.cumsum(counts)
            out.append(self.flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(self.starts[at], counts)])
        return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, rows_at_once: int = 1000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each row's ids and the end id, cut only where longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.shared(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), rows_at_once):
                part = batch.slice(at, rows_at_once)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    rows += [(doc_id, i, s, len(p := ids[s : s + capacity]), zlib.crc32(p.tobytes())) for i, s in enumerate(range(0, len(ids), capacity))]
                columns = zip(*rows)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, in the order given: the fullest bin with room takes it, of several the one that came
    last. ``open_`` is a bit for every amount of room that some bin has."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, bins, out = 0, 0, []
    for length in lengths:
        fitting = open_ >> length
        if fitting:
            left = length + (fitting & -fitting).bit_length() - 1
            chosen = room[left].pop()
            if not room[left]:
                open_ &= ~(1 << left)
        else:
            left, chosen, bins = capacity, bins, bins + 1
        out.append((chosen, capacity - left))
        if rest := left - length:
            room[rest].append(chosen)
            open_ |= 1 << rest
    return out


def pack(items: DataFrame, capacity: int, slack: int = 8, items_per_group: int = ITEMS_PER_GROUP, fan_in: int = FAN_IN) -> DataFrame:
    """id, bin, offset for items (id long, length long of 1..capacity): as few bins as it can, bins named by an item's id.

    Each group of about ``items_per_group`` items packs its own, longest first. Bins with at most ``slack`` free are done.
    Of the others no two of one group fit together, so each group has at most one bin that is no more than half full. Only
    these can still be saved: they meet in a next round with as many of the emptiest bins of more than half, and no
    other bin could take one that none of those can. Its groups are sized by its rows, at most two for each group before, and
    rounds go on until one group is left or nothing can be saved. Where bins end is resolved from the last round back to
    the first and joined to the items once. A group's order is its content's, so a rerun of a lost task gives the same bins.
    """
    n = items.count()
    groups = max(1, math.ceil(n / items_per_group))
    level = items.select("id", "length", F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g"))
    rounds = []
    while True:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "id"], ascending=[False, True], ignore_index=True)
            placed = best_fit(pdf["length"].tolist(), capacity)
            bins = np.array([b for b, _ in placed], np.int64)
            first = np.full(bins.max() + 1, -1, np.int64)
            ids = pdf["id"].to_numpy()
            first[bins[::-1]] = ids[::-1]
            used = np.bincount(bins, weights=pdf["length"].to_numpy()).astype(np.int64)
            return pd.DataFrame({"id": ids, "bin": first[bins], "offset": np.array([o for _, o in placed], np.int64), "used": used[bins], "g": pdf["g"]})

        rounds.append(kept(level.groupBy("g").applyInPandas(run, "id long, bin long, offset long, used long, g long")))
        if groups == 1:
            break
        underfull = rounds[-1].filter((F.col("used") < capacity - slack) & (F.col("id") == F.col("bin"))).select("id", F.col("used").alias("length"))
        low = underfull.filter(F.col("length") * 2 <= capacity)
        n = low.count()
        if not n:
            break
        high = underfull.filter(F.col("length") * 2 > capacity).orderBy("length", "id").limit(n)
        groups = min(math.ceil(2 * n / items_per_group), math.ceil(groups / fan_in))
        level = low.unionByName(high).select("id", "length", F.pmod(F.xxhash64("id", F.lit(len(rounds))), F.lit(groups)).alias("g"))
    out = rounds[-1].select("id", "bin", "offset")
    for before in reversed(rounds[:-1]):
        later = out.select(F.col("id").alias("of"), F.col("bin").alias("to"), F.col("offset").alias("by"))
        out = (before.join(later, F.col("bin") == F.col("of"), "left")
               .select("id", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset")))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every row of (doc_id, text).

    ``tokenizer`` is the path of a tokenizer file whose words do not reach across white space. A null text is empty and has the
    end id only; repeated rows are packed as often as they come, and null ids keep their rows; an empty table gives an empty
    table. Full pieces are sequences of their own. Memory: one text and a group of ITEMS_PER_GROUP pieces.
    """
    in_small_batches(docs.sparkSession)
    pieces = kept(token_pieces(docs, tokenizer, capacity, end_id).withColumn("id", F.monotonically_increasing_id()))
    placed = pack(pieces.filter(F.col("length") < capacity).select("id", "length"), capacity)
    bins = placed.select(F.col("id").alias("of"), "bin", "offset")
    return (pieces.join(bins, F.col("id") == F.col("of"), "left")
            .select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("bin", "id").alias("sequence_id"),
                    F.coalesce("offset", F.lit(0).cast("long")).alias("offset")))
