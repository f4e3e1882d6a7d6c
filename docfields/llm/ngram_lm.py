"""Language-model scoring with a weighted backoff automaton over n-grams of any order, counted on all training text.

The model never exists in one place. Documents are read in chunks, whose words become small codes. A chunk sends its
distinct n-grams, as sorted 64-bit keys with their training counts, to the key range that owns them. The owner adds
up the counts of all chunks and answers each chunk in the order of its own keys. With the answers a chunk builds the part
of the automaton that its documents can reach and runs over them.

The automaton: a state is a history of up to order - 1 words (or the start of a text and words after it) that training text
has; the root is the empty one. An arc leaves state h for every n-gram (h, w) of the training text and ends in the longest
history that (h, w) ends with; the root has an arc for every word. The failure arc of h leads to h without its first word.
Weights are log10 of P(w | h) = lambda(h) c(hw) / c(h) + (1 - lambda(h)) P(w | h less its first word) on arcs, and of 1 - lambda(h)
on failure arcs, with lambda(h) = mu c(h) / (c(h) + kappa). P(w) is (1 - u) c(w) / N, and the class of unknown words has u, the
Good-Turing mass of words seen once. mu and kappa are the pair of a small grid that makes all training text most likely
when each token is scored without its own occurrence.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import ascii_words, from_planes, in_small_batches, key_ranges, kept, mixed, packed_keys, planes, shared_folder, unpacked_keys

TOKENS_PER_CHUNK = 1_000_000
DOCUMENTS_PER_ROW = 1000
CHARS_PER_BUCKET = 8_000_000
#: Spark's own bound on the buckets of a table is 100,000.
MOST_TABLE_BUCKETS = 65_536
#: Documents are cut into pieces of so many tokens that run side by side.
TOKENS_PER_PIECE = 256
#: (mu, kappa) to choose from
GRID = tuple((mu, kappa) for mu in (0.1, 0.4, 0.7, 0.95) for kappa in (2.0, 50.0))
END, START = 0, 1
#: Longer n-grams are told apart by 56 bits of their hash; the cleared byte costs nothing in a packed key.
_GRAM = ~np.uint64(0xFF)
#: No word holds white space, so these never meet a word's hash on purpose.
_MARKS = [xxhash.xxh64_intdigest(m) for m in (b" end", b" start")]


class Codes(dict):
    """word -> code in order of appearance, after the marks."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self) + 2
        return code

    def hashes(self) -> np.ndarray:
        return np.fromiter(_MARKS + [xxhash.xxh64_intdigest(w) for w in self], np.uint64, len(self) + 2)


def held_out(ids: list, fold: int, held: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % fold == held for i in ids], bool)


def laid_out(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, places in their document) of the documents laid end to end, each after a start mark in place 0."""
    sizes = np.array([len(c) + 1 for c in codes])
    starts = np.cumsum(sizes) - sizes
    line = np.full(int(sizes.sum()), START, np.int32)
    place = np.arange(len(line)) - np.repeat(starts, sizes)
    line[place > 0] = np.concatenate(codes)
    return line, place


def gram_keys(hashes: np.ndarray, line: np.ndarray, place: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, last positions, keys) of the n-grams of 2 to ``order`` codes; none reaches over the start of its document."""
    key = own = hashes[line]
    for n in range(2, order + 1):
        key = np.concatenate([key[:1], mixed(key[:-1], own[1:])])
        at = np.flatnonzero(place >= n - 1)
        yield n, at, key[at] & _GRAM


SCHEMA = "kind int, chunk long, part int, ids array<long>, data binary, sizes binary"
_FIELDS = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("data", pa.binary()), ("sizes", pa.binary())])
DOC, WORDS = 0, -1


def _chunks(docs: DataFrame) -> DataFrame:
    """Per chunk: its documents as codes, and the hash of each code."""

    def flush(chunk: int, ids: list, codes: list[np.ndarray], table: Codes) -> Iterator[pa.RecordBatch]:
        rows = [(WORDS, chunk, 0, None, table.hashes().tobytes(), None)]
        for part, at in enumerate(range(0, len(ids), DOCUMENTS_PER_ROW)):
            some = codes[at : at + DOCUMENTS_PER_ROW]
            rows.append((DOC, chunk, part, ids[at : at + DOCUMENTS_PER_ROW], planes(np.concatenate(some)), planes(np.array([len(c) for c in some]))))
        for at in range(0, len(rows), 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 16]), _FIELDS)], schema=_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        table, ids, codes, size = Codes(), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = ascii_words(text.as_py() or b"")
                mine = np.empty(len(words) + 1, np.int32)
                mine[:-1] = np.fromiter(map(table.__getitem__, words), np.int32, len(words))
                mine[-1] = END
                ids.append(doc_id)
                codes.append(mine)
                size += len(mine)
                if size >= TOKENS_PER_CHUNK:
                    yield from flush(chunk, ids, codes, table)
                    chunk, table, ids, codes, size = chunk + 1, Codes(), [], [], 0
        if codes:
            yield from flush(chunk, ids, codes, table)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def _opened(chunk: pa.Table) -> tuple[list, list[np.ndarray], np.ndarray]:
    """(ids, codes of each document, hash of each code) of a chunk's rows, in the order of their parts whatever order they came in."""
    chunk = chunk.sort_by([("kind", "ascending"), ("part", "ascending")])
    hashes, docs = np.frombuffer(chunk["data"][0].as_py(), np.uint64), chunk.slice(1)
    ids = [i for row in docs["ids"].to_pylist() for i in row]
    sizes = np.concatenate([from_planes(x) for x in docs["sizes"].to_pylist()]).astype(np.int64)
    line = np.concatenate([from_planes(x).astype(np.int32) for x in docs["data"].to_pylist()])
    return ids, np.split(line, np.cumsum(sizes)[:-1]), hashes


GRAMS = "kind int, chunk long, bucket int, data binary, counts binary"
_GRAM_FIELDS = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()), ("counts", pa.binary())])


def _grams(fold: int, held: int, orders: range, bits: int):
    """The distinct n-grams of a chunk, n in ``orders``, with their training counts, by key range."""

    def run(group: pa.Table) -> pa.Table:
        ids, codes, hashes = _opened(group)
        line, place = laid_out(codes)
        training = np.repeat(~held_out(ids, fold, held), [len(c) + 1 for c in codes])
        rows = []
        if 1 in orders:
            keys, inverse = np.unique(hashes, return_inverse=True)
            rows += [(1, b, packed_keys(k), planes(c)) for b, k, c in key_ranges(keys, np.bincount(inverse[line[training]], minlength=len(keys)), bits)]
        for n, at, found in gram_keys(hashes, line, place, orders[-1]):
            keys, inverse = np.unique(found, return_inverse=True)
            counts = np.bincount(inverse[training[at]], minlength=len(keys))
            rows += [(n, b, packed_keys(k), planes(c)) for b, k, c in key_ranges(keys, counts, bits)]
        kinds, buckets, data, counts = zip(*rows) if rows else ([],) * 4
        chunk = group["chunk"][0].as_py()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((kinds, [chunk] * len(rows), buckets, data, counts), _GRAM_FIELDS)], schema=_GRAM_FIELDS)

    return run


def _totals(group: pa.Table) -> pa.Table:
    """The sums of one key range, sent back to every chunk in the order of its keys, and a row of statistics."""
    group = group.sort_by("chunk")
    kind, bucket, chunks = group["kind"][0].as_py(), group["bucket"][0].as_py(), group["chunk"].to_pylist()
    parts = [unpacked_keys(x) for x in group["data"].to_pylist()]
    keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    sums = np.bincount(inverse, weights=np.concatenate([from_planes(x) for x in group["counts"].to_pylist()]).astype(np.float64)).astype(np.int64)
    answers = np.split(sums[inverse], np.cumsum([len(p) for p in parts])[:-1])
    words = sums[keys != np.uint64(_MARKS[START])]
    n = len(chunks)
    return pa.table({
        "kind": pa.array([kind] * n + [kind], pa.int32()), "chunk": pa.array([*chunks, -1], pa.int64()), "bucket": pa.array([bucket] * (n + 1), pa.int32()),
        "totals": pa.array([planes(a) for a in answers] + [None], pa.binary()),
        "n": pa.array([None] * n + [int(words.sum())], pa.int64()), "v": pa.array([None] * n + [int((words > 0).sum())], pa.int64()),
        "once": pa.array([None] * n + [int((words == 1).sum())], pa.int64())})


class Automaton:
    """The part of the automaton that the documents of one chunk can reach.

    ``counts[n]`` are training counts: of each code for n = 1, of each distinct n-gram of the chunk in key order for longer ones.
    """

    def __init__(self, hashes: np.ndarray, line: np.ndarray, place: np.ndarray, counts: dict[int, np.ndarray], n: int, once: int):
        self.line, self.place, self.n, self.order = line, place, n, max(counts)
        self.counts = {k: c.astype(np.float64) for k, c in counts.items()}
        self.unknown = (once + 0.5) / (n + 1.0)
        symbols = self.symbols = len(hashes)
        # per order: the n-gram at each position, and of each n-gram its history, its suffix and its last code
        self.at, self.history, self.suffix = {1: line}, {}, {}
        sources, codes, ends, self.arc_gram = [np.zeros(symbols, np.int64)], [np.arange(symbols)], [], {1: np.arange(symbols)}
        base, state = {0: 0, 1: 1}, 1 + symbols
        fail = [np.zeros(1 + symbols, np.int64)]
        ends.append(np.where((self.counts[1] > 0) & (self.order > 1), 1 + np.arange(symbols), 0))
        for k, at, keys in gram_keys(hashes, line, place, self.order):
            _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            first = at[first]
            self.at[k] = np.full(len(line), -1, np.int32)
            self.at[k][at] = inverse
            self.history[k], self.suffix[k] = self.at[k - 1][first - 1], self.at[k - 1][first]
            there = self.arc_gram[k] = np.flatnonzero(self.counts[k] > 0)
            sources.append(base[k - 1] + self.history[k][there].astype(np.int64))
            codes.append(line[first[there]])
            if k < self.order:
                base[k], state = state, state + len(first)
                fail.append(base[k - 1] + self.suffix[k].astype(np.int64))
                ends.append(base[k] + there)
            else:
                ends.append(base[k - 1] + self.suffix[k][there].astype(np.int64))
        self.fail = np.concatenate(fail)
        keys = np.concatenate(sources) * symbols + np.concatenate(codes)
        self.sorted = np.argsort(keys)
        self.keys, self.ends = keys[self.sorted], np.concatenate(ends)[self.sorted]

    def run(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """One traversal from left to right: the arc taken at each position, and the states left by a failure arc before it (-1: none).

        Pieces of documents run side by side. A piece inside a document starts order - 1 tokens early at the root, and is then
        in the state that a run from the start would have reached, as a state holds no more words than that.
        """
        starts = np.flatnonzero(self.place == 0)
        sizes = np.diff(np.append(starts, len(self.line))) - 1
        pieces = -(-sizes // TOKENS_PER_PIECE)
        doc = np.repeat(np.arange(len(starts)), pieces)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cut = starts[doc] + 1 + number * TOKENS_PER_PIECE
        stop = np.minimum(cut + TOKENS_PER_PIECE, starts[doc] + 1 + sizes[doc])
        begin = np.maximum(starts[doc] + 1, cut - (self.order - 1))
        longest = np.argsort(begin - stop, kind="stable")
        cut, stop, begin = cut[longest], stop[longest], begin[longest]
        marked = 1 + START if self.order > 1 and self.counts[1][START] > 0 else 0
        state = np.where(self.place[begin] == 1, marked, 0).astype(np.int64)
        arcs = np.zeros(len(self.line), np.int32)
        failed = [np.full(len(self.line), -1, np.int32) for _ in range(self.order - 1)]
        lengths = begin - stop
        for step in range(int(-lengths[0])):
            alive = int(np.searchsorted(lengths, -step, "left"))
            at = begin[:alive] + step
            code, counted = self.line[at], at >= cut[:alive]
            now, arc, todo = state[:alive].copy(), np.zeros(alive, np.int64), np.arange(alive)
            for level in range(self.order):
                key = now[todo] * self.symbols + code[todo]
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[found] == key
                arc[todo[hit]] = found[hit]
                todo = todo[~hit]
                if not len(todo):
                    break
                left = todo[counted[todo]]
                failed[level][at[left]] = now[left]
                now[todo] = self.fail[now[todo]]
            arcs[at[counted]] = arc[counted]
            state[:alive] = self.ends[arc]
        return arcs, failed

    def _part(self, counts: np.ndarray, mu: float, kappa: float) -> np.ndarray:
        return np.where(counts > 0, mu * counts / (counts + kappa), 0.0)

    def probabilities(self, mu: float, kappa: float, without: int = 0) -> dict[int, np.ndarray]:
        """P(w | h) of every n-gram (h, w) by order; ``without`` 1 leaves one occurrence out of all its counts."""
        c = self.counts[1] - without
        p = {1: np.where(c > 0, (1 - self.unknown) * c / max(self.n - without, 1), self.unknown)}
        for k in range(2, self.order + 1):
            h, hw = self.counts[k - 1][self.history[k]] - without, self.counts[k] - without
            part = self._part(h, mu, kappa)
            p[k] = np.where(hw > 0, part * hw / np.maximum(h, 1), 0.0) + (1 - part) * p[k - 1][self.suffix[k]]
        return p

    def weights(self, mu: float, kappa: float) -> tuple[np.ndarray, np.ndarray]:
        """log10 weights of the arcs in key order, and of each state's failure arc (a last 0 for none)."""
        p = self.probabilities(mu, kappa)
        arcs = np.log10(np.concatenate([p[k][self.arc_gram[k]] for k in range(1, self.order + 1)]))[self.sorted]
        leave = [1 - self._part(self.counts[k], mu, kappa) for k in range(1, self.order)]
        return arcs, np.log10(np.concatenate([[1.0], *leave, [1.0]])) if leave else np.zeros(2 + self.symbols)

    def apart(self, training: np.ndarray, mu: float, kappa: float) -> float:
        """log10 likelihood of the training tokens, each without its own occurrence."""
        p, total = self.probabilities(mu, kappa, without=1), 0.0
        for k in range(1, self.order + 1):
            top = training & (self.place > 0) & ((self.place >= k - 1) if k == self.order else (self.place == k - 1))
            seen = np.bincount(self.at[k][top], minlength=len(p[k]))
            total += float((np.log10(p[k][seen > 0]) * seen[seen > 0]).sum())
        return total


def _scores(n: int, v: int, once: int, fold: int, held: int, order: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, codes, hashes = _opened(left)
        line, place = laid_out(codes)
        right = right.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds, answers = right["kind"].to_pylist(), right["totals"].to_pylist()
        totals = {k: np.concatenate([from_planes(x) for kind, x in zip(kinds, answers) if kind == k] or [np.zeros(0, np.uint64)]).astype(np.int64) for k in range(1, order + 1)}
        totals[1] = totals[1][np.unique(hashes, return_inverse=True)[1]]
        automaton = Automaton(hashes, line, place, totals, n, once)
        arcs, failed = automaton.run()
        tokens, out = place > 0, held_out(ids, fold, held)
        sizes = np.array([len(c) for c in codes])
        starts = np.cumsum(sizes) - sizes
        arcs, failed = arcs[tokens], [f[tokens] for f in failed]
        training = np.repeat(~out, sizes + 1)
        scores, apart = [], []
        for mu, kappa in GRID:
            weight, leave = automaton.weights(mu, kappa)
            scores.append(np.add.reduceat(weight[arcs] + sum(leave[f] for f in failed), starts))
            apart.append(automaton.apart(training, mu, kappa))
        words = line[tokens]
        base = np.log10((totals[1] + 0.5) / (n + 0.5 * (v + 1)))[words]
        rows = len(codes)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(out), "n_tokens": pa.array(sizes, pa.int64()),
            "n_known": pa.array(np.add.reduceat((totals[1] > 0)[words].astype(np.int64), starts), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base, starts), pa.float64()),
            "scores": pa.array(list(np.stack(scores, axis=1)), pa.list_(pa.float64())),
            # the chunk's sum, once
            "apart": pa.array([np.array(apart)] + [None] * (rows - 1), pa.list_(pa.float64()))})

    return run


def score_documents(docs: DataFrame, fold: int = 5, held: int = 1, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of (doc_id, text).

    Tokens are the words, A-Z lower-cased, and one end. Documents whose crc32(doc_id as text) mod ``fold`` is ``held`` are
    scored but not learned from. ``base_score`` is the add-half unigram log10 probability, ``score`` the automaton's, whose
    n-grams have up to ``order`` words (1 or more). A null
    text is empty and has the end only; a null doc_id counts as the empty text; repeated rows count as often as they come.
    An empty table gives an empty table; with no training text every token is unknown. Words are told apart by 64-bit hashes, longer
    n-grams by 56-bit ones.

    Memory: a chunk has TOKENS_PER_CHUNK tokens (or one longer document), a key range about CHARS_PER_BUCKET characters' worth
    of n-grams, whatever the size of the corpus. Only six sums and one number per grid point come to the driver.
    """
    in_small_batches(docs.sparkSession)
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    bits = max(2, math.ceil(math.log2(max(1, chars / CHARS_PER_BUCKET))))
    spark, tasks = docs.sparkSession, min(2**bits, MOST_TABLE_BUCKETS)
    # a table with its rows dealt by chunk is read twice without a shuffle; n-gram keys are made from it and never written
    name = f"docfields_chunks_{uuid4().hex}"
    _chunks(docs).write.option("compression", "zstd").option("path", shared_folder(spark)).bucketBy(tasks, "chunk").saveAsTable(name)
    chunks = spark.table(name)

    def answers(orders: range) -> DataFrame:
        grams = chunks.groupBy("chunk").applyInArrow(_grams(fold, held, orders, bits), GRAMS)
        return grams.repartition(len(orders) * tasks, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(
            _totals, "kind int, chunk long, bucket int, totals binary, n long, v long, once long")

    words = kept(answers(range(1, 2)))
    n, v, once = (int(x) for x in words.filter("chunk = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "once")]).first())
    right = words if order == 1 else words.unionByName(answers(range(2, order + 1)))
    right = right.filter("chunk >= 0").select("chunk", "kind", "bucket", "totals").repartition(tasks, "chunk")
    scored = kept(chunks.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(
        _scores(n, v, once, fold, held, order), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, apart array<double>"))
    # the files stay in the shared folder, the name goes
    spark.sql(f"DROP TABLE {name}")
    likelihoods = scored.agg(*[F.coalesce(F.sum(F.col("apart")[i]), F.lit(0.0)) for i in range(len(GRID))]).first()
    best = max(range(len(GRID)), key=lambda i: likelihoods[i])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score",
                         F.col("scores")[best].alias("score"))
