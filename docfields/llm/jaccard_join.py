"""Exact n-gram Jaccard join: universe partition, pigeonhole signatures, one-deletion neighbourhoods, exact check.

Sizes fall into bands such that partners lie in the same band or in the next one. In the scheme of a band (the
smaller partner's) two linked sets differ in at most H tokens. The universe of tokens is hashed into slots; a segment is
what a set has in one slot (an exact segment) or in two (a deletion segment). An exact segment that agrees costs no
difference, a deletion segment that agrees up to one token at most one: with slots H + 1 + slack, more than the slack of the
slots lie in agreeing segments. Each set may therefore leave out as many exact segments as the slack allows, in an order
that depends on their content only, smallest first: those are the ones that unrelated sets share. A deletion segment is
entered whole and with each one of its tokens left out.

How many slots go to deletion segments is a matter of cost: entries in the index against expected chance partners in a band
with that many sets (``allocation``). Sets that share an entry form loose clusters, whose pairs are checked exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import Hashes, ascii_words, in_small_batches, kept, mixed
from docfields.llm.components import components

ROWS_PER_FLUSH = 500_000
ENTRIES_PER_BUCKET = 1_500_000
TOKENS_PER_BLOCK = 1_000_000
#: Of the cost model: tokens of a passage that unrelated documents share, and how many of a million pairs share one.
PASSAGE, SHARING = 60, 1000


def shingles(text: bytes | None, n: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; a shorter text is one shingle; no words, none."""
    words = ascii_words(text or b"")
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    if len(h) < n:
        out = h[:1]
        for x in h[1:]:
            out = mixed(out, np.array([x], np.uint64))
        return mixed(out, np.array([len(h)], np.uint64))
    out = h[: len(h) - n + 1]
    for j in range(1, n):
        out = mixed(out, h[j : len(h) - n + 1 + j])
    return np.unique(out)


def set_key(tokens: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(tokens.tobytes())], np.uint64).view(np.int64)[0])


def band_edges(percent: int, most: int) -> list[int]:
    """First sizes of the bands, up to beyond ``most``: a partner is never more than one band away."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
    return edges + [-(-edges[-1] * 100 // percent)]


def most_different(edges: list[int], band: int, percent: int) -> int:
    """H: tokens by which a set of the band and a partner at least as large can differ."""
    r = edges[band + 1] - 1
    return (r + r * 100 // percent) * (100 - percent) // (100 + percent)


def allocation(h: int, size: int, sets: int) -> tuple[int, int, int]:
    """(deletion segments, exact segments, slack) of least cost for a band of so many sets of about this size."""
    shared = min(0.5, PASSAGE / max(1, size))
    best = None
    for deletions in range((h + 1) // 2 + 1 + (h + 1) % 2):
        plain = max(0, h + 1 - 2 * deletions)
        slack = -(-plain // 4)
        slots = 2 * deletions + plain + slack
        each = size / slots
        entries = plain + deletions * (2 * each + 1)
        apart = each * (1 - shared)
        chance = plain * math.exp(-apart) / 2 + deletions * math.exp(-2 * apart) * (1 + 2 * apart)
        cost = entries + chance * sets * SHARING / 1e6
        if best is None or cost < best[0]:
            best = (cost, (deletions, plain + slack, slack))
    return best[1]


def signatures(tokens: np.ndarray, scheme: int, deletions: int, exact: int, slack: int) -> np.ndarray:
    """Entries of one set in one scheme; the lowest bit tells those with a token left out."""
    slots = 2 * deletions + exact
    content = mixed(tokens, np.full(1, 0x51ED27, np.uint64))
    slot = ((content >> np.uint64(33)) % np.uint64(slots)).astype(np.int64)
    segment = np.where(slot < 2 * deletions, slot // 2, slot - deletions)
    order = np.argsort(segment, kind="stable")
    segment, content = segment[order], content[order]
    count = np.bincount(segment, minlength=deletions + exact)
    whole = np.zeros(deletions + exact, np.uint64)
    filled = np.flatnonzero(count)
    with np.errstate(over="ignore"):
        whole[filled] = np.add.reduceat(content, (np.cumsum(count) - count)[filled])
        place = np.arange(deletions + exact, dtype=np.uint64) + np.uint64(scheme << 32)
        entry = mixed(whole, place) & ~np.uint64(1)
        late = np.arange(deletions, deletions + exact)
        late = late[np.lexsort((entry[late], count[late]))[slack:]]
        inside = segment < deletions
        less = mixed(whole[segment[inside]] - content[inside], place[segment[inside]]) | np.uint64(1)
    return np.concatenate([entry[:deletions], entry[late], less])


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.large_binary() if sum(map(len, values)) > 2**30 else pa.binary())


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    """One text at a time: only the batch itself is in memory."""
    return (t.as_py() for t in batch.column(1).cast(pa.binary()))


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null without shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            found = [(len(s), set_key(s) if len(s) else None) for s in (shingles(t, n, hashes) for t in _texts(batch))]
            yield pa.record_batch({"doc_id": batch.column(0), "n_shingles": pa.array([f[0] for f in found], pa.int64()),
                                   "set_key": pa.array([f[1] for f in found], pa.int64())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_key long")


def _entries(docs: DataFrame, n: int, plan: dict[int, tuple[int, int, int]], edges: list[int], bits: int) -> DataFrame:
    """Packed (bucket, entry, set_key) arrays; a set that a task has just seen is not entered again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, entries, keys, held = Hashes(), set(), [], [], 0

        def flush() -> pa.RecordBatch:
            e, k = np.concatenate(entries), np.concatenate(keys)
            order = np.argsort(e)
            e, k = e[order], k[order]
            ends = np.searchsorted(e, np.arange(1, 2**bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, int)
            parts = [(b, x, y) for b, (x, y) in enumerate(zip(np.split(e, ends), np.split(k, ends))) if len(x)]
            return pa.record_batch({"bucket": pa.array([p[0] for p in parts], pa.int32()), "entries": _binary([p[1].tobytes() for p in parts]),
                                    "keys": _binary([p[2].tobytes() for p in parts])})

        for batch in batches:
            for text in _texts(batch):
                tokens = shingles(text, n, hashes)
                if not len(tokens) or (key := set_key(tokens)) in seen:
                    continue
                seen.add(key)
                band = int(np.searchsorted(edges, len(tokens), side="right")) - 1
                for scheme in (band, band - 1):
                    if scheme in plan:
                        entries.append(signatures(tokens, scheme, *plan[scheme]))
                        keys.append(np.full(len(entries[-1]), key, np.int64))
                        held += len(entries[-1])
                if held >= ROWS_PER_FLUSH:
                    yield flush()
                    seen, entries, keys, held = set(), [], [], 0
        if held:
            yield flush()

    return docs.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "bucket int, entries binary, keys binary")


def _linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, least node) of the components that the edges form, as index arrays."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := top.get(x, x)) != x:
            top[x] = x = top.get(y, y)
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            top[max(x, y)] = min(x, y)
    nodes = [x for x in top if find(x) != x]
    return np.array(nodes, np.int64), np.array([find(x) for x in nodes], np.int64)


def _meet(group: pa.Table) -> pa.Table:
    """Edges between sets that share an entry of the bucket, of which one at least is whole."""
    e = np.frombuffer(b"".join(group["entries"].to_pylist()), np.uint64)
    k = np.frombuffer(b"".join(group["keys"].to_pylist()), np.int64)
    base = e & ~np.uint64(1)
    order = np.argsort(base, kind="stable")
    e, k, base = e[order], k[order], base[order]
    starts = np.flatnonzero(np.r_[True, base[1:] != base[:-1]]) if len(e) else np.empty(0, int)
    ends = np.r_[starts[1:], len(e)]
    if len(starts):
        whole = np.minimum.reduceat(e & np.uint64(1), starts) == 0
        mixed_keys = np.minimum.reduceat(k, starts) != np.maximum.reduceat(k, starts)
        use = np.flatnonzero(whole & mixed_keys)
        spread = np.repeat(np.arange(len(use)), (ends - starts)[use])
        least = np.minimum.reduceat(k, starts)[use][spread]
        at = np.arange(len(spread)) - np.repeat(np.cumsum((ends - starts)[use]) - (ends - starts)[use], (ends - starts)[use]) + np.repeat(starts[use], (ends - starts)[use])
        pairs = np.unique(np.stack([k[at], least]), axis=1)
        a, b = _linked(*pairs[:, pairs[0] != pairs[1]])
    else:
        a = b = np.empty(0, np.int64)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of the concatenated runs starts..starts+counts."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def similar_within(keys: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets (with two sides: links across them), each checked exactly.

    Rare tokens first, a linked pair shares a token among the first n - ceil(percent n / 100) + 1 of either set.
    Sets that are already connected need no check.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((keys, sizes))
    keys, sets, side, sizes = keys[order], [sets[i] for i in order], side[order], sizes[order]
    _, ids, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sets)), sizes)
    ids = ids[np.lexsort((ids, freq[ids], owner))]
    prefix = sizes - -(-sizes * percent // 100) + 1
    early = _gather(first, prefix)
    tokens, docs = ids[early], owner[early]
    by_token = np.argsort(tokens, kind="stable")
    posting_docs = docs[by_token]
    posting_start = np.searchsorted(tokens[by_token], np.arange(len(freq) + 1))
    label, present, found, crossing = np.arange(len(sets)), np.zeros(len(freq), bool), [], bool(side.any())
    for r in range(1, len(sets)):
        mine = ids[first[r] : first[r] + sizes[r]]
        own = mine[: prefix[r]]
        near = posting_docs[_gather(posting_start[own], posting_start[own + 1] - posting_start[own])]
        near = near[near < r]
        near = near[(label[near] != label[r]) & (sizes[near] * 100 >= percent * sizes[r])]
        if crossing:
            near = near[side[near] != side[r]]
        near = np.unique(near)
        if not len(near):
            continue
        present[mine] = True
        for at in range(0, len(near), 4096):
            some = near[at : at + 4096]
            hits = np.add.reduceat(present[ids[_gather(first[some], sizes[some])]].astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            for c in some[100 * hits >= percent * (sizes[some] + sizes[r] - hits)]:
                if label[c] != label[r]:
                    found.append((int(keys[r]), int(keys[c])))
                    label[label == label[c]] = label[r]
        present[mine] = False
    return found


def possible(ids: DataFrame, column: str, most_bits: int = 2**27):
    """(place, test): a Column that says if a row's ``column``, a long, may be among ``ids`` is ``test(place)``.

    A bitmap of hashed ids, of at most ``most_bits`` bits, tells: a row whose id is not in it is surely not among them. Where ids
    are too many for it, more rows may be. It spares a join that follows the shuffle of rows that it cannot need.
    """
    bits = min(most_bits, max(2**15, 2 ** math.ceil(math.log2(16 * max(1, ids.count())))))
    place = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    parts = (ids.select(place.alias("p"))
             .groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap")).collect())
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in parts:
        bitmap[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bitmap"], np.uint8)
    sent = ids.sparkSession.sparkContext.broadcast(bitmap)

    def test(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False) - 1
        return pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return place, test


def _possible(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of (doc_id, text) whose doc_id may be among ``ids``."""
    place, test = possible(ids.select(F.col("rep").alias("doc_id")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.filter(test(batch.column(2)))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(1)], ["doc_id", "text"])

    return texts.filter("doc_id IS NOT NULL").select("doc_id", "text", place.alias("p")).mapInArrow(run, "doc_id long, text string")


def _check_tiles(docs: DataFrame, members: DataFrame, loose: DataFrame, n: int, percent: int) -> DataFrame:
    """Verified edges (a, b) between sets of one loose cluster.

    A cluster is cut into blocks of about TOKENS_PER_BLOCK tokens; a task sees two blocks at most. Only sets in a cluster are
    sent, and never a pair of them.
    """
    sets = members.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    known = kept(sets.join(loose, F.col("set_key") == F.col("node")).select("set_key", "rep", "n", "component"))
    weight = known.groupBy("component").agg(F.ceil(F.sum("n") / TOKENS_PER_BLOCK).alias("blocks")).withColumnRenamed("component", "c")
    placed = (known.join(weight, F.col("component") == F.col("c"))
              .withColumn("block", F.pmod(F.xxhash64("set_key"), "blocks"))
              .select("set_key", "rep", F.col("component").alias("cluster"), "blocks", "block"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, len(b), 1000)):
            sets_ = [shingles(t, n, hashes) for t in _texts(batch)]
            # a repeated id may carry another text: only the set that was asked for counts
            right = [i for i, (s, k) in enumerate(zip(sets_, batch.column(0).to_pylist())) if len(s) and set_key(s) == k]
            rest = batch.take(pa.array(right, pa.int64()))
            yield pa.record_batch({"set_key": rest.column(0), "cluster": rest.column(2), "blocks": rest.column(3), "block": rest.column(4),
                                   "tokens": _binary([sets_[i].tobytes() for i in right])})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = _possible(texts, known.select("rep")).join(placed, F.col("doc_id") == F.col("rep")).select("set_key", "text", "cluster", "blocks", "block")
    sent = asked.mapInArrow(tokens, "set_key long, cluster long, blocks long, block long, tokens binary")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    tiles = (sent.withColumn("other", other)
             .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
             .select("cluster", "i", "j", (F.col("block") == F.col("j")) & (F.col("i") != F.col("j")), "set_key", "tokens").toDF("cluster", "i", "j", "side", "set_key", "tokens"))

    def check(tile: pa.Table) -> pa.Table:
        keys, at = np.unique(tile["set_key"].to_numpy(), return_index=True)
        sets_ = tile["tokens"].to_pylist()
        side = np.array(tile["side"].to_pylist(), bool)
        found = similar_within(keys, [np.frombuffer(sets_[i], np.uint64) for i in at], side[at], percent) if len(keys) > 1 else []
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tiles.groupBy("cluster", "i", "j").applyInArrow(check, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, set_key, component_id of every row of (doc_id, text).

    Two rows link when 100 * intersection >= percent * union of their sets of distinct n-word shingles (a shorter text is
    one shingle). ``component_id`` is the smallest doc_id reachable by links, the own included. Rows without words have
    no shingles, set_key NULL, and are their own component; a null doc_id has component_id NULL when nothing links it
    and never gives its id to others. Repeated rows are one set. An empty table gives an empty table. Sets and
    shingles are told apart by 64-bit hashes.

    Copies never meet as rows: every step works on distinct sets, and groups of copies only at the end by an aggregation.
    """
    in_small_batches(docs.sparkSession)
    members = kept(document_sets(docs, n))
    sets = members.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.first("n_shingles").alias("n"))
    most, total = sets.agg(F.max("n"), F.sum("n")).first()
    labels = None
    if most:
        edges = band_edges(percent, most)
        # sizes by band: one number for each of about a hundred bands
        band = F.lit(len(edges) - 1)
        for i in reversed(range(len(edges) - 1)):
            band = F.when(F.col("n") < edges[i + 1], i).otherwise(band)
        filled = {r["band"]: r["sets"] for r in sets.groupBy(band.alias("band")).agg(F.count("*").alias("sets")).collect()}
        plan = {}
        for b in {x for f in filled for x in (f, f - 1) if x >= 0}:
            if h := most_different(edges, b, percent):
                plan[b] = allocation(h, edges[b + 1] - 1, filled.get(b, 0) + filled.get(b + 1, 0))
        bits = max(3, math.ceil(math.log2(max(1, total / ENTRIES_PER_BUCKET))))
        loose = components(_entries(docs, n, plan, edges, bits).groupBy("bucket").applyInArrow(_meet, "a long, b long"))
        labels = components(_check_tiles(docs, members, loose, n, percent))
    if labels is None:
        grouped = members.withColumn("label", F.col("set_key"))
    else:
        grouped = members.join(labels, F.col("set_key") == F.col("node"), "left").withColumn("label", F.coalesce("component", "set_key")).drop("node", "component")
    least = grouped.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("label", "of")
    return (grouped.join(least, F.col("label") == F.col("of"), "left")
            .select("doc_id", "n_shingles", "set_key", F.coalesce("component_id", "doc_id").alias("component_id")))
