"""Trie of conversation prefixes by whole-sequence collapse.

Identical conversations become one weighted sequence with the list of conversations that end there. Only distinct sequences are
spelled out into prefixes; those that are proper prefixes of another drop out of the leaves by an anti-join; counts of a node are
weighted sums over the sequences through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.common import WORD, kept

#: Conversation ids of one sequence are listed in blocks of ids that agree but for their last bits.
BLOCK_BITS = 10
ROOT = b"\x00" * 16


def _digest(*parts: Column) -> Column:
    """128 bits of a SHA-256 over texts, each with its length before it."""
    lengths = [x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]
    return F.substring(F.unhex(F.sha2(F.concat(*lengths).cast("binary"), 256)), 1, 16)


def turn_lists(turns: DataFrame) -> DataFrame:
    """conv_id, turns: every conversation's turns in order, each as (digest of role and text, words)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", role.alias("role"), _digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("int").alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt_conversations(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """conv_id, turns: the first h turns of conversation c - c mod ``family``, then c's own turns after its first h, where h is
    crc32 of the decimal c modulo ``most``. An absent first conversation gives no turns."""
    own = turn_lists(turns)
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(family))
    heads = own.filter(F.pmod("conv_id", F.lit(family)) == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    joined = own.join(heads, base == F.col("base"), "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), h)).otherwise(F.slice("turns", F.lit(1), F.lit(0)))
    return joined.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _prefixes(sequences: DataFrame) -> DataFrame:
    """first, weight, ending, depth, node, parent, words: a row per prefix of every sequence, the root (depth 0) included.
    ``ending`` is the sequence's key on its last prefix and NULL before. A node's key chains the digests of its turns."""
    schema = "first long, weight long, ending binary, depth int, node binary, parent binary, words int"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return batch

        for batch in batches:
            for row in range(len(batch)):
                first, weight, ending, digests, words = (batch.column(k)[row].as_py() for k in range(5))
                node, parent = ROOT, None
                out.append((first, weight, None if digests else ending, 0, node, None, 0))
                for depth, (digest, n) in enumerate(zip(digests, words), 1):
                    node, parent = hashlib.blake2b(node + digest, digest_size=16).digest(), node
                    out.append((first, weight, ending if depth == len(digests) else None, depth, node, parent, n))
                    if len(out) >= 10_000:
                        yield flushed()
        if out:
            yield flushed()

    return sequences.select("first", "weight", "sequence", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words")).mapInArrow(run, schema)


def _list_digests(blocks: DataFrame) -> DataFrame:
    """sequence, sha: SHA-256 of each sequence's conversation ids, ascending, with commas between.

    The blocks of a sequence stream through one running hash in order; no list is ever whole in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            done = []
            for sequence, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if sequence != key:
                    if key is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = sequence, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["sequence", "sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], ["sequence", "sha"])

    ordered = blocks.select("sequence", F.array_join("ids", ",").alias("ids"), "block").repartition("sequence").sortWithinPartitions("sequence", "block")
    return ordered.mapInArrow(run, "sequence binary, sha string")


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node.

    ``rebuilt`` has conv_id (unique) and turns, an array of (digest, words). A node is a distinct sequence of the first depth
    turns of some conversation; the root has depth 0, so several nodes may share conv_id, their smallest member. ``saved_tokens``
    sums (n_convs - 1) * words of the last turn over the subtree, ``ends_sha256`` digests the ids that end at the node.

    Conversations without turns are members of the root. Null roles and texts are empty, rows without a conv_id take no part,
    turns with the same number are ordered by role and then by a digest of their text, a null number first; repeated rows are
    turns of their own. Without conversations there is no root and the result is empty.

    Scale: after the first shuffle by conversation, rows hold digests and counts, not texts. A conversation is one value, as it
    is one training example; a sequence shared by many is one row with a weight, and the list of its conversations stays in
    blocks. A common node meets its rows in sums that Spark combines before the shuffle. Joins on a parent may be skewed (many
    children); they carry one narrow row a node and are plain equi joins that Spark splits.
    """
    block = F.shiftright("conv_id", BLOCK_BITS)
    key = F.substring(F.unhex(F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "").cast("binary"), 256)), 1, 16)
    blocks = kept(rebuilt.groupBy("turns", block.alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids")).withColumn("sequence", key))
    sequences = blocks.groupBy("sequence", "turns").agg(F.sum(F.size("ids").cast("long")).alias("weight"), F.min(F.col("ids")[0]).alias("first"))
    prefixes = kept(_prefixes(sequences))
    # everything but the sums follows from the node, so it can stand among the keys
    nodes = kept(prefixes.groupBy("node", "depth", "parent", "words").agg(F.sum("weight").alias("n_convs"), F.min("first").alias("conv_id")))

    ends = prefixes.filter("ending IS NOT NULL").select("node", "first", "ending")
    inner = prefixes.filter("ending IS NULL").select("node").distinct()
    leaves = ends.join(inner, "node", "left_anti").select(F.col("first").alias("leaf_first"))
    # a node's own saving is booked at one sequence, that of its smallest member, and summed from its depth downwards
    gains = nodes.select(F.col("conv_id").alias("gain_first"), F.col("depth").alias("gain_depth"), ((F.col("n_convs") - 1) * F.col("words")).alias("gain"))
    below = Window.partitionBy("first").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    booked = prefixes.select("first", "depth", "node").join(gains, (F.col("first") == F.col("gain_first")) & (F.col("depth") == F.col("gain_depth")), "left")
    summed = booked.withColumn("saved", F.sum(F.coalesce("gain", F.lit(0).cast("long"))).over(below)).select("first", "node", "saved")
    subtree = (summed.join(leaves, F.col("first") == F.col("leaf_first"), "left")
               .groupBy(F.col("node").alias("s_node")).agg(F.sum("saved").alias("saved_tokens"), F.count("leaf_first").alias("n_leaves")))
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("c_node")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("node").alias("p_node"), F.col("conv_id").alias("parent_conv_id"))
    lists = (ends.join(_list_digests(blocks), F.col("ending") == F.col("sequence")).select(F.col("node").alias("e_node"), "sha"))
    zero, empty = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    return (nodes.join(subtree, F.col("node") == F.col("s_node"))
            .join(children, F.col("node") == F.col("c_node"), "left")
            .join(lists, F.col("node") == F.col("e_node"), "left")
            .join(parents, F.col("parent") == F.col("p_node"), "left")
            .select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                    "n_leaves", "saved_tokens", F.coalesce("sha", empty).alias("ends_sha256")))
