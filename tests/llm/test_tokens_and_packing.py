"""Operators 1 and 7: flat token files and packed sequences."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docfields.llm import packing
from docfields.llm.common import kept, shared_folder
from docfields.llm.packing import WordEncoder, best_fit, pack, pack_documents
from docfields.llm.queries import tokenizer_path
from docfields.llm.separator_scan import document_token_counts, file_sizes, token_counts
from tests.llm.data import documents, empty

WORD_FILE = tokenizer_path("word_bpe_49k.json")


def whole_words():
    return lambda texts: [[len(w) for w in t.split()] for t in texts]


def test_token_counts_of_odd_documents(spark):
    docs = documents(spark)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in document_token_counts(docs, whole_words, 60000, block_tokens=64).collect())
    assert got == sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").split())) for r in docs.collect())
    assert document_token_counts(empty(spark), whole_words, 60000).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_scan_stitches_over_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    streams = {"a.bin": [rng.choice([9, 1, 2]) for _ in range(60)], "b.bin": [1] * 20, "c.bin": [9] * 5, "d.bin": [], "e.bin": [1, 1, 9]}
    for name, ids in streams.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes() + (b"x" if name == "e.bin" else b""))
    want = []
    for name, ids in streams.items():
        start = ordinal = 0
        for i, t in enumerate(ids):
            if t == 9:
                want.append((name, ordinal, start, i - start, True))
                start, ordinal = i + 1, ordinal + 1
        if start < len(ids):
            want.append((name, ordinal, start, len(ids) - start, False))
    files = file_sizes(spark, str(tmp_path))
    got = token_counts(files.unionByName(files), str(tmp_path), 9, block_tokens=block, block_chunk=3).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_shared_folder_is_new_each_time(spark):
    assert shared_folder(spark) != shared_folder(spark)


ODD = st.text(alphabet=st.sampled_from(list("abcDEF'st019 \t\n\r\x0b\x0c\x1c\x1f\x85\xa0éÉ\u0308ßİıΣς\u200b\u3000漢😀<|>!.,-\x00")), max_size=40)


@given(st.lists(ODD, max_size=5))
@settings(max_examples=150, deadline=None)
def test_word_ids_equal_the_tokenizer(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORD_FILE)
    assert [a.tolist() for a in WordEncoder.shared(WORD_FILE).encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_forgets_and_goes_on():
    encoder = WordEncoder(WORD_FILE, most=5)
    texts = [f"word{i} other{i} same" for i in range(20)]
    assert [encoder.encode([t])[0].tolist() for t in texts] == [a.tolist() for a in WordEncoder(WORD_FILE).encode(texts)]


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=100, deadline=None)
def test_best_fit_fills_without_gaps(lengths):
    used = {}
    for n, (b, offset) in zip(lengths, best_fit(lengths, 50)):
        room = {k: 50 - v for k, v in used.items() if 50 - v >= n}
        if room:
            assert b in room and room[b] == min(room.values())
        else:
            assert b not in used
        assert offset == used.get(b, 0)
        used[b] = offset + n
    assert all(v <= 50 for v in used.values())


def check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_rounds_of_packing(spark):
    rng = random.Random(3)
    items = spark.createDataFrame([(i, rng.choice([3, 10, 30, 45, 51, 70])) for i in range(3000)], "id long, length long")
    placed = pack(items, 100, slack=0, items_per_group=100, fan_in=3).join(items, "id")
    n = check_packed([{"sequence_id": r["bin"], **r.asDict()} for r in placed.collect()], 100)
    whole = len({b for b, _ in best_fit(sorted((r["length"] for r in items.collect()), reverse=True), 100)})
    assert placed.count() == 3000 and n <= whole * 1.05


def test_groups_stay_small_where_nothing_pairs(spark, monkeypatch):
    most = []

    def written(df):
        table = kept(df)
        most.append(table.groupBy("g").count().agg({"count": "max"}).first()[0])
        return table

    monkeypatch.setattr(packing, "kept", written)
    rng = random.Random(8)
    # a few small ones among many of more than half: every small one that has a place somewhere must find it
    lengths = [rng.randrange(51, 70) for _ in range(1980)] + [45] * 20
    items = spark.createDataFrame(list(enumerate(lengths)), "id long, length long")
    placed = pack(items, 100, slack=0, items_per_group=100, fan_in=8).join(items, "id")
    n = check_packed([{"sequence_id": r["bin"], **r.asDict()} for r in placed.collect()], 100)
    assert placed.count() == 2000 and n == 1980 and max(most) < 200
    only = items.filter("length > 50")
    assert pack(only, 100, slack=0, items_per_group=100, fan_in=8).select("bin").distinct().count() == 1980 and max(most) < 200


def test_packed_documents(spark):
    docs = documents(spark)
    rows = pack_documents(docs, WORD_FILE, capacity=64).collect()
    check_packed(rows, 64)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORD_FILE)
    want = []
    for r in docs.collect():
        ids = np.array(plain.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(r["doc_id"] or -1, i, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for i, s in enumerate(range(0, len(ids), 64))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    assert pack_documents(empty(spark), WORD_FILE).count() == 0
