"""Conversation tries, chunked encoding and whitening against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from docfields.llm import charpoly
from docfields.llm.chunked_bpe import Codec, _unpacked, cuts, encode_documents, encoded
from docfields.llm.prefix_trie import prefix_trie, rebuilt_conversations
from docfields.llm.whitening import whiten
from tests.llm.data import documents, empty, words

TURNS = "conv_id long, turn long, role string, text string, node string, weight int"


def tokenizer_file():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children), len(leaves), saved,
                    hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(spark, rows):
    df = spark.createDataFrame(rows, TURNS)
    return sorted((tuple(r) for r in prefix_trie(rebuilt_conversations(df)).collect()), key=repr)


def test_trie_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 45), *range(2000, 2030), 10**12 + 20]:
        for turn in range(rng.randint(1, 5)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "long " * 50]), "x", 1))
    # one conversation shared by many, in several blocks of ids; repeated rows; a null turn comes first; no conv_id
    rows += [(c, t, "user", f"same {t}", "y", 2) for c in range(5001, 9000, 20) for t in range(3)]
    rows += [(3, 0, "user", "a b", "x", 1), (3, 0, "user", "a b", "x", 1), (4, None, "system", "first", "x", 1), (None, 0, "user", "lost", "x", 1), (10**12 + 20, 9, None, None, None, None)]
    got = trie_rows(spark, rows)
    assert got == brute_trie(rows)
    assert sum(r[1] == 0 for r in got) == 1 and max(r[3] for r in got if r[1] == 3) > 40


def test_trie_of_long_and_turnless_conversations(spark):
    # conversation 21 has one turn and no first conversation: with h > 1 it loses its turns and is a member of the root
    rows = [(40, t, "user", f"w{t} x", None, 0) for t in range(90)] + [(c, 0, "user", "hi", None, 0) for c in (21, 22, 23, 25, 61, 62, 63)]
    got = trie_rows(spark, rows)
    assert got == brute_trie(rows) and max(r[1] for r in got) == 90
    assert prefix_trie(rebuilt_conversations(empty(spark, TURNS))).collect() == []


def reference(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_cuts_follow_content_not_place():
    shared = words(9, 2000)
    one, two = cuts([words(1, 300) + shared, words(2, 77) + " " + shared])
    tail_one, tail_two = ({len(shared) - (p - off) for p in line} for line, off in ((one, len(words(1, 300))), (two, len(words(2, 77)) + 1)))
    assert len(tail_one & tail_two) > 15
    texts = ["", "a", "b" * 10_000, shared]
    for text, line in zip(texts, cuts(texts)):
        assert line[0] == 0 and line[-1] == len(text) and all(0 < b - a <= 2048 for a, b in zip(line, line[1:]))


def test_joined_parts_equal_the_whole():
    codec, rng = Codec(tokenizer_file()), random.Random(3)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "1", "22", "é", "漢", "字", "_", "-", "...", "\x1c", "\r\n", "😀", "word", " the"]
    for _ in range(150):
        parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(rng.randint(1, 8))]
        whole = codec.tokenizer.encode("".join(parts), add_special_tokens=False).ids
        assert codec.joined(codec.encode(parts)).tolist() == whole
    long = [words(k, 6000) for k in range(3)]
    assert codec.joined(codec.encode(long)).tolist() == codec.tokenizer.encode("".join(long), add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [2**26, 2**15])
def test_encoding_equals_the_library(spark, bits):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    passage = words(11, 400)
    special = [(100, words(12, 80) + passage + "<|endoftext|>" + passage, "en", "a", 1, 1, 1), (101, passage + "<|endof", "en", "a", 1, 1, 1), (102, "text|>" + passage, "en", "a", 1, 1, 1),
               (103, "漢字" * 3000, "zh", "a", 1, 1, 1), (104, " " * 5000 + passage, "en", "a", 1, 1, 1), (105, "x" + "漢字" * 3000, "zh", "a", 1, 1, 1), (106, "<|endoftext|>", "en", "a", 1, 1, 1)]
    rows = [tuple(r) for r in documents(spark).collect()] + special
    got = encode_documents(documents(spark, rows), tokenizer_file, bits).collect()
    assert sorted((repr(r[0]), *r[1:4]) for r in got) == sorted((repr(r[0]), *reference(tokenizer, r[1])) for r in rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[100]["n_reused"] > 3 and by_id[6]["n_tokens"] == 0
    ids = {r["doc_id"]: _unpacked(r["ids"]).tolist() for r in encoded(documents(spark, rows), tokenizer_file, bits).collect()}
    assert ids[100] == tokenizer.encode(special[0][1], add_special_tokens=False).ids
    assert encode_documents(empty(spark), tokenizer_file).collect() == []


def exact_polynomial(matrix):
    """Faddeev-LeVerrier in fractions, constant first."""
    d = len(matrix)
    m, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    a = [[Fraction(int(v)) for v in row] for row in matrix]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        out.append(-sum(sum(a[i][t] * m[t][i] for t in range(d)) for i in range(d)) / k)
    return [int(c) for c in reversed(out)]


def scatter(x):
    x = x.astype(object)
    return len(x) * (x.T @ x) - np.outer(x.sum(0), x.sum(0))


@pytest.mark.parametrize("seed,rank", [(1, 7), (2, 3), (3, 1)])
def test_polynomial_is_exact_and_roots_are_isolated(seed, rank):
    rng = np.random.default_rng(seed)
    m = scatter(rng.integers(-300, 300, (12, rank)) @ rng.integers(-3, 4, (rank, 7)))
    primes = charpoly.primes_for(int(np.trace(m)), 7)
    poly = charpoly.combined([charpoly.polynomial_mod(m, p) for p in primes], primes)
    assert poly == exact_polynomial(m)
    roots = charpoly.largest_roots(poly, 4)
    assert len(roots) == min(4, rank)
    for (root, _), vector, known in zip(roots, charpoly.null_vectors(m, roots), np.linalg.eigvalsh(m.astype(float))[::-1]):
        assert math.isclose(float(root), known, rel_tol=1e-12)
        v = vector.astype(float)
        assert np.abs(m.astype(float) @ v - float(root) * v).max() < 1e-9 * known and abs(v @ v - 1) < 1e-14


def test_multiple_roots_get_orthogonal_vectors():
    m = np.diag([5, 5, 3, 0]).astype(object)
    primes = charpoly.primes_for(13, 4)
    poly = charpoly.combined([charpoly.polynomial_mod(m, p) for p in primes], primes)
    roots = charpoly.largest_roots(poly, 4)
    assert [float(r) for r, _ in roots] == [5, 5, 3] and roots[0][1] == roots[1][1]
    v = np.array([x.astype(float) for x in charpoly.null_vectors(m, roots)])
    assert np.allclose(v @ v.T, np.eye(3), atol=1e-14)
    assert charpoly.is_prime(2**31 - 1) and not charpoly.is_prime(2**31 - 3) and charpoly.is_prime(7) and not charpoly.is_prime(1)


VECTORS = "vec_id long, embedding array<float>, label int, n long, whitened string"


def check_whitening(rows, got, k=4):
    kept = [(i, np.array([math.floor(256 * float(np.float32(c))) for c in v], object)) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and len(v)]
    for d in {len(x) for _, x in kept}:
        mine = [(i, x) for i, x in kept if len(x) == d]
        fit = np.array(sorted({tuple(x) for _, x in mine}), object)
        n, sums, m = len(fit), fit.sum(0), scatter(fit)
        e, u = np.linalg.eigh(m.astype(float))
        e, u = e[::-1], u[:, ::-1]
        rank = min(k, int((e > e[0] * 1e-12).sum()) if e[0] > 0 else 0)
        by_row = defaultdict(list)
        for r in got:
            if (r["vec_id"], r["deviation"]) in {(i, int(((n * x - sums) ** 2).sum())) for i, x in mine} and r["n"] == n:
                by_row[(r["vec_id"], r["deviation"])].append(r)
        signs = {}
        for i, x in mine:
            y = n * x - sums
            found = by_row[(i, int((y**2).sum()))]
            assert len([r for r in found if r["component"] == 1]) >= (1 if rank else 0)
            for r in found:
                c = r["component"] - 1
                assert c < rank and math.isclose(r["explained"], e[c] / e.sum(), rel_tol=1e-9) and r["identity_error"] < 1e-6
                want = y.astype(float) @ u[:, c] / math.sqrt(e[c])
                if abs(want) > 1e-6:
                    assert signs.setdefault(c, math.copysign(1, want * r["whitened"])) == math.copysign(1, want * r["whitened"])
                assert math.isclose(abs(want), abs(r["whitened"]), rel_tol=1e-6, abs_tol=1e-7)


def test_whitening_equals_eigen_decomposition(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.normal(0, 1 + np.arange(6) / 3)], 1, 5, "x") for i in range(80)]
    rows += [rows[3], (rows[3][0], rows[4][1], 0, 0, ""), (None, rows[5][1], 0, 0, ""), (200, None, 0, 0, ""), (201, [1.0, None] * 3, 0, 0, ""), (202, [float("nan")] * 6, 0, 0, ""),
             (203, [float("inf")] * 6, 0, 0, ""), (204, [], 0, 0, ""), (205, [-0.0] * 6, 0, 0, "")]
    # vectors of another length are fitted apart; two of them differ, so there is one component
    rows += [(300, [1.0, 2.0], 0, 0, ""), (301, [1.5, 2.0], 0, 0, "")]
    got = whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == 4 * 84 + 2
    check_whitening(rows, got)


def test_whitening_of_alike_huge_long_and_no_vectors(spark):
    alike = [(i, [1.0, 2.0, 3.0], 0, 0, "") for i in range(5)]
    assert whiten(spark.createDataFrame(alike, VECTORS)).collect() == []
    assert whiten(empty(spark, VECTORS)).collect() == []
    huge = [(i, [3e30 if i == 0 else float(i), float(i * i)], 0, 0, "") for i in range(5)]
    got = whiten(spark.createDataFrame(huge, VECTORS)).collect()
    assert len(got) == 10 and {r["deviation"] for r in got} == {2**63 - 1} and all(math.isfinite(r["whitened"]) for r in got)
    rng = np.random.default_rng(2)
    long = [(i, [float(v) for v in rng.normal(size=130)], 0, 0, "") for i in range(140)]
    check_whitening(long, whiten(spark.createDataFrame(long, VECTORS)).collect())
