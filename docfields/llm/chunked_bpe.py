"""BPE encoding with content-defined chunk reuse.

A rolling hash over the last characters cuts texts where the content says so, so a passage that documents share is cut alike in
all of them. A chunk that occurs again is encoded once and its ids are joined back; runs of chunks that occur once are encoded
where they lie. The pieces of a document are encoded as if each stood alone, so their joins are then repaired: text around a join
is encoded again, between places where the encodings must agree, and spliced in; if they do not agree there, the text grows.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import in_small_batches, kept

WINDOW, MEAN, LEAST, MOST = 32, 256, 64, 2048
BITMAP_BITS = 2**26
# fixed value: how byte-level vocabularies split a text before merging
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text and its parts: added tokens stand alone, and no repair crosses them.
TEXT, ADDED = 0, 1
#: A word ends here whatever stands around: no alternative of a byte-level split has a space or line feed after a character
#: that is no white space. UTF-8 of ASCII and of U+00C0 to U+053F and U+4000 to U+9FFF, where no other white space lies.
SURE = re.compile(rb"(?:[!-~]|[\xc3-\xd4][\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2})(?=[ \n])")


def load(path: str):
    """The tokenizer of a file, without truncation and padding. Must have byte-level steps, on which the repair rests."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        form = json.load(f)
    kinds = {(form.get("pre_tokenizer") or {}).get("type"), (form.get("decoder") or {}).get("type")}
    stripping = any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in form["added_tokens"])
    if kinds != {"ByteLevel"} or form["pre_tokenizer"].get("add_prefix_space") or form.get("normalizer") or stripping:
        raise ValueError("a byte-level tokenizer without normalizer, prefix space and stripping tokens is needed")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def cuts(texts: list[str]) -> list[list[int]]:
    """Places in characters where each text is cut, ends included. The hash of the ``WINDOW`` characters before a place decides;
    pieces have ``LEAST`` to ``MOST`` characters but for the last."""
    data = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    mixed = (data ^ (data >> np.uint32(7))) * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    # h[i] = sum of mixed[i - j] * 5^j over the window, a power of two: each step doubles how far a hash reaches
    h, j = mixed, 1
    while j < min(WINDOW, len(data)):
        longer = h.copy()
        longer[j:] += h[:-j] * np.uint32(pow(5, j, 2**32))
        h, j = longer, 2 * j
    places = np.flatnonzero((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - int(math.log2(MEAN))) == 0) + 1
    out, at = [], 0
    for text in texts:
        end, line, last = at + len(text), [0], at
        inside = places[np.searchsorted(places, at + WINDOW): np.searchsorted(places, end)].tolist()
        for p in inside:
            while p - last > MOST:
                last += MOST
                line.append(last - at)
            if p - last >= LEAST:
                last = p
                line.append(last - at)
        while end - last > MOST:
            last += MOST
            line.append(last - at)
        if end - at > line[-1]:
            line.append(end - at)
        out.append(line)
        at = end
    return out


def chunk_key(chunk: str) -> bytes:
    return xxhash.xxh3_128_digest(chunk.encode())


def _packed(ids: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(ids.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


class Codec:
    """A tokenizer with what joining needs: bytes of every id, added tokens, and a fast way to the same ids.

    Where the file's merges rise with their ids, tiktoken finds the same ids from the same vocabulary several times faster. It
    sees only texts whose characters both libraries are known to class alike (letter, number, space, other): every character
    is tried once in all four neighbourhoods. All other texts go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.tokenizer = load(path)
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {text: i for i, text in added.items()}
        self.pattern = re.compile("|".join(sorted(map(re.escape, self.added), key=len, reverse=True))) if added else None
        letters = {c: b for b, c in _byte_letters().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = added[i].encode() if i in added else bytes(letters[c] for c in token)
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        with open(path, encoding="utf-8") as f:
            merges = [m.split(" ") if isinstance(m, str) else m for m in json.load(f)["model"]["merges"]]
        order = [vocabulary[x + y] for x, y in merges]
        self.fast = None
        if order == sorted(order) and len(order) + 256 == len(vocabulary) - len(added):
            self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if i not in added}, special_tokens={})
        self.alike: dict[str, bool] = {}

    def _plain(self, text: str) -> bool:
        """Both libraries split this text alike."""
        if text.isascii():
            return True
        for c in set(text):
            if c not in self.alike:
                probe = f"a{c}a 1{c}1 !{c}! {c} \t{c}\n"
                self.alike[c] = self.fast.encode_ordinary(probe) == self.tokenizer.encode(probe, add_special_tokens=False).ids
            if not self.alike[c]:
                return False
        return True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text as if it stood alone; no text holds an added token."""
        return [np.array(self.fast.encode_ordinary(t) if self.fast and self._plain(t) else self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]

    def split(self, text: str) -> list[tuple[int, str]]:
        """(kind, text) pieces around the added tokens."""
        if self.pattern is None:
            return [(TEXT, text)] if text else []
        out, at = [], 0
        for m in self.pattern.finditer(text):
            out += [(TEXT, text[at:m.start()]), (ADDED, m[0])]
            at = m.end()
        return [p for p in [*out, (TEXT, text[at:])] if p[1]]

    def text(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def joined(self, parts: list[np.ndarray]) -> np.ndarray:
        """Ids of the texts of ``parts`` put together, from the ids of each.

        From a sure place before a join to a sure place after it, the text is encoded anew. Both places are word ends in the
        whole text and in either part, so what lies outside is right already. The word on either side of the new text is
        encoded along and must come out as it was; else, or where no sure place is found, more text goes in.
        """
        settled, done = [], parts[0]
        for part in parts[1:]:
            reach = 32
            while True:
                while settled and reach > len(done):
                    done = np.concatenate([settled.pop(), done])
                left, right = done[max(0, len(done) - reach):], part[:reach]
                whole = len(left) == len(done) and len(right) == len(part)
                start, stop = self._sure_before(left, len(left) == len(done)), self._sure_after(right, len(right) == len(part))
                if start is not None and stop is not None:
                    (skip, a), (take, b) = start, stop
                    window = np.concatenate([left[skip:], right[:take]])
                    again = self.encode([self.text(window).decode()])[0]
                    if whole or (np.array_equal(again[:a], window[:a]) and np.array_equal(again[len(again) - b:], window[len(window) - b:])):
                        break
                assert not whole, "the whole text is sure on both sides"
                reach *= 4
            done = np.concatenate([done[: len(done) - len(left) + skip], again, part[take:]])
            if len(done) > 8192:
                # a later join rarely reaches further back; if it does, what is settled is taken up again
                settled.append(done[:-1024])
                done = done[-1024:]
        return np.concatenate([*settled, done])

    def _marks(self, ids: np.ndarray) -> list[int]:
        """Numbers of the ids, but for the first, that start right after a sure word end. The ids may start or end inside a character."""
        text = self.text(ids)
        ends = np.cumsum(self.sizes[ids])
        places = [m.end() for m in SURE.finditer(text)]
        at = np.searchsorted(ends, places)
        return [int(i) + 1 for i, p in zip(at, places) if i + 1 < len(ends) and ends[i] == p]

    def _sure_before(self, ids: np.ndarray, all_of_it: bool) -> tuple[int, int] | None:
        """(ids to skip, ids that must come out again) at the left of a join: the last but one sure word end, so that one
        whole word follows it before the last one."""
        marks = self._marks(ids)
        if len(marks) >= 2:
            return marks[-2], marks[-1] - marks[-2]
        return (0, 0) if all_of_it else None

    def _sure_after(self, ids: np.ndarray, all_of_it: bool) -> tuple[int, int] | None:
        """(ids to take, ids that must come out again) at the right of a join: the second sure word end."""
        marks = self._marks(ids)
        if len(marks) >= 2:
            return marks[1], marks[1] - marks[0]
        return (len(ids), 0) if all_of_it else None


def _byte_letters() -> dict[int, str]:
    """Byte -> character of the byte-level alphabet: printable Latin-1 stands for itself, the rest for 256 and up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


@lru_cache(maxsize=4)
def codec_at(path: str) -> Codec:
    """The codec of a worker process, built once for each file."""
    return Codec(path)


def _remembered(path: Callable[[], str]) -> Callable[[], Codec]:
    def get() -> Codec:
        from docfields.llm.chunked_bpe import codec_at

        return codec_at(path())

    return get


def _digests(codec: Codec, ids: np.ndarray) -> tuple[int, str, str]:
    numbers = ids.tolist()
    # what the library's decoder does: bytes of all ids, special ones too, put together and read as UTF-8
    decoded = codec.text(ids).decode("utf-8", "replace")
    return len(numbers), hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _chunks_of(codec: Codec, texts: list[str]) -> list[list[tuple[int, str]]]:
    """(kind, text) pieces of every text: chunks, and added tokens between."""
    split = [codec.split(t) for t in texts]
    plain = [piece for pieces in split for kind, piece in pieces if kind == TEXT]
    lines = iter(cuts(plain))
    out = []
    for pieces in split:
        chunks: list[tuple[int, str]] = []
        for kind, piece in pieces:
            if kind == ADDED:
                chunks.append((ADDED, piece))
            else:
                line = next(lines)
                chunks += [(TEXT, piece[a:b]) for a, b in zip(line, line[1:])]
        out.append(chunks)
    return out


def _batches(batches: Iterator[pa.RecordBatch], column: int, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about so many characters at most; one long text is a slice of its own."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < len(batch):
            until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chars, "right")))
            yield batch.slice(at, until - at)
            at = until


def shared_chunks(docs: DataFrame, codec: Callable[[], Codec], most_bits: int = BITMAP_BITS) -> np.ndarray:
    """Bitmap of hashed keys of the chunks that occur more than once. Its size is bounded; where too many chunks are shared for
    it, chunks that occur once pass as shared, which costs work but changes no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for batch in _batches(batches, 0):
            keys: dict[int, int] = {}
            for pieces in _chunks_of(c, [t or "" for t in batch.column(0).to_pylist()]):
                for kind, chunk in pieces:
                    if kind == TEXT:
                        key = int.from_bytes(chunk_key(chunk)[:8], "little", signed=True)
                        keys[key] = keys.get(key, 0) + 1
            yield pa.record_batch({"key": pa.array(list(keys), pa.int64()), "n": pa.array(list(keys.values()), pa.int64())})

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "key long, n long")
    place = F.pmod("key", F.lit(most_bits)) + 1
    parts = (counts.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select(place.alias("p"))
             .groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap")))
    bitmap = np.zeros(most_bits // 8, np.uint8)
    for r in parts.collect():
        bitmap[(r["bucket"] - 1) * 4096: r["bucket"] * 4096] = np.frombuffer(r["bitmap"], np.uint8)
    return bitmap


def encode_documents(docs: DataFrame, path: Callable[[], str], most_bits: int = BITMAP_BITS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_chunks, n_reused: one row per document row.

    ``path`` gives the tokenizer file's place on the machine that asks. Ids are those of the tokenizers library for the whole
    text with added tokens recognised and none put around; they are decoded again with special tokens kept. ``ids_sha256`` is
    over the decimal ids with commas, ``decoded_sha256`` over the decoded text. ``n_reused`` counts the document's chunks that
    came out of the common table. ``encoded`` returns the ids themselves.

    Null texts are empty; an empty text has no tokens and the digests of nothing. Null and repeated ids and repeated rows are
    documents of their own; other columns are dropped; an empty table gives an empty table.
    """
    get = _remembered(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = get()
        for batch in batches:
            found = [_digests(codec, _unpacked(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()),
                 pa.array([f[2] for f in found], pa.string()), batch.column(2), batch.column(3)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chunks", "n_reused"])

    ids = encoded(docs, path, most_bits)
    return ids.mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks int, n_reused int")


def encoded(docs: DataFrame, path: Callable[[], str], most_bits: int = BITMAP_BITS) -> DataFrame:
    """doc_id, ids (packed, see ``_unpacked``), n_chunks, n_reused: one row per document row.

    Scale: texts are read several times and never shuffled whole. The first pass counts chunk keys. The second sends on the
    chunks that may occur again: their texts meet by key, which Spark combines before the shuffle, and their ids return by an
    equi join on the key. Documents without such a chunk are encoded in one pass without a shuffle; of the others the ids of
    their other runs meet the returned ids by the hash of their text, so copies ask once. A chunk or text in a third of all
    documents makes a skewed join; it has one row on the other side, and Spark splits it.
    """
    in_small_batches(docs.sparkSession)
    get = _remembered(path)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, get, most_bits))

    def plans(batch: pa.RecordBatch) -> Iterator[tuple[list[tuple[int, bytes | None, str]], int]]:
        """For every text of a batch its pieces as (kind, key of a shared chunk, text), other neighbours put together, and the
        number of its chunks. The same text always gives the same plan."""
        codec, bitmap = get(), sent.value
        for pieces in _chunks_of(codec, [t or "" for t in batch.column(1).to_pylist()]):
            plan: list[tuple[int, bytes | None, str]] = []
            open_: list[str] = []
            for kind, chunk in pieces:
                key = chunk_key(chunk) if kind == TEXT else None
                if key is not None:
                    at = int.from_bytes(key[:8], "little") % most_bits
                    key = key if bitmap[at >> 3] >> (at & 7) & 1 else None
                if kind == TEXT and key is None:
                    open_.append(chunk)
                    continue
                if open_:
                    plan.append((TEXT, None, "".join(open_)))
                    open_ = []
                plan.append((kind, key, chunk))
            if open_:
                plan.append((TEXT, None, "".join(open_)))
            yield plan, len(pieces)

    def own_ids(codec: Codec, kind: int, text: str) -> np.ndarray:
        return np.array([codec.added[text]], np.uint32) if kind == ADDED else codec.encode([text])[0]

    def put_together(codec: Codec, parts: list[tuple[int, np.ndarray]]) -> bytes:
        done, open_ = [], []
        for kind, ids in parts:
            if kind == TEXT:
                open_.append(ids)
                continue
            done += [codec.joined(open_), ids] if open_ else [ids]
            open_ = []
        done += [codec.joined(open_)] if open_ else []
        return _packed(np.concatenate(done) if done else np.zeros(0, np.uint32))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 1):
            out = [(t, no, key, chunk) for t, (plan, _) in zip(batch.column(2).to_pylist(), plans(batch)) for no, (_, key, chunk) in enumerate(plan) if key is not None]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int32(), pa.binary(), pa.string()))], ["text_key", "no", "key", "chunk"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = get()
        for batch in _batches(batches, 1):
            found = [(i, put_together(codec, [(kind, own_ids(codec, kind, x)) for kind, _, x in plan]), n)
                     for i, (plan, n) in enumerate(plans(batch)) if all(key is None for _, key, _ in plan)]
            at, ids, n = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.binary()), pa.array(n, pa.int32()), pa.array([0] * len(n), pa.int32())],
                                             ["doc_id", "ids", "n_chunks", "n_reused"])

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = get()
        part = pa.struct([("no", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary())])
        for batch in _batches(batches, 1):
            found = [(i, n, [{"no": no, "kind": kind, "ids": _packed(own_ids(codec, kind, x))} for no, (kind, key, x) in enumerate(plan) if key is None])
                     for i, (plan, n) in enumerate(plans(batch)) if any(key is not None for _, key, _ in plan)]
            at, n, own = zip(*found) if found else ((), (), ())
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), pa.array(n, pa.int32()), pa.array(own, pa.list_(part))],
                                             ["doc_id", "text_key", "n_chunks", "own"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = get()
        for batch in _batches(batches, 1):
            ids = codec.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_packed(x) for x in ids], pa.binary())], ["k", "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = get()
        for batch in batches:
            out = [put_together(codec, [(p["kind"], _unpacked(p["ids"])) for p in parts]) for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(1), batch.column(3)], ["doc_id", "ids", "n_chunks", "n_reused"])

    schema = f"doc_id {id_type}, ids binary, n_chunks int, n_reused int"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"))
    refs = kept(rows.mapInArrow(ask, "text_key binary, no int, key binary, chunk string"))
    table = refs.select("key", "chunk").distinct().select(F.col("key").alias("k"), "chunk").mapInArrow(encode, "k binary, ids binary")
    back = (refs.select("text_key", "no", "key").distinct().join(table, F.col("key") == F.col("k"))
            .select("text_key", F.struct("no", F.lit(TEXT).alias("kind"), "ids").alias("p")))
    # written, so that Spark can split the copies of one text in the join that follows
    gathered = kept(back.groupBy(F.col("text_key").alias("of")).agg(F.collect_list("p").alias("back")))
    asking = rows.mapInArrow(mixed, f"doc_id {id_type}, text_key binary, n_chunks int, own array<struct<no:int,kind:int,ids:binary>>")
    together = (asking.join(gathered, F.col("text_key") == F.col("of"))
                .select("doc_id", "n_chunks", F.sort_array(F.concat("own", "back")).alias("parts"), F.size("back").alias("n_reused")))
    return together.mapInArrow(join, schema).unionByName(rows.mapInArrow(alone, schema))
