"""Token counts by a separator scan over flat token files that have no index.

A token file is nothing but ids, ``dtype`` wide and little-endian, documents one after another, each closed by the end id.
The scan cuts files into blocks at any place, finds the end ids of a block with one vectorised comparison, and stitches
documents over block borders with a prefix scan over one summary per block: where the last end id before it lies, and how
many there were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm.common import in_small_batches, kept, shared_folder
from docfields.operators.ordered import running_total

BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 25


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a uri; a path without a scheme is a shared path that every machine sees."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, encode, folder: str, end_id: int, dtype: str = "<u2", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the ids of every row of (doc_id, text) to flat files in ``folder`` and return the order of the documents.

    ``encode()`` gives, inside a task, a function from a list of texts to a list of id sequences. The result (file,
    ordinal, doc_id) is the only place where ids of documents are kept; the files hold none. A file gets its name when it is
    complete: a task that runs again writes files of its own, and only those in the result count. A null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder = TaskContext.get(), encode()
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        name, out, size, ids, number = "", None, 0, [], 0

        def finish() -> pa.RecordBatch:
            out.close()
            system.move(f"{root}/_{name}", f"{root}/{name}")
            return pa.record_batch({"file": pa.array([name] * len(ids), pa.string()), "ordinal": pa.array(range(len(ids)), pa.int64()), "doc_id": pa.array(ids, pa.int64())})

        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                for doc_id, tokens in zip(part.column(0).to_pylist(), encoder([t or "" for t in part.column(1).to_pylist()])):
                    if out is None:
                        name, number = f"tokens-{task.partitionId():05d}-{task.taskAttemptId()}-{number}.bin", number + 1
                        out, size, ids = system.open_output_stream(f"{root}/_{name}"), 0, []
                    data = np.append(np.asarray(tokens, np.int64), end_id)
                    out.write(data.astype(dtype).tobytes())
                    ids.append(doc_id)
                    size += len(data)
                    if size >= file_tokens:
                        yield finish()
                        out = None
        if out is not None:
            yield finish()

    written = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file string, ordinal long, doc_id long")
    return kept(written)


def file_sizes(spark: SparkSession, folder: str, pattern: str = "*.bin") -> DataFrame:
    """file, bytes of the token files in a folder; Spark lists them, their contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
            .select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes")))


def scan_blocks(files: DataFrame, folder: str, end_id: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, tokens, ends: the places (in the file) of the end ids of every block of (file, bytes)."""
    width = np.dtype(dtype).itemsize
    count = F.floor(F.col("bytes") / width).cast("long")
    blocks = (files.filter(count > 0).withColumn("n", count)
              .select("file", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block_tokens))).alias("block")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = opened(folder)
        for pdf in batches:
            for file, n, block in pdf.itertuples(index=False):
                first = block * block_tokens
                with system.open_input_file(f"{root}/{file}") as source:
                    source.seek(first * width)
                    ids = np.frombuffer(source.read(min(block_tokens, n - first) * width), dtype)
                yield pd.DataFrame({"file": [file], "block": [block], "tokens": [len(ids)], "ends": [(np.flatnonzero(ids == end_id) + first).astype(np.int64)]})

    return blocks.repartition("file", "block").mapInPandas(run, "file string, block long, tokens long, ends array<long>")


def token_counts(files: DataFrame, folder: str, end_id: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS, block_chunk: int = 4096) -> DataFrame:
    """file, ordinal, start, n_tokens, closed: one row per document of the files (file, bytes) in ``folder``.

    ``start`` is the place of the first token, ``n_tokens`` leaves the end id out; two end ids in a row are an empty
    document. Tokens after the last end id are a document with ``closed`` false. Bytes that do not fill an id at the end of a
    file are ignored; an empty file has no document; a file listed twice is read once. Memory: one block.

    The prefix scan adds, per file, numbers of end ids over one row per block; the carried place of the last end id is the
    maximum so far, which the running count of filled blocks picks out. Both run in chunks of ``block_chunk`` blocks.
    """
    scanned = kept(scan_blocks(files.groupBy("file").agg(F.max("bytes").alias("bytes")), folder, end_id, dtype, block_tokens))
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    summary = scanned.select("file", "block", F.size("ends").cast("long").alias("count"), last.alias("last"))
    chunk = F.floor(F.col("block") / block_chunk)
    counted = running_total(summary, ["file"], ["block"], F.col("count"), chunk, "up_to")
    # blocks with an end id are numbered: block number k carries its last place to the blocks up to number k + 1
    filled = running_total(counted, ["file"], ["block"], F.when(F.col("count") > 0, 1).otherwise(0), chunk, "filled")
    carried = filled.filter("count > 0").select(F.col("file").alias("of"), F.col("filled").alias("k"), F.col("last").alias("before"))
    mine = filled.withColumn("k_before", F.col("filled") - F.when(F.col("count") > 0, 1).otherwise(0)).select("file", "block", (F.col("up_to") - F.col("count")).alias("first"), "k_before")
    placed = (mine.join(carried, (F.col("file") == F.col("of")) & (F.col("k_before") == F.col("k")), "left")
              .select(F.col("file").alias("f"), F.col("block").alias("b"), "first", F.coalesce("before", F.lit(-1).cast("long")).alias("before")))
    stitched = scanned.join(placed, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    inside = F.transform("ends", lambda e, i: F.struct((F.col("first") + i).alias("ordinal"), (F.when(i == 0, F.col("before")).otherwise(F.get("ends", i - 1)) + 1).alias("start"), e.alias("end")))
    closed = stitched.select("file", F.explode(inside).alias("d")).select("file", "d.ordinal", "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = scanned.groupBy("file").agg(F.sum("tokens").alias("n"), F.sum(F.size("ends").cast("long")).alias("ordinal"), F.coalesce(F.max(last), F.lit(-1).cast("long")).alias("last"))
    rest = whole.filter("last + 1 < n").select("file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("n") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def document_token_counts(docs: DataFrame, encode, end_id: int, dtype: str = "<u2", **scan) -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens of every row of (doc_id, text): texts are encoded into flat token files in the
    shared folder, and the counts come from scanning those. Null texts have no tokens; repeated rows and null ids stay."""
    spark = docs.sparkSession
    in_small_batches(spark)
    folder = shared_folder(spark)
    order = write_token_files(docs, encode, folder, end_id, dtype)
    listed = order.select("file").distinct()
    sizes = file_sizes(spark, folder) if order.select("file").limit(1).count() else listed.withColumn("bytes", F.lit(0).cast("long"))
    files = sizes.join(listed.withColumnRenamed("file", "name"), F.col("file") == F.col("name"), "left_semi")
    counts = token_counts(files, folder, end_id, dtype, **scan)
    named = order.select(F.col("file").alias("name"), F.col("ordinal").alias("number"), "doc_id")
    return (counts.join(named, (F.col("file") == F.col("name")) & (F.col("ordinal") == F.col("number")))
            .select("doc_id", "file", "ordinal", "start", "n_tokens"))
