"""Exact top-k search by inner product: columnar branch-and-bound over blocks of vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.common import kept


def scaled(vector: Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of every component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double")))


def _finite(vector: Column) -> Column:
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(usable, F.lit(False))


def _kind(queries: np.ndarray, rows: np.ndarray):
    """The cheapest number type in which every inner product is exact."""
    q, r = (int(max(abs(int(m.max())), abs(int(m.min())))) if m.size else 0 for m in (queries, rows))
    most = q * r * max(1, queries.shape[1])
    return np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def search_block(query_rows, queries, floors, row_rows, row_ids, rows, k: int, dims: int = 16, chunk: int = 128):
    """The k best rows of one block for every query of one block: (query row, row id, score) tuples.

    The rows lie in vertical layout, one line per dimension. Scores grow by ``dims`` dimensions at a time. What the
    remaining dimensions can still add or take away is at most the product of the remaining lengths of query and row;
    a row whose upper bound is below the k-th best lower bound, or below the floor the query brings along, is out, and
    rows that are out for every query of the chunk are compacted away. Ties at the k-th place and at the floor all
    survive, so the tie rule (smaller id) is exact.
    """
    kind = _kind(queries, rows)
    lines = np.ascontiguousarray(rows.T).astype(kind)
    squares = np.asarray(rows, np.float64) ** 2
    # remaining squared length of every row after each dimension block
    left = [squares[:, d:].sum(1) for d in range(0, rows.shape[1] + dims, dims)]
    out = []
    for at in range(0, len(queries), chunk):
        part = queries[at : at + chunk].astype(kind)
        mine_of = query_rows[at : at + chunk]
        known = floors[at : at + chunk]
        q_squares = np.asarray(queries[at : at + chunk], np.float64) ** 2
        alive = np.arange(len(rows))
        scores = np.zeros((len(part), len(rows)), kind)
        own = mine_of[:, None] == row_rows[None, :]
        for step, d in enumerate(range(0, rows.shape[1], dims)):
            here = lines[d : d + dims] if len(alive) == len(rows) else lines[d : d + dims][:, alive]
            scores += part[:, d : d + dims] @ here
            if d + dims >= rows.shape[1] or len(alive) <= k + 1:
                continue
            # one more and a relative margin cover the rounding of the bound itself
            bound = np.sqrt(np.outer(q_squares[:, d + dims :].sum(1), left[step + 1][alive])) * (1 + 1e-9) + 1
            now = np.where(own, -np.inf, scores.astype(np.float64))
            floor = np.maximum(np.partition(now - bound, -k, axis=1)[:, -k], known)
            keep = (now + bound >= floor[:, None] - np.abs(floor[:, None]) * 1e-9).any(0)
            if not keep.all():
                alive, scores, own = alive[keep], scores[:, keep], own[:, keep]
        for i in range(len(part)):
            mine = np.flatnonzero(~own[i])
            if len(mine) > k:
                line = scores[i][mine]
                mine = mine[line >= (sorted(line)[-k] if kind is object else np.partition(line, -k)[-k])]
            best = sorted(((-int(scores[i][j]), int(row_ids[alive[j]])) for j in mine))[:k]
            out += [(int(mine_of[i]), row, max(-(2**63), min(2**63 - 1, -score))) for score, row in best]
    return out


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
                factor: float = 256.0, block_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest integer inner product for every query row.

    Every row but the query's own is a candidate; ties go to the smaller id; fewer candidates give fewer rows.
    Rows with a null id, a null vector, or a null or non-finite component take no part; vectors are compared with
    vectors of their own length only. Rows that share an id are rows of their own: each is a candidate of the others, and
    each that is a query has its own ranks. A score beyond the long range is set to its end. No query or no candidate
    gives an empty table.

    The scaled vectors are written once with a row number; a hash of it deals them into blocks of about ``block_rows``.
    Each pair of a query block and a candidate block is one group, so memory is bounded by two blocks at any table size.
    A first pass meets all queries with one candidate block; the k-th best score of a query there is the floor it brings
    to all other blocks. A block pair returns at most k rows per query, and a window picks the k best of those.
    """
    # the flag is computed on the caller's columns, before anything is renamed
    rows = kept(vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
                .filter(F.col("id").isNotNull() & _finite(F.col("v")))
                .select(F.monotonically_increasing_id().alias("row"), "id", scaled(F.col("v"), factor).alias("v"), "q")
                .withColumn("d", F.size("v")))
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    blocks, query_blocks = max(1, math.ceil(n / block_rows)), max(1, math.ceil((n_queries or 0) / block_rows))
    asked = rows.filter("q").withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(query_blocks)))
    dealt = rows.withColumn("rb", F.pmod(F.xxhash64("row"), F.lit(blocks)))

    def longs(column: pa.ChunkedArray):
        return column.combine_chunks().to_numpy(zero_copy_only=False)

    def matrix(t: pa.Table):
        return t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        found = search_block(longs(left["row"]), matrix(left), longs(left["floor"]), longs(right["row"]), longs(right["id"]), matrix(right), k) \
            if len(left) and len(right) else []
        q, r, s = zip(*found) if found else ((), (), ())
        return pa.table({"query": pa.array(q, pa.int64()), "vec_id": pa.array(r, pa.int64()), "score": pa.array(s, pa.int64())})

    def met(queries: DataFrame, candidates: DataFrame, first: int, last: int) -> DataFrame:
        """Queries (with a floor) against candidate blocks ``first`` to ``last``."""
        keys = ["d", "qb", "rb"]

        def each(low: int, high: int):
            return F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long")))

        left = queries.select("row", "v", "d", "qb", "floor", each(first, last).alias("rb"))
        right = candidates.filter(F.col("rb").between(first, last)).select("row", "id", "v", "d", "rb", each(0, query_blocks - 1).alias("qb"))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pairs, "query long, vec_id long, score long")

    none = F.lit(float("-inf"))
    found = met(asked.withColumn("floor", none), dealt, 0, 0)
    if blocks > 1:
        found = kept(found)
        floors = found.groupBy("query").agg(F.when((F.count("*") >= k) & (F.min("score") > -(2**63)), F.min("score").cast("double")).alias("_floor"))
        told = kept(asked.join(floors, F.col("row") == F.col("query"), "left").withColumn("floor", F.coalesce("_floor", none)).drop("query", "_floor"))
        found = found.unionByName(met(told, dealt, 1, blocks - 1))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return (ranked.join(asked.select("row", F.col("id").alias("query_id")), F.col("query") == F.col("row"))
            .select("query_id", "rank", "vec_id", "score"))
