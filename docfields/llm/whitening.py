"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

x = floor(factor * component) makes every vector integer, so the scatter n * sum(x x^T) - S S^T of the n distinct vectors is an
integer matrix without rounding. Its polynomial is found modulo many primes and put together by the Chinese remainder theorem;
its largest roots are isolated exactly, and inverse iteration gives their vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import kept

#: Sums are exchanged as five signed parts of 32 bits, so that Spark adds them as longs without rounding.
LIMBS = 5
LONG_MAX = 2**63 - 1


def integers(vector: Column, factor: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double")))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _gram(x: np.ndarray) -> np.ndarray:
    """x^T x, exactly, as Python integers where longs could overflow."""
    most = max(int(x.max()), -int(x.min()), 1)
    if most * most * len(x) < 2**53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    y = x.astype(object) if most * most * len(x) >= 2**62 else x
    return y.T @ y


def _sums(distinct: DataFrame) -> DataFrame:
    """d, at, l0..l4: exact sums over the vectors of each length. ``at`` >= 0 is a place i * d + j (j >= i) of sum(x x^T);
    -1 - i is the sum of component i; -1 - d is the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                rows = starts[sizes == d]
                x = flat[rows[:, None] + np.arange(d)]
                # Python integers across batches never overflow
                parts = [_gram(x)[np.triu_indices(d)].astype(object), x.astype(object).sum(0) if np.abs(x.astype(np.float64)).max() * len(x) > 2**62 else x.sum(0).astype(object), np.array([len(x)], object)]
                held[d] = [a + b for a, b in zip(held[d], parts)] if d in held else parts
        for d, parts in held.items():
            i, j = np.triu_indices(d)
            at = np.concatenate([i * d + j, -1 - np.arange(d), [-1 - d]])
            values = np.concatenate(parts)
            limbs = []
            for k in range(LIMBS):
                # the last part keeps the sign
                limbs.append((values if k == LIMBS - 1 else values % 2**32).astype(np.int64))
                values = values // 2**32
            yield pa.record_batch([pa.array(np.full(len(at), d), pa.int32()), pa.array(at, pa.int64()), *[pa.array(x) for x in limbs]],
                                  ["d", "at", *[f"l{k}" for k in range(LIMBS)]])

    parts = distinct.select("x").mapInArrow(run, "d int, at long, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    return parts.groupBy("d", "at").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])


def _matrix(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The scatter as Python integers, the sums and the count, from one length's rows of ``_sums``."""
    d = int(group["d"].iloc[0])
    values = {int(at): sum(int(v) << (32 * k) for k, v in enumerate(limbs)) for at, *limbs in group[["at", *[f"l{k}" for k in range(LIMBS)]]].itertuples(index=False)}
    n, sums = values[-1 - d], [values[-1 - i] for i in range(d)]
    scatter = np.empty((d, d), object)
    for i in range(d):
        for j in range(i, d):
            scatter[i, j] = scatter[j, i] = n * values[i * d + j] - sums[i] * sums[j]
    return scatter, np.array(sums, object), n


def _packed(numbers) -> str:
    return " ".join(str(int(v)) for v in numbers)


def fitted(distinct: DataFrame, components: int) -> DataFrame:
    """d, n, sums, component, root, trace, vector: one row per vector length and component, largest root first.

    ``distinct`` has each vector (``x``, array of long) once. ``root`` is the eigenvalue of the scatter, n * n times that of the
    covariance. The polynomial's residues are spread over tasks by prime; what meets in one task is a d x d matrix.
    """
    spark = distinct.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def dealt(group: pd.DataFrame) -> pd.DataFrame:
        from docfields.llm.charpoly import primes_for

        scatter, sums, n = _matrix(group)
        d = len(scatter)
        # a common factor of all entries only makes the numbers longer
        common = math.gcd(*[int(v) for v in scatter.ravel()]) or 1
        scatter = scatter // common
        trace = sum(int(scatter[i, i]) for i in range(d))
        primes = primes_for(trace, d)
        parts = [primes[k::tasks] for k in range(min(tasks, len(primes)))]
        text = _packed(scatter.ravel())
        return pd.DataFrame({"d": d, "n": str(n), "sums": _packed(sums), "common": str(common), "scatter": text, "primes": [_packed(p) for p in parts]})

    def reduced(group: pd.DataFrame) -> pd.DataFrame:
        from docfields.llm.charpoly import polynomial_mod

        out = []
        for row in group.itertuples():
            matrix = np.array([int(v) for v in row.scatter.split()], object).reshape(row.d, row.d)
            for p in map(int, row.primes.split()):
                out.append((row.d, row.n, row.sums, row.common, row.scatter if row.first and not out else None, p, _packed(polynomial_mod(matrix, p))))
        return pd.DataFrame(out, columns=["d", "n", "sums", "common", "scatter", "prime", "residues"])

    def solved(group: pd.DataFrame) -> pd.DataFrame:
        from docfields.llm.charpoly import combined, largest_roots, null_vectors

        first = group.iloc[0]
        d, common = int(first["d"]), int(first["common"])
        scatter = np.array([int(v) for v in group["scatter"].dropna().iloc[0].split()], object).reshape(d, d)
        poly = combined([np.array([int(v) for v in r.split()], np.int64) for r in group["residues"]], [int(p) for p in group["prime"]])
        roots = largest_roots(poly, components)
        vectors = null_vectors(scatter, roots)
        trace = float(sum(int(scatter[i, i]) for i in range(d)))
        return pd.DataFrame([(d, first["n"], first["sums"], k + 1, float(root) * common, trace * common, [float(v) for v in vector])
                             for k, ((root, _), vector) in enumerate(zip(roots, vectors))],
                            columns=["d", "n", "sums", "component", "root", "trace", "vector"])

    sums = _sums(distinct)
    parts = sums.groupBy("d").applyInPandas(dealt, "d int, n string, sums string, common string, scatter string, primes string")
    parts = parts.withColumn("first", F.col("primes").startswith("2147483647"))
    residues = (parts.groupBy("d", "primes").applyInPandas(reduced, "d int, n string, sums string, common string, scatter string, prime long, residues string"))
    return residues.groupBy("d").applyInPandas(solved, "d int, n string, sums string, component int, root double, trace double, vector array<double>")


def whiten(vectors: DataFrame, components: int = 4, factor: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component.

    x is floor(factor * entry). Each distinct x counts once in the fit: its number n, the sums S and the covariance (divisor n)
    come from exact integers. ``whitened`` is x - S/n on the component's unit vector over the root of its variance, ``explained``
    the variance's share of the trace, ``deviation`` the sum of (n*x - S)^2 and ``identity_error`` the largest entry of the
    fitted rows' whitened covariance minus the identity.

    Null vectors and vectors with a null or non-finite entry give no row; null and repeated ids stay as they are. Vectors of
    different lengths are fitted apart. Components of variance 0 (all vectors alike, fewer dimensions than components) have no
    whitened form and give no row, and so do empty vectors; of equal variances any orthogonal choice holds, and it is the same
    for all rows. A deviation beyond the long range is set to its end. An empty table gives an empty table. Other columns are
    dropped.

    Scale: one shuffle of the distinct vectors. Each task sums its own d x d products, and Spark adds those by place. Later
    steps see d x d numbers, d being the length of a vector.
    """
    rows = (vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("v")).filter(usable(F.col("v")))
            .select("vec_id", integers(F.col("v"), factor).alias("x")).filter(F.size("x") > 0))
    distinct = kept(rows.select("x").distinct())
    big = "decimal(38,0)"
    model = fitted(distinct, components).select(
        "d", F.col("n").cast("long").alias("n"), F.transform(F.split("sums", " "), lambda s: s.cast(big)).alias("sums"), "component", "root", "trace", "vector")
    model = kept(model)
    # one row per length: the components side by side, and whether n * x - S and its square stay in a long
    wide = F.exists("sums", lambda s: F.abs(s) > F.lit(2**28).cast(big) * F.col("n"))
    sides = model.groupBy("d").agg(
        F.first("n").alias("n"), F.first("sums").alias("sums"), F.first("trace").alias("trace"),
        F.sort_array(F.collect_list(F.struct("component", "root", "vector"))).alias("parts")).withColumn("wide", wide)
    sides = sides.withColumn("long_sums", F.when(~F.col("wide"), F.transform("sums", lambda s: s.cast("long"))))

    end, cap = F.lit(LONG_MAX).cast(big), F.lit(3_100_000_000).cast(big)

    def of(y: Column, deviation: Column) -> Column:
        """``whitened`` (one number per component) and ``deviation`` from y = n * x - S, computed once."""
        dots = F.transform("parts", lambda p: F.aggregate(F.zip_with(y, p["vector"], lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v) / F.sqrt(p["root"]))
        return F.struct(dots.alias("whitened"), deviation.alias("deviation"))

    def in_longs(y: Column) -> Column:
        # below this bound on |n * x - S| the sum of squares fits a long
        fits = F.forall(y, lambda v: F.abs(v) * F.sqrt(F.col("d")) < 3.0e9)
        exact = F.aggregate(y, F.lit(0).cast(big), lambda s, v: (s + v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast(big))
        return of(y, F.when(fits, F.aggregate(y, F.lit(0).cast("long"), lambda s, v: s + v * v)).otherwise(F.least(end, exact).cast("long")))

    def in_decimals(y: Column) -> Column:
        # a single entry beyond the cap already has a square beyond the long range
        part = F.transform(y, lambda v: F.least(F.abs(v), cap).cast("decimal(11,0)"))
        return of(y, F.aggregate(part, F.lit(0).cast(big), lambda s, v: F.least(end, (s + v * v).cast(big))).cast("long"))

    def projected(df: DataFrame) -> DataFrame:
        """Adds ``r``: whitened and deviation."""
        joined = df.withColumn("len", F.size("x")).join(sides, F.col("len") == F.col("d")).drop("len")
        huge = F.col("wide") | (F.col("n") > 2**33) | F.exists("x", lambda v: (v > 2**28) | (v < -(2**28)))
        close = F.zip_with("x", "long_sums", lambda v, s: v * F.col("n") - s)
        far = F.zip_with("x", "sums", lambda v, s: (v.cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)") - s).cast(big))
        return joined.withColumn("r", F.when(huge, _let(far, in_decimals)).otherwise(_let(close, in_longs)))

    # covar_pop centres before it multiplies
    fit = projected(distinct)
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    errors = fit.groupBy("d").agg(F.greatest(*[
        F.coalesce(F.abs(F.covar_pop(F.get("r.whitened", i), F.get("r.whitened", j)) - F.lit(float(i == j))), F.lit(0.0)) for i, j in pairs], F.lit(0.0)).alias("identity_error"))
    errors = kept(errors).withColumnRenamed("d", "error_d")

    out = projected(rows)
    out = out.join(errors, F.col("d") == F.col("error_d"))
    return (out.select("vec_id", "n", "r.deviation", "trace", "identity_error", F.posexplode(F.arrays_zip(F.col("parts"), F.col("r.whitened").alias("whitened"))).alias("at", "p"))
            .select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("p.whitened").alias("whitened"),
                    (F.col("p.parts.root") / F.col("trace")).alias("explained"), "identity_error"))
