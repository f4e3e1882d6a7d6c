"""Order-dependent work inside groups that may be very large.

A plain window puts a whole group into one task. Here a group is first cut into chunks by an expression that
never decreases along the order (page div 10000, line div 4096 ...). Windows run per (group, chunk); only one
summary row per chunk is combined across the group and joined back on (group, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docfields.session import large


def _columns(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _joined(df: DataFrame, side: DataFrame, keys) -> DataFrame:
    cond = None
    for k in keys:
        part = df[k].eqNullSafe(side[k])
        cond = part if cond is None else cond & part
    return df.join(large(side), cond, "left").select(df["*"], *[side[c] for c in side.columns if c not in keys])


def running_total(df: DataFrame, keys, order, amount: Column, chunk: Column, name: str) -> DataFrame:
    """Inclusive running sum of ``amount`` along ``order`` within ``keys``."""
    keys = list(keys)
    cut = df.withColumn("_chunk", chunk).withColumn("_amount", amount.cast("long"))
    inside = W.partitionBy(*keys, "_chunk").orderBy(*_columns(order)).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = (cut.groupBy(*keys, "_chunk").agg(F.sum("_amount").alias("_sum"))
               .select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")))
    ranked = cut.withColumn("_inside", F.sum("_amount").over(inside))
    return (_joined(ranked, offsets, [*keys, "_chunk"])
            .withColumn(name, F.col("_inside") + F.col("_offset"))
            .drop("_chunk", "_amount", "_inside", "_offset"))


def ordinal(df: DataFrame, keys, order, chunk: Column, name: str = "ordinal") -> DataFrame:
    """Row number within ``keys``. ``order`` must be total within a chunk."""
    return running_total(df, keys, order, F.lit(1), chunk, name)


def previous(df: DataFrame, keys, order, values: dict[str, str], chunk: Column, found: str | None = None) -> DataFrame:
    """``values`` maps new column to source column: the source value of the row before, across chunks too."""
    keys = list(keys)
    cut = df.withColumn("_chunk", chunk)
    packed = F.struct(*[F.col(src).alias(dst) for dst, src in values.items()])
    cut = cut.withColumn("_here", packed)
    inside = W.partitionBy(*keys, "_chunk").orderBy(*_columns(order))
    ends = (cut.groupBy(*keys, "_chunk").agg(F.max_by("_here", F.struct(*_columns(order))).alias("_last"))
            .select(*keys, "_chunk", F.lag("_last").over(W.partitionBy(*keys).orderBy("_chunk")).alias("_carried")))
    lagged = cut.withColumn("_lag", F.lag("_here").over(inside))
    out = _joined(lagged, ends, [*keys, "_chunk"])
    before = F.coalesce(F.col("_lag"), F.col("_carried"))
    extra = {found: before.isNotNull()} if found else {}
    return (out.withColumns({**{dst: before[dst] for dst in values}, **extra})
            .drop("_chunk", "_here", "_lag", "_carried"))
