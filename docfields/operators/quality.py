"""Coverage, profiles and run comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.functions.names import needs_review


def filled_count(records: DataFrame, fields, blank_counts: bool = True, name: str = "filled") -> DataFrame:
    """Non-null fields; ``blank_counts=False`` leaves empty strings out."""

    def full(f: str):
        c = F.col(f"`{f}`")
        return (c.isNotNull() if blank_counts else F.coalesce(c, F.lit("")) != "").cast("int")

    return records.withColumn(name, reduce(lambda a, b: a + b, [full(f) for f in fields]))


def field_coverage(records: DataFrame, fields) -> DataFrame:
    """Found, missing and rate per field, from one aggregation over the wide records."""
    counts = records.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{f}`")).alias(f"_c{i}") for i, f in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_c{i}").alias("found")) for i, f in enumerate(fields)])
    return (counts.select("_n", F.explode(rows).alias("r"))
            .select("r.field", "r.found", (F.col("_n") - F.col("r.found")).alias("missing"),
                    (F.col("r.found") / F.nullif("_n", F.lit(0))).alias("rate")))


def plate_length_profile(plates: DataFrame, plate: str = "vehicle", error: str | None = None) -> DataFrame:
    """G6."""
    n = F.length(plate)
    failed = F.col(error).isNotNull() if error else F.lit(False)
    return plates.agg(
        F.count_if(~failed & (n > 0)).alias("found"), F.count_if(~failed & (n > 0) & (n <= 10)).alias("standard"),
        F.count_if(~failed & (n > 10)).alias("oversized"),
        F.count_if(~failed & (F.coalesce(n, F.lit(0)) == 0)).alias("missing"), F.count_if(failed).alias("errors"))


def compare_runs(a: DataFrame, b: DataFrame, keys=("doc_id", "field"), value: str = "value") -> DataFrame:
    """Values of two runs side by side and whether they agree (NULL equals NULL)."""
    left = a.select(*keys, F.col(value).alias("a_value"))
    right = b.select(*keys, F.col(value).alias("b_value"))
    return left.join(right, list(keys), "full_outer").withColumn("same", F.col("a_value").eqNullSafe(F.col("b_value")))


def long_form(records: DataFrame, fields, keys=("doc_id",)) -> DataFrame:
    """Wide records to (key, field, value) rows."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in fields])
    return records.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.field", "r.value")


def review_queue(records: DataFrame, column: str = "Consignee") -> DataFrame:
    """Records whose name should be looked at by a refiner."""
    return records.filter(needs_review(F.col(f"`{column}`")))
