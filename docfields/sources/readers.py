"""Sources: log, rules, mapping, files and page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields import schema
from docfields.operators.lines import to_lines


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", kind=None, **options: str) -> DataFrame:
    """Any Spark source; filters and column lists of later steps are pushed into it."""
    reader = spark.read.format(fmt).options(**options)
    if kind is not None and fmt in ("json", "csv", "parquet", "orc"):
        reader = reader.schema(kind)
    return reader.load(path) if path else reader.load()


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds=None,
              partitions: int = 64, **options: str) -> DataFrame:
    """A database table; with a partition column it is read by many tasks."""
    opts = {"url": url, "dbtable": table, **options}
    if partition_column:
        opts |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
                 "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**opts).load()


def read_log(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return read_table(spark, path, fmt, schema.PROCESSING_LOG, **options)


def read_rules(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Value rules. Order is a matter of the listing (``correct.list_rules``), not of lookup."""
    return read_table(spark, path, fmt, schema.VALUE_RULES, **options)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Mapping files ``client<c>/format<f>_mapping.json`` to rows (client, format, final, raw, ord)."""
    files = spark.read.option("wholetext", "true").text(path.rstrip("/") + "/client*/format*_mapping.json").select(
        F.col("_metadata.file_path").alias("file"), "value")
    pairs = F.from_json("value", "map<string,string>")
    return files.select(
        F.regexp_extract("file", r"client(\d+)/format(\d+)_", 1).try_cast("int").alias("client_id"),
        F.regexp_extract("file", r"client(\d+)/format(\d+)_", 2).try_cast("int").alias("format_id"),
        F.posexplode(F.map_entries(pairs)).alias("ord", "e"),
    ).select("client_id", "format_id", F.col("e.key").alias("final_field"), F.col("e.value").alias("raw_field"), "ord")


def mapping_frame(spark: SparkSession) -> DataFrame:
    """The mappings of all registered packs as a table."""
    from docfields.rules import registered, rule_pack

    rows = [(c, f, final, raw, i) for c, f in registered() if rule_pack(c, f).mapping
            for i, (final, raw) in enumerate(rule_pack(c, f).mapping)]
    return spark.createDataFrame(rows, schema.FIELD_MAPPING)


def with_mapping(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Documents with their mapping entries; a pair without mapping gets an error text."""
    packed = mapping.groupBy("client_id", "format_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "final_field", "raw_field"))).alias("mapping"))
    missing = F.format_string("Mapping config not found: client%d/format%d", F.col("client_id"), F.col("format_id"))
    return docs.join(packed, ["client_id", "format_id"], "left").withColumn(
        "error", F.when(F.col("mapping").isNull(), missing))


def map_long(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """R1 in long form: raw (doc, client, format, raw_field, value) rows to final fields."""
    return mapping.join(values, ["client_id", "format_id", "raw_field"]).select(
        "doc_id", "client_id", "format_id", "final_field", "ord", "value")


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """S3: file bytes. Paths lose their scheme so that they compare with stored paths."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
            .withColumn("path", F.regexp_replace("path", "^file:/*", "/")))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """File names only: the content column is never read."""
    return read_files(spark, path, glob).select("path", "length", "modificationTime")


def read_page_text(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Recognised text, one row per page variant."""
    return read_table(spark, path, fmt, schema.VARIANTS)


def text_lines(variants: DataFrame) -> DataFrame:
    return to_lines(variants, "text", ("doc_id", "page_no", "variant_no"))
