"""Value rules: exact and similarity correction, dictionaries, rule maintenance.

No side is broadcast on an estimate: rules and names may be many times what their files tell, so these joins are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.operators.fuzzy import best_matches
from docfields.session import cut_lineage, large, spread, written

# --- fixed values ---------------------------------------------------------------------------------
FUZZY_FIELDS = ("Branch", "Source", "Destination", "Consignor", "Consignee")
TRANSFORMED_FIELDS = (
    "Vehicle", "vehicle_number", "vehicle", "Destination", "destination", "Consignee", "consignee", "consignee_name",
)
VALUE_THRESHOLD = 0.80
NAME_THRESHOLD = 0.75
RUN_CELLS, RUN_SHARES, SHARE_ROWS = 1 << 16, 1 << 12, 1_000
# --------------------------------------------------------------------------------------------------


def effective_rules(rules: DataFrame) -> DataFrame:
    """One target per (field, from); the highest id wins where a pair was entered twice."""
    return rules.groupBy(F.col("field_name").alias("field"), "from_value").agg(F.max_by("to_value", "id").alias("to_value"))


def apply_exact_rules(values: DataFrame, rules: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    """Adds ``new_value`` and ``changed``; blank values stay as they are."""
    r = large(effective_rules(rules).select(F.col("field").alias("_field"), F.col("from_value").alias("_from"), "to_value"))
    keyed = _keyed(values, value)
    joined = keyed.join(r, (keyed[field] == r["_field"]) & (keyed["_key"] == r["_from"]), "left")
    hit = F.col("to_value").isNotNull()
    return joined.select(
        *[c for c in values.columns], F.when(hit, F.col("to_value")).otherwise(F.col(value)).alias("new_value"),
        hit.alias("changed"))


def _keyed(rows: DataFrame, value: str) -> DataFrame:
    """``_key``: the value, or for a blank one, which no rule may match, a key that no rule has, dealt by the whole row.

    Blank values are many and would all meet in one task of a shuffled join.
    """
    salt = F.concat(F.lit("\x00blank"), F.pmod(F.xxhash64(*rows.columns), F.lit(997)).cast("string"))
    return rows.withColumn("_key", F.when(F.coalesce(F.col(value), F.lit("")) != "", F.col(value)).otherwise(salt))


def resolve_values(values: DataFrame, rules: DataFrame, threshold: float = VALUE_THRESHOLD,
                   fuzzy_fields=FUZZY_FIELDS, field: str = "field", value: str = "value") -> DataFrame:
    """J1 then J2 on the distinct (field, value) pairs: only changed pairs are returned, with their score."""
    r = large(effective_rules(rules))
    distinct = values.select(F.col(field).alias("field"), F.col(value).alias("_raw")).filter(
        F.coalesce(F.col("_raw"), F.lit("")) != "").distinct()
    # read by the search, by the join of its matches and by the result
    exact = written(distinct.join(r, (distinct["field"] == r["field"]) & (distinct["_raw"] == r["from_value"]), "left").select(
        distinct["field"], "_raw", "to_value"))
    missed = exact.filter(F.col("to_value").isNull() & F.col("field").isin(*fuzzy_fields)).select(
        "field", "_raw", F.lower("_raw").alias("_value"))
    entries = r.filter(F.col("field").isin(*fuzzy_fields) & (F.col("from_value") != "")).select(
        "field", F.lower("from_value").alias("_entry"),
        F.struct("from_value", "to_value").alias("_rank"))
    close = best_matches(missed.select("field", "_value").distinct(), entries, threshold)
    fuzzy = missed.join(large(close), ["field", "_value"]).select(
        "field", "_raw", F.col("_rank.to_value").alias("to_value"), F.col("_score").alias("score"))
    found = exact.filter(F.col("to_value").isNotNull()).withColumn("score", F.lit(1.0)).unionByName(fuzzy)
    return found.select(F.col("field").alias(field), F.col("_raw").alias(value), "to_value", "score")


def apply_fuzzy_rules(values: DataFrame, rules: DataFrame, threshold: float = VALUE_THRESHOLD,
                      fuzzy_fields=FUZZY_FIELDS, field: str = "field", value: str = "value") -> DataFrame:
    """J1 + J2: every row back with ``new_value``, ``changed`` and the score of the rule used."""
    resolved = large(resolve_values(values, rules, threshold, fuzzy_fields, field, value).select(
        F.col(field).alias("_field"), F.col(value).alias("_from"), "to_value", "score"))
    keyed = _keyed(values, value)
    joined = keyed.join(resolved, (keyed[field] == resolved["_field"]) & (keyed["_key"] == resolved["_from"]), "left")
    return joined.select(
        *values.columns, F.coalesce("to_value", value).alias("new_value"),
        F.col("to_value").isNotNull().alias("changed"), "score")


def match_dictionary(values: DataFrame, names: DataFrame, threshold: float = NAME_THRESHOLD, value: str = "value") -> DataFrame:
    """Upper-cased value, its known name when exact or close enough, itself otherwise."""
    keyed = values.withColumn("_value", F.upper(F.trim(F.col(value))))
    known = names.select(F.col("name").alias("_entry"), F.col("ord").alias("ord")).distinct()
    distinct = keyed.select("_value").filter(F.coalesce(F.col("_value"), F.lit("")) != "").distinct()
    missed = distinct.join(large(known), F.col("_value") == F.col("_entry"), "left_anti")
    close = best_matches(
        missed.withColumn("field", F.lit("name")),
        known.select(F.lit("name").alias("field"), "_entry", F.struct("ord", "_entry").alias("_rank")), threshold,
    ).select("_value", F.col("_rank._entry").alias("_match"), F.col("_score").alias("score"))
    return keyed.join(large(close), "_value", "left").select(
        *values.columns, F.when(F.col("_value") != "", F.coalesce("_match", "_value")).alias("matched"), "score")


def transform_records(records: DataFrame, rules: DataFrame, fields=TRANSFORMED_FIELDS, compat: bool = False,
                      threshold: float = VALUE_THRESHOLD) -> DataFrame:
    """Corrected columns plus ``transformed`` and the change list.

    Records stay wide: each present field is one left join with its resolved values (distinct values of that
    column only), so with small resolved sets no row of the record table is shuffled. ``compat=True`` keeps
    lower-case aliases away from the rules of the capitalised field.
    """
    present = [f for f in fields if f in records.columns]
    stack = ", ".join(f"'{f}', `{f}`" for f in present)
    pairs = records.selectExpr(f"stack({len(present)}, {stack}) as (field, value)").filter(
        F.coalesce(F.col("value"), F.lit("")) != "").distinct()
    # every pair tries its own field, lower-case aliases also the capitalised one; all tries are resolved in one go
    tries = F.array(F.struct(F.lit(0).alias("chance"), F.col("field").alias("try")))
    if not compat:
        own = F.initcap(F.regexp_replace(F.col("field"), "_(number|name)$", ""))
        tries = F.when(F.lower("field") == F.col("field"), F.array(
            F.struct(F.lit(0).alias("chance"), F.col("field").alias("try")), F.struct(F.lit(1).alias("chance"), own.alias("try")))).otherwise(tries)
    tried = pairs.select("field", "value", F.explode(tries).alias("t")).select("field", "value", "t.chance", "t.try")
    known = resolve_values(tried.select(F.col("try").alias("field"), "value").distinct(), rules, threshold)
    found = tried.join(large(known.withColumnRenamed("field", "try")), ["try", "value"]).groupBy("field", "value").agg(
        F.min_by("to_value", "chance").alias("to_value"))
    # one join per field reads it: written once to the shared folder
    resolved = cut_lineage(found)
    out = records
    for i, f in enumerate(present):
        side = resolved.filter(F.col("field") == f).select(F.col("value").alias("_from"), F.col("to_value").alias(f"_new{i}"))
        keyed = _keyed(out, f)
        out = keyed.join(side, keyed["_key"] == side["_from"], "left").drop("_key", "_from")
    changes = F.array_compact(F.array(*[
        F.when(F.col(f"_new{i}").isNotNull(), F.struct(
            F.lit(f).alias("field"), F.col(f).alias("from"), F.col(f"_new{i}").alias("to")))
        for i, f in enumerate(present)]))
    return out.withColumn("changes", changes).withColumn("transformed", F.size("changes") > 0).select(
        *[F.coalesce(F.col(f"_new{present.index(c)}"), F.col(c)).alias(c) if c in present else F.col(f"`{c}`")
          for c in records.columns],
        "transformed", "changes")


def apply_rule_changes(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules after creates, updates and deletes; the latest change of an id decides."""
    valid = changes.filter(
        (F.col("op") == "delete")
        | ((F.coalesce(F.trim("field_name"), F.lit("")) != "") & (F.coalesce(F.trim("from_value"), F.lit("")) != "")
           & (F.coalesce(F.trim("to_value"), F.lit("")) != "")))
    latest = valid.groupBy("id").agg(
        F.max_by(F.struct("op", "field_name", "from_value", "to_value", "changed_at"), "changed_at").alias("c"),
        F.max((F.col("op") == "create").cast("int")).alias("made"))
    known = rules.select("id", "created_at").withColumn("_known", F.lit(True))
    upserts = (latest.join(known, "id", "left")
               .filter((F.col("c.op") != "delete") & ((F.col("c.op") == "create") | (F.col("made") == 1) | F.col("_known")))
               .select("id", F.col("c.field_name").alias("field_name"), F.col("c.from_value").alias("from_value"),
                       F.col("c.to_value").alias("to_value"),
                       F.coalesce("created_at", "c.changed_at").alias("created_at"),
                       F.col("c.changed_at").alias("updated_at")))
    return rules.join(latest, "id", "left_anti").unionByName(upserts)


def unknown_rule_changes(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Updates and deletes whose id is neither in the table nor created by an earlier change."""
    made = changes.filter(F.col("op") == "create").select("id")
    return changes.filter(F.col("op") != "create").join(rules.select("id").union(made).distinct(), "id", "left_anti")


def rule_stats(rules: DataFrame) -> DataFrame:
    """Rules per field, with the overall total as a row of its own (NULL field)."""
    per_field = rules.groupBy("field_name").agg(F.count(F.lit(1)).alias("rules"))
    total = per_field.agg(F.lit(None).cast("string").alias("field_name"), F.coalesce(F.sum("rules"), F.lit(0)).alias("rules"))
    return per_field.unionByName(total).orderBy(F.col("field_name").asc_nulls_last())


def rules_version(rules: DataFrame) -> DataFrame:
    """A value that moves whenever a rule is added or edited."""
    return rules.agg(F.max(F.coalesce("updated_at", "created_at")).alias("version"))


def list_rules(rules: DataFrame, field: str | None = None, rule_id: int | None = None) -> DataFrame:
    """T2."""
    out = rules
    if field is not None:
        out = out.filter(F.col("field_name") == field)
    if rule_id is not None:
        out = out.filter(F.col("id") == rule_id)
    return out.orderBy("field_name", "from_value", "id")


def _look_up(runs: DataFrame, places: DataFrame, keys) -> DataFrame:
    """Runs of words with the learned place that each is, by an equi join.

    Some words stand in nearly every address, and all their rows would meet in one task. So runs are counted by the cell of
    their hash. A cell with more than a share is cut, by ``keys``, into as many parts as it has shares, and its places are
    copied to each: all cells together have at most twice RUN_SHARES parts, so few places are copied.
    """
    spark = runs.sparkSession
    cell = F.pmod(F.xxhash64("_run"), F.lit(RUN_CELLS)).alias("_cell")
    counted = runs.groupBy(cell).agg(F.count(F.lit(1)).alias("n")).collect()
    share = max(SHARE_ROWS, sum(r["n"] for r in counted) // RUN_SHARES)
    crowded = F.broadcast(spark.createDataFrame([(r["_cell"], -(-r["n"] // share)) for r in counted if r["n"] > share], "_cell long, _parts long"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = runs.withColumn("_cell", cell).join(crowded, "_cell", "left").withColumn("_part", F.pmod(F.xxhash64(*keys), parts)).drop("_cell", "_parts")
    copied = places.withColumn("_cell", cell).join(crowded, "_cell", "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_cell", "_parts")
    return spread(dealt, "_run", "_part").join(large(copied), ["_run", "_part"]).drop("_part")


def correct_places(addresses: DataFrame, learned: DataFrame, keys=("doc_id",), text: str = "address") -> DataFrame:
    """The lower-cased addresses with every learned place, of one or more words, put right.

    Runs of words, up to as many as the longest learned place has, are looked up in the learned table by an equi join;
    separators do not travel. Where places overlap, the one stored first wins, then the one further left. What a
    correction writes is not looked up again. Of a place learned twice the latest correction counts, at its first place
    in the order. ``keys`` must name one address each.
    """
    known = learned.filter(F.coalesce(F.trim("wrong"), F.lit("")) != "").select(F.lower(F.trim("wrong")).alias("_run"), "correct", "ord")
    most = known.agg(F.max(F.size(F.regexp_extract_all("_run", F.lit(r"(?U)\w+"), F.lit(0))))).first()[0] or 0
    places = known.groupBy("_run").agg(F.lower(F.max_by("correct", "ord")).alias("_right"), F.min("ord").alias("_ord"))
    cut = addresses.select(*keys, F.expr(f"regexp_extract_all(lower(`{text}`), '(?U)\\\\w+|[^\\\\w]+', 0)").alias("_pieces"))
    if not most:
        return cut.select(*keys, F.array_join("_pieces", "").alias(text))

    def runs_from(i: Column) -> Column:
        # n words and the n - 1 separators between them
        longest = F.least(F.lit(most), F.floor((F.size("_pieces") - i + 1) / 2).cast("int"))
        return F.transform(F.sequence(F.lit(1), longest), lambda n: F.struct(
            i.alias("_at"), (2 * n - 1).alias("_size"), F.array_join(F.slice("_pieces", i + 1, 2 * n - 1), "").alias("_run")))

    runs = cut.select(*keys, F.explode(F.flatten(F.transform("_pieces", lambda piece, i: F.when(piece.rlike(r"(?U)^\w"), runs_from(i)).otherwise(
        F.array().cast("array<struct<_at:int,_size:int,_run:string>>"))))).alias("r")).select(*keys, "r.*")
    spans = _look_up(runs, places, keys).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_ord", "_at", "_size", "_right"))).alias("_spans"))
    free = F.aggregate("_spans", F.slice("_spans", F.lit(1), F.lit(0)), lambda kept, s: F.when(
        F.exists(kept, lambda k: (k["_at"] < s["_at"] + s["_size"]) & (s["_at"] < k["_at"] + k["_size"])), kept).otherwise(F.concat(kept, F.array(s))))
    written = F.transform("_pieces", lambda piece, i: F.coalesce(
        F.get(F.transform(F.filter("_kept", lambda k: (k["_at"] <= i) & (i < k["_at"] + k["_size"])),
                          lambda k: F.when(k["_at"] == i, k["_right"]).otherwise(F.lit(""))), 0), piece))
    return (spread(cut, *keys).join(large(spans), list(keys), "left").withColumn("_kept", F.when(F.col("_spans").isNotNull(), free))
            .select(*keys, F.array_join(F.when(F.col("_kept").isNull(), F.col("_pieces")).otherwise(written), "").alias(text)))


def learn_place(learned: DataFrame, wrong: str, correct: str) -> DataFrame:
    """V5: the learned table with one more pair (lower-case key, title-case value)."""
    wrong, correct = (wrong or "").strip().lower(), (correct or "").strip().title()
    if not wrong or not correct:
        return learned
    spark = learned.sparkSession
    added = spark.range(1).select(F.lit(wrong).alias("wrong"), F.lit(correct).alias("correct"), (
        F.unix_micros(F.current_timestamp())).alias("ord"))
    return learned.filter(F.col("wrong") != wrong).unionByName(added)
