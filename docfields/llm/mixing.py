"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over block quotas, in Columns only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.common import WORD, kept
from docfields.operators.ordered import running_total

WEIGHTS = (5.0, 2.0, 1.0)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, target from a (source, source_size) table with one row per source.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. A target stops at
    ``most`` times its source's size and the excess goes to the others by weight. That fixed point is found in one
    pass: in ascending order of limit per weight the stopped sources come first, and all others get weight times
    one common level. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    limited = ranked.withColumns({"weight": weight, "limit": (F.col("source_size") * most).cast("double")})
    by_limit = Window.orderBy((F.col("limit") / F.col("weight")).asc(), "place")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    stepped = (limited.withColumns({"level": level, "order": F.row_number().over(by_limit)})
               .withColumn("free", F.col("limit") >= F.col("level") * F.col("weight")))
    first = F.min(F.when(F.col("free"), F.struct("order", "level"))).over(everything)
    return (stepped.withColumn("common", first["level"])
            .select("source", "place", "source_size",
                    F.when(F.col("common").isNull(), F.col("limit"))
                    .otherwise(F.least(F.col("limit"), F.col("common") * F.col("weight"))).alias("target")))


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` of ``population`` blocks are among the ``marked`` ones, by inverse transform of u in [0, 1).

    Weights relative to the mode follow from the ratio of neighbours, walked up and then down; twelve standard
    deviations on either side hold all mass a double can tell from 0.
    """
    zero = F.lit(0).cast("long")
    share = marked / F.greatest(population, F.lit(1).cast("long"))
    given = F.struct(population.alias("n"), marked.alias("m"), drawn.alias("d"), u.alias("u"),
                     F.least(marked, drawn, F.floor((drawn + 1.0) * (marked + 1.0) / (population + 2.0)).cast("long")).alias("mode"),
                     (F.sqrt(drawn * share * (1 - share)) * 12 + 30).cast("long").alias("spread"))

    def bounded(g: Column) -> Column:
        low = F.greatest(zero, g["d"] + g["m"] - g["n"], g["mode"] - g["spread"])
        high = F.least(g["m"], g["d"], g["mode"] + g["spread"])
        return _let(F.struct(g.alias("g"), low.alias("low"), high.alias("high"), F.greatest(low, F.least(high, g["mode"])).alias("mode")), chosen)

    def chosen(b: Column) -> Column:
        g, mode = b["g"], b["mode"]

        def up(w: Column, x: Column) -> Column:
            """weight of x from that of x - 1"""
            return w * ((g["m"] - x + 1.0) * (g["d"] - x + 1.0)) / (x * (g["n"] - g["m"] - g["d"] + x) * 1.0)

        def down(w: Column, x: Column) -> Column:
            """weight of x from that of x + 1"""
            return w * ((x + 1.0) * (g["n"] - g["m"] - g["d"] + x + 1.0)) / ((g["m"] - x) * (g["d"] - x) * 1.0)

        def steps(first: Column, last: Column) -> Column:
            return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

        rising, falling = steps(mode + 1, b["high"]), F.reverse(steps(b["low"], mode - 1))

        def total(xs: Column, ratio) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
            return F.aggregate(xs, start, lambda s, x: _let(ratio(s["w"], x), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"))), lambda s: s["sum"])

        def pick(xs: Column, ratio, state: Column) -> Column:
            return F.aggregate(xs, state, lambda s, x: _let(ratio(s["w"], x), lambda w: F.struct(
                w.alias("w"), (s["sum"] + w).alias("sum"), s["goal"].alias("goal"),
                F.when(s["at"].isNull() & (s["sum"] + w > s["goal"]), x).otherwise(s["at"]).alias("at"))))

        def from_goal(goal: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), goal.alias("goal"), F.when(goal < 1.0, mode).alias("at"))
            return _let(pick(rising, up, start), lambda s: F.coalesce(
                pick(falling, down, F.struct(F.lit(1.0).alias("w"), s["sum"].alias("sum"), s["goal"].alias("goal"), s["at"].alias("at")))["at"], mode))

        return _let(g["u"] * (total(rising, up) + total(falling, down) + 1.0), from_goal)

    return _let(given, bounded)


def split_quotas(quotas: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """place, shard, blocks: each source's blocks dealt to 2**levels shards.

    ``quotas`` has one row (place, blocks) per source. A tree node holds one count per source; its left child takes
    half of all its blocks, and how many of each source follows the multivariate hypergeometric law, drawn source by
    source. Counts stay exact: children sum to their node in every source, and sizes of siblings differ by one at most.
    """
    node = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), F.col("blocks").cast("long").alias("n")))).alias("counts"))
    node = node.withColumn("node", F.lit(1).cast("long"))

    def drawn(counts: Column, key: Column) -> Column:
        everything = F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + c["n"])
        start = _let(everything, lambda n: F.struct(n.alias("population"), F.floor(n / 2).cast("long").alias("draws"),
                                                    F.array().cast("array<struct<place:bigint,n:bigint>>").alias("out")))

        def draw(s: Column, c: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(seed), key, c["place"]), F.lit(2**52)) / float(2**52)
            return _let(hypergeometric(s["population"], c["n"], s["draws"], u), lambda h: F.struct(
                (s["population"] - c["n"]).alias("population"), (s["draws"] - h).alias("draws"),
                F.concat(s["out"], F.array(F.struct(c["place"].alias("place"), h.alias("n")))).alias("out")))

        return F.aggregate(counts, start, draw, lambda s: s["out"])

    for _ in range(levels):
        left = drawn(F.col("counts"), F.col("node"))
        halves = node.select("node", "counts", left.alias("left"))
        right = F.zip_with("counts", "left", lambda c, h: F.struct(c["place"].alias("place"), (c["n"] - h["n"]).alias("n")))
        node = halves.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("counts")))).alias("child")).select("child.*")
    leaf = node.select((F.col("node") - 2**levels).alias("shard"), F.explode("counts").alias("c"))
    return leaf.select(F.col("c.place").alias("place"), "shard", F.col("c.n").alias("blocks"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3, levels: int = 4, block_words: int = 1024,
        seed: int = 0, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and draws, one row per document row.

    ``draws`` is an array of (shard, repeat, place): in its ``repeat``-th pass the whole document goes to ``shard``, at the
    random ``place`` there. ``taken`` is the number of words in all draws. Every source's documents are permuted by a hash
    and read round and round as one stream of words; its target, rounded to whole words, is cut into blocks of
    ``block_words`` (the last may be shorter); shards take disjoint runs of those blocks by the quotas of the splitting
    tree, and a draw belongs to the shard that holds its first word. The document across the end of the target is taken
    if that ends no further from the target than leaving it. So each source's taken words differ from its target by half
    of one document at most, a shard's from its quota by one document at either end, and no document is taken more than
    ``most`` times or in part.

    Null texts and texts without words have size 0 and are never drawn; null sources are a source of their own;
    repeated rows are documents of their own; reruns agree. An empty table gives an empty table. Further
    ``columns`` of the documents can be carried along.

    Only the source table (one row per source) and the tree (one count per source and node) meet in one task. The
    stream positions within a source are running sums over hash ranges of about 4,096 documents each.
    """
    shards = 2**levels
    sized = kept(docs.select("doc_id", "source", *columns, words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
                 .withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                                      F.coalesce(F.col("source"), F.lit(""))).cast("binary"))))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    # one row per source from here on; kept, as the tree and the documents both use it
    plan = kept(targets(sources.select("source", "source_size"), weights, most)
                .join(sources.select(F.col("source").alias("name"), "documents"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
                .withColumn("goal", F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size") * most)))
    blocks = F.ceil(F.col("goal") / block_words).cast("long")
    runs = split_quotas(plan.select("place", blocks.alias("blocks")), levels, seed)
    until = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (runs.withColumn("end", F.sum("blocks").over(until))
            .groupBy("place").agg(F.sort_array(F.collect_list(F.struct("shard", (F.col("end") * block_words).alias("end"), (F.col("blocks") * block_words).alias("words")))).alias("cuts")))
    plan = plan.join(cuts.withColumnRenamed("place", "cut_place"), F.col("place") == F.col("cut_place")).drop("cut_place", "place")
    placed = sized.join(plan.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")

    # the first 13 hexadecimal digits as a fraction give the hash range, which never decreases along the key
    fraction = F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / float(2**52)
    chunk = F.floor(fraction * F.ceil(F.col("documents") / 4096)).cast("long")
    placed = running_total(placed, ["source"], ["key", F.col("doc_id").asc_nulls_first(), "size", "tie"], F.col("size"), chunk, "stop")
    return placed.select("doc_id", "source", "size", "source_size", "target", *columns, "key", "tie", "goal", "cuts", (F.col("stop") - F.col("size")).alias("start")) \
        .withColumn("draws", _draws(most, seed)) \
        .withColumn("taken", F.col("size") * F.size("draws")) \
        .select("doc_id", "source", "size", "source_size", "target", "taken", "draws", *columns)


def _draws(most: int, seed: int) -> Column:
    """The passes that take the document, each with the shard whose blocks hold the draw's first word."""

    def of_pass(r: Column) -> Column:
        at = F.col("start") + r * F.col("source_size")
        shard = F.filter("cuts", lambda c: c["end"] > at)[0]["shard"]
        return F.when((F.col("size") > 0) & ((F.col("goal") - at) * 2 >= F.col("size")), F.struct(
            shard.alias("shard"), r.alias("repeat"), F.xxhash64(F.lit(seed), F.col("key"), F.col("doc_id"), F.col("tie"), r).alias("place")))

    return F.array_compact(F.transform(F.array(*[F.lit(r).cast("long") for r in range(most)]), of_pass))


def shards(mixed: DataFrame, *columns: str) -> DataFrame:
    """doc_id, source, columns, shard, repeat, place: one row per draw."""
    return mixed.select("doc_id", "source", *columns, F.explode("draws").alias("d")).select("doc_id", "source", *columns, "d.*")


def mixed_documents(docs: DataFrame, words_per_slice: int = 4_000_000, **options) -> DataFrame:
    """doc_id, text, lang, source, n_chars: the mix as documents, whole texts only, shard by shard in random order.

    A document drawn n times comes n times. The draws are settled on ids and sizes; texts join them once and are then dealt by
    shard and place. A shard lies in slices of about ``words_per_slice`` words, so a task sorts one slice, not a shard.
    """
    fields = ("doc_id", "text", "lang", "source", "n_chars")
    rows = kept(docs.select(*fields).withColumn("row", F.monotonically_increasing_id()))
    mixed = kept(mix(rows, columns=("row",), **options).filter("taken > 0").select("doc_id", "source", "row", "taken", "draws"))
    slices = max(1, math.ceil((mixed.agg(F.sum("taken")).first()[0] or 0) / 2 ** options.get("levels", 4) / words_per_slice))
    # the place is uniform over the longs, and its slice never decreases along it
    piece = F.floor((F.col("place").cast("double") / 2.0**64 + 0.5) * slices)
    draws = shards(mixed, "row").select(F.col("row").alias("of"), "shard", "place", piece.alias("slice"))
    return (rows.join(draws, F.col("row") == F.col("of")).repartition("shard", "slice")
            .sortWithinPartitions("shard", "slice", "place", "row").select(*fields))
