"""Word boxes: rows, bands, split words, anchors and boxes around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docfields.functions.address import DELIVERY_HEADER, RECIPIENT_HEADER
from docfields.session import large, spread

# --- fixed values ---------------------------------------------------------------------------------
ROW_BUCKET = 8
BAND_TOLERANCE = 20
DEFAULT_CHAR_WIDTH = 6.0
JOIN_GAP_RATIO = 0.4
HEADER_BEFORE, HEADER_AFTER = 10, 11
NOT_A_HEADER = r"(?i)Delivery\s*Challan|Original\s*for\s*Consignee"
# label, side of the box relative to the label: (left edge from, offset, right edge from, offset)
WEIGHT_ANCHORS = (
    ("rate", r"rate|(?=.*per)(?=.*mt)|(?=.*er)(?=.*mt)", ("left", -230, "left", -5)),
    ("packing", r"packing|cking", ("right", 5, "right", 155)),
    ("amount", r"^(?!.*net).*amount", ("left", -750, "left", -350)),
    ("hsn", r"hsn", ("left", 400, "left", 800)),
)
BOX_BELOW = (5, 105)
GC_BOX = (-30, 700, -60, 80)
# --------------------------------------------------------------------------------------------------

PAGE = ("doc_id", "page_no")


def right(df_col=F.col) -> Column:
    return df_col("left") + df_col("w")


def median_char_width(words: DataFrame, keys=PAGE) -> DataFrame:
    """Median box width per character; the default stands in where a crop has no words with text."""
    widths = F.col("w") / F.greatest(F.length("text"), F.lit(1))
    # a page has few different widths: they are counted in a plain hash aggregation, and only their counts are sorted
    counted = words.filter(F.length("text") > 0).groupBy(*keys, widths.alias("_width")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(
        F.coalesce(F.percentile("_width", 0.5, F.col("_n")), F.lit(DEFAULT_CHAR_WIDTH)).alias("char_width"))


def line_rollup(words: DataFrame, keys=PAGE, bucket: Column | None = None) -> DataFrame:
    """Words of one row bucket joined left to right."""
    row = F.floor(F.col("top") / ROW_BUCKET) if bucket is None else bucket
    ordered = F.array_sort(F.collect_list(F.struct("left", "word_no", "text")))
    return (words.withColumn("row_no", row).groupBy(*keys, "row_no")
            .agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("line")))


def band_rows(words: DataFrame, tolerance: int = BAND_TOLERANCE, keys=PAGE, span: int = 4096, whole_pages: bool = False) -> DataFrame:
    """Adds ``band`` (its head's top): a word joins while it is within the tolerance of the band's first top.

    Banding depends only on the distinct tops of a page and is sequential along them, but the state entering any
    stretch of the page is small: the current head is one of the ``tolerance`` tops just above the stretch, or none.
    So each stretch of ``span`` units is reduced, in parallel, to a table entering head -> leaving head; these
    tables are chained per page, and each stretch is then banded with its known entering head. A task sees at most
    ``span`` distinct tops, a page's chain one row per stretch.

    Words and bands are one table, shuffled once and dealt by stretches; with ``whole_pages`` by pages, for steps that go on
    with whole pages and then need no other shuffle.
    """
    keys = list(keys)
    tops = words.select(*keys, "top").distinct().withColumn("_part", F.floor(F.col("top") / span))
    parts = tops.groupBy(*keys, "_part").agg(F.array_sort(F.collect_list("top")).alias("_tops"))

    def walk(head: Column) -> Column:
        return F.aggregate(F.col("_tops"), head, lambda h, t: F.when(h.isNull() | (t > h + tolerance), t).otherwise(h))

    first = F.col("_part") * span
    # position 0: no open band; position k: an open band whose head is k units above the stretch
    leaving = F.transform(F.sequence(F.lit(0), F.lit(tolerance)), lambda k: walk(
        F.when(k > 0, (first - k).cast("int"))))
    tables = parts.select(*keys, "_part", leaving.alias("_leaving"))
    chained = tables.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_part", "_leaving"))).alias("_chain"))
    start = F.struct(F.lit(None).cast("int").alias("head"), F.array().cast("array<int>").alias("heads"))

    def follow(acc: Column, part: Column) -> Column:
        gap = (part["_part"] * span - acc["head"]).cast("int")
        at = F.when(gap.isNotNull() & (gap <= tolerance), gap).otherwise(0)
        leave = F.get(part["_leaving"], at)
        return F.struct(leave.alias("head"), F.concat(acc["heads"], F.array(acc["head"])).alias("heads"))

    heads = chained.select(*keys, F.explode(F.arrays_zip(
        F.col("_chain._part").alias("_part"),
        F.aggregate("_chain", start, follow)["heads"].alias("_entering"))).alias("p")).select(
        *keys, F.col("p._part").alias("_part"), F.col("p._entering").alias("_entering"))
    step = F.struct(F.col("_entering").alias("head"), F.array().cast("array<struct<top:int,band:int>>").alias("out"))

    def place(acc: Column, t: Column) -> Column:
        head = F.when(acc["head"].isNull() | (t > acc["head"] + tolerance), t).otherwise(acc["head"])
        return F.struct(head.alias("head"), F.concat(
            acc["out"], F.array(F.struct(t.alias("top"), head.alias("band")))).alias("out"))

    banded = (parts.join(large(heads), [*keys, "_part"])
              .select(*keys, F.explode(F.aggregate("_tops", step, place)["out"]).alias("b"))
              .select(*keys, F.col("b.top").alias("top"), F.col("b.band").alias("band")))
    dealt = keys if whole_pages else [*keys, "_part"]
    rows = words.select(*words.columns, F.lit(True).alias("_is_word")).unionByName(banded.withColumn("_is_word", F.lit(False)), allowMissingColumns=True)
    rows = spread(rows.withColumn("_part", F.floor(F.col("top") / span)), *dealt)
    of_top = F.max("band").over(W.partitionBy(*keys, "_part", "top"))
    return rows.withColumn("band", of_top).filter(F.col("_is_word") & F.col("band").isNotNull()).select(*words.columns, "band")


def reading_order(words: DataFrame, keys=PAGE, tolerance: int = BAND_TOLERANCE) -> DataFrame:
    """Words numbered in reading order (band, then left) within their page.

    Words are shuffled once, by page; a page's words are sorted, on disk where they must, and counted one after the other.
    """
    banded = band_rows(words, tolerance, keys, whole_pages=True)
    return banded.withColumn("read_no", F.row_number().over(W.partitionBy(*keys).orderBy("band", "left", "word_no")).cast("long"))


def join_split_words(words: DataFrame, keys=PAGE, widths: DataFrame | None = None) -> DataFrame:
    """Tokens of a row after words with a tiny gap are glued together."""
    widths = median_char_width(words, keys) if widths is None else widths
    row = [*keys, "row_no"]
    rows = words.withColumn("row_no", F.floor(F.col("top") / ROW_BUCKET)).join(large(widths), list(keys), "left")
    order = W.partitionBy(*row).orderBy("left", "word_no")
    gap = F.col("left") - F.lag(right()).over(order)
    limit = F.greatest(F.lit(1.0), F.coalesce("char_width", F.lit(DEFAULT_CHAR_WIDTH)) * JOIN_GAP_RATIO)
    apart = F.when(gap <= limit, 0).otherwise(1)
    islands = rows.withColumn("_apart", apart).withColumn(
        "token_no", F.sum("_apart").over(order.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("left", "word_no", "text")))
    return islands.groupBy(*row, "token_no").agg(
        F.array_join(F.transform(parts, lambda s: s["text"]), "").alias("text"),
        F.min("left").alias("left"), F.max(right()).alias("right"))


def context_of(ordered: DataFrame, keys=PAGE, before: int = HEADER_BEFORE, after: int = HEADER_AFTER, block: int = 1024) -> DataFrame:
    """Words with the text of their neighbours in reading order.

    Windows run over blocks of the page; the few words around a block border are copied to both blocks, so a huge
    page is many tasks and every context is still complete.
    """
    home = F.floor(F.col("read_no") / block)
    reach = F.array_distinct(F.array(
        home, F.floor((F.col("read_no") - after) / block), F.floor((F.col("read_no") + before) / block)))
    copied = ordered.withColumn("_home", home).withColumn("_block", F.explode(reach))
    span = W.partitionBy(*keys, "_block").orderBy("read_no").rowsBetween(-before, after)
    return (copied.withColumn("context", F.array_join(F.collect_list("text").over(span), " "))
            .filter(F.col("_block") == F.col("_home")).drop("_block", "_home"))


def header_score(words: DataFrame, pattern: str = DELIVERY_HEADER, keys=PAGE) -> DataFrame:
    """The best header word of the right half per page, with its score."""
    return _best_header(words, [pattern], keys).drop("_kind")


def _best_header(words: DataFrame, patterns: list[str], keys) -> DataFrame:
    """Header words of the first pattern a page has; contexts are built once for all patterns."""
    kind = F.coalesce(*[F.when(F.col("context").rlike(p), i) for i, p in enumerate(patterns)])
    # words in reading order lie by pages already, so neither the width nor the context shuffles them again
    ordered = reading_order(words, keys).withColumn("_width", F.max(right()).over(W.partitionBy(*keys)))
    scored = context_of(ordered, keys).filter(
        (F.col("left") >= F.col("_width") * 0.5) & ~F.col("context").rlike(NOT_A_HEADER)
    ).withColumn("_kind", kind).filter(F.col("_kind").isNotNull())
    score = (
        F.when(F.contains("context", F.lit("Address")), 10).otherwise(0)
        + F.when(F.contains("context", F.lit("Name")), 5).otherwise(0)
        + F.when(F.col("left") > F.col("_width") * 0.55, 30).when(F.col("left") > F.col("_width") * 0.5, 10).otherwise(0)
        + F.when(F.col("top") < 800, 20).otherwise(0))
    kept = ["word_no", "text", "left", "top", "w", "h"]
    best = F.min_by(F.struct(*kept, "_score", "_kind"), F.struct("_kind", (-F.col("_score")).alias("s"), F.col("read_no")))
    return (scored.withColumn("_score", score).groupBy(*keys).agg(best.alias("b"))
            .select(*keys, *[F.col(f"b.{c}").alias(c) for c in (*kept, "_kind")], F.col("b._score").alias("score")))


def delivery_header(words: DataFrame, keys=PAGE) -> DataFrame:
    """A delivery header, else a recipient header, per page."""
    found = _best_header(words, [DELIVERY_HEADER, RECIPIENT_HEADER], keys)
    return found.withColumn("kind", F.when(F.col("_kind") == 0, "delivery").otherwise("recipient")).drop("_kind")


def row_extent(words: DataFrame, headers: DataFrame, keys=PAGE) -> DataFrame:
    """Header box grown right and down over the words of its row that are not left of it."""
    h = headers.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("left", "top", "w", "h")])
    reach = F.greatest(F.lit(6), F.floor(F.col("_h") / 2))
    near = words.join(large(h), list(keys)).filter(
        (F.abs(F.col("top") - F.col("_top")) <= reach) & (F.col("left") >= F.col("_left")))
    grown = near.groupBy(*keys).agg(F.max(right()).alias("_r"), F.max(F.col("top") + F.col("h")).alias("_b"))
    return h.join(large(grown), list(keys), "left").select(
        *keys, F.col("_left").alias("left"), F.col("_top").alias("top"),
        F.greatest(F.col("_left") + F.col("_w"), "_r").alias("right"),
        F.greatest(F.col("_top") + F.col("_h"), "_b").alias("bottom"))


def nearest_anchor(words: DataFrame, first: Column, second: Column, keys=PAGE, dy: int = 15, dx: int = 100) -> DataFrame:
    """Per page the closest (first word, second word) pair on one row, the second to the right.

    A range join turned into groups of grid cells: the first word's right end names its cell, the second word is copied to the
    cells it can be reached from. Equal boxes are one candidate, so a cell holds at most dy * dx different boxes per side.
    Only flagged words are shuffled, once and by page; they are copied to cells after that.
    """
    keys = list(keys)

    def box(flag: Column, is_first: bool, x: Column) -> Column:
        return F.when(flag, F.struct(F.lit(is_first).alias("_first"), F.col("top").alias("_top"), x.alias("_x"), "word_no"))

    # one column names the page: of several, one that is the same for all rows would not be known as dealt by
    page, both = F.struct(*keys).alias("_page"), F.array_compact(F.array(box(first, True, right()), box(second, False, F.col("left"))))
    flagged = words.dropna(subset=keys).select(page, F.explode(both).alias("_b")).select("_page", "_b.*")
    boxes = spread(flagged, "_page").groupBy("_page", "_first", "_top", "_x").agg(F.min("word_no").alias("_no"))
    gy, gx = F.floor(F.col("_top") / dy), F.floor(F.col("_x") / dx)

    def cell(y: Column, x: Column) -> Column:
        return F.struct(y.alias("_gy"), x.alias("_gx"))

    cells = F.when(F.col("_first"), F.array(cell(gy, gx))).otherwise(F.array(*[cell(gy + y, gx + x) for y in (-1, 0, 1) for x in (-1, 0)]))
    placed = boxes.withColumn("_cell", F.explode(cells))
    point = F.struct(F.col("_top").alias("y"), F.col("_x").alias("x"), F.col("_no").alias("n"))
    met = placed.groupBy("_page", "_cell").agg(
        F.collect_list(F.when(F.col("_first"), point)).alias("_as"), F.collect_list(F.when(~F.col("_first"), point)).alias("_bs")).filter(
        (F.size("_as") > 0) & (F.size("_bs") > 0))

    def nearest(a: Column) -> Column:
        def near(b: Column) -> Column:
            y, x = F.abs(a["y"] - b["y"]), b["x"] - a["x"]
            return F.when((y < dy) & (x > 0) & (x < dx), F.struct((x + y).alias("distance"), a["n"].alias("a_word_no"), b["n"].alias("b_word_no")))

        return F.array_min(F.transform("_bs", near))

    best = F.min(F.array_min(F.transform("_as", nearest)))
    return (met.groupBy("_page").agg(best.alias("m")).filter(F.col("m").isNotNull())
            .select(*[F.col("_page")[k].alias(k) for k in keys], "m.a_word_no", "m.b_word_no", "m.distance"))


def words_in_box(words: DataFrame, boxes: DataFrame, keys=PAGE) -> DataFrame:
    """Text of the words whose left top corner lies in a box, top to bottom and left to right."""
    inside = words.join(large(boxes), list(keys)).filter(
        F.col("left").between(F.col("x1"), F.col("x2")) & F.col("top").between(F.col("y1"), F.col("y2")))
    ordered = F.array_sort(F.collect_list(F.struct("top", "left", "word_no", "text")))
    return inside.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("box_text"))


def weight_box(words: DataFrame, keys=PAGE) -> DataFrame:
    """The box under and beside the first Rate, Packing or Amount label (HSN only without any of them)."""
    label = F.lower(F.trim("text"))
    kind = None
    for i, (_, pattern, _) in enumerate(WEIGHT_ANCHORS):
        kind = (F.when(label.rlike(pattern), i) if kind is None else kind.when(label.rlike(pattern), i))
    labels = words.withColumn("_kind", kind).filter(F.col("_kind").isNotNull())
    last = len(WEIGHT_ANCHORS) - 1
    # reading order for the first three; among HSN labels the last one counts
    order = F.struct((F.col("_kind") == last).alias("weak"),
                     F.when(F.col("_kind") == last, -F.col("word_no")).otherwise(F.col("word_no")).alias("at"))
    chosen = labels.groupBy(*keys).agg(F.min_by(F.struct("_kind", "left", "top", "w", "h"), order).alias("a"))

    def edge(side: int) -> Column:
        out = None
        for i, (_, _, box) in enumerate(WEIGHT_ANCHORS):
            base = F.col("a.left") if box[2 * side] == "left" else F.col("a.left") + F.col("a.w")
            value = F.greatest(base + box[2 * side + 1], F.lit(0))
            out = F.when(F.col("a._kind") == i, value) if out is None else out.when(F.col("a._kind") == i, value)
        return out

    below = F.col("a.top") + F.col("a.h")
    return chosen.select(*keys, edge(0).alias("x1"), edge(1).alias("x2"),
                         (below + BOX_BELOW[0]).alias("y1"), (below + BOX_BELOW[1]).alias("y2"))


def gc_box(words: DataFrame, label_pattern: str, keys=PAGE) -> DataFrame:
    """The number box of the first consignment-note label."""
    labels = words.filter(F.upper(F.trim("text")).rlike(label_pattern))
    chosen = labels.groupBy(*keys).agg(F.min_by(F.struct("left", "top", "w", "h"), "word_no").alias("a"))
    end = F.col("a.left") + F.col("a.w")
    return chosen.select(
        *keys, F.greatest(end + GC_BOX[0], F.lit(0)).alias("x1"), (end + GC_BOX[1]).alias("x2"),
        F.greatest(F.col("a.top") + GC_BOX[2], F.lit(0)).alias("y1"),
        (F.col("a.top") + F.col("a.h") + GC_BOX[3]).alias("y2"))


def respace_initials(words: DataFrame, chars: DataFrame, keys=PAGE) -> DataFrame:
    """two or three capitals are spaced out when the mean gap between their boxes exceeds half a width.

    Words and their characters are one table, dealt by the word and sorted once. The count of tasks is explicit: such boxes
    are so alike that a shuffle packs them to a few bytes, by which adaptive execution would merge them to too few tasks.
    """
    word = [*keys, "word_no"]
    boxes = chars.dropna(subset=word).select(*word, F.lit(True).alias("_is_char"), "char_no", "x1", "x2")
    rows = spread(words.select(*word, F.lit(False).alias("_is_char"), F.struct("*").alias("_word")).unionByName(boxes, allowMissingColumns=True), *word)
    whole = W.partitionBy(*word)
    following, text = F.lead("x1").over(whole.orderBy("_is_char", "char_no")), F.col("_word.text")
    gap = F.when(F.col("_is_char") & following.isNotNull(), F.coalesce((following - F.col("x2")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0)), F.lit(0.0)))
    scored = rows.withColumn("_gap", gap).withColumn("_apart", F.max(text.rlike("^[A-Z]{2,3}$")).over(whole) & (F.avg("_gap").over(whole) > 0.5))
    spaced = F.when(F.col("_apart"), F.trim(F.regexp_replace(text, "(.)", "$1 "))).otherwise(text)
    return scored.filter(~F.col("_is_char")).select(
        *[spaced.alias(c) if c == "text" else F.col(f"_word.`{c}`").alias(c) for c in [*word, *(c for c in words.columns if c not in word)]])
