"""Preference formatting of chosen and rejected conversations, in Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


def _same(a: Column, b: Column) -> Column:
    return a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many first turns are equal in role and text (null equals null)."""
    shorter = F.least(F.size(chosen), F.size(rejected))
    equal = F.zip_with(F.slice(chosen, F.lit(1), shorter), F.slice(rejected, F.lit(1), shorter), _same)
    differs = F.array_position(F.transform(equal, lambda e: e.cast("string")), F.lit("false"))
    return F.when(differs > 0, differs.cast("int") - 1).otherwise(shorter)


def render_turn(turn: Column, opening: str, closing: str) -> tuple[Column, Column]:
    """Header and body of one rendered turn; a null role or text is empty."""
    role, text = F.coalesce(turn["role"], F.lit("")), F.coalesce(turn["text"], F.lit(""))
    return F.concat(F.lit(opening), role, F.lit("\n")), F.concat(text, F.lit(closing))


def render(turns: Column, opening: str, closing: str) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(*render_turn(t, opening, closing))), "")


def masks(turns: Column, trained_role: str, opening: str, closing: str) -> Column:
    """array<struct<start, stop>>: the code points of the rendered turns that are trained on, which are the bodies (text
    and closing mark) of the turns of ``trained_role``; headers and all other turns are masked out."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(s: Column, t: Column) -> Column:
        head, body = render_turn(t, opening, closing)
        begin = s["at"] + F.length(head)
        end = begin + F.length(body)
        span = F.array(F.struct(begin.alias("start"), end.alias("stop")))
        return F.struct(end.alias("at"), F.when(t["role"].eqNullSafe(F.lit(trained_role)), F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_preferences(pairs: DataFrame, trained_role: str = "assistant", opening: str = "<|", closing: str = "<|end|>\n",
                       chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """The pairs with prompt_turns, prompt, chosen_text, rejected_text, chosen_mask, rejected_mask instead of the two turn
    arrays (array<struct<role, text>>).

    The longest common turn prefix is rendered once as ``prompt``; what follows on either side is that side's
    completion, and its mask lists the code points trained on. A null array counts as no turns and a null turn, role or text
    as empty; equal conversations have two empty completions, conversations without a common turn an empty prompt.
    Repeated rows stay. All other columns are kept (a column of the result's name is replaced). One row is one pair: the
    work is a projection and needs no shuffle.
    """

    def turns(name: str) -> Column:
        given = F.coalesce(F.col(name).cast(TURNS), F.array().cast(TURNS))
        return F.transform(given, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))

    staged = pairs.withColumns({"_chosen": turns(chosen), "_rejected": turns(rejected)}).withColumn("prompt_turns", common_turns(F.col("_chosen"), F.col("_rejected")))

    def rest(name: str) -> Column:
        return F.slice(name, F.col("prompt_turns") + 1, F.greatest(F.lit(0), F.size(name) - F.col("prompt_turns")))

    out = staged.withColumns({"_prompt": F.slice("_chosen", F.lit(1), F.col("prompt_turns")), "_chosen": rest("_chosen"), "_rejected": rest("_rejected")})
    return out.withColumns({
        "prompt": render(F.col("_prompt"), opening, closing),
        "chosen_text": render(F.col("_chosen"), opening, closing), "rejected_text": render(F.col("_rejected"), opening, closing),
        "chosen_mask": masks(F.col("_chosen"), trained_role, opening, closing),
        "rejected_mask": masks(F.col("_rejected"), trained_role, opening, closing),
    }).drop("_prompt", "_chosen", "_rejected", chosen, rejected)


def gathered(turns: DataFrame) -> DataFrame:
    """conv_id, turns: the rows (conv_id, turn, role, text) of each conversation in order of turn, role, text, nulls first.

    A conversation is one value by definition, as a document is. Rows with a null conv_id belong to no conversation.
    """
    packed = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return (turns.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(packed.alias("rows"))
            .select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns")))


def branched_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, chosen, rejected: a preference pair for every conversation of a table that holds single conversations.

    Conversations 2i and 2i + 1 are partners. The rejected side of a conversation goes its way up to a turn that
    depends on the conv_id and takes its partner's turns from there on; without a partner it just ends there.
    """
    convs = gathered(turns)
    other = convs.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("of"), F.col("turns").alias("theirs"))
    joined = convs.join(other, F.col("conv_id") == F.col("of"), "left")
    cut = F.pmod(F.floor(F.col("conv_id") / 2), F.size("turns") + 1).cast("int")
    tail = F.coalesce(F.slice("theirs", F.col("cut") + 1, F.greatest(F.lit(0), F.size("theirs") - F.col("cut"))), F.array().cast(TURNS))
    return (joined.withColumn("cut", cut)
            .select("conv_id", F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("cut")), tail).alias("rejected")))
