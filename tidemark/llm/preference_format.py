"""Format preference pairs: one prompt, and a masked completion for each side, in column expressions only.

A pair is two conversations as arrays of (role, text). Their longest common turn prefix is rendered
once as the prompt; what remains of either side is rendered as its completion, with the stretches the
loss may see (the assistant's own words and the end mark behind them) as character spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import pick

#: The chat template: a head naming the role, the text, and an end mark.
HEAD, NECK, END = "<|", "|>\n", "<|end|>\n"
TURN = "struct<role:string,text:string>"


def common_turns(a: Column, b: Column) -> Column:
    """Number of equal turns at the start of both."""
    shortest = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, shortest), F.slice(b, 1, shortest), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(shortest).cast("int")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(NECK), t["text"], F.lit(END))), "")


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """(start, end) of the role's text and end mark in ``render(turns)``; the end is exclusive."""
    head, tail = len(HEAD) + len(NECK), len(END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        begin = state["at"] + head + F.length(turn["role"])
        stop = begin + F.length(turn["text"]) + tail
        span = F.array(F.struct(begin.alias("start"), stop.alias("end")))
        return F.struct(stop.alias("at"), F.when(turn["role"] == role, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda state: state["spans"])


def conversations(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv_id, turns): turns in order; a null place comes last, ties go by role and text, repeats stay.

    Null roles and texts count as empty. Rows without conversation id belong to none and are left out.
    """
    rows = pick(turns, conv_id=id_column, turn=turn_column, role=role_column, text=text_column).where("conv_id is not null")
    turn = F.struct(F.col("turn").isNull().alias("last"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return gathered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans from (pair_id, chosen, rejected).

    A null or empty side has no turns, so its completion is empty. Equal sides have everything in the
    prompt and two empty completions. Repeated pairs are formatted as often as given.
    """
    none = F.array().cast(f"array<{TURN}>")
    sides = pairs.select("pair_id", F.coalesce(F.col("chosen").cast(f"array<{TURN}>"), none).alias("a"), F.coalesce(F.col("rejected").cast(f"array<{TURN}>"), none).alias("b"))
    cut = sides.withColumn("n_common", common_turns(F.col("a"), F.col("b")))

    def rest(side: str) -> Column:
        return F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))

    parts = cut.select("pair_id", "n_common", F.slice("a", 1, F.col("n_common")).alias("shared"), rest("a").alias("a"), rest("b").alias("b"))
    return parts.select(
        "pair_id", "n_common", render(F.col("shared")).alias("prompt"), render(F.col("a")).alias("chosen"), render(F.col("b")).alias("rejected"),
        loss_spans(F.col("a")).alias("chosen_spans"), loss_spans(F.col("b")).alias("rejected_spans"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs for tables without rejected answers: each conversation is chosen, and rejected is the same
    one with its last assistant turn, and all behind it, replaced by that of the next conversation id.

    A conversation without assistant turn is paired with its empty self; where the next id is missing
    or has no assistant turn, the rejected side just ends before the answer.
    """
    talks = conversations(turns).withColumn("answer", F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"]), "assistant") + 1)
    has = F.col("answer") <= F.size("turns")
    own = talks.select("conv_id", "turns", F.when(has, F.col("answer")).alias("answer"))
    other = own.select((F.col("conv_id") - 1).alias("conv_id"), F.when(F.col("answer").isNotNull(), F.element_at("turns", F.col("answer").cast("int"))).alias("instead"))
    head = F.slice("turns", 1, (F.coalesce("answer", F.lit(1)) - 1).cast("int"))
    rejected = F.when(F.col("instead").isNotNull(), F.concat(head, F.array("instead"))).otherwise(head)
    return own.join(other, "conv_id", "left").select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))
