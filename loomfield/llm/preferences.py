"""Preference formatting (operator 9): the longest common turn prefix of a chosen and a rejected conversation is
rendered once as the prompt; what follows on either side becomes a pair of masked completions.

The result has one row per rendered turn, in sections `prompt`, `chosen` and `rejected`, so that no conversation need
fit one task: turns are compared in one shuffle by (pair, turn), the first difference of a pair is a map-side
partial minimum, and the join back to the turns can be split by adaptive execution. Only assistant turns of
completions are trained on (mask 1). `assembled` joins the sections to strings where rows of whole pairs are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rendered(role: Column, text: Column) -> Column:
    """A turn between markers; a marker inside the role or text loses its bar, so that it can't end the turn."""
    def plain(c: Column) -> Column:
        return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< "))

    return F.concat(F.lit(OPEN), plain(role), F.lit("\n"), plain(text), F.lit(CLOSE + "\n"))


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """Preferences from a table that has none: each conversation up to its last assistant turn is chosen, and the same with the
    conversation's first assistant turn in place of the last one is rejected.

    So the two sides share all turns but the last. With one assistant turn only, the rejected side ends before it; without
    any, the sides are equal. Rows without conv_id or turn are left out, turns after the last assistant turn too. Of several
    rows of the first assistant turn the smallest text counts, null being empty.
    """
    rows = conversations.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    assistant = F.col("role") == "assistant"
    ends = rows.groupBy("conv_id").agg(
        F.max(F.when(assistant, F.col("turn"))).alias("last"), F.min(F.when(assistant, F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("first"))
    joined = rows.join(checkpointed(ends), "conv_id").filter("last IS NULL OR turn <= last")

    def side(name: str, role: Column, text: Column) -> Column:
        return F.struct(F.lit(name).alias("side"), role.alias("role"), text.alias("text"))

    chosen, same, other = side("chosen", F.col("role"), F.col("text")), side("rejected", F.col("role"), F.col("text")), side("rejected", F.lit("assistant"), F.col("first.text"))
    ending = F.when(F.col("first.turn") < F.col("last"), F.array(chosen, other)).otherwise(F.array(chosen))
    return joined.select(F.col("conv_id").alias("pair_id"), "turn", F.explode(F.when(F.col("turn") == F.col("last"), ending).otherwise(F.array(chosen, same))).alias("x")).select("pair_id", "x.side", "turn", "x.role", "x.text")


def id_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs conversation 2k (chosen) with 2k + 1 (rejected)."""
    conv = F.col("conv_id").cast("long")
    half = F.shiftright(conv, 1)
    return conversations.select(
        half.alias("pair_id"),
        F.when(F.pmod(conv, F.lit(2)) == 0, F.lit("chosen")).otherwise(F.lit("rejected")).alias("side"),
        F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )


def format_preferences(sides: DataFrame) -> DataFrame:
    """From (pair_id, side, turn, role, text) to (pair_id, section, turn, role, rendered, mask, n_chars).

    side is `chosen` or `rejected`. Turns are equal if role and text are (nulls equal each other); the prefix ends
    before the first turn that differs or that one side lacks. Rows that repeat a pair, side and turn are one turn,
    the smallest by role and text. Rows without pair_id, side or turn have no place and are left out. A pair
    with one side only has an empty prefix and that side's completion; equal sides have a prompt and no completion.
    """
    turn = F.struct(F.col("role").isNull().alias("no_role"), "role", F.col("text").isNull().alias("no_text"), "text")
    turns = (
        sides.filter(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected") & F.col("turn").isNotNull())
        .groupBy("pair_id", "turn")
        .agg(F.min(F.when(F.col("side") == "chosen", turn)).alias("chosen"), F.min(F.when(F.col("side") == "rejected", turn)).alias("rejected"))
    )
    same = F.col("chosen").isNotNull() & F.col("rejected").isNotNull() & F.col("chosen").eqNullSafe(F.col("rejected"))
    turns = checkpointed(turns.withColumn("same", same))
    parting = turns.filter(~F.col("same")).groupBy("pair_id").agg(F.min("turn").alias("parting"))
    joined = turns.join(checkpointed(parting), "pair_id", "left")
    prompt = F.col("parting").isNull() | (F.col("turn") < F.col("parting"))
    rows = joined.select(
        "pair_id", "turn",
        F.explode(
            F.when(prompt, F.array(F.struct(F.lit("prompt").alias("section"), F.col("chosen").alias("t")))).otherwise(
                F.array(F.struct(F.lit("chosen").alias("section"), F.col("chosen").alias("t")), F.struct(F.lit("rejected").alias("section"), F.col("rejected").alias("t")))
            )
        ).alias("x"),
    ).filter("x.t IS NOT NULL")
    return rows.select(
        "pair_id", F.col("x.section").alias("section"), "turn", F.col("x.t.role").alias("role"),
        rendered(F.col("x.t.role"), F.col("x.t.text")).alias("rendered"),
        F.when((F.col("x.section") != "prompt") & (F.col("x.t.role") == "assistant"), 1).otherwise(0).cast("int").alias("mask"),
    ).withColumn("n_chars", F.char_length("rendered").cast("long"))


def assembled(formatted: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen, rejected, and the masks of the completions' turns in order."""
    def part(name: str, field: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("section") == name, F.struct("turn", field)))), lambda x: x[field])

    return formatted.groupBy("pair_id").agg(
        F.array_join(part("prompt", "rendered"), "").alias("prompt"), F.array_join(part("chosen", "rendered"), "").alias("chosen"),
        F.array_join(part("rejected", "rendered"), "").alias("rejected"),
        part("chosen", "mask").alias("chosen_masks"), part("rejected", "mask").alias("rejected_masks"),
    )
