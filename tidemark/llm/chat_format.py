"""Chat formatting by perspective rotation: every participant in turn is the assistant.

The result has a row per (conversation, perspective, turn), so a conversation of any length is
never gathered; its segments in order of turn (nulls last), speaker and segment are the rendered
dialogue, so equal turn numbers have a fixed order too: rows that still tie are alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """Marks inside a text are broken by a space, so that a text can't open or close a segment."""
    for mark in (START, END):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("<|", "< |")))
    return text


def named(role: Column) -> Column:
    """A role as a name in a segment's header: it can't end the header's line, open or close a segment
    or add a field of its own (control characters and '=' become '_')."""
    return F.regexp_replace(escaped(role), r"[\x00-\x1F\x7F\x85\u2028\u2029=]", "_")


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                        role_col: str = "role", text_col: str = "text", system_role: str = "system") -> DataFrame:
    """One row per turn and perspective: conversation, perspective, turn, speaker, role, name, segment,
    loss_mask, mask_start, mask_end.

    Participants are the distinct roles of a conversation but the system role.  For each of them
    its own turns are the assistant's, and loss_mask is true there; the loss covers characters
    [mask_start, mask_end) of the segment (text and end mark).  The others are users with their
    name.  System turns stay system turns, and a conversation of nothing else has no perspective.
    A null role is the participant 'unknown', a null text is empty, null conversation ids are one
    conversation; repeated rows and equal turn numbers are rendered one by one; other columns are
    not read.  Names in headers are made harmless by ``named``; speaker and perspective keep the
    role as it is.
    """
    rows = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"),
                        F.coalesce(F.col(role_col), F.lit("unknown")).alias("_who"),
                        escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    who = (rows.filter(F.col("_who") != system_role)
           .groupBy(F.col("_conv").alias("_of"), F.col("_who").alias("_as")).agg(F.lit(1)).select("_of", "_as"))
    own, system = F.col("_who") == F.col("_as"), F.col("_who") == system_role
    role = F.when(own, F.lit("assistant")).when(system, F.lit("system")).otherwise(F.lit("user"))
    name = F.when(~own & ~system, named(F.col("_who")))
    opening = F.concat(F.lit(START), F.col("role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")),
                       F.lit("\n"))
    return (rows.join(who, F.col("_conv").eqNullSafe(F.col("_of")))
            .select("_conv", "_as", "_turn", "_who", "_text", role.alias("role"), name.alias("name"),
                    own.alias("loss_mask"))
            .select(F.col("_conv").alias(conv_col), F.col("_as").alias("perspective"), F.col("_turn").alias(turn_col),
                    F.col("_who").alias("speaker"), "role", "name",
                    F.concat(opening, "_text", F.lit(END + "\n")).alias("segment"), "loss_mask",
                    F.when(F.col("loss_mask"), F.length(opening)).alias("mask_start"),
                    F.when(F.col("loss_mask"), F.length(opening) + F.length("_text") + len(END)).alias("mask_end")))
