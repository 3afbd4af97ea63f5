"""Chat formatting by perspective rotation.

Built-in functions only.  Every participant of a conversation once takes the assistant's part: their own turns are rendered as
the assistant's and masked in (trained on), the others' turns are rendered as named users and masked out.
Roles in ``context`` (system, tool) are no participants and are rendered as they are, masked out.

A dialogue is rendered in *pieces* of ``piece_turns`` turn numbers, so that no conversation, however
long, has to fit into one row: ``piece`` k holds the turns with ``floor(turn / piece_turns) = k``, and
concatenating the pieces of a perspective in order gives the whole dialogue.  The usual
conversation is one piece.  A piece carries its text and, per segment, start, end and mask in it.

Defined cases: a null text is empty; roles are trimmed, so "ann" and " ann" are one; a null or empty role is the role ``unknown`` and takes part like any
other; a very long text is one turn like any other; null turns come first, in piece 0; equal turns are ordered by role, then text; exact repeats of a row are one turn; rows
with a null conv_id belong to no conversation and are left out; conversations of context roles only have no
perspective; an empty table gives an empty result; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CONTEXT = ("system", "tool")


def _segment(role: Column, mine: Column, context: Column, text: Column) -> tuple[Column, Column]:
    head = F.when(mine, F.lit("<|assistant|>\n")).when(context, F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    return head, F.concat(text, F.lit("<|end|>\n"))


def rotate(turns: DataFrame, context: tuple[str, ...] = CONTEXT, piece_turns: int = 64) -> DataFrame:
    """``conv_id, perspective, piece, n_turns, text, segments``; segments are structs
    ``(turn, role, start, stop, mask)`` in characters of ``text``; a trained segment begins after its header."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.nullif(F.trim(F.col("role").cast("string")), F.lit("")), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    t = t.withColumn("piece", F.coalesce(F.floor(F.col("turn") / piece_turns), F.lit(0)))
    pieces = t.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"), F.collect_set("role").alias("roles"))
    # who takes part is known by conversation, not by piece; one row a conversation and participant
    who = pieces.select("conv_id", F.explode("roles").alias("perspective")).where(~F.col("perspective").isin(*context)).distinct()
    p = pieces.select("conv_id", "piece", "turns").join(who, "conv_id")
    parts = F.transform("turns", lambda x: F.struct(x.turn.alias("turn"), x.role.alias("role"), (x.role == F.col("perspective")).alias("mask"), *[c.alias(n) for c, n in zip(_segment(x.role, x.role == F.col("perspective"), x.role.isin(*context), x.text), ("head", "body"), strict=True)]))
    p = p.withColumn("parts", parts).withColumn("text", F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"])), ""))
    # running offsets: the fold's state is the list so far and the place it ends at
    kind = "array<struct<turn:bigint,role:string,start:int,stop:int,mask:boolean>>"

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["head"])
        stop = start + F.length(x["body"])
        one = F.struct(x["turn"].alias("turn"), x["role"].alias("role"), start.alias("start"), stop.alias("stop"), x["mask"].alias("mask"))
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(one).cast(kind)).alias("out"))

    fold = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda state: state["out"])
    return p.select("conv_id", "perspective", "piece", F.size("turns").cast("long").alias("n_turns"), "text", fold.alias("segments"))


