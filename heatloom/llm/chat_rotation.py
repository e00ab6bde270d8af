"""Multi-party perspective rotation: one training example per participant of a dialogue.

Each participant in turn is the assistant; the others are users that carry their
name; speakers of context roles stay what they are and never take a turn as
assistant.  The loss mask covers what the assistant says.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from heatloom.operators.groups import GroupProfile
from heatloom.operators.ordering import running_totals

#: Messages of one example. Longer dialogues give several parts, so no row grows with a dialogue.
PART_TURNS = 512
#: A name for turns without a speaker; such a speaker never is the assistant.
NOBODY = "unknown"


def message_key() -> Column:
    """Hash of (role, content); the length of the role tells a role from the text behind it, "-" no role from an empty one."""
    role = F.coalesce(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role")), F.lit("-:"))
    return F.md5(F.concat(role, F.col("content")).cast("binary"))


def in_parts(said: DataFrame, size: int, profile: GroupProfile | None = None) -> DataFrame:
    """The messages (conv_id, key, turn, role, content) with their ``part`` and place ``pos`` in the conversation, from 0.

    Equal messages are one row with their number while the order is made, so neither a
    conversation nor a repeated message fills a task: long conversations are ordered in
    ranges of turns, turns that many messages share in ranges of the messages' hashes.
    """
    distinct = said.withColumn("hash", message_key()).groupBy("conv_id", "key", "turn", "hash", "role", "content").agg(
        F.count(F.lit(1)).alias("times"))
    placed = running_totals(distinct, "turn", "hash", "times", ("key",), profile, "stop").withColumn("begin", F.col("stop") - F.col("times"))
    part = lambda at: F.floor(at / F.lit(size))
    parts = placed.withColumn("part", F.explode(F.sequence(part(F.col("begin")), part(F.col("stop") - 1))))
    first, last = F.greatest("begin", F.col("part") * size), F.least("stop", (F.col("part") + 1) * size) - 1
    return parts.withColumn("pos", F.explode(F.sequence(first, last))).select("conv_id", "key", "part", "pos", "role", "content")


def rotate_perspectives(
    turns: DataFrame, context_roles: tuple[str, ...] = ("system",), part_turns: int = PART_TURNS, profile: GroupProfile | None = None,
) -> DataFrame:
    """Render (conv_id, turn, role, text) once per conversation and participant.

    Returns conv_id, speaker, part, n_messages, n_own, text, mask_starts, mask_ends:
    the masks are character spans [start, end) of ``text`` that the speaker wrote,
    with the line break behind them.  A message is ``<|assistant|>``,
    ``<|user name=NAME|>`` or ``<|ROLE|>`` (context), a line break, the content and a
    line break.  Part p holds the messages from p * part_turns on, whatever their turn
    numbers are; the participants are those of the whole conversation, and a part
    without a word of the speaker still is rendered (empty masks).  Order: turn (NULL
    counts as 0), then the hash of role and text.
    NULL text is empty, a NULL role is a user named "unknown" that is no
    participant; rows with a NULL conv_id are one conversation; repeated turns stay;
    conversations with context roles alone give nothing.  ``profile``: number of
    conversations and messages of the longest one, if known.
    """
    said = turns.select(
        F.col("conv_id"), F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.col("role"), F.coalesce("text", F.lit("")).alias("content"),
    )
    context = F.col("role").isin(*context_roles)
    people = said.groupBy("key", "role").agg(F.count(F.lit(1)).alias("n"))
    speakers = people.where(F.col("role").isNotNull() & ~context).select("key", F.col("role").alias("speaker"))
    # a speaker meets the messages part by part, so the rows of a long dialogue are spread
    lengths = people.groupBy("key").agg(F.sum("n").alias("n"))
    asked = speakers.join(lengths, "key").select(
        F.col("key").alias("_key"), "speaker", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.lit(part_turns)))).alias("_part"))
    own = F.coalesce(F.col("role") == F.col("speaker"), F.lit(False))
    head = F.when(own, F.lit("<|assistant|>\n")).when(context, F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))).otherwise(
        F.concat(F.lit("<|user name="), F.coalesce("role", F.lit(NOBODY)), F.lit("|>\n")))
    views = (
        in_parts(said, part_turns, profile).join(asked, (F.col("key") == F.col("_key")) & (F.col("part") == F.col("_part")))
        .select("conv_id", "speaker", "part", "pos", "content", own.alias("own"), head.alias("head"))
        .withColumn("width", F.length("head") + F.length("content") + 1)
    )
    order = Window.partitionBy("conv_id", "speaker", "part").orderBy("pos")
    end = F.sum("width").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = views.withColumn("end", end).withColumn("start", F.col("end") - F.length("content") - 1)
    message = F.struct("end", F.concat("head", "content", F.lit("\n")).alias("text"), "start", "own")
    mine = F.filter("m", lambda x: x["own"])
    return (
        placed.groupBy("conv_id", "speaker", "part").agg(F.sort_array(F.collect_list(message)).alias("m"))
        .select("conv_id", "speaker", "part", F.size("m").cast("long").alias("n_messages"), F.size(mine).cast("long").alias("n_own"),
                F.array_join(F.transform("m", lambda x: x["text"]), "").alias("text"),
                F.transform(mine, lambda x: x["start"]).alias("mask_starts"),
                F.transform(mine, lambda x: x["end"]).alias("mask_ends"))
    )
