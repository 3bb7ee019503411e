"""Conversations as training examples: every assistant turn with all turns before it, only its text trainable.

A turn is written ``OPEN role SAY text CLOSE``. In roles and texts every control string gets an escape character
behind its first character, and escape characters are doubled, so nobody's text can open or close a turn, and
what was there can be read back. Beside the template's own three strings those of ``FOREIGN`` are escaped, which
other templates use and a tokenizer may know.

The prefix of an example is built from turns that were escaped once. A conversation whose last turn is not an
assistant's has one more example with all its turns and nothing to train on, so that no turn is lost. All
examples of a conversation together are as long as its turns times its replies; a conversation lies in one row
while they are made, as the digest of all its turns demands.

Defined results: a NULL text or role is empty; turns lie in order of ``turn`` (NULL first), role and text; rows
without a conv_id are one conversation; repeated rows are turns of their own; an empty table gives an empty
result; an empty reply is an example with an empty mask; long texts are kept whole; columns that are not named
stay unread.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bind

OPEN, SAY, CLOSE = "<|turn|>", "<|say|>", "<|end|>"
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\\"
ASSISTANT = "assistant"

CONTROLS = (OPEN, SAY, CLOSE, *FOREIGN)
#: Control strings by their first character, which is what an escape follows.
_RESTS = {first: "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == first) for first in sorted({c[0] for c in CONTROLS})}


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for first, rests in _RESTS.items():
        text = F.regexp_replace(text, f"{re.escape(first)}(?={rests})", first + re.escape(ESCAPE))
    return text


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``: a single escape character only stands inside what was a control string."""
    for first, rests in _RESTS.items():
        text = F.regexp_replace(text, f"{re.escape(first + ESCAPE)}(?={rests})", first)
    return F.replace(text, F.lit(ESCAPE * 2), F.lit(ESCAPE))


def examples(conversations: DataFrame, assistant: str = ASSISTANT) -> DataFrame:
    """conv_id, example (from 1), last (the longest), text, and the trainable characters from ``loss_start`` to ``loss_end``.

    Both are counted in code points from 0, the end exclusive; an example without a reply has neither.
    """
    role, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn").isNotNull().alias("known"), "turn", role.alias("role"), said.alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def written(t: Column) -> Column:
        return F.struct(
            (t["role"] == assistant).alias("reply"), F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(SAY)).alias("head"), escaped(t["text"]).alias("body"))

    pieces = rows.select("conv_id", F.transform("turns", written).alias("pieces"))
    replies = F.filter(F.sequence(F.lit(1), F.size("pieces")), lambda i: F.col("pieces")[i - 1]["reply"])
    tail = F.when(F.element_at("pieces", -1)["reply"], F.array().cast("array<int>")).otherwise(F.array(F.size("pieces")))
    counted = pieces.withColumn("ends", F.concat(replies, tail)).select("conv_id", "pieces", F.size("ends").alias("many"), F.posexplode("ends").alias("nth", "at"))

    here = F.col("pieces")[F.col("at") - 1]
    before = F.array_join(F.transform(F.slice("pieces", 1, F.col("at") - 1), lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    # The prefix is bound to a name, so it is made once for the text and for the place of the mask.
    made = bind(F.concat(before, here["head"]), lambda prefix: F.struct(
        F.concat(prefix, here["body"], F.lit(CLOSE)).alias("text"), F.when(here["reply"], F.char_length(prefix)).alias("start"),
        F.when(here["reply"], F.char_length(prefix) + F.char_length(here["body"])).alias("end")))
    return counted.select(
        "conv_id", (F.col("nth") + 1).alias("example"), (F.col("nth") + 1 == F.col("many")).alias("last"), made.alias("made")).select(
        "conv_id", "example", "last", "made.text", F.col("made.start").cast("long").alias("loss_start"), F.col("made.end").cast("long").alias("loss_end"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    written = F.split(text, re.escape(CLOSE))
    return F.transform(F.slice(written, 1, F.size(written) - 1), lambda t: bind(F.split(t, re.escape(SAY), 2), lambda parts: F.struct(
        unescaped(F.substr(parts[0], F.lit(len(OPEN) + 1))).alias("role"), unescaped(parts[1]).alias("text"))))


def read_back(made: DataFrame) -> DataFrame:
    """What the examples of each conversation say, from their texts and masks alone.

    Each example gives a few numbers, a digest and its own reply, so only these meet per conversation.
    """
    loss = F.when(F.col("loss_start").isNotNull(), unescaped(F.substr("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))))
    lines = bind(read_turns(F.col("text")), lambda turns: F.struct(
        F.size(turns).cast("long").alias("n"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("sha256")))
    read = made.select("conv_id", "example", F.char_length("text").cast("long").alias("chars"), loss.alias("loss"), F.when(F.col("last"), lines).alias("turns"))
    told = read.groupBy("conv_id").agg(
        F.max("turns").alias("turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"))
    trained = F.array_join(F.col("losses.loss"), "")
    return told.select(
        "conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha256").alias("turns_sha256"), F.char_length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def planted(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -1, whose texts hold control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    two = conversations.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), said.alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(two)
