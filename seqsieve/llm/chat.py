"""Multi-party perspective rotation of dialogues.

For every participant the dialogue is rendered with that participant as the assistant and all
others as named users; the mask covers what the assistant says, end marker included. Turns are
first gathered into chunks of CHUNK turn numbers, and a chunk of many rows or long texts into pieces
that a hash of its rows decides, so a dialogue of any length and shape is a series of bounded rows, and
a perspective only joins participants to chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 64
#: A chunk is cut into pieces of about so many rows and code points.
ROWS, POINTS = 256, 4 << 20
#: Copies of a row that are numbered at once.
COPIES = 1 << 16
ASSISTANT, USER, END = "<|assistant|>\n", "<|user:{}|>\n", "<|end|>\n"


def _clean(text: Column) -> Column:
    """Text that cannot be taken for a marker."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, chunk, piece, n_turns, rendered, mask for every participant of every conversation (conv_id, turn, role, text).

    chunk numbers a conversation's blocks of CHUNK turn numbers, from that of turn 0. A chunk of up to
    ROWS rows and POINTS code points is piece 0; a larger one is dealt to pieces 0, 1, .. by a hash of
    turn, role, text and the copy's number. Within a piece turns are ordered by turn, then role, then
    text; rows equal in all four columns are rendered as often as they occur. mask is an array of
    struct(start, end), in code points of `rendered`. A null role is the speaker "" and a null text is
    empty. A row without a conversation or without a turn number has no place among others: it is a
    chunk of its own with a null number, seen by its speaker if conv_id is null, else by all. A turn of
    any length stays whole. Other columns are ignored; an empty table gives an empty table.
    """
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), _clean(F.col("text")).alias("text"))
    # equal rows travel once, then get numbers
    turns = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times"))
    turns = turns.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / COPIES))))
    turns = turns.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("times") - F.col("block") * COPIES))))
    turns = turns.select("conv_id", "turn", "role", "text", (F.col("block") * COPIES + F.col("nth")).alias("copy"))
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    turn = F.struct("turn", "role", "text", "copy")
    one = turns.where(alone).select("conv_id", F.lit(None).cast("long").alias("chunk"), F.lit(0).cast("long").alias("piece"), F.array(turn).alias("turns"), F.col("role").alias("own"))
    rows = turns.where(~alone).withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    large = rows.groupBy("conv_id", "chunk").agg(F.greatest(F.ceil(F.count("*") / ROWS), F.ceil(F.sum(F.length("text")) / POINTS)).alias("pieces")).where("pieces > 1")
    draw = F.conv(F.substring(F.md5(F.concat_ws("\n", "turn", "role", "text", "copy")), 1, 8), 16, 10).cast("long")
    rows = rows.join(large, ["conv_id", "chunk"], "left").withColumn("piece", F.when(F.col("pieces").isNull(), F.lit(0).cast("long")).otherwise(draw % F.col("pieces")))
    chunks = rows.groupBy("conv_id", "chunk", "piece").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    speakers = turns.where("conv_id is not null").groupBy("conv_id", F.col("role").alias("speaker")).agg(F.count("*").alias("n_")).drop("n_")
    shared = chunks.unionByName(one.where("conv_id is not null").drop("own")).join(speakers, "conv_id")
    both = shared.unionByName(one.where("conv_id is null").withColumnRenamed("own", "speaker"))
    user = USER.split("{}")
    parts = F.transform("turns", lambda t: F.struct((t["role"] == F.col("speaker")).alias("own"), F.when(t["role"] == F.col("speaker"), F.lit(ASSISTANT)).otherwise(F.concat(F.lit(user[0]), F.replace(t["role"], F.lit("|>"), F.lit("| >")), F.lit(user[1]))).alias("head"), F.concat(t["text"], F.lit(END)).alias("body")))
    both = both.select("conv_id", "speaker", "chunk", "piece", F.size("turns").cast("long").alias("n_turns"), parts.alias("parts"))
    none = F.array().cast("array<struct<start: int, end: int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["head"])
        end = start + F.length(x["body"])
        return F.struct(end.alias("pos"), F.when(x["own"], F.concat(acc["mask"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["mask"]).alias("mask"))

    mask = F.aggregate("parts", F.struct(F.lit(0).alias("pos"), none.alias("mask")), step, lambda acc: acc["mask"])
    rendered = F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"])), "")
    return both.select("conv_id", "speaker", "chunk", "piece", "n_turns", rendered.alias("rendered"), mask.alias("mask"))
