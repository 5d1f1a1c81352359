"""Multi-party perspective rotation of dialogues (DataFrame functions only).

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users.  The rendering is kept
as one row a turn with its offsets, so that a very long conversation never has
to meet in one value; concatenating ``segment`` by ``position`` gives the whole
rendering, and ``loss_start``/``loss_end`` mark the characters to learn from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taleweave.llm.frames import join_on

NOT_SPEAKERS = ("system", "tool")
BLOCK = 64  # turns that are numbered together in one window


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation, perspective and turn.

    Turns are ordered by turn number (nulls last), role and text; repeated rows
    are turns of their own.  A null role reads as ``unknown`` and is a speaker;
    ``system`` and ``tool`` turns keep their role in every perspective and are
    never a perspective themselves, so a conversation of such turns alone, like
    an empty table, gives no rows.  A null text renders as an empty one.  Rows
    with a null conversation id form one conversation.  Other input columns are
    ignored.

    Numbers and offsets come from sums over blocks of turn numbers, so a
    conversation with a third of all rows is spread over many tasks.
    """
    base = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**62)))
    speakers = base.where(~F.col("speaker").isin(*NOT_SPEAKERS)).select("conv_id", F.col("speaker").alias("perspective")).distinct()

    in_block = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    numbered = base.withColumn("nth", F.row_number().over(in_block) - 1)
    before_blocks = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = base.groupBy("conv_id", "block").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before_blocks), F.lit(0))).drop("n")
    numbered = join_on(numbered, blocks, ["conv_id", "block"]).withColumn("position", (F.col("before") + F.col("nth")).cast("long")).drop("nth", "before")

    wide = join_on(numbered, speakers, ["conv_id"])
    own = F.col("speaker") == F.col("perspective")
    head = (
        F.when(F.col("speaker").isin(*NOT_SPEAKERS), F.concat(F.lit("<|"), F.col("speaker"), F.lit("|>\n")))
        .when(own, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), F.col("speaker"), F.lit("|>\n")))
    )
    tail = "\n<|end|>\n"
    wide = wide.withColumn("head", head).withColumn("segment", F.concat("head", "text", F.lit(tail)))
    length = F.char_length("segment")
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.withColumn("within", F.coalesce(F.sum(length).over(inside), F.lit(0)))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = wide.groupBy("conv_id", "perspective", "block").agg(F.sum(length).alias("chars"))
    sizes = sizes.withColumn("chars_before", F.coalesce(F.sum("chars").over(earlier), F.lit(0))).drop("chars")
    laid = join_on(wide, sizes, ["conv_id", "perspective", "block"]).withColumn("start", (F.col("chars_before") + F.col("within")).cast("long"))
    # the end mark is learned as well, the header never is
    loss = F.when(own, F.col("start") + F.char_length("head"))
    return laid.select(
        "conv_id",
        "perspective",
        "position",
        F.when(F.col("speaker").isin(*NOT_SPEAKERS), F.col("speaker")).when(own, F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
        "speaker",
        "segment",
        "start",
        (F.col("start") + length).cast("long").alias("end"),
        own.cast("int").alias("mask"),
        loss.cast("long").alias("loss_start"),
        F.when(own, F.col("start") + length - 1).cast("long").alias("loss_end"),
    )
