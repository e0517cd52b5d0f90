"""Multi-party perspective rotation of conversations.

For every participant the dialogue is rendered with that speaker as the assistant, the others as
named users and system turns as they are. Only the assistant's words and end marks are to be learned.
What a speaker wrote can't pass for a turn's mark: "<|" is written "< |" in texts and names, and a
name's line breaks as spaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turns of a conversation that one window sums up; longer conversations are summed stretch by stretch.
STRETCH = 1024


def _harmless(column: str):
    return F.replace(F.col(column), F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame, system: str = "system", unnamed: str = "unknown") -> DataFrame:
    """conv_id, perspective, turn, segment, start, mask_start, mask_end: a row for each turn and participant.

    The rendered dialogue of (conv_id, perspective) is its segments in order of start (code points).
    Characters from mask_start to mask_end (exclusive) are to be learned; both are null in others' turns. A null role
    counts as the speaker `unnamed`, a null text as empty, null conv_ids as one conversation; turns of
    equal number follow by speaker, then text, equal rows each have their segment. A
    conversation of system turns alone has no participant and gives no rows. Other columns are ignored.
    Segments stay apart, so that no conversation, however long, has to fit into one row or task. There are as many rows as
    participants times turns, of each conversation: that is the feature, and grows with the square of a room's size.
    An empty table gives no rows.
    """
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit(unnamed)).alias("speaker"), F.coalesce(_harmless("text"), F.lit("")).alias("text"))
    people = said.where(F.col("speaker") != system).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    rotated = said.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    head = F.when(F.col("speaker") == F.col("perspective"), F.lit("<|im_start|>assistant\n")).when(F.col("speaker") == system, F.lit("<|im_start|>system\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), F.translate(_harmless("speaker"), "\r\n", "  "), F.lit("\n")))
    rendered = rotated.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, "text", F.lit("<|im_end|>\n"))).withColumn("size", F.length("segment"))
    stretched = rendered.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    sums = stretched.groupBy("conv_id", "perspective", "stretch").agg(F.sum("size").alias("chars"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("stretch").alias("s"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv_id", "perspective", "stretch").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = stretched.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(offsets, F.expr("conv_id <=> c and perspective = p and stretch <=> s"))
    start = F.col("before") + F.col("inside")
    mine = F.col("speaker") == F.col("perspective")
    return joined.select("conv_id", "perspective", "turn", "segment", start.alias("start"), F.when(mine, start + F.col("head")).alias("mask_start"), F.when(mine, start + F.col("size") - 1).alias("mask_end"))
