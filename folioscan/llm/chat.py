"""Multi-party dialogues from every participant's side.

For each participant of a conversation the whole dialogue is rendered with that speaker as the assistant, all others
as named users, and system turns as they are. A row is one rendered turn of one perspective, with its place and its
span of characters in the perspective's dialogue (the turns' texts, joined in order) and the span that is trained
on: the text and end mark of the assistant's own turns. Marks in texts and names are escaped (`<|` becomes `<||`, and
back), so no turn can end itself or begin another.

No dialogue is ever gathered. Rows are dealt by ranges of their order and numbered, and BLOCK rows in a row are a block, so
neither long dialogues nor many turns without a number or of the same number come into one task; only turns that are
equal in number, speaker and their first PREFIX characters, and longer, stay together. Places and spans are running
sums, first over blocks, by lengths only, one row a block and speaker; then inside a block.

Turns are ordered by number (null first), then speaker, then text; equal rows are turns of their own. A null text is
empty, a null speaker is called `unknown`, a null conversation id is one conversation; conversations of system turns
alone have no participant and give no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bits of a block's rows, and characters of a text that rows are dealt by.
BLOCK_BITS, PREFIX = 8, 256
SYSTEM, END = "system", "<|end|>\n"


def escaped(c) -> Column:
    """Texts without the beginning of a mark; replacing `<||` by `<|` gives them back."""
    return F.replace(c, F.lit("<|"), F.lit("<||"))


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, perspective, turn, place, rendered, start, end, train_start, train_end) of all perspectives. Ends are
    exclusive; train_start equals train_end where nothing is trained on."""
    said = turns.select(
        F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("raw"),
    )
    said = said.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    order = ["key", F.asc_nulls_first("turn"), "speaker"]
    tie = F.when(F.length("raw") <= PREFIX, F.col("read")).otherwise(0)
    dealt = said.withColumn("read", F.monotonically_increasing_id()).repartitionByRange(*order, F.substring("raw", 1, PREFIX), tie).sortWithinPartitions(*order, "raw")
    said = dealt.drop("read").withColumn("at", F.monotonically_increasing_id()).withColumn("said", escaped(F.col("raw"))).withColumn("named", escaped(F.col("speaker"))).drop("raw")
    said = stored(said, "turns").withColumn("block", F.shiftright("at", BLOCK_BITS))

    def head(perspective: Column) -> Column:
        own = F.col("speaker") == perspective
        return F.when(own, "<|assistant|>\n").when(F.col("speaker") == SYSTEM, "<|system|>\n").otherwise(F.concat(F.lit("<|user|>\n"), "named", F.lit(": ")))

    parts = said.groupBy("key", "block", "speaker", "named").agg(F.count("*").alias("n"), F.sum(F.length("said")).alias("chars"))
    sides = parts.filter(F.col("speaker") != SYSTEM).select("key", F.col("speaker").alias("perspective")).distinct()
    sizes = parts.join(sides, "key").groupBy("key", "perspective", "block").agg(F.sum("n").alias("n"), F.sum(F.col("chars") + F.col("n") * (F.length(head(F.col("perspective"))) + len(END))).alias("chars"))
    before = Window.partitionBy("key", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("key", "block", F.struct("perspective", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("place"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("start")).alias("side"))
    starts = starts.groupBy("key", "block").agg(F.collect_list("side").alias("sides"))  # as many as a conversation has speakers
    rows = said.join(starts, ["key", "block"]).withColumn("side", F.explode("sides")).select("key", "block", "at", "conv_id", "turn", "speaker", "named", "said", "side.*")
    rows = rows.withColumn("head", head(F.col("perspective"))).withColumn("rendered", F.concat("head", "said", F.lit(END)))
    inside = Window.partitionBy("key", "block", "perspective").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.col("place") + F.count("*").over(inside)).withColumn("start", F.col("start") + F.coalesce(F.sum(F.length("rendered")).over(inside), F.lit(0)))
    end = F.col("start") + F.length("rendered")
    own = F.col("speaker") == F.col("perspective")
    return rows.select(
        "conv_id", "perspective", "turn", "place", "rendered", "start", end.alias("end"), F.when(own, F.col("start") + F.length("head")).otherwise(end).alias("train_start"), end.alias("train_end"),
    )


ORACLE = """
    WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said FROM conversations),
    sides AS (SELECT DISTINCT conv_id AS side_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
    parts AS (SELECT *, CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) WHEN speaker = 'system' THEN '<|system|>' || chr(10)
                     ELSE '<|user|>' || chr(10) || replace(speaker, '<|', '<||') || ': ' END AS head FROM said JOIN sides ON conv_id IS NOT DISTINCT FROM side_id),
    whole AS (SELECT *, head || replace(said, '<|', '<||') || '<|end|>' || chr(10) AS rendered FROM parts),
    placed AS (SELECT *, row_number() OVER w - 1 AS place, CAST(sum(length(rendered)) OVER w AS BIGINT) AS e FROM whole
               WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, perspective, turn, place, rendered, e - length(rendered) AS start, e AS "end",
           CASE WHEN speaker = perspective THEN e - length(rendered) + length(head) ELSE e END AS train_start, e AS train_end FROM placed"""
