"""Chat formatting by perspective rotation: each participant in turn is the assistant, the others are named users.

A rendered dialogue is kept as one row for each turn, with its place in the whole, so a conversation of any length is never
gathered: the rows of a (conversation, perspective) in order of ``start`` concatenate to the dialogue. Running lengths are
summed over chunks of ``CHUNK`` turns first and over the sums of the chunks then.

A context role (system) takes part in no perspective of its own and is shown as itself in all. The mask covers the text and
closing marker of the assistant's turns.

Markers in texts and names are escaped ('<|' becomes '<\\|', line ends in names blanks), so no text forges a turn.

Defined results: a null role is the speaker "unknown", a null text is empty, a null turn comes first; turns of one number
follow in order of role and text, repeated rows stay repeated; rows without conv_id belong to no conversation and are left
out; a conversation of context roles alone gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = ("system",)
CHUNK = 64
#: The markers of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """Text that can't open or close a turn: '<|' is written '<\\|'."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def shown_name(speaker: Column) -> Column:
    """A name on one line."""
    return F.regexp_replace(escaped(speaker), r"[\r\n]", " ")


def perspectives(turns: DataFrame, context: tuple[str, ...] = CONTEXT, chunk: int = CHUNK) -> DataFrame:
    """conv_id, perspective, turn, speaker, role, rendered, start, end, mask_start, mask_end (characters; null unmasked)."""
    said = turns.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), escaped(F.coalesce("text", F.lit(""))).alias("text")
    )
    people = said.where(~F.col("speaker").isin(*context)).groupBy("conv_id", F.col("speaker").alias("perspective")).agg(F.count("*").alias("turns_taken")).drop("turns_taken")
    mine = F.col("speaker") == F.col("perspective")
    role = F.when(mine, "assistant").when(F.col("speaker").isin(*context), shown_name(F.col("speaker"))).otherwise("user")
    head = F.concat(F.lit(OPEN), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), shown_name(F.col("speaker")))).otherwise(""), F.lit("\n"))
    rows = (
        said.join(people, "conv_id")
        .withColumn("role", role)
        .withColumn("head", head)
        .withColumn("rendered", F.concat("head", "text", F.lit(CLOSE)))
        .withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(1 << 40))))
    )
    key = ["conv_id", "perspective"]
    within = F.sum(F.length("rendered")).over(Window.partitionBy(*key, "chunk").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy(*key, "chunk").agg(F.sum(F.length("rendered")).alias("size"))
    before = sums.select(*key, "chunk", (F.sum("size").over(Window.partitionBy(*key).orderBy("chunk")) - F.col("size")).alias("before"))
    end = F.col("before") + F.col("within")
    placed = rows.withColumn("within", within).join(before, [*key, "chunk"]).withColumn("end", end).withColumn("start", F.col("end") - F.length("rendered"))
    masked = F.col("role") == "assistant"
    return placed.select(
        *key, "turn", "speaker", "role", "rendered", "start", "end",
        F.when(masked, F.col("start") + F.length("head")).alias("mask_start"),
        F.when(masked, F.col("end") - 1).alias("mask_end"),
    )


ORACLE = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '<\|') AS text FROM conversations WHERE conv_id IS NOT NULL
), people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
shown AS (
  SELECT *, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM said JOIN people USING (conv_id)
), headed AS (
  SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || translate(replace(speaker, '<|', '<\|'), chr(10) || chr(13), '  ') ELSE '' END || chr(10) AS head FROM shown
), ended AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered,
    sum(length(head || text || '<|im_end|>' || chr(10))) OVER (PARTITION BY conv_id, perspective ORDER BY turn, speaker, text ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
  FROM headed
)
SELECT conv_id, perspective, turn, speaker, role, rendered, stop - length(rendered) AS start, stop AS "end",
  CASE WHEN role = 'assistant' THEN stop - length(rendered) + length(head) END AS mask_start,
  CASE WHEN role = 'assistant' THEN stop - 1 END AS mask_end
FROM ended
"""
