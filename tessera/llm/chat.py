"""Chat formatting from every participant's perspective.  DataFrame operations only.

A dialogue is rendered once for each of its speakers: that speaker's turns are the
assistant's, other speakers are named users, system turns stay.  The result has one
row for each turn and perspective, with its text and its place in the whole
rendering, and masks for the characters that training should predict.  Rows of a
dialogue in order give the rendering; no task has to hold a dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
PART = 64  # turn numbers of a part: places are summed in parts, then over the parts
#: The markers of a turn (fixed values of the ChatML format).
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What stands for a marker inside a text or a name, where it must not begin or end a turn.
PLAIN = {"<|im_start|>": "<im_start>", "<|im_end|>": "<im_end>"}
CLOSE_MASKED = len(CLOSE) - 1  # the closing marker is predicted, its line break is not


def _plain(text: Column) -> Column:
    for marker, plain in PLAIN.items():
        text = F.replace(text, F.lit(marker), F.lit(plain))
    return text


def _head(seen: Column, speaker: Column) -> Column:
    return (
        F.when(speaker == seen, F.lit(f"{OPEN}assistant\n"))
        .when(speaker == SYSTEM, F.lit(f"{OPEN}system\n"))
        .when(speaker.isNull(), F.lit(f"{OPEN}user\n"))
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), F.translate(_plain(speaker), "\r\n", "  "), F.lit("\n")))
    )


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each turn and perspective.

    ``conv_id, perspective, turn, position, role, name, rendered, char_start, char_end,
    mask_start, mask_end``; places count code points from the start of the rendering,
    ends excluded.  The mask is null except on the assistant's turns, where it covers the text
    and the closing marker.

    Turns are ordered by number (null first), speaker and text; equal rows follow one another
    and are all rendered.  A null text is empty.  A null speaker is an unnamed user and no
    participant; a dialogue of none but system and unnamed turns has no perspective and so no
    rows.  Markers of turns inside a text or name, and line breaks in a name, are written so that
    they forge no turn.  Null dialogue ids are one dialogue.  Other columns are ignored.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(speaker_col).alias("speaker"),
        _plain(F.coalesce(text_col, F.lit(""))).alias("text"),
    )
    # repeated rows are counted first, so that no number of copies is one task's work
    rows = rows.groupBy("conv", "turn", "speaker", "text").agg(F.count("*").alias("copies"))
    people = (
        turns.where(F.col(speaker_col).isNotNull() & (F.col(speaker_col) != SYSTEM))
        .select(F.col(conv_col).alias("_conv"), F.col(speaker_col).alias("perspective"))
        .distinct()
    )
    seen = rows.join(people, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    head = _head(F.col("perspective"), F.col("speaker"))
    seen = (
        seen.withColumn("head", F.length(head))
        .withColumn("rendered", F.concat(head, F.col("text"), F.lit(CLOSE)))
        .withColumn("size", F.length("rendered").cast("long"))
        .withColumn("part", F.coalesce(F.floor(F.col("turn") / PART), F.lit(-(1 << 62))))
    )
    own = ["conv", "perspective", "part"]
    line = Window.partitionBy(*own).orderBy(F.col("turn").asc_nulls_first(), F.col("speaker").asc_nulls_first(), "text").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda x: F.coalesce(F.sum(x).over(line), F.lit(0))
    placed = seen.withColumn("chars", upto(F.col("size") * F.col("copies"))).withColumn("rows", upto(F.col("copies")))
    parts = seen.groupBy(*own).agg(F.sum(F.col("size") * F.col("copies")).alias("part_chars"), F.sum("copies").alias("part_rows"))
    order = Window.partitionBy("conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(
        *[F.col(c).alias(f"_{c}") for c in own],
        F.coalesce(F.sum("part_chars").over(order), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("part_rows").over(order), F.lit(0)).alias("rows_before"),
    )
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_perspective")) & (F.col("part") == F.col("_part"))
    joined = placed.join(before, same).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    start = F.col("chars_before") + F.col("chars") + F.col("copy") * F.col("size")
    is_own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    return joined.select(
        F.col("conv").alias(conv_col),
        "perspective",
        F.col("turn").alias(turn_col),
        (F.col("rows_before") + F.col("rows") + F.col("copy")).alias("position"),
        F.when(is_own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user").alias("role"),
        F.when(~is_own & (F.coalesce(F.col("speaker"), F.lit(SYSTEM)) != SYSTEM), F.col("speaker")).alias("name"),
        "rendered",
        start.alias("char_start"),
        (start + F.col("size")).alias("char_end"),
        F.when(is_own, start + F.col("head")).alias("mask_start"),
        F.when(is_own, start + F.col("head") + F.length("text") + CLOSE_MASKED).alias("mask_end"),
    )


def op1_query(spark, sf_dir: str) -> DataFrame:
    """Every dialogue of ``conversations`` from every participant's perspective."""
    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _plain_sql(text: str) -> str:
    for marker, plain in PLAIN.items():
        text = f"replace({text}, '{marker}', '{plain}')"
    return text


#: The same rows in DuckDB.
SQL = f"""
WITH p AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> '{SYSTEM}'),
r AS (SELECT c.conv_id, perspective, turn, c.role AS speaker, {_plain_sql("coalesce(text, '')")} AS t, coalesce(c.role = perspective, false) AS own,
    CASE WHEN c.role = perspective THEN '{OPEN}assistant' WHEN c.role = '{SYSTEM}' THEN '{OPEN}system' WHEN c.role IS NULL THEN '{OPEN}user'
    ELSE '{OPEN}user name=' || translate({_plain_sql('c.role')}, chr(13) || chr(10), '  ') END || chr(10) AS head FROM conversations c JOIN p ON p.conv_id IS NOT DISTINCT FROM c.conv_id),
s AS (SELECT *, head || t || '{CLOSE.strip()}' || chr(10) AS rendered FROM r),
w AS (SELECT *, row_number() OVER o - 1 AS position, sum(length(rendered)) OVER o - length(rendered) AS char_start FROM s
    WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, t ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, CAST(turn AS BIGINT) AS turn, position,
    CASE WHEN own THEN 'assistant' WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user' END AS role,
    CASE WHEN NOT own AND speaker <> '{SYSTEM}' THEN speaker END AS name, rendered, CAST(char_start AS BIGINT) AS char_start,
    CAST(char_start + length(rendered) AS BIGINT) AS char_end, CAST(CASE WHEN own THEN char_start + length(head) END AS BIGINT) AS mask_start,
    CAST(CASE WHEN own THEN char_start + length(head) + length(t) + {CLOSE_MASKED} END AS BIGINT) AS mask_end FROM w
"""
