"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Loggers often store a conversation again after each turn. The turns of a conversation, in order, get a rolling
hash: the hash after turn k stands for the whole prefix. A conversation whose last hash is another's prefix hash is a
snapshot of it and goes; of equal conversations the smallest id stays. What remains is rendered turn by turn.

Rolling hashes, places and character offsets come from prefix sums in two steps (inside a block of turns, then over
the blocks), so that a conversation of any length is spread over tasks. The hash of a prefix is a pair of sums
over its turns, of 64-bit hashes of place, role and text.

Defined results: order is by turn (nulls first), then role, then text; a null role or text is the empty one;
equal rows of one conversation (same turn, role and text) count once; rows that
share a turn number lie in one block; rows with a null conversation id are one
conversation; a conversation renders alike whatever other columns the table has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut

#: Turn numbers of one block.
BLOCK_TURNS = 64
#: The template, plain ChatML.
START, END = "<|im_start|>", "<|im_end|>\n"
_WIDE = "decimal(38,0)"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def _running(df: DataFrame, **values: Column) -> DataFrame:
    """Adds each name: the sum of its value over the earlier turns of the conversation and this one."""
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumns(values)
    sums = marked.groupBy("conv_id", "block").agg(*(F.sum(v).alias(v) for v in values))
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("block").alias("_k"), *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}") for v in values))
    joined = marked.join(sums, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_k")))
    return joined.withColumns({v: F.sum(v).over(inside) + F.col(f"_{v}") for v in values}).drop("_c", "_k", *(f"_{v}" for v in values))


def turns_of(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, text_hash, block, place (from 0) of each turn."""
    plain = df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # copies of a row fold before the shuffle; equal texts have equal hashes
    once = plain.withColumn("text_hash", F.sha2("text", 256)).groupBy("conv_id", "turn", "role", "text_hash").agg(F.first("text").alias("text"))
    blocked = once.withColumn("block", F.floor(F.coalesce("turn", F.lit(-BLOCK_TURNS)) / BLOCK_TURNS))
    return _running(blocked, place=F.lit(1).cast("long")).withColumn("place", F.col("place") - 1)


def with_prefix_hashes(turns: DataFrame) -> DataFrame:
    """Adds h1 and h2, the rolling hash after each turn."""
    one = F.xxhash64("place", "role", "text_hash").cast(_WIDE)
    two = F.xxhash64("text_hash", F.lit(17), "role", "place").cast(_WIDE)
    return _running(turns, h1=one, h2=two)


def maximal(turns: DataFrame) -> DataFrame:
    """Turns (with prefix hashes) of conversations that are no prefix of another; of equal ones the smallest id."""
    prefix = F.struct("place", "h1", "h2")
    last = turns.groupBy("conv_id").agg(F.max(prefix).alias("last"))
    # one row for each different prefix, folded before the shuffle: how long its longest conversation is
    ends = last.select("conv_id", F.col("last.place").alias("end"))
    longer = turns.join(ends.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).filter(F.col("place") < F.col("end"))
    inner = longer.select("place", "h1", "h2").distinct()
    first = last.groupBy("last").agg(F.min("conv_id").alias("conv_id"), F.max(F.col("conv_id").isNull()).alias("none"))
    whole = first.select(F.col("last.place").alias("place"), F.col("last.h1").alias("h1"), F.col("last.h2").alias("h2"), "conv_id")
    kept = whole.join(inner, ["place", "h1", "h2"], "left_anti").select(F.col("conv_id").alias("_kept"))
    return turns.join(kept, F.col("conv_id").eqNullSafe(F.col("_kept")), "left_semi")


def format_chats(df: DataFrame) -> DataFrame:
    """Rendered turns of the maximal conversations.

    conv_id, place, role, rendered, start (code points before it in the conversation), n_chars, is_target (whether a
    model trains on it: the assistant's turns).
    """
    turns = cut(with_prefix_hashes(turns_of(df)))
    kept = maximal(turns).withColumn("rendered", rendered(F.col("role"), F.col("text"))).withColumn("n_chars", F.length("rendered").cast("long"))
    out = _running(kept, until=F.col("n_chars"))
    return out.select("conv_id", "place", "role", "rendered", (F.col("until") - F.col("n_chars")).alias("start"), "n_chars", (F.col("role") == "assistant").alias("is_target"))


#: The same result in DuckDB; prefixes are compared as texts.
ORACLE = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT *, row_number() OVER w - 1 AS place, string_agg(role || chr(1) || text, chr(2)) OVER w AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text) ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT conv_id, max(place) AS place, max_by(prefix, place) AS prefix FROM p GROUP BY conv_id
), f AS (
  SELECT place, prefix, min(conv_id) AS conv_id FROM l GROUP BY place, prefix
), k AS (
  SELECT conv_id FROM f WHERE NOT EXISTS (
    SELECT 1 FROM p JOIN l USING (conv_id) WHERE p.place < l.place AND p.place = f.place AND p.prefix = f.prefix)
), r AS (
  SELECT p.conv_id, p.place, p.role, '{START}' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10) AS rendered
  FROM p JOIN k ON p.conv_id IS NOT DISTINCT FROM k.conv_id
)
SELECT conv_id, place, role, rendered,
  CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  CAST(length(rendered) AS BIGINT) AS n_chars, role = 'assistant' AS is_target
FROM r
"""
