"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation again and again, each time some turns longer. A rolling hash over a conversation's turns
(the exclusive or of 128-bit hashes of position, role and text) identifies each of its beginnings. A conversation whose whole
hash is the hash of a beginning of a longer one is a snapshot; an anti-join leaves it out, as it leaves out equal
conversations but the one with the least id. What remains is rendered.

Positions and hashes are prefix sums over turns that are range-partitioned by conversation and turn: each range is
summed by itself, and the ranges' totals are added. So a conversation may be of any length. Rendered text comes in parts
of at most PART_TURNS turns, by which no group grows with a conversation.

Edge cases: turns are ordered by turn, role, text, nulls first; repeated rows count once; a null conversation id is a
conversation of its own; a null role or text differs from an empty one and is rendered as empty; an empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.llm.common import staged

PART_TURNS = 64


def _before(name: str, column: Column) -> Column:
    """Total of earlier ranges of the conversation."""
    return column.over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias(name)


def prefix_hashes(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, position (from 1), role, text and the hashes a, b of the conversation up to and with each turn."""
    cols = [F.col(c).alias(n) for c, n in ((conv_col, "conv"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))]
    order = ["turn", "role", "text"]
    ranges = turns.select(*cols).distinct().repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id())
    ranges = staged(ranges, "turns")
    local = F.row_number().over(W.partitionBy("conv", "part").orderBy(*order))
    counts = ranges.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")).select("conv", "part", _before("n_before", F.sum("n")))
    same = [F.col("x.conv").eqNullSafe(F.col("y.conv")), F.col("x.part") == F.col("y.part")]
    placed = ranges.withColumn("local", local).alias("x").join(counts.alias("y"), same).select("x.*", (F.col("local") + F.coalesce("n_before", F.lit(0))).alias("position"))
    content = [F.col("position"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    placed = placed.withColumn("ta", F.xxhash64(F.lit(1), *content)).withColumn("tb", F.xxhash64(F.lit(2), *content))
    running = W.partitionBy("conv", "part").orderBy("local").rowsBetween(W.unboundedPreceding, 0)
    summed = placed.select("conv", "part", "position", "role", "text", F.bit_xor("ta").over(running).alias("a"), F.bit_xor("tb").over(running).alias("b"))
    totals = placed.groupBy("conv", "part").agg(F.bit_xor("ta").alias("a"), F.bit_xor("tb").alias("b")).select("conv", "part", _before("a_before", F.bit_xor("a")), _before("b_before", F.bit_xor("b")))
    zero = F.lit(0).cast("long")
    return summed.alias("x").join(totals.alias("y"), same).select(
        "x.conv", "position", "role", "text",
        F.col("x.a").bitwiseXOR(F.coalesce("a_before", zero)).alias("a"), F.col("x.b").bitwiseXOR(F.coalesce("b_before", zero)).alias("b"),
    )


def maximal(hashed: DataFrame) -> DataFrame:
    """conv and n_turns of the conversations that are no beginning of a longer one, of equal ones the least id's."""
    size = hashed.groupBy("conv").agg(F.max(F.struct("position", "a", "b")).alias("last"))
    # as a table, so that the join with it can be divided where a conversation is long
    whole = staged(size.select("conv", F.col("last.position").alias("n"), "last.a", "last.b"), "whole")
    named = whole.groupBy("n", "a", "b").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    inner = hashed.alias("x").join(whole.alias("y"), [F.col("x.conv").eqNullSafe(F.col("y.conv")), F.col("x.position") < F.col("y.n")])
    prefixes = inner.select(F.col("x.position").alias("n"), "x.a", "x.b").distinct()
    return named.join(prefixes, ["n", "a", "b"], "left_anti").select("conv", F.col("n").alias("n_turns"))


def render(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, n_turns and rendered text of the maximal conversations; a conversation's parts, in order, are its text."""
    hashed = staged(prefix_hashes(turns, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col), "hashed")
    kept = hashed.alias("x").join(maximal(hashed).alias("y"), F.col("x.conv").eqNullSafe(F.col("y.conv"))).select("x.conv", "n_turns", "position", "role", "text")
    turn = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    part = F.floor((F.col("position") - 1) / part_turns).cast("int").alias("part")
    # dealt by part, not by conversation: so the join before can be divided where a conversation is long
    dealt = kept.select("conv", "n_turns", part, F.struct("position", turn.alias("t")).alias("turn")).repartition("conv", "part")
    grouped = dealt.groupBy("conv", "n_turns", "part").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.select(F.col("conv").alias("conv_id"), "part", F.col("n_turns").cast("long").alias("n_turns"), F.concat_ws("", F.transform("turns", lambda t: t["t"])).alias("rendered"))
