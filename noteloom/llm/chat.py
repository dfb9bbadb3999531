"""Operator 7: chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A logged conversation whose turns begin a longer one is an earlier snapshot of it. Each turn gets its place in its
conversation and the rolling hash of the turns so far: two 64-bit hashes of (place, role, text), joined by exclusive or, so
that blocks of `BLOCK` turns can be hashed apart and a long conversation does not fall to one task. Whole conversations
whose (length, hash) is a prefix of a longer one go by an anti-join with the distinct prefixes; of equal conversations the
one with the smallest conv_id stays. What is left is rendered, one row a conversation: blocks become text apart, so that
the task that joins a conversation reads one row for each `BLOCK` turns and holds no more than the text it returns.

Nulls: a null conv_id is a conversation of its own (kept among equals only if none has an id), null turns come first, null
roles and texts are empty. Rows that repeat a turn are turns, ordered by role and text. A conversation of any number of
turns, and texts of any length, stay whole. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

BLOCK = 256


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, h1, h2): each turn with its place and the rolling hashes up to it."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", none("role").alias("role"), none("text").alias("text"), F.floor(F.coalesce(F.col("turn"), F.lit(0)) / BLOCK).alias("block"), F.col("turn").isNotNull().alias("known"))
    sizes = rows.groupBy("conv_id", "known", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("known", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "known", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    own = Window.partitionBy("conv_id", "known", "block").orderBy("turn", "role", "text")
    numbered = rows.withColumn("row", F.row_number().over(own))
    keys = [numbered[c].eqNullSafe(starts[c]) for c in ("conv_id", "known", "block")]
    return numbered.join(starts, keys).select(numbered["conv_id"], (F.col("at") + F.col("row")).alias("pos"), "role", "text")


def hashed(turns: DataFrame) -> DataFrame:
    """`placed` with part, h1 and h2."""
    rows = turns.withColumn("part", F.floor((F.col("pos") - 1) / BLOCK).cast("int"))
    for k in (1, 2):
        rows = rows.withColumn(f"x{k}", F.xxhash64(F.lit(k), "pos", "role", "text"))
    parts = rows.groupBy("conv_id", "part").agg(*[F.bit_xor(f"x{k}").alias(f"y{k}") for k in (1, 2)])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), *[F.coalesce(F.bit_xor(f"y{k}").over(before), F.lit(0)).alias(f"y{k}") for k in (1, 2)])
    inside = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = rows.select("conv_id", "part", "pos", *[F.bit_xor(f"x{k}").over(inside).alias(f"z{k}") for k in (1, 2)])
    joined = rolled.join(parts, rolled["conv_id"].eqNullSafe(parts["c"]) & (rolled["part"] == parts["p"]))
    return joined.select("conv_id", "part", "pos", *[F.col(f"z{k}").bitwiseXOR(F.col(f"y{k}")).alias(f"h{k}") for k in (1, 2)])


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id of the conversations that begin no longer one, one of equals."""
    lengths = prefixes.groupBy("conv_id").agg(F.max("pos").alias("n"))
    tagged = prefixes.join(lengths.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    whole = tagged.filter("pos = n").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    longer = tagged.filter("pos < n").select("pos", "h1", "h2").distinct()
    return whole.join(longer, ["pos", "h1", "h2"], "left_anti").select("conv_id")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and text of the maximal conversations."""
    rows = materialize(placed(turns), "turns")
    kept = maximal(hashed(rows)).withColumnRenamed("conv_id", "c")
    turn = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    said = rows.join(kept, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("conv_id", F.floor((F.col("pos") - 1) / BLOCK).cast("int").alias("part"), F.struct("pos", turn.alias("said")).alias("t"))
    joined = lambda xs: F.array_join(F.transform(F.array_sort(xs), lambda x: x["said"]), "")
    blocks = said.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.collect_list("t").alias("t"))  # BLOCK turns at most
    blocks = blocks.select("conv_id", "n", F.struct("part", joined(F.col("t")).alias("said")).alias("t"))
    return blocks.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.collect_list("t").alias("t")).select("conv_id", "n_turns", joined(F.col("t")).alias("text"))
