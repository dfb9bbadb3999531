"""Operator 6: mixing sources to target weights.

Tokens (words) are summed per source; sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share the total.
A target stops at `most` times its source's size and the excess goes to the others by weight. A source's rate is
target / size; each document is emitted floor(rate) times, plus one Bernoulli copy whose draw is a hash of its id, source,
size and the seed, so reruns agree.

Nulls: a null text has size 0, a null source is a source of its own, null ids draw by the rest. Sources of size 0 have
target 0 and rate 0. Repeated rows draw alike, and so do rows that tie in id, source and size. A very long text is counted
whole and taken whole. An empty table gives an empty table. Extra columns stay in `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, free_name, materialize

MOST = 3
SEED = 20
#: Cycle of weights over the ordered sources.
WEIGHTS = (1, 2, 3)


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, target, rate)."""
    # sources in order, in ranges: a place is the place in its range after the ranges before
    ranged = materialize(sizes.repartitionByRange(F.asc_nulls_last("source")).withColumn("range", F.spark_partition_id()), "ranges")
    before, at = {}, 0
    for r in ranged.groupBy("range").count().orderBy("range").collect():  # as many as shuffle partitions
        before[r.range], at = at, at + r["count"]
    start = F.element_at(F.create_map(*[F.lit(x) for pair in (before or {0: 0}).items() for x in pair]), F.col("range"))
    place = start + F.row_number().over(Window.partitionBy("range").orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(ranged.select("source", "source_size", weight.alias("weight")), "sources")
    share, cap = None, F.col("source_size").cast("double") * most
    total = ranked.agg(F.sum(F.col("source_size").cast("double"))).first()[0] or 0.0
    while True:  # each pass fixes at least one more source at its cap
        over = F.lit(False) if share is None else F.lit(share) * F.col("weight") > cap
        capped, free = ranked.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        now = (total - (capped or 0.0)) / free if free else share
        if now == share or now is None:
            break
        share = now
    target = F.least(F.lit(share or 0.0) * F.col("weight"), cap)
    return ranked.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, copies) for each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    out = rows.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source")), "left")
    return out.select("doc_id", "size", "source_size", "target", copies(F.col("rate"), [F.col("doc_id"), F.col("s"), F.col("size")], seed, most).alias("copies"))


def copies(rate: Column, keys: list[Column], seed: int, most: int) -> Column:
    """floor(rate), and one more if the hash of the keys, as a number in [0, 1), is under the fraction."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.least(F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0), F.lit(most)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, most: int = MOST) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    size, key, rate, n = (free_name(docs, x) for x in ("mix_size", "mix_source", "mix_rate", "mix_copy"))
    sized = docs.withColumn(size, n_words(F.col(text_col)))
    sums = sized.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.sum(size).alias("source_size"))
    targets = source_targets(sums, most).select(F.col("source").alias(key), F.col("rate").alias(rate))
    out = sized.join(targets, F.col(source_col).cast("string").eqNullSafe(F.col(key)), "left")
    times = copies(F.col(rate), [F.col(id_col), F.col(source_col).cast("string"), F.col(size)], seed, most).cast("int")
    return out.withColumn(n, F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
