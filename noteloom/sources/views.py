"""The store's tables, derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    hours = lambda n: start + F.make_dt_interval(hours=n)
    d = F.col("doc_id")
    kinds = F.array(*[F.lit(x) for x in ("note", "research", "decision", "state", "session")])
    return read(spark, sf_dir, "documents").select(
        d.alias("id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"), F.array("source", "lang").alias("tags"), F.col("source").alias("project"),
        F.element_at(kinds, (d % 5 + 1).cast("int")).alias("doc_type"),
        F.when(d % 10 < 6, "inferred").when(d % 10 < 9, "observed").otherwise("verified").alias("tier"),
        hours(d.cast("int")).alias("created_at"), F.when(d % 17 == 0, hours((d + 24).cast("int"))).alias("superseded_at"),
    )


def retrievals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    surface = {"view": "hint", "click": "kb_read", "purchase": "kb_search", "signup": "briefing"}
    named = F.lit("kb_context")
    for kind, name in surface.items():
        named = F.when(F.col("event_type") == kind, name).otherwise(named)
    return read(spark, sf_dir, "events").select(
        e.alias("id"), F.get_json_object("props", "$.k").cast("long").alias("doc_id"), named.alias("surface"),
        F.when(e % 11 != 0, F.concat(F.lit("u"), "user_id")).alias("session"), F.col("ts").alias("created_at"),
        F.when(e % 3 != 0, F.concat(F.lit("e"), F.floor(e / 2))).alias("event_id"), (F.col("user_id") % 29 == 0).alias("is_test"),
        F.concat(F.when(e % 13 == 0, "<task-notification>").otherwise(""), F.lit("q"), e % 50).alias("query"),
    )


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("ok"), F.floor("value").alias("duration_ms"), (F.col("event_id") * 7 % 400).alias("result_chars"), F.col("ts").alias("created_at"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("customer_"), "o_custkey").alias("subject"), F.lit("status").alias("predicate"), F.col("o_orderstatus").alias("object"),
        F.to_date("o_orderdate").alias("valid_from"), F.to_date(F.lead("o_orderdate").over(after)).alias("valid_to"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("c"), F.col("conv_id") % 20).alias("channel"), F.col("role").alias("sender"), F.col("text").alias("body"),
        F.when(F.col("turn") % 3 == 0, "assistant").alias("recipient"), "conv_id", "turn",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
