"""X, S9, S14: transcripts, chunks and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteloom.operators import transcripts as X
from noteloom.sources import files as S
from noteloom.sources import views as V

from noteloom.functions.tables import new_path

from .base import query


def files(spark, sf_dir):
    """Conversations as transcript files of two line shapes, with bad lines, side chains and shell calls among them."""
    c = V.read(spark, sf_dir, "conversations")
    k = F.col("turn") % 5
    plain = F.to_json(F.struct(F.when(F.col("role") == "user", "user").otherwise("assistant").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    other = F.to_json(F.struct(F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("payload")))
    side = F.to_json(F.struct(F.lit("user").alias("type"), F.lit(True).alias("isSidechain"), F.struct(F.col("text").alias("content")).alias("message")))
    bash = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("Bash").alias("name"), F.struct(F.concat(F.lit("cat <<EOF\nhidden\nEOF\ngit push origin b"), "turn").alias("command")).alias("input"))).alias("content")).alias("message")))
    line = F.when(k == 0, plain).when(k == 1, other).when(k == 2, side).when(k == 3, bash).otherwise(F.lit("{bad"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"])
    return c.groupBy("conv_id").agg(F.array_join(rows, "\n").alias("text")).select(F.concat(F.lit("/t/s"), "conv_id", F.lit(".jsonl")).alias("path"), "text")


@query("SELECT '/t/s' || conv_id || '.jsonl' AS path, string_agg(CASE turn % 5 WHEN 0 THEN CASE role WHEN 'user' THEN 'USER' ELSE 'ASSISTANT' END ELSE upper(role) END || ': ' || trim(text), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE turn % 5 < 2 AND trim(text) <> '' GROUP BY conv_id")
def s9_transcripts(spark, sf_dir):
    return X.transcript_text(files(spark, sf_dir))


@query("SELECT 's' || conv_id AS session, 'cat <<EOF ; git push origin b' || turn AS command FROM conversations WHERE turn % 5 = 3")
def s14_commands(spark, sf_dir):
    return X.shell_commands(files(spark, sf_dir)).select("session", "command")


@query("SELECT page_id, page_id % 2 = 0 AS print_mode FROM pages")
def s11_print_mode(spark, sf_dir):
    p = V.read(spark, sf_dir, "pages")
    text = F.concat(F.when(F.col("page_id") % 2 == 0, F.lit('{"entrypoint": "sdk-cli"}\n')).otherwise(F.lit("")), "html")
    return p.select("page_id", S.is_print_mode(text).alias("print_mode"))


@query("WITH d AS (SELECT doc_id AS id, text, CAST(ceil(length(text) / 300.0) AS INTEGER) AS n FROM documents WHERE length(text) > 0), p AS (SELECT id, text, n, unnest(range(0, n)) AS pos FROM d) SELECT id, pos::INTEGER AS pos, substr(text, pos * 300 + 1, 300) AS chunk FROM p WHERE n <= 20 OR pos < 4 OR pos >= n - 16")
def x2_chunks(spark, sf_dir):
    return X.chunks(V.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 300)


@query("SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 400) || chr(10) || '[... ' || (length(text) - 1000) || ' characters not read ...]' || chr(10) || right(text, 600) END AS text FROM documents")
def x3_sampled(spark, sf_dir):
    return V.read(spark, sf_dir, "documents").select("doc_id", X.sampled(F.col("text"), 400, 600).alias("text"))


@query()
def x4_x5_sentence_chunks(spark, sf_dir):
    return X.sentence_chunks(V.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("WITH d AS (SELECT doc_id AS id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL) SELECT id, CASE WHEN regexp_matches(w[1], '[\\p{L}\\p{N}#]') AND CASE WHEN id % 2 = 0 THEN regexp_matches(w[2], '[\\p{L}\\p{N}#]') ELSE regexp_matches(w[2], '#[0-9]') END THEN 'kept' ELSE 'skipped' END AS status FROM d")
def x6_x7_grounded(spark, sf_dir):
    d = V.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").filter("text IS NOT NULL")
    w = F.split("text", " ")
    f = d.select(F.col("id").alias("doc_id"), w[0].alias("subject"), F.lit("is").alias("predicate"), F.when(F.col("id") % 2 == 0, F.get(w, 1)).otherwise(F.concat(F.lit("zzqx"), F.get(w, 1))).alias("object"), F.lit(None).cast("string").alias("valid_from"))
    return X.grounded(f, d, F.lit("2024-05-01")).select(F.col("doc_id").alias("id"), "status")


@query("SELECT event_id, event_id % 5 <> 4 AS stated FROM events")
def x8_x9_dates(spark, sf_dir):
    k = F.col("event_id") % 5
    day = F.col("event_id") % 28 + 1
    iso = F.concat(F.lit("2024-07-"), F.lpad(day.cast("string"), 2, "0"))
    text = F.when(k == 0, F.concat(F.lit("seen on "), iso, F.lit("."))).when(k == 1, F.concat(F.lit("seen July "), day, F.lit("th"))).when(k == 2, F.concat(F.lit("the "), day, F.lit(" of July"))).when(k == 3, F.concat(F.lit("on 7/"), day, F.lit(" it"))).otherwise(F.lit("in August"))
    return V.read(spark, sf_dir, "events").select("event_id", X.date_stated(text, iso).alias("stated"))


@query("SELECT conv_id % 10 AS part, count(*) AS lines, TRUE AS in_flight FROM conversations GROUP BY 1")
def s10_s13_discovery(spark, sf_dir):
    """Conversations written as JSON lines, found by their time: all were touched just now."""
    path = new_path(spark, "transcripts")
    V.read(spark, sf_dir, "conversations").withColumn("part", F.col("conv_id") % 10).repartition("part").write.partitionBy("part").json(path)
    t = S.transcripts(spark, path, since="2000-01-01T00:00:00", pattern="*.json")
    part = F.regexp_extract("path", r"part=(\d+)/", 1).cast("long")
    return t.groupBy(part.alias("part")).agg(F.sum(F.regexp_count("text", F.lit("\n"))).alias("lines"), F.bool_and(S.in_flight(F.col("modified"), F.current_timestamp())).alias("in_flight"))


@query("SELECT 'u' || user_id AS session, CASE event_id % 3 WHEN 0 THEN 'git push m' || event_id ELSE 'ls' END AS command, count(*) AS n FROM events WHERE event_id % 3 <> 2 GROUP BY ALL")
def s15_corpus(spark, sf_dir):
    path = new_path(spark, "corpus")
    k = F.col("event_id") % 3
    line = F.concat(F.lit("u"), "user_id", F.lit("\t"), F.when(k == 0, F.concat(F.lit(" Git  PUSH\tm"), "event_id")).when(k == 1, "LS ").otherwise("  "))
    V.read(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return S.command_corpus(spark, path).groupBy("session", "command").agg(F.count("*").alias("n"))


@query("SELECT 'u' || user_id AS session, event_id AS doc_id, event_id % 2 = 0 AS shown FROM events WHERE event_id % 5 <> 0")
def s16_fires(spark, sf_dir):
    path = new_path(spark, "fires")
    e = V.read(spark, sf_dir, "events")
    row = F.to_json(F.struct(F.col("ts").cast("string").alias("ts"), F.concat(F.lit("u"), "user_id").alias("session"), F.col("event_id").alias("doc_id"), F.lit("ls").alias("command"), (F.col("event_id") % 2 == 0).alias("shown")))
    e.select(F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{cut "), row)).otherwise(row).alias("value")).write.text(path)
    return S.fire_log(spark, f"{path}/*").select("session", "doc_id", "shown")
