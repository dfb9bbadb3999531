"""B: the message log, in batch; tests pair the streams with these."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteloom.functions.tables import new_path
from noteloom.operators import bus as B
from noteloom.sources import views as V

from .base import query

#: Notes fire in the order of time and id; the first two of a session are shown, each once.
CMDS_STREAM = "WITH f AS (SELECT 'u' || user_id AS session, event_id % 7 AS doc_id, ts FROM events), n AS (SELECT session, count(*) AS fires, count(DISTINCT doc_id) AS d FROM f GROUP BY session) SELECT session, fires, least(d, 2) AS shown FROM n"
READERS = ", readers AS (SELECT DISTINCT r AS reader, channel, CASE WHEN length(channel) = 2 THEN 5000 END AS last_seen FROM messages, (VALUES ('user'), ('assistant'), ('kim')) v(r))"
MINE = "sender <> reader AND (recipient IS NULL OR recipient = reader)"


def readers(spark, sf_dir):
    c = V.messages(spark, sf_dir).select("channel").distinct()
    return c.select(F.explode(F.array(F.lit("user"), F.lit("assistant"), F.lit("kim"))).alias("reader"), "channel", F.when(F.length("channel") == 2, 5000).alias("last_seen"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'note' WHEN event_id % 2 = 0 THEN 'request' END AS kind, 't' || user_id AS thread, event_id % 4 = 0 AS expects_reply, event_id % 2 = 0 AND event_type <> 'click' OR event_id % 4 = 0 AS needs FROM events")
def b1_envelopes(spark, sf_dir):
    e = V.read(spark, sf_dir, "events")
    meta = F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, "request").alias("kind"), F.concat(F.lit("t"), "user_id").alias("thread"), F.when(F.col("event_id") % 4 == 0, True).alias("expects_reply")))
    m = B.envelopes(e.select("event_id", meta.alias("metadata_json"), F.when(F.col("event_type") == "click", "note").otherwise("").alias("kind"), F.lit(None).cast("string").alias("recipient")))
    return m.select("event_id", "kind", "thread", "expects_reply", B.needs_agent(F.col("kind"), F.col("expects_reply"), F.lit(False), F.col("flagged")).alias("needs"))


@query(", r AS (SELECT channel, id, row_number() OVER (PARTITION BY channel ORDER BY id) AS place FROM messages WHERE id > 20000) SELECT channel, id, place::INTEGER AS place FROM r WHERE place <= 10", ("messages",))
def b2_page(spark, sf_dir):
    m = V.messages(spark, sf_dir)
    rows, _ = B.page(m, m.select("channel").distinct().withColumn("cursor", F.lit(20000)), 10)
    return rows.select("channel", "id", "place")


@query(READERS + f" SELECT reader, r.channel, count_if({MINE})::BIGINT AS unread, max(id) AS next FROM readers r JOIN messages m ON r.channel = m.channel AND id > coalesce(last_seen, -1) GROUP BY ALL", ("messages",))
def b3_inbox(spark, sf_dir):
    return B.inbox(V.messages(spark, sf_dir), readers(spark, sf_dir))


@query(", a AS (SELECT sender AS reader, channel, id AS last_seen FROM messages) SELECT reader, channel, max(last_seen) AS last_seen FROM a GROUP BY ALL", ("messages",))
def b4_cursors(spark, sf_dir):
    m = V.messages(spark, sf_dir).select(F.col("sender").alias("reader"), "channel", F.col("id").alias("last_seen"))
    return B.merged_cursors(m.filter("last_seen % 2 = 0"), m.filter("last_seen % 2 = 1"))


@query(READERS + f""", j AS (SELECT reader, id, sender, body, count(*) OVER (PARTITION BY reader) AS total, row_number() OVER (PARTITION BY reader ORDER BY id DESC) AS place FROM readers r JOIN messages m ON r.channel = m.channel AND id > coalesce(last_seen, -1) WHERE {MINE})
SELECT reader, max(total) AS total, string_agg('#' || id || ' ' || sender || ': ' || substr(trim(regexp_replace(body, '\\s+', ' ', 'g')), 1, 80), chr(10) ORDER BY place) AS text FROM j WHERE place <= 5 GROUP BY reader""", ("messages",))
def b5_digest(spark, sf_dir):
    return B.digest(V.messages(spark, sf_dir), readers(spark, sf_dir))


@query("SELECT 'u' || user_id AS session, max(ts) >= TIMESTAMP '2024-01-30' - INTERVAL 300 SECOND AS live FROM events GROUP BY user_id")
def b6_presence(spark, sf_dir):
    e = V.read(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("session"), F.col("ts").alias("at"))
    return B.presence(e, F.lit("2024-01-30").cast("timestamp_ntz")).select("session", "live")


@query(READERS + f" SELECT DISTINCT id AS message_id, reader AS session FROM readers r JOIN messages m ON r.channel = m.channel AND id > coalesce(last_seen, -1) WHERE {MINE} AND id % 3 <> 0", ("messages",))
def b7_deliveries(spark, sf_dir):
    m = V.messages(spark, sf_dir)
    s = readers(spark, sf_dir).withColumnRenamed("reader", "session")
    done = m.filter("id % 3 = 0").select(F.col("id").alias("message_id"), F.explode(F.array(F.lit("user"), F.lit("assistant"), F.lit("kim"))).alias("session"))
    return B.deliveries(m, s, done)


@query(", r AS (SELECT id, channel, row_number() OVER (PARTITION BY channel ORDER BY id DESC) AS k FROM messages) SELECT id, channel FROM r WHERE k <= 7", ("messages",))
def b8_pruned(spark, sf_dir):
    return B.pruned(V.messages(spark, sf_dir), 7).select("id", "channel")


@query(READERS + f", u AS (SELECT reader, r.channel, count_if({MINE})::BIGINT AS unread FROM readers r JOIN messages m ON r.channel = m.channel AND id > coalesce(last_seen, -1) GROUP BY ALL), l AS (SELECT channel, sender AS reader, max(id) AS last_message FROM messages GROUP BY ALL) SELECT channel, reader, last_message, unread FROM readers LEFT JOIN l USING (channel, reader) LEFT JOIN u USING (channel, reader)", ("messages",))
def b12_status(spark, sf_dir):
    return B.status(V.messages(spark, sf_dir), readers(spark, sf_dir)).select("channel", "reader", "last_message", "unread")


@query("SELECT channel, count(*) AS messages, count(DISTINCT sender) AS senders, max(id) AS last FROM messages GROUP BY channel", ("messages",))
def b13_channels(spark, sf_dir):
    return B.channels(V.messages(spark, sf_dir))


@query("WITH e AS (SELECT *, substr(sha256('h' || (user_id % 3) || chr(10) || 'u' || user_id || chr(10) || 'c'), 1, 16) AS session_id FROM events) SELECT session_id, arg_max(event_type, (event_id)) AS state, max(event_id) AS at FROM e GROUP BY session_id")
def b14_sessions(spark, sf_dir):
    e = V.read(spark, sf_dir, "events").select(F.concat(F.lit("h"), F.col("user_id") % 3).alias("host"), F.concat(F.lit("u"), "user_id").alias("user"), F.lit("c").alias("channel"), F.col("event_type").alias("state"), F.col("event_id").alias("at"))
    return B.sessions(e)


@query(", a AS (SELECT DISTINCT 'bot' || channel AS agent, channel FROM messages WHERE channel NOT IN ('c1', 'c2')), t AS (SELECT agent, id AS message_id, row_number() OVER (PARTITION BY agent ORDER BY id) AS k FROM a JOIN messages m ON a.channel = m.channel WHERE recipient IS NULL AND turn % 2 = 0 AND id % 4 <> 0) SELECT agent, message_id FROM t WHERE k <= 3 - CASE WHEN agent = 'botc3' THEN 1 ELSE 0 END", ("messages",))
def b15_runnable(spark, sf_dir):
    m = V.messages(spark, sf_dir).withColumn("needs_agent", F.col("turn") % 2 == 0)
    agents = m.select("channel").distinct().select(F.concat(F.lit("bot"), "channel").alias("agent"), "channel", (F.col("channel") != "c1").alias("enabled"), F.lit(3).alias("concurrency"), F.lit(60).alias("cooldown_s"))
    now = F.lit("2024-01-01 00:00:30").cast("timestamp_ntz")
    done = m.filter("id % 4 = 0").select(F.concat(F.lit("bot"), "channel").alias("agent"), F.col("id").alias("message_id"), F.lit("done").alias("state"), now.alias("at"))
    extra = spark.createDataFrame([("botc2", -1, "failed"), ("botc3", -2, "running")], "agent string, message_id long, state string").withColumn("at", now)
    return B.runnable(agents, m, done.unionByName(extra), now)


@query("SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, tool, count(*) AS calls, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM tool_calls GROUP BY ALL", ("tool_calls",))
def b16_tool_days(spark, sf_dir):
    from noteloom.operators.reports import tool_partials

    return tool_partials(V.tool_calls(spark, sf_dir)).select(F.col("day").cast("string").alias("day"), "tool", "calls", "total_ms")


@query("SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'no_channel' WHEN turn % 4 = 3 THEN 'bad_reply' END AS reject FROM conversations")
def b17_validated(spark, sf_dir):
    c = V.read(spark, sf_dir, "conversations")
    m = c.select("conv_id", "turn", F.when(F.col("conv_id") % 5 == 0, "  ").otherwise("c").alias("channel"), F.col("role").alias("sender"), F.concat(F.lit("x "), "text").alias("body"), F.when(F.col("turn") % 4 == 3, -1).alias("reply_to"))
    return B.validated(m).select("conv_id", "turn", "reject")


@query("SELECT user_id AS agent, max(event_id) AS last_run FROM events GROUP BY user_id ORDER BY last_run DESC LIMIT 100")
def b18_runs(spark, sf_dir):
    from noteloom.operators.notes import latest

    e = V.read(spark, sf_dir, "events").select(F.col("user_id").alias("agent"), F.col("event_id").alias("last_run"))
    return latest(e, "agent", "last_run").orderBy(F.desc("last_run")).limit(100)


KINDS = ", k AS (SELECT *, CASE id % 11 WHEN 0 THEN 'control' WHEN 1 THEN 'heartbeat' WHEN 2 THEN 'status' ELSE 'note' END AS kind FROM messages)"
HOOKS = READERS + ", hooks AS (SELECT *, CASE reader WHEN 'user' THEN TIMESTAMP '2024-01-01 00:00:00' WHEN 'kim' THEN TIMESTAMP '2023-12-31 00:00:00' END AS last_hook_at, 12000 AS notify_cursor FROM readers)"


def kinds(spark, sf_dir):
    k = F.col("id") % 11
    return V.messages(spark, sf_dir).withColumn("kind", F.when(k == 0, "control").when(k == 1, "heartbeat").when(k == 2, "status").otherwise("note"))


def hooks(spark, sf_dir):
    at = F.when(F.col("reader") == "user", "2024-01-01 00:00:00").when(F.col("reader") == "kim", "2023-12-31 00:00:00").cast("timestamp_ntz")
    return readers(spark, sf_dir).withColumn("last_hook_at", at).withColumn("notify_cursor", F.lit(12_000))


def noon():
    return F.lit("2024-01-01 00:04:00").cast("timestamp_ntz")


@query(HOOKS + KINDS + f""", j AS (SELECT reader, r.channel, id, sender, kind, recipient, body, count(*) OVER (PARTITION BY reader, r.channel) AS total, row_number() OVER (PARTITION BY reader, r.channel ORDER BY id DESC) AS place FROM hooks r JOIN k m ON r.channel = m.channel AND id > coalesce(last_seen, -1) WHERE {MINE})
SELECT reader, channel, max(total) AS total, '[bus] ' || channel || ' — ' || max(total) || CASE WHEN max(total) = 1 THEN ' new message:' ELSE ' new messages:' END || chr(10) || '  • presence — live: user | stale: kim' || chr(10)
|| string_agg('  • #' || id || ' ' || sender || ' (' || kind || CASE WHEN recipient IS NOT NULL THEN ' → ' || recipient ELSE '' END || ') — "' || substr(trim(regexp_replace(body, '\\s+', ' ', 'g')), 1, 80) || '"', chr(10) ORDER BY place) || CASE WHEN max(total) > count(*) THEN chr(10) || '  • …and ' || (max(total) - count(*)) || ' more' ELSE '' END AS text FROM j WHERE place <= 5 GROUP BY reader, channel""", ("messages",))
def b5_notifications(spark, sf_dir):
    return B.notifications(kinds(spark, sf_dir), hooks(spark, sf_dir), noon())


@query(", r AS (SELECT id, channel, row_number() OVER (PARTITION BY channel ORDER BY id DESC) AS k FROM messages), a AS (SELECT id FROM r WHERE k <= 7) SELECT 'messages' AS part, count(*) AS n FROM a UNION ALL SELECT 'deliveries', 2 * count(*) FROM a UNION ALL SELECT 'runs', count(*) FROM a WHERE id % 3 = 0", ("messages",))
def b8_cascade(spark, sf_dir):
    m = V.messages(spark, sf_dir)
    given = m.select(F.col("id").alias("message_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("session"))
    left = B.pruned_with_children(m, given, m.filter("id % 3 = 0").select(F.col("id").alias("trigger_message_id")), 7)
    count = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return count(left[0], "messages").unionByName(count(left[1], "deliveries")).unionByName(count(left[2], "runs"))


@query(HOOKS + KINDS + f", a AS (SELECT h.reader, h.channel, count(id) AS unread_messages FROM hooks h LEFT JOIN k m ON h.channel = m.channel AND id > coalesce(last_seen, -1) GROUP BY ALL), n AS (SELECT h.reader, h.channel, count_if({MINE})::BIGINT AS unread_notifications FROM hooks h LEFT JOIN k m ON h.channel = m.channel AND id > notify_cursor GROUP BY ALL), b AS (SELECT channel, sender AS reader, max(id) AS last_heartbeat FROM k WHERE kind IN ('heartbeat', 'status') GROUP BY ALL) SELECT channel, reader, unread_messages, unread_notifications, CASE reader WHEN 'user' THEN 'live' WHEN 'kim' THEN 'stale' ELSE 'unknown' END AS presence, last_heartbeat FROM hooks JOIN a USING (reader, channel) JOIN n USING (reader, channel) LEFT JOIN b USING (channel, reader)", ("messages",))
def b12_readers(spark, sf_dir):
    return B.reader_status(kinds(spark, sf_dir), hooks(spark, sf_dir), noon())


@query(KINDS + " SELECT channel, sender, count(*) AS messages, max(id) AS last_message, max(id) FILTER (kind IN ('heartbeat', 'status')) AS last_heartbeat, (SELECT max(id) FROM k c WHERE c.channel = k.channel AND kind = 'control') AS last_control FROM k GROUP BY channel, sender", ("messages",))
def b12_participants(spark, sf_dir):
    return B.participants(kinds(spark, sf_dir))


@query(" SELECT id, session_id FROM (SELECT id, 's' || (id % 5) AS session_id FROM messages WHERE channel = 'c3') WHERE session_id = 's2' ORDER BY id DESC LIMIT 100", ("messages",))
def b14_deliveries(spark, sf_dir):
    d = V.messages(spark, sf_dir).select("id", "channel", F.concat(F.lit("s"), F.col("id") % 5).alias("session_id"))
    return B.delivery_list(d, "c3", "s2").select("id", "session_id")


@query(CMDS_STREAM)
def b9_stream_warnings(spark, sf_dir):
    """The command calls as a stream, in session state."""
    from noteloom.streaming import streams as S

    e = S.read(spark, sf_dir, "events")
    fires = e.select(F.concat(F.lit("u"), "user_id").alias("session"), (F.col("event_id") % 7).alias("doc_id"), F.col("ts").alias("at"))
    return S.drained_table(S.warnings(S.ended(fires, "2100-01-01"))).groupBy("session").agg(F.count("*").alias("fires"), F.count_if("shown").alias("shown"))


@query(", p AS (SELECT * FROM retrievals WHERE surface = 'hint'), r AS (SELECT * FROM retrievals WHERE surface = 'kb_read') SELECT p.id AS push_id, r.id AS read_id FROM p JOIN r ON p.session = r.session AND p.doc_id = r.doc_id AND r.created_at >= p.created_at AND r.created_at <= p.created_at + INTERVAL 3 DAY", ("retrievals",))
def b10_stream_followed(spark, sf_dir):
    """Pushes and reads as two streams; pushes without a read wait for the watermark, so only pairs are listed here."""
    from noteloom.streaming import streams as S

    def rows(kind):
        e = S.read(spark, sf_dir, "events").filter(F.col("event_type") == kind)
        return e.select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("doc_id"), F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("u"), "user_id")).alias("session"), F.col("ts").alias("created_at"))

    return S.drained_table(S.follow_through(rows("view"), rows("click"), "3 days", "400 days")).filter("read_id IS NOT NULL")


@query("WITH f AS (SELECT 'customer_' || o_custkey AS subject, min_by(o_orderstatus, o_orderkey) AS was, min_by(o_orderdate, o_orderkey) AS since, max(o_orderkey) AS arrival, max_by(o_orderstatus, o_orderkey) AS object, max_by(o_orderdate, o_orderkey) AS seen FROM orders GROUP BY o_custkey) SELECT arrival, subject, object, CAST(CAST(seen AS DATE) AS VARCHAR) AS valid_from FROM f WHERE was <> object AND CAST(since AS DATE) > CAST(seen AS DATE)")
def b11_late_facts(spark, sf_dir):
    """Each customer's first status, and then the last one, as two batches of a stream; what comes too late is set aside."""
    from noteloom.streaming import streams as S

    path = new_path(spark, "facts")
    o = V.read(spark, sf_dir, "orders")
    for number, pick, of in ((0, F.min_by, F.min), (1, F.max_by, F.max)):
        rows = o.groupBy("o_custkey").agg(of("o_orderkey").alias("arrival"), pick("o_orderstatus", "o_orderkey").alias("object"), pick("o_orderdate", "o_orderkey").alias("at"))
        facts = rows.select("arrival", F.concat(F.lit("customer_"), "o_custkey").alias("subject"), F.lit("status").alias("predicate"), "object", F.to_date("at").cast("string").alias("valid_from"))
        facts.write.parquet(f"{path}/in/{number}")
        S.feed(spark.readStream.schema(facts.schema).parquet(f"{path}/in/*"), S.late_facts(f"{path}/held", f"{path}/late"), f"{path}/checkpoint")
    return spark.read.schema("status string, arrival long, subject string, predicate string, object string, valid_from string").parquet(f"{path}/late/*").select("arrival", "subject", "object", "valid_from")


@query(READERS + KINDS + f" SELECT reader, m.channel, id, {MINE} AS addressed, kind IN ('request', 'question', 'task') OR id % 4 = 0 OR (recipient IS NOT NULL AND recipient = reader) OR id % 9 = 0 AS needs FROM readers r JOIN k m ON r.channel = m.channel WHERE {MINE}", ("messages",))
def p11_p12_addressed(spark, sf_dir):
    j = readers(spark, sf_dir).join(kinds(spark, sf_dir), "channel").filter(B.targets(F.col("sender"), F.col("recipient"), F.col("reader")))
    direct = F.col("recipient").isNotNull() & (F.col("recipient") == F.col("reader"))
    return j.select("reader", "channel", "id", F.lit(True).alias("addressed"), B.needs_agent(F.col("kind"), F.col("id") % 4 == 0, direct, F.col("id") % 9 == 0).alias("needs"))
