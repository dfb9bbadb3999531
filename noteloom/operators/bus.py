"""The message log: envelopes, cursors, inboxes, deliveries, retention and agents. The same columns serve batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

META = "struct<kind:string,thread:string,reply_to:long,recipient:string,deadline:string,expects_reply:boolean,needs_agent:boolean>"


def envelopes(messages: DataFrame) -> DataFrame:
    """Typed columns over the message's own and its metadata (B1). Columns: metadata_json, kind, recipient, ..."""
    m = F.from_json("metadata_json", META)
    out = messages.withColumn("_m", m)
    for c in ("kind", "recipient"):
        out = out.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("_m")[c]))
    return out.select("*", F.col("_m.thread").alias("thread"), F.col("_m.reply_to").alias("reply_to"), F.coalesce("_m.expects_reply", F.lit(False)).alias("expects_reply"), F.coalesce("_m.needs_agent", F.lit(False)).alias("flagged")).drop("_m")


def targets(sender: Column, recipient: Column, reader: Column) -> Column:
    """Not one's own, and to all or to the reader."""
    return (sender != reader) & (recipient.isNull() | (recipient == "") | (recipient == reader))


def needs_agent(kind: Column, expects: Column, direct: Column, flagged: Column) -> Column:
    """P12."""
    return F.coalesce(kind.isin("request", "question", "task") | expects | direct | flagged, F.lit(False))


def validated(messages: DataFrame) -> DataFrame:
    """Messages trimmed, with what is wrong with them."""
    t = messages.withColumn("channel", F.trim("channel")).withColumn("body", F.trim("body"))
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return t.withColumn("reject", F.when(empty("channel"), "no_channel").when(empty("sender"), "no_sender").when(empty("body"), "no_body").when(F.col("reply_to") <= 0, "bad_reply"))


def page(messages: DataFrame, since: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The next messages of each channel after its cursor, and the new cursors (B2). `since`: channel, cursor."""
    j = messages.join(since, "channel").filter(F.col("id") > F.col("cursor"))
    rows = j.withColumn("place", F.row_number().over(Window.partitionBy("channel").orderBy("id"))).filter(F.col("place") <= limit).drop("cursor")
    return rows, rows.groupBy("channel").agg(F.max("id").alias("cursor"))


#: Ids of a bucket in which messages are counted before readers meet them.
BUCKET = 4096


def unread(messages: DataFrame, readers: DataFrame, cursor: str = "last_seen", bucket: int = BUCKET) -> DataFrame:
    """(reader, channel, unread) of all readers: addressed messages beyond each cursor.

    What is addressed to a reader is what goes to all and what goes to the reader, less the reader's own of both; each of
    these is counted by channel and bucket of ids, and readers meet the counts, and the messages of their cursor's bucket only."""
    everyone = F.coalesce("recipient", F.lit("")) == ""
    one = lambda who, n: F.struct(who.alias("who"), F.lit(n).alias("n"))
    marks = F.array(F.when(everyone, one(F.lit(None).cast("string"), 1)).otherwise(one(F.col("recipient"), 1)), F.when(everyone | (F.col("recipient") == F.col("sender")), one(F.col("sender"), -1)))
    each = messages.filter("sender IS NOT NULL").select("channel", "id", F.floor(F.col("id") / bucket).alias("b"), F.explode(F.array_compact(marks)).alias("m")).select("channel", "id", "b", F.col("m.who").alias("who"), F.col("m.n").alias("n"))
    counts = each.groupBy("channel", "who", "b").agg(F.sum("n").alias("n"))
    at = F.coalesce(F.col(cursor), F.lit(-1))
    asked = readers.select("reader", F.col("channel").alias("c"), at.alias("at"), F.floor(at / bucket).alias("ab"), F.explode(F.array(F.lit(None).cast("string"), F.col("reader"))).alias("w"))
    on = lambda df: (F.col("c") == df["channel"]) & F.col("w").eqNullSafe(df["who"])
    whole = asked.join(counts, on(counts) & (F.col("b") > F.col("ab"))).select("reader", "channel", "n")
    part = asked.join(each, on(each) & (F.col("b") == F.col("ab")) & (F.col("id") > F.col("at"))).select("reader", "channel", "n")
    sums = whole.unionByName(part).groupBy("reader", "channel").agg(F.sum("n").alias("unread"))
    return readers.select("reader", "channel").join(sums, ["reader", "channel"], "left").fillna(0, ["unread"])


def inbox(messages: DataFrame, readers: DataFrame) -> DataFrame:
    """(reader, channel, unread, next) of addressed messages beyond each cursor (B3). `readers`: reader, channel, last_seen."""
    last = messages.groupBy("channel").agg(F.max("id").alias("next"))
    beyond = F.col("next").isNull() | (F.col("next") > F.coalesce("last_seen", F.lit(-1)))
    return readers.join(last, "channel", "left").filter(beyond).select("reader", "channel", "next").join(unread(messages, readers), ["reader", "channel"]).select("reader", "channel", "unread", "next")


def merged_cursors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cursors never move back, and null keeps the old."""
    return old.unionByName(new).groupBy("reader", "channel").agg(F.max("last_seen").alias("last_seen"))


def preview(body: Column, chars: int = 80) -> Column:
    return F.substring(F.trim(F.regexp_replace(body, r"[\s\p{Cntrl}]+", " ")), 1, chars)


def newest(messages: DataFrame, readers: DataFrame, by: list[str], most: int, cursor: str = "last_seen") -> DataFrame:
    """The newest addressed messages beyond the cursors, `most` for each of `by`. Only the newest of each sender to each
    recipient take part, so readers do not meet whole channels."""
    rank = F.row_number().over(Window.partitionBy("channel", "sender", "recipient").orderBy(F.desc("id")))
    few = messages.withColumn("_k", rank).filter(F.col("_k") <= most).drop("_k")
    j = readers.join(few, "channel").filter((F.col("id") > F.coalesce(cursor, F.lit(-1))) & targets(F.col("sender"), F.col("recipient"), F.col("reader")))
    return j.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("id")))).filter(F.col("place") <= most)


def digest(messages: DataFrame, readers: DataFrame, most: int = 5) -> DataFrame:
    """For each reader the newest addressed messages, as one text, and their total."""
    total = unread(messages, readers).groupBy("reader").agg(F.sum("unread").alias("total"))
    line = F.concat_ws(" ", F.concat(F.lit("#"), "id"), F.concat("sender", F.lit(":")), preview(F.col("body")))
    top = newest(messages, readers, ["reader"], most).groupBy("reader").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return top.join(total, "reader").select("reader", "total", "text")


def notifications(messages: DataFrame, readers: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """(reader, channel, total, text): what a reader is told of a channel: the number of new messages, who is there, the newest
    messages and how many more (B5). `readers`: reader, channel, last_seen, last_hook_at; messages have a kind."""
    total = unread(messages, readers).filter("unread > 0").withColumnRenamed("unread", "total")
    heard = readers.filter("last_hook_at IS NOT NULL").withColumn("live", F.col("last_hook_at") >= now - F.make_dt_interval(secs=F.lit(300.0)))
    names = lambda cond: F.array_join(F.sort_array(F.collect_set(F.when(cond, F.col("reader")))), ", ")
    there = heard.groupBy("channel").agg(names(F.col("live")).alias("live"), names(~F.col("live")).alias("stale"))
    who = F.concat("sender", F.lit(" ("), "kind", F.when(F.coalesce("recipient", F.lit("")) != "", F.concat(F.lit(" → "), "recipient")).otherwise(""), F.lit(")"))
    line = F.concat(F.lit("  • #"), "id", F.lit(" "), who, F.lit(' — "'), preview(F.col("body")), F.lit('"'))
    top = newest(messages, readers, ["reader", "channel"], most).groupBy("reader", "channel").agg(F.count("*").alias("shown"), F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]).alias("lines"))
    j = total.join(top, ["reader", "channel"]).join(there, "channel", "left")
    first = F.concat(F.lit("[bus] "), "channel", F.lit(" — "), "total", F.when(F.col("total") == 1, " new message:").otherwise(" new messages:"))
    named = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{c}: "), c))
    bits = F.concat_ws(" | ", named("live"), named("stale"))
    seen = F.when(bits != "", F.concat(F.lit("  • presence — "), bits))
    rest = F.when(F.col("total") > F.col("shown"), F.concat(F.lit("  • …and "), F.col("total") - F.col("shown"), F.lit(" more")))
    text = F.array_join(F.array_compact(F.concat(F.array(first, seen), F.col("lines"), F.array(rest))), "\n")
    return j.select("reader", "channel", "total", text.alias("text"))


def presence(beats: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """Live if the last beat is at most five minutes old (B6). Columns: session, at."""
    return beats.groupBy("session").agg(F.max("at").alias("last")).withColumn("live", F.col("last") >= now - F.make_dt_interval(secs=F.lit(float(seconds))))


def due(messages: DataFrame, readers: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Messages with the readers (reader, channel, cursor) that they address beyond their cursors.

    A message meets a reader by channel, bucket of ids and addressee (all, or the reader), so direct messages meet their
    recipient only, a busy channel is many keys, and ids are compared in the bucket of the cursor alone."""
    to = F.nullif(F.coalesce("recipient", F.lit("")), F.lit("")).alias("_to")
    m = messages.filter("sender IS NOT NULL").select("*", to, F.floor(F.col("id") / bucket).alias("_b"))
    slots = m.select(F.col("channel").alias("_c"), F.col("_b").alias("_slot")).distinct()
    at = F.coalesce("cursor", F.lit(-1))
    asked = readers.select("reader", F.col("channel").alias("_channel"), at.alias("_at"), F.floor(at / bucket).alias("_first"))
    asked = asked.join(slots, (F.col("_channel") == F.col("_c")) & (F.col("_slot") >= F.col("_first")))
    asked = asked.select("reader", "_channel", "_at", "_slot", F.explode(F.array(F.lit(None).cast("string"), F.col("reader"))).alias("_who"))
    j = asked.join(m, (F.col("_channel") == F.col("channel")) & (F.col("_slot") == F.col("_b")) & F.col("_who").eqNullSafe(F.col("_to")))
    return j.filter((F.col("id") > F.col("_at")) & (F.col("sender") != F.col("reader"))).select("reader", *messages.columns)


def deliveries(messages: DataFrame, sessions: DataFrame, delivered: DataFrame) -> DataFrame:
    """(message_id, session) that are due and not delivered before (B7). `sessions`: session, channel, last_seen."""
    met = due(messages, sessions.select(F.col("session").alias("reader"), "channel", F.col("last_seen").alias("cursor")))
    return met.select(F.col("id").alias("message_id"), F.col("reader").alias("session")).distinct().join(delivered, ["message_id", "session"], "left_anti")


def pruned(messages: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` of each channel (B8); children follow by a semi-join on id."""
    return messages.withColumn("_k", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("id")))).filter(F.col("_k") <= keep).drop("_k")


def pruned_with_children(messages: DataFrame, deliveries: DataFrame, runs: DataFrame, keep: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The newest `keep` messages of each channel, and the deliveries (message_id) and runs (trigger_message_id) of those."""
    kept = pruned(messages, keep)
    ids = kept.select(F.col("id").alias("_id"))
    of = lambda df, c: df.join(ids, F.col(c) == F.col("_id"), "left_semi")
    return kept, of(deliveries, "message_id"), of(runs, "trigger_message_id")


def status(messages: DataFrame, readers: DataFrame) -> DataFrame:
    """Each participant's last message and unread count."""
    last = messages.groupBy("channel", F.col("sender").alias("reader")).agg(F.max("id").alias("last_message"), F.max_by("body", "id").alias("last_body"))
    told = inbox(messages, readers).select("reader", "channel", "unread")  # where there is anything beyond the cursor
    return readers.join(last, ["channel", "reader"], "left").join(told, ["reader", "channel"], "left")


HEARTBEATS = ("heartbeat", "status")


def reader_status(messages: DataFrame, readers: DataFrame, now: Column) -> DataFrame:
    """(channel, reader, unread_messages, unread_notifications, presence, last_heartbeat) of each reader.

    `readers`: reader, channel, last_seen, notify_cursor, last_hook_at; messages have a kind."""
    every = messages.select("channel", "id", F.lit("").alias("sender"), F.lit(None).cast("string").alias("recipient"))
    all_ = unread(every, readers).withColumnRenamed("unread", "unread_messages")
    told = unread(messages, readers, "notify_cursor").withColumnRenamed("unread", "unread_notifications")
    beat = messages.filter(F.col("kind").isin(*HEARTBEATS)).groupBy("channel", F.col("sender").alias("reader")).agg(F.max("id").alias("last_heartbeat"))
    live = F.col("last_hook_at") >= now - F.make_dt_interval(secs=F.lit(300.0))
    seen = F.when(F.col("last_hook_at").isNull(), "unknown").when(live, "live").otherwise("stale")
    j = readers.join(all_, ["reader", "channel"]).join(told, ["reader", "channel"]).join(beat, ["channel", "reader"], "left")
    return j.select("channel", "reader", "unread_messages", "unread_notifications", seen.alias("presence"), "last_heartbeat")


def participants(messages: DataFrame) -> DataFrame:
    """(channel, sender, messages, last_message, last_heartbeat, last_control): who takes part, and a channel's last control."""
    beat = F.max(F.when(F.col("kind").isin(*HEARTBEATS), F.col("id")))
    each = messages.groupBy("channel", "sender").agg(F.count("*").alias("messages"), F.max("id").alias("last_message"), beat.alias("last_heartbeat"))
    control = messages.filter("kind = 'control'").groupBy("channel").agg(F.max("id").alias("last_control"))
    return each.join(control, "channel", "left")


def delivery_list(deliveries: DataFrame, channel: str | None = None, session_id: str | None = None, most: int = 100) -> DataFrame:
    """The newest deliveries of a channel or a session."""
    for name, value in (("channel", channel), ("session_id", session_id)):
        if value is not None:
            deliveries = deliveries.filter(F.col(name) == value)
    return deliveries.orderBy(F.desc("id")).limit(most)


def channels(messages: DataFrame) -> DataFrame:
    """B13."""
    return messages.groupBy("channel").agg(F.count("*").alias("messages"), F.countDistinct("sender").alias("senders"), F.max("id").alias("last"))


def tail(messages: DataFrame, n: int) -> DataFrame:
    return pruned(messages, n).select("channel", "id", "sender")


def sessions(rows: DataFrame) -> DataFrame:
    """The latest row of each session, whose id is a hash of its parts."""
    sid = F.substring(F.sha2(F.concat_ws("\n", "host", "user", "channel"), 256), 1, 16)
    return rows.withColumn("session_id", sid).groupBy("session_id").agg(F.max_by(F.struct("state", "at"), F.struct("at", "state")).alias("s")).select("session_id", "s.state", "s.at")


def runnable(agents: DataFrame, messages: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """(agent, message_id) that enabled agents below their concurrency and not cooling down have to run.

    Agents: agent, channel, enabled, concurrency, cooldown_s; runs: agent, message_id, state, at."""
    load = runs.groupBy("agent").agg(F.count_if(F.col("state") == "running").alias("active"), F.max(F.when(F.col("state") == "failed", F.col("at"))).alias("failed_at"))
    a = agents.join(load, "agent", "left").fillna(0, ["active"])
    cooled = F.col("failed_at").isNull() | (F.col("failed_at") + F.make_dt_interval(secs=F.col("cooldown_s").cast("double")) <= now)
    free = a.filter(F.col("enabled") & (F.col("active") < F.col("concurrency")) & cooled)
    met = due(messages.filter("needs_agent"), free.select(F.col("agent").alias("reader"), "channel", F.lit(None).cast("long").alias("cursor"))).select(F.col("reader").alias("agent"), "channel", F.col("id").alias("message_id"))
    todo = met.join(runs.select("agent", "message_id"), ["agent", "message_id"], "left_anti").join(free.select("agent", "channel", "concurrency", "active"), ["agent", "channel"])
    place = F.row_number().over(Window.partitionBy("agent").orderBy("message_id"))
    return todo.withColumn("place", place).filter(F.col("place") <= F.col("concurrency") - F.col("active")).select("agent", "message_id")
