"""R: reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteloom.operators import reports as R
from noteloom.sources import views as V

from .base import query

NOW = "2024-02-01 00:00:00"
WEEK = 7 * 86_400


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("SELECT count(*) AS total, count(s.doc_id) AS retrieved, round(count(s.doc_id) / count(*), 6) AS coverage FROM notes n LEFT JOIN (SELECT DISTINCT doc_id FROM retrievals) s ON n.id = s.doc_id WHERE superseded_at IS NULL", ("notes", "retrievals"))
def r1_coverage(spark, sf_dir):
    return R.coverage(V.notes(spark, sf_dir), V.retrievals(spark, sf_dir))


@query("SELECT doc_type, count(*) AS total, count(s.doc_id) AS retrieved, round(count(s.doc_id) / count(*), 6) AS coverage FROM notes n LEFT JOIN (SELECT DISTINCT doc_id FROM retrievals) s ON n.id = s.doc_id WHERE superseded_at IS NULL GROUP BY doc_type", ("notes", "retrievals"))
def r2_coverage_by_type(spark, sf_dir):
    return R.coverage(V.notes(spark, sf_dir), V.retrievals(spark, sf_dir), ("doc_type",))


@query(f"SELECT count(*) AS written, count_if(f <= created_at + INTERVAL 30 DAY)::BIGINT AS read_in_time FROM notes LEFT JOIN (SELECT doc_id, min(created_at) AS f FROM retrievals GROUP BY doc_id) ON id = doc_id WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY", ("notes", "retrievals"))
def r3_freshness(spark, sf_dir):
    return R.freshness(V.notes(spark, sf_dir), V.retrievals(spark, sf_dir), now())


@query("SELECT count(*) AS hints, count_if(EXISTS (SELECT 1 FROM retrievals r WHERE r.surface = 'kb_read' AND r.session = h.session AND r.doc_id = h.doc_id AND r.created_at > h.created_at))::BIGINT AS followed FROM retrievals h WHERE surface = 'hint'", ("retrievals",))
def r4_followed_rows(spark, sf_dir):
    return R.followed_rows(V.retrievals(spark, sf_dir))


@query("SELECT count_if(surface IN ('hint', 'briefing'))::BIGINT AS pushed, count_if(surface NOT IN ('hint', 'briefing'))::BIGINT AS pulled, count(session) AS with_session, count(*) AS total FROM retrievals", ("retrievals",))
def r5_push_pull(spark, sf_dir):
    return R.push_pull(V.retrievals(spark, sf_dir))


@query(", r AS (SELECT surface, CASE WHEN id % 7 <> 0 THEN doc_id END AS doc_id FROM retrievals) SELECT surface, count(*) AS total, count_if(doc_id IS NULL)::BIGINT AS misses, round(count_if(doc_id IS NULL) / count(*), 6) AS miss_rate FROM r GROUP BY surface", ("retrievals",))
def r6_misses(spark, sf_dir):
    rows = V.retrievals(spark, sf_dir)
    return R.misses(rows.withColumn("doc_id", F.when(F.col("id") % 7 != 0, F.col("doc_id"))))


@query(""", p AS (SELECT session, created_at AS ts, id, surface = 'hint' AS fired, surface = 'kb_context' AS nudge FROM retrievals WHERE session IS NOT NULL),
q AS (SELECT *, lag(fired) OVER (PARTITION BY session ORDER BY ts, id) AS before FROM p)
SELECT count(*) AS nudges, count_if(before)::BIGINT AS after_fire, count_if(NOT before)::BIGINT AS after_silence, count_if(before IS NULL)::BIGINT AS first_prompt FROM q WHERE nudge""", ("retrievals",))
def r7_asked_to_look(spark, sf_dir):
    rows = V.retrievals(spark, sf_dir)
    return R.asked_to_look(rows.select("session", F.col("created_at").alias("at"), "id", (F.col("surface") == "hint").alias("fired"), (F.col("surface") == "kb_context").alias("nudge")))


EVENTS = """, events_ AS (
  SELECT surface, coalesce(event_id, concat_ws('|', coalesce(session, ''), surface, strftime(created_at, '%Y-%m-%d %H:%M:%S'), query)) AS event,
         min(created_at) AS ts, max(session) AS session, list_sort(list_filter(list_distinct(list(doc_id)), lambda x: x IS NOT NULL)) AS docs, bool_or(is_test) AS is_test, arg_min(query, (created_at, id)) AS asked
  FROM retrievals GROUP BY ALL),
classed AS (SELECT *, CASE WHEN session IS NULL THEN 'unattributable' WHEN is_test THEN 'test' WHEN surface = 'hint' AND regexp_matches(asked, '^<(agent-message|task-notification)') THEN 'envelope' END AS class FROM events_)"""
MARKED = EVENTS + """, hits AS (
  SELECT surface, event, bool_or(t <= ts + INTERVAL 7 DAY) AS in_window, min({'t': t, 'rid': rid}) FILTER (WHERE t <= ts + INTERVAL 7 DAY) AS first
  FROM (SELECT surface, event, ts, session, unnest(docs) AS d FROM classed) e JOIN (SELECT session AS s, doc_id AS rd, created_at AS t, id AS rid FROM retrievals WHERE surface = 'kb_read') r ON e.session = r.s AND e.d = r.rd AND r.t >= e.ts GROUP BY ALL),
marked AS (SELECT c.*, coalesce(h.in_window, FALSE) AS in_window, h.in_window IS NOT NULL AS ever, first['t'] AS first_read_at, first['rid'] AS first_read FROM classed c LEFT JOIN hits h USING (surface, event))"""


@query(EVENTS + " SELECT surface, event, strftime(ts, '%Y-%m-%d %H:%M:%S') AS happened, session, array_to_string(docs, ',') AS docs, is_test, class FROM classed", ("retrievals",))
def r8_events(spark, sf_dir):
    e = R.events(V.retrievals(spark, sf_dir))
    return e.select("surface", "event", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("happened"), "session", F.array_join("docs", ",").alias("docs"), "is_test", "class")


def marked(spark, sf_dir, window_s=WEEK):
    rows = V.retrievals(spark, sf_dir)
    return R.followed(R.events(rows), rows, window_s)


@query(MARKED + " SELECT surface, event, in_window, ever FROM marked WHERE surface IN ('hint', 'briefing')", ("retrievals",))
def r9_followed(spark, sf_dir):
    return marked(spark, sf_dir).filter(F.col("surface").isin(*R.PUSHED)).select("surface", "event", "in_window", "ever")


@query(MARKED + " SELECT surface, event, first_read, strftime(first_read_at, '%Y-%m-%d %H:%M:%S') AS first_read_at FROM marked WHERE surface IN ('hint', 'briefing') AND in_window", ("retrievals",))
def r10_first_read(spark, sf_dir):
    m = marked(spark, sf_dir).filter(F.col("surface").isin(*R.PUSHED) & F.col("in_window"))
    return m.select("surface", "event", "first_read", F.date_format("first_read_at", "yyyy-MM-dd HH:mm:ss").alias("first_read_at"))


@query(MARKED + """ SELECT surface, count(*) AS events, count_if(class = 'unattributable')::BIGINT AS unattributable, count_if(class = 'test')::BIGINT AS test, count_if(class = 'envelope')::BIGINT AS envelope,
count_if(class IS NULL AND len(docs) > 0)::BIGINT AS fires, count_if(class IS NULL AND len(docs) = 0)::BIGINT AS declines, count_if(class IS NULL AND len(docs) > 0 AND in_window)::BIGINT AS followed,
count_if(class IS NULL AND len(docs) > 0 AND ever)::BIGINT AS followed_ever, round(followed / nullif(fires, 0), 6) AS rate, round(followed_ever / nullif(fires, 0), 6) AS rate_ever FROM marked GROUP BY surface""", ("retrievals",))
def r11_surface_stats(spark, sf_dir):
    return R.surface_stats(marked(spark, sf_dir))


@query(MARKED + """ SELECT count(*) AS fires, count_if(in_window)::BIGINT AS followed FROM marked WHERE surface = 'briefing' AND class IS NULL""", ("retrievals",))
def r12_trigger_fires(spark, sf_dir):
    m = marked(spark, sf_dir).filter("surface = 'briefing' AND class IS NULL")
    return m.agg(F.count("*").alias("fires"), F.count_if("in_window").alias("followed"))


@query()
def r13_bootstrap(spark, sf_dir):
    m = marked(spark, sf_dir).filter("class IS NULL AND surface IN ('hint', 'briefing')")
    return R.bootstrap(m.select("session", F.col("ever").alias("followed")), iterations=500)


@query(MARKED + """ SELECT 'all' AS part, count(*) AS events, count_if(class IS NULL)::BIGINT AS counted, count_if(class IS NULL AND in_window)::BIGINT AS followed FROM marked
UNION ALL SELECT surface, count(*), count_if(class IS NULL)::BIGINT, count_if(class IS NULL AND in_window)::BIGINT FROM marked GROUP BY surface""", ("retrievals",))
def r14_follow_through(spark, sf_dir):
    m = marked(spark, sf_dir)
    sums = m.rollup("surface").agg(F.count("*").alias("events"), F.count_if(F.col("class").isNull()).alias("counted"), F.count_if(F.col("class").isNull() & F.col("in_window")).alias("followed"))
    return sums.select(F.coalesce("surface", F.lit("all")).alias("part"), "events", "counted", "followed")


@query(", f AS (SELECT tool, ok, duration_ms, result_chars FROM tool_calls) SELECT tool, count(*) AS calls, count_if(NOT ok)::BIGINT AS failed, count_if(result_chars <= 80)::BIGINT AS empty, CAST(floor(sum(duration_ms) / count(*)) AS BIGINT) AS mean_ms, max(duration_ms) AS max_ms FROM f GROUP BY tool", ("tool_calls",))
def r15_tool_demand(spark, sf_dir):
    calls = V.tool_calls(spark, sf_dir)
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    old, new = R.tool_partials(calls.filter(F.col("created_at") < cut)), R.tool_partials(calls.filter(F.col("created_at") >= cut))
    return R.tool_demand(old.unionByName(new))


@query("SELECT tool, count(*) AS n, list_sort(list(duration_ms))[CAST(least(floor(count(*) * 0.5), count(*) - 1) AS INTEGER) + 1] AS p50, list_sort(list(duration_ms))[CAST(least(floor(count(*) * 0.9), count(*) - 1) AS INTEGER) + 1] AS p90 FROM tool_calls GROUP BY tool", ("tool_calls",))
def r16_percentiles(spark, sf_dir):
    return R.percentiles(V.tool_calls(spark, sf_dir), "tool", "duration_ms")


DECISIONS = ", d AS (SELECT event_id % 1000 AS doc_id, (event_id * 37 % 1000) / 1000.0 AS s FROM events)"


@query(DECISIONS + " SELECT CAST(floor(s * 10) AS DOUBLE) / 10 AS band, count(*) AS decisions, count_if(s >= 0.85)::BIGINT AS refused, count(n.id) AS later_retired FROM d LEFT JOIN (SELECT id FROM notes WHERE superseded_at IS NOT NULL) n ON d.doc_id = n.id GROUP BY 1", ("notes",))
def r17_decision_bands(spark, sf_dir):
    e = V.read(spark, sf_dir, "events")
    score = (F.col("event_id") * 37 % 1000).cast("decimal(10,3)") / F.lit(1000).cast("decimal(4,0)")
    d = e.select((F.col("event_id") % 1000).alias("doc_id"), score.alias("nearest_score"), (score >= 0.85).alias("refused"))
    return R.decision_bands(d, V.notes(spark, sf_dir))


@query(f"""SELECT 'retrievals' AS log, count(*) AS rows, date_diff('day', min(created_at), TIMESTAMP '{NOW}')::INTEGER AS age_days, round(count_if(created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) / 7, 6) AS rows_per_day FROM retrievals
UNION ALL SELECT 'tool_calls', count(*), date_diff('day', min(created_at), TIMESTAMP '{NOW}')::INTEGER, round(count_if(created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) / 7, 6) FROM tool_calls""", ("retrievals", "tool_calls"))
def r18_growth(spark, sf_dir):
    return R.growth({"retrievals": V.retrievals(spark, sf_dir), "tool_calls": V.tool_calls(spark, sf_dir)}, now())


@query("SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, tool, count(*) AS calls, count_if(NOT ok)::BIGINT AS failed, CAST(sum(duration_ms) AS BIGINT) AS total_ms, max(duration_ms) AS max_ms FROM tool_calls WHERE created_at < TIMESTAMP '2024-01-15' GROUP BY ALL", ("tool_calls",))
def r19_prune(spark, sf_dir):
    calls = V.tool_calls(spark, sf_dir)
    _, rolled = R.prune(calls, R.tool_partials(calls.limit(0)), F.lit("2024-01-15").cast("timestamp_ntz"))
    return rolled.select(F.col("day").cast("string").alias("day"), "tool", "calls", "failed", "total_ms", "max_ms")


@query("SELECT count(*) AS notes, count_if(superseded_at IS NULL)::BIGINT AS live, CAST(sum(length(content)) AS BIGINT) AS chars, count(DISTINCT doc_type) AS types FROM notes", ("notes",))
def r20_stats(spark, sf_dir):
    n = V.notes(spark, sf_dir)
    return n.agg(F.count("*").alias("notes"), F.count_if(F.col("superseded_at").isNull()).alias("live"), F.sum(F.length("content").cast("long")).alias("chars"), F.countDistinct("doc_type").alias("types"))


@query("SELECT tier, count(*) AS notes, count(*) OVER () > 1 AS discriminates FROM notes WHERE superseded_at IS NULL GROUP BY tier", ("notes",))
def r21_tiers(spark, sf_dir):
    from pyspark.sql.window import Window

    live = V.notes(spark, sf_dir).filter("superseded_at IS NULL").groupBy("tier").agg(F.count("*").alias("notes"))
    return live.withColumn("discriminates", F.count("*").over(Window.partitionBy(F.lit(0))) > 1)  # as many rows as tiers


@query(""" SELECT count(*) AS notes, count(e.vec_id) AS with_vector, count_if(length(content) >= 100)::BIGINT AS summarisable, count_if(length(content) >= 100 AND id % 3 <> 0)::BIGINT AS with_summary FROM notes LEFT JOIN embeddings e ON notes.id = e.vec_id WHERE superseded_at IS NULL""", ("notes",))
def r22_health(spark, sf_dir):
    n = V.notes(spark, sf_dir).filter("superseded_at IS NULL").select("id", F.length("content").alias("n"))
    j = n.join(V.vectors(spark, sf_dir).select(F.col("id").alias("vid")), F.col("id") == F.col("vid"), "left")
    return j.agg(F.count("*").alias("notes"), F.count("vid").alias("with_vector"), F.count_if(F.expr("n >= 100")).alias("summarisable"), F.count_if(F.expr("n >= 100 AND id % 3 <> 0")).alias("with_summary"))


@query("SELECT 'type' AS dim, doc_type AS name, count(*) AS notes FROM notes GROUP BY doc_type UNION ALL SELECT 'project', project, count(*) FROM notes GROUP BY project", ("notes",))
def r23_index_status(spark, sf_dir):
    n = V.notes(spark, sf_dir)
    sums = n.groupingSets([["doc_type"], ["project"]], "doc_type", "project").agg(F.count("*").alias("notes"), F.grouping("doc_type").alias("g"))
    return sums.select(F.when(F.col("g") == 0, "type").otherwise("project").alias("dim"), F.when(F.col("g") == 0, F.col("doc_type")).otherwise(F.col("project")).alias("name"), "notes")


@query(""", s AS (SELECT id, 'state' AS part FROM notes WHERE doc_type = 'state' AND superseded_at IS NULL ORDER BY created_at DESC, id LIMIT 3), r AS (SELECT id, 'recent' AS part FROM notes WHERE superseded_at IS NULL ORDER BY created_at DESC, id LIMIT 10)
SELECT part, CAST(id AS VARCHAR) AS name, 1::BIGINT AS n FROM s UNION ALL SELECT part, CAST(id AS VARCHAR), 1 FROM r UNION ALL SELECT 'type', doc_type, count(*) FROM notes WHERE superseded_at IS NULL GROUP BY doc_type""", ("notes",))
def r24_briefing(spark, sf_dir):
    live = V.notes(spark, sf_dir).filter("superseded_at IS NULL")
    top = lambda df, part, n: df.orderBy(F.desc("created_at"), "id").limit(n).select(F.lit(part).alias("part"), F.col("id").cast("string").alias("name"), F.lit(1).cast("long").alias("n"))
    types = live.groupBy("doc_type").agg(F.count("*").alias("n")).select(F.lit("type").alias("part"), F.col("doc_type").alias("name"), "n")
    return top(live.filter("doc_type = 'state'"), "state", 3).unionByName(top(live, "recent", 10)).unionByName(types)


@query(""", s AS (SELECT session, arg_max(doc_id, (r.created_at, r.id)) AS last_read FROM retrievals r JOIN notes n ON r.doc_id = n.id WHERE n.doc_type = 'state' AND r.session IS NOT NULL GROUP BY session),
newest AS (SELECT arg_max(id, created_at) AS id FROM notes WHERE doc_type = 'state' AND superseded_at IS NULL)
SELECT a.session, coalesce(s.last_read, (SELECT id FROM newest)) AS state_note FROM (SELECT DISTINCT session FROM retrievals WHERE session IS NOT NULL) a LEFT JOIN s USING (session)""", ("notes", "retrievals"))
def r25_active_state(spark, sf_dir):
    r, n = V.retrievals(spark, sf_dir).filter("session IS NOT NULL"), V.notes(spark, sf_dir).filter("doc_type = 'state'")
    newest = n.filter("superseded_at IS NULL").agg(F.max_by("id", "created_at").alias("newest")).first()[0]
    read = r.join(n.select(F.col("id").alias("nid")), F.col("doc_id") == F.col("nid")).groupBy("session").agg(F.max_by("doc_id", F.struct("created_at", "id")).alias("last"))
    return r.select("session").distinct().join(read, "session", "left").select("session", F.coalesce("last", F.lit(newest)).alias("state_note"))


@query("SELECT id, title, project FROM notes WHERE created_at >= TIMESTAMP '2024-01-20' AND doc_type NOT IN ('session')", ("notes",))
def r26_recent(spark, sf_dir):
    return V.notes(spark, sf_dir).filter((F.col("created_at") >= F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("doc_type") != "session")).select("id", "title", "project")


@query(", r AS (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id) AS place, count(*) OVER (PARTITION BY project) AS n FROM notes) SELECT project, id, place::INTEGER AS place, n FROM r WHERE place <= 5", ("notes",))
def r27_review(spark, sf_dir):
    from pyspark.sql.window import Window

    n = V.notes(spark, sf_dir).select("project", "id", "created_at")
    top = n.withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("created_at"), "id"))).filter("place <= 5")
    return top.join(n.groupBy("project").agg(F.count("*").alias("n")), "project").select("project", "id", "place", "n")


@query(", s AS (SELECT project, id, created_at, substr(content, 1, 2000) AS body, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id) AS k FROM notes WHERE doc_type = 'session') SELECT project, count(*) AS sessions, string_agg(id, ',' ORDER BY created_at, id) AS ids, CAST(sum(length(body)) AS BIGINT) AS chars FROM s WHERE k <= 15 GROUP BY project", ("notes",))
def r28_session_rollup(spark, sf_dir):
    from pyspark.sql.window import Window

    s = V.notes(spark, sf_dir).filter("doc_type = 'session'").select("project", "id", "created_at", F.substring("content", 1, 2000).alias("body"))
    last = s.withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("created_at"), "id"))).filter("k <= 15")
    rows = F.array_sort(F.collect_list(F.struct("created_at", "id")))
    return last.groupBy("project").agg(F.count("*").alias("sessions"), F.array_join(F.transform(rows, lambda x: x["id"].cast("string")), ",").alias("ids"), F.sum(F.length("body").cast("long")).alias("chars"))


@query("SELECT user_id AS action, bool_or(event_type = 'error') AS blocked, CASE max(CASE WHEN value > 400 THEN 3 WHEN value > 100 THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS risk, count(*) AS reviewers FROM events GROUP BY user_id")
def r29_verdicts(spark, sf_dir):
    e = V.read(spark, sf_dir, "events")
    risk = F.when(F.col("value") > 400, "high").when(F.col("value") > 100, "medium").otherwise("low")
    return R.verdicts(e.select(F.col("user_id").alias("action"), (F.col("event_type") != "error").alias("safe"), risk.alias("risk")))
