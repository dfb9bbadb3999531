"""P and S: filters, queues, registry upkeep and captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteloom.operators import notes as N
from noteloom.sources import files as X
from noteloom.sources import views as V

from .base import query

joined = lambda c: F.array_join(c, ",")
SLUG = "substr(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60)"


@query("SELECT id, doc_type FROM notes WHERE doc_type = 'research' AND list_contains(tags, 'en') AND superseded_at IS NULL ORDER BY created_at DESC, id LIMIT 20 OFFSET 5", ("notes",))
def p1_list(spark, sf_dir):
    return N.list_notes(V.notes(spark, sf_dir), "research", "en", 20, 5).select("id", "doc_type")


@query(", k AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) * 20 AS id FROM events) SELECT k.id, n.id AS found, n.tier FROM k LEFT JOIN notes n ON k.id = n.id", ("notes",))
def p2_by_ids(spark, sf_dir):
    ids = V.retrievals(spark, sf_dir).select((F.col("doc_id") * 20).alias("id")).distinct()
    return N.by_ids(ids, V.notes(spark, sf_dir)).select("id", "found", "tier")


@query("SELECT id FROM notes WHERE list_contains(tags, 'en') AND (list_contains(tags, 'src0') OR list_contains(tags, 'src1'))", ("notes",))
def p3_tags(spark, sf_dir):
    aliases = spark.createDataFrame([("src1", "src0"), ("english", "en")], "alias string, tag string")
    return N.with_tags(V.notes(spark, sf_dir), ["English", "src1"], aliases).select("id")


@query(", hits AS (SELECT DISTINCT doc_id FROM retrievals WHERE surface = 'kb_search') SELECT id FROM notes JOIN hits ON id = doc_id WHERE doc_type = 'decision' AND project = 'src0'", ("notes", "retrievals"))
def p4_post_filters(spark, sf_dir):
    hits = V.retrievals(spark, sf_dir).filter("surface = 'kb_search'").select(F.col("doc_id").alias("id"))
    return V.notes(spark, sf_dir).filter("doc_type = 'decision' AND project = 'src0'").join(hits, "id", "left_semi").select("id")


@query(", s AS (SELECT CASE WHEN id % 13 = 0 THEN 'Test-' || id WHEN id % 13 = 1 THEN 'fake_' || id WHEN id % 13 = 2 THEN 'testing' ELSE session END AS session FROM retrievals) SELECT coalesce(regexp_matches(session, '(?i)^(smoke|test|fake)[-_]') OR session IN ('test', 'smoke', 'fake'), FALSE) AS is_test, count(*) AS rows FROM s GROUP BY 1", ("retrievals",))
def p5_test_sessions(spark, sf_dir):
    i = F.col("id") % 13
    s = V.retrievals(spark, sf_dir).select(F.when(i == 0, F.concat(F.lit("Test-"), "id")).when(i == 1, F.concat(F.lit("fake_"), "id")).when(i == 2, "testing").otherwise(F.col("session")).alias("session"))
    return s.groupBy(N.is_test(F.col("session")).alias("is_test")).agg(F.count("*").alias("rows"))


@query(", log AS (SELECT id, surface, query, session || ' ' || strftime(created_at, '%Y-%m-%d') AS session FROM retrievals), gone AS (SELECT DISTINCT session FROM log WHERE surface = 'hint' AND query = 'q7' AND session NOT IN (SELECT session FROM log WHERE surface NOT IN ('hint', 'briefing') AND session IS NOT NULL)) SELECT id FROM log r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.session = r.session)", ("retrievals",))
def p6_self_traffic(spark, sf_dir):
    """A user's day is a session."""
    day = F.concat("session", F.lit(" "), F.date_format("created_at", "yyyy-MM-dd"))
    return N.without_self_traffic(V.retrievals(spark, sf_dir).withColumn("session", day), F.col("query") == "q7").select("id")


@query("SELECT conv_id, turn, coalesce(regexp_matches(t, '(?i)\\b(check|search|look (in|at|up)|consult|query)\\b.{0,40}\\b(kb|knowledge base|vault|notes)\\b'), FALSE) AS nudge, coalesce(length(trim(t)) >= 20 AND NOT regexp_matches(t, '^\\s*/'), FALSE) AS admitted FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'please check the KB: ' || text WHEN 1 THEN '/cmd ' || text ELSE text END AS t FROM conversations)")
def p7_p9_prompts(spark, sf_dir):
    k = F.col("turn") % 4
    t = F.when(k == 0, F.concat(F.lit("please check the KB: "), "text")).when(k == 1, F.concat(F.lit("/cmd "), "text")).otherwise(F.col("text"))
    return V.read(spark, sf_dir, "conversations").select("conv_id", "turn", N.is_nudge(t).alias("nudge"), N.admitted(t).alias("admitted"))


@query(", q AS (SELECT id, doc_type, content, CASE WHEN id % 3 = 0 THEN 'x' END AS summary, CASE WHEN id % 4 = 0 THEN 'x' END AS aliases FROM notes) SELECT id, 'classify' AS queue FROM q WHERE doc_type = 'session' UNION ALL SELECT id, 'summarise' FROM q WHERE summary IS NULL AND length(content) >= 100 UNION ALL SELECT id, 'aliases' FROM q WHERE aliases IS NULL", ("notes",))
def p13_queues(spark, sf_dir):
    n = V.notes(spark, sf_dir)
    kind = F.when(F.col("doc_type") == "session", "capture").otherwise(F.col("doc_type"))
    return N.queues(n.select("id", kind.alias("doc_type"), "content", F.when(F.col("id") % 3 == 0, "x").alias("summary"), F.when(F.col("id") % 4 == 0, "x").alias("aliases")))


@query("SELECT url, CASE WHEN page_id % 2 = 0 THEN 'tkt-' || page_id END AS ticket FROM pages")
def p14_tickets(spark, sf_dir):
    p = V.read(spark, sf_dir, "pages")
    path = F.concat(F.lit("/home/abc-1/work"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/TKT-"), "page_id", F.lit("/src"))).otherwise(F.lit("")))
    t = N.ticket(path)
    return p.select("url", F.when(t != "abc-1", t).alias("ticket"))


@query(", p AS (SELECT doc_id AS id, quality, toxic FROM labels) SELECT n.id, CASE WHEN p.id IS NOT NULL AND quality = 1 THEN 'Better ' || n.id ELSE title END AS title, array_to_string(CASE WHEN p.toxic = 1 THEN ['toxic'] ELSE tags END, ',') AS tags, p.id IS NOT NULL AS classified FROM notes n LEFT JOIN p ON n.id = p.id", ("notes",))
def p15_merge(spark, sf_dir):
    label = V.read(spark, sf_dir, "labels")
    proposals = label.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.concat(F.lit("Better "), "doc_id")).otherwise("").alias("title"), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).alias("tags"), F.lit(None).cast("string").alias("doc_type"))
    return N.merge_proposals(V.notes(spark, sf_dir), proposals).select("id", "title", joined("tags").alias("tags"), "classified")


def _files(spark, sf_dir):
    d = F.col("doc_id")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("decisions", "research", "projects/archive", "misc")]), (d % 4 + 1).cast("int"))
    head = F.concat(F.lit("---\ntitle: 'Doc "), d, F.lit("'\ntags: [A, "), "lang", F.lit(", a]\ndomains: "), "source", F.lit("\n---\n"))
    body = F.concat(F.when(d % 3 == 1, F.concat(F.lit("# Head "), d, F.lit("\n"))).otherwise(F.lit("")), "text")
    return V.read(spark, sf_dir, "documents").select(F.concat(folder, F.lit("/d"), d, F.lit(".md")).alias("path"), F.concat(F.when(d % 3 == 0, head).otherwise(F.lit("")), body).alias("content"), d.alias("doc_id"))


FILES = """WITH files AS (SELECT doc_id, ['decisions', 'research', 'projects/archive', 'misc'][doc_id % 4 + 1] AS folder, folder || '/d' || doc_id || '.md' AS path,
  (CASE WHEN doc_id % 3 = 0 THEN '---' || chr(10) || 'title: ''Doc ' || doc_id || '''' || chr(10) || 'tags: [A, ' || lang || ', a]' || chr(10) || 'domains: ' || source || chr(10) || '---' || chr(10) ELSE '' END)
  || (CASE WHEN doc_id % 3 = 1 THEN '# Head ' || doc_id || chr(10) ELSE '' END) || text AS content, lang, source FROM documents)
"""


@query(FILES + """SELECT path, CASE doc_id % 3 WHEN 0 THEN 'Doc ' || doc_id WHEN 1 THEN 'Head ' || doc_id ELSE 'd' || doc_id END AS title,
CASE doc_id % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'research' WHEN 2 THEN 'archive' ELSE 'note' END AS doc_type,
CASE WHEN doc_id % 3 = 0 THEN 'a,' || lang || ',' || source ELSE '' END AS tags, 'active' AS status FROM files""")
def s1_s2_front_matter(spark, sf_dir):
    return N.front_matter(_files(spark, sf_dir)).select("path", "title", "doc_type", joined("tags").alias("tags"), "status")


@query(FILES + """, now AS (SELECT path, substr(sha256(content), 1, 16) AS h FROM files WHERE doc_id % 10 <> 9), was AS (SELECT path, CASE WHEN doc_id % 10 = 1 THEN 'old' ELSE substr(sha256(content), 1, 16) END AS h FROM files WHERE doc_id % 10 <> 2)
SELECT coalesce(now.path, was.path) AS path, CASE WHEN was.path IS NULL THEN 'new' WHEN now.path IS NULL THEN 'deleted' WHEN now.h = was.h THEN 'unchanged' ELSE 'changed' END AS state FROM now FULL JOIN was ON now.path = was.path""")
def s3_classify(spark, sf_dir):
    f = _files(spark, sf_dir).select("path", "doc_id", N.content_hash(F.col("content")).alias("hash"))
    was = f.filter("doc_id % 10 <> 2").withColumn("hash", F.when(F.col("doc_id") % 10 == 1, "old").otherwise(F.col("hash")))
    return N.classify_files(f.filter("doc_id % 10 <> 9"), was)


@query("SELECT source AS path, arg_max(doc_id, doc_id) AS doc_id, TRUE AS fresh FROM documents WHERE doc_id % 2 = 1 AND source <> 'src3' GROUP BY source UNION ALL SELECT source, max(doc_id), FALSE FROM documents GROUP BY source HAVING count_if(doc_id % 2 = 1) = 0 AND source <> 'src3'")
def s4_s5_upsert_delete(spark, sf_dir):
    d = V.read(spark, sf_dir, "documents").select(F.col("source").alias("path"), "doc_id", F.col("doc_id").alias("at"), (F.col("doc_id") % 2 == 1).alias("fresh"))
    merged = N.upsert(d.filter("NOT fresh"), d.filter("fresh"), "path")
    return N.delete(merged, spark.createDataFrame([("src3",)], "path string"), "path").select("path", "doc_id", "fresh")


@query("SELECT 'f/' || page_id || '.' || CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' ELSE 'xyz' END AS path, CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' ELSE 'unknown' END AS kind, CASE WHEN page_id % 3 = 1 THEN '[pdf file: ' || page_id || '.pdf, ' || strlen(html) || ' bytes]' ELSE html END AS text FROM pages")
def s6_mixed(spark, sf_dir):
    ext = F.element_at(F.array(F.lit("html"), F.lit("pdf"), F.lit("xyz")), (F.col("page_id") % 3 + 1).cast("int"))
    f = V.read(spark, sf_dir, "pages").select(F.concat(F.lit("f/"), "page_id", F.lit("."), ext).alias("path"), F.encode("html", "UTF-8").alias("content"), F.octet_length("html").alias("length"))
    return X.mixed(f).select("path", "kind", "text")


@query("SELECT name, min(id) AS id FROM (SELECT substr(text, 1, 12) AS name, doc_id AS id FROM documents WHERE doc_id % 2 = 1) WHERE name NOT IN (SELECT substr(text, 1, 12) FROM documents WHERE doc_id % 2 = 0) GROUP BY name")
def s7_unseen(spark, sf_dir):
    d = V.read(spark, sf_dir, "documents").select(F.substring("text", 1, 12).alias("name"), F.col("doc_id").alias("id"))
    return N.unseen(d.filter("id % 2 = 1"), d.filter("id % 2 = 0"), "name", "id")


@query("SELECT doc_id AS id, coalesce(nullif(trim(string_split(text, chr(10))[1]), ''), 'untitled') AS title, CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE lang END AS doc_type, lang || ',x' AS tags, length(coalesce(text, '')) AS size FROM documents")
def s8_text_ingest(spark, sf_dir):
    d = V.read(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.when(F.col("doc_id") % 2 == 0, " ").otherwise(F.col("lang")).alias("doc_type"), F.concat(F.upper("lang"), F.lit(", x,"), "lang").alias("tags"), "text")
    return N.text_records(rows).select("id", "title", "doc_type", joined("tags").alias("tags"), F.length("content").cast("long").alias("size"))


RAW_SLUG = "substr(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), 1, {1})"
SAID = "c AS (SELECT conv_id AS id, arg_min(text, turn) AS title, max(text) AS last, count(*) AS n FROM conversations GROUP BY conv_id)"


def said(spark, sf_dir):
    c = V.read(spark, sf_dir, "conversations")
    g = c.groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", "turn").alias("title"), F.max("text").alias("last"), F.count("*").alias("n"))
    section = lambda head, text: F.struct(F.lit(head).alias("head"), text.alias("text"))
    return g.select("id", "title", "n", F.lit("2024-05-01").alias("day"), F.lpad((F.col("id") % 24).cast("string"), 4, "0").alias("clock"), F.concat(F.lit("http://v/"), "id").alias("url"), F.when(F.col("id") % 2 == 0, "p").alias("project"), F.array(F.lit("t")).alias("tags"), F.array(section("First", F.lit("")), section("Last", F.col("last"))).alias("sections"))


@query("WITH " + SAID + ", p AS (SELECT id, 'sources/youtube/2024-05-01-' || " + RAW_SLUG.format("title", 60) + " || '.md' AS path, title, last FROM c) SELECT min(id) AS id, path, arg_min(length('---' || chr(10) || 'title: \"' || replace(title, '\"', '\\\"') || '\"' || chr(10) || 'type: source' || chr(10) || 'url: \"http://v/' || id || '\"' || chr(10) || 'created: \"2024-05-01\"' || chr(10) || 'updated: \"2024-05-01\"' || chr(10) || CASE WHEN id % 2 = 0 THEN 'project: p' || chr(10) ELSE '' END || 'tags: [t, youtube]' || chr(10) || 'status: inbox' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || CASE WHEN last <> '' THEN chr(10) || '## Last' || chr(10) || last || chr(10) ELSE '' END), id) AS size FROM p GROUP BY path")
def s18_videos(spark, sf_dir):
    return N.captured(said(spark, sf_dir), "video").select("id", "path", F.length("note").cast("long").alias("size"))


@query("WITH " + SAID + ", p AS (SELECT id, 'builds/sessions/2024-05-01-' || lpad(CAST(id % 24 AS VARCHAR), 4, '0') || '-' || " + RAW_SLUG.format("title", 40) + " || '.md' AS path FROM c) SELECT max(id) AS id, path FROM p GROUP BY path")
def s18_sessions(spark, sf_dir):
    return N.captured(said(spark, sf_dir), "session").select("id", "path")


@query("WITH " + SAID + ", p AS (SELECT id, 'builds/fixes/2024-05-01-' || " + RAW_SLUG.format("title", 50) + " || '.md' AS path FROM c) SELECT max(id) AS id, path FROM p GROUP BY path")
def s18_fixes(spark, sf_dir):
    return N.captured(said(spark, sf_dir), "fix").select("id", "path")


@query("WITH " + SAID + ", p AS (SELECT id, 'sources/x-bookmarks/' || " + RAW_SLUG.format("title", 50) + " || '.md' AS path FROM c) SELECT min(id) AS id, path FROM p WHERE path NOT IN (SELECT path FROM p WHERE id % 5 = 0) GROUP BY path")
def s18_bookmarks(spark, sf_dir):
    rows = said(spark, sf_dir)
    held = N.captured(rows.filter("id % 5 = 0"), "bookmark")
    return N.captured(rows, "bookmark", held).select("id", "path")


@query(", w AS (SELECT n.*, CASE doc_type WHEN 'research' THEN 'research' WHEN 'decision' THEN 'decisions' WHEN 'session' THEN 'builds/sessions' ELSE 'inbox' END || '/2024-05-01-' || " + SLUG.format("title") + " || '.md' AS path FROM notes n), r AS (SELECT doc_id AS id, quality FROM labels) SELECT w.id, path, 'title: ' || CAST(to_json(title) AS VARCHAR) AS head, CASE WHEN r.id IS NOT NULL THEN '- [[n' || w.id || ']] — T' || w.id || CASE WHEN quality = 1 THEN ' (0.7)' ELSE ' (0.65)' END ELSE '' END AS links FROM w LEFT JOIN r ON w.id = r.id", ("notes",))
def s19_built(spark, sf_dir):
    w = V.notes(spark, sf_dir).select("id", "title", "doc_type", "content", joined("tags").alias("tags"), "project", F.lit(None).cast("string").alias("source"), "tier", F.lit(None).cast("string").alias("ref"), F.lit("2024-05-01").alias("day"))
    r = V.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(1).alias("place"), F.concat(F.lit("T"), "doc_id").alias("title"), F.concat(F.lit("x/n"), "doc_id", F.lit(".md")).alias("path"), F.when(F.col("quality") == 1, 0.7).otherwise(0.65).alias("score"))
    n = N.built(w, r)
    return n.select("id", "path", F.regexp_extract("note", "(?m)^title: .*$", 0).alias("head"), F.regexp_extract("note", r"\n\n## Related\n(- \[\[n[\s\S]*)$", 1).alias("links"))


@query("SELECT path, modified FROM (SELECT 'p' || c.doc_id AS path, c.n_chars AS modified, l.quality, l.toxic FROM documents c LEFT JOIN labels l ON c.doc_id = l.doc_id) WHERE quality IS NULL OR modified > 1500 OR toxic = 0 ORDER BY modified, path LIMIT 30")
def s12_select_work(spark, sf_dir):
    c = V.read(spark, sf_dir, "documents").select(F.concat(F.lit("p"), "doc_id").alias("path"), F.col("n_chars").alias("modified"))
    m = V.read(spark, sf_dir, "labels").select(F.concat(F.lit("p"), "doc_id").alias("path"), F.lit(1500).alias("mark"), (F.col("toxic") == 1).alias("facts_done"))
    return N.select_work(c, m)


@query(", q AS (SELECT DISTINCT conv_id AS query_id, CASE WHEN conv_id % 5 = 0 THEN 'smoke-' || conv_id ELSE 's' || conv_id END AS session FROM conversations) SELECT query_id, session, r.doc_id, conv_id_place AS place, regexp_matches(session, '(?i)^(smoke|test|fake)[-_]') AS is_test FROM q LEFT JOIN (SELECT turn * 7 AS doc_id, conv_id, turn AS conv_id_place FROM conversations WHERE conv_id % 3 > 0) r ON q.query_id = r.conv_id".lstrip(", ").replace("q AS", "WITH q AS", 1))
def s22_read_log(spark, sf_dir):
    c = V.read(spark, sf_dir, "conversations")
    q = c.select(F.col("conv_id").alias("query_id")).distinct().withColumn("session", F.when(F.col("query_id") % 5 == 0, F.concat(F.lit("smoke-"), "query_id")).otherwise(F.concat(F.lit("s"), "query_id")))
    return N.read_log(q, c.filter("conv_id % 3 > 0").select(F.col("conv_id").alias("query_id"), (F.col("turn") * 7).alias("doc_id"), F.col("turn").alias("place")))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN substr(repeat(props, 20), 1, 200) END AS error FROM events")
def s23_meter_rows(spark, sf_dir):
    e = V.read(spark, sf_dir, "events")
    return N.cut_errors(e.select("event_id", F.when(F.col("event_type") == "error", F.repeat("props", 20)).alias("error")))


@query("SELECT doc_id, min(turn) AS turn FROM (SELECT conv_id % 100 AS doc_id, turn FROM conversations) WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id")
def s24_undecided(spark, sf_dir):
    d = V.read(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 100).alias("doc_id")).agg(F.min("turn").alias("turn"))
    return N.undecided(d, V.read(spark, sf_dir, "labels"))


@query(", c AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'B, a,b' END AS tags, CASE WHEN toxic = 1 THEN 'verified' END AS tier FROM labels) SELECT n.id, CASE WHEN c.tags IS NOT NULL THEN 'b,a' ELSE array_to_string(n.tags, ',') END AS tags, coalesce(c.tier, n.tier) AS tier, CASE WHEN coalesce(c.tier, n.tier) = n.tier THEN 1 ELSE 2 END AS tier_at FROM notes n LEFT JOIN c ON n.id = c.id", ("notes",))
def s25_updated(spark, sf_dir):
    c = V.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "B, a,b").alias("tags"), F.when(F.col("toxic") == 1, "verified").alias("tier"), F.lit(2).alias("at"))
    return N.updated(V.notes(spark, sf_dir).withColumn("tier_at", F.lit(1)), c).select("id", joined("tags").alias("tags"), "tier", "tier_at")


@query("SELECT user_id % 20 AS key, max(event_id) AS event_id FROM events GROUP BY 1")
def s26_state(spark, sf_dir):
    return N.latest(V.read(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("key"), "event_id"), "key", "event_id")


@query("SELECT doc_id AS id, class, CASE class WHEN 'en' THEN 'english' ELSE 'first' END || '/' || " + SLUG.format("substr(text, 1, 30)") + " || '.md' AS path FROM (SELECT doc_id, text, unnest(list_distinct([lang, source])) AS class FROM documents) WHERE class IN ('en', 'src0')")
def s27_fan_out(spark, sf_dir):
    d = V.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 30).alias("title"), F.array("lang", "source").alias("classes"))
    return N.fan_out(d, {"en": "english", "src0": "first"})


@query("SELECT min(page_id) AS page_id, path FROM (SELECT page_id, 'inbox/' || coalesce(nullif(" + SLUG.format("regexp_extract(html, '<title>([^<]*)', 1)") + ", ''), 'page-' || page_id) || '.md' AS path FROM pages) GROUP BY path")
def s18_captures(spark, sf_dir):
    p = V.read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.col("html").alias("body"))
    return N.captures(p).select("page_id", "path")


@query(", r AS (SELECT id, CASE doc_type WHEN 'research' THEN 'research' WHEN 'decision' THEN 'decisions' WHEN 'session' THEN 'sessions' WHEN 'state' THEN 'projects' ELSE 'notes' END AS folder, coalesce(nullif(" + SLUG.format("title") + ", ''), 'untitled') AS slug FROM notes WHERE id NOT IN (SELECT doc_id FROM labels)) SELECT id, folder || '/' || slug || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.md' AS path FROM (SELECT *, row_number() OVER (PARTITION BY folder, slug ORDER BY id) AS k FROM r)", ("notes",))
def s20_routed(spark, sf_dir):
    return N.routed(V.notes(spark, sf_dir), V.read(spark, sf_dir, "labels"))


@query("SELECT 'f' || (page_id % 10) AS path, (row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id))::BIGINT AS n, 'T' || page_id AS title, url, 'body ' || page_id AS body FROM pages")
def s17_bookmarks(spark, sf_dir):
    p = V.read(spark, sf_dir, "pages").select(F.concat(F.lit("f"), F.col("page_id") % 10).alias("path"), F.struct("page_id", F.concat(F.lit("## [T"), "page_id", F.lit("]("), "url", F.lit(")\nbody "), "page_id").alias("t")).alias("s"))
    return N.bookmarks(p.groupBy("path").agg(F.concat(F.lit("intro\n"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "\n")).alias("content")))
