"""Notes: parsing, registry upkeep, filters, queues and captures. Latest rows are chosen per key, never in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Folder prefixes and the note type they stand for; the longest that fits wins.
PREFIX_TYPES = {"decisions/": "decision", "research/": "research", "sessions/": "session", "projects/": "project", "projects/archive/": "archive", "inbox/": "capture", "workflows/": "workflow", "ideas/": "idea"}
#: Sessions that tests and probes use (fixed values).
TEST_SESSION = r"(?i)^(smoke|test|fake)[-_]"
NUDGE = r"(?i)\b(check|search|look (in|at|up)|consult|query)\b.{0,40}\b(kb|knowledge base|vault|notes)\b"
ENVELOPE = r"^\s*<([a-z][a-z-]*)>[\s\S]*</\1>\s*$"


def split_tags(c: Column) -> Column:
    """A comma list as distinct lower-case tags in first order (K1)."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def front_matter(files: DataFrame) -> DataFrame:
    """(path, content) to title, doc_type, tags, status and body (S2): the head's plain `key: value` lines are read natively."""
    head = F.regexp_extract("content", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    body = F.regexp_replace("content", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    field = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*)$", 1), "^[\"']|[\"']$", "")), F.lit(""))
    listed = lambda k: split_tags(F.regexp_replace(F.coalesce(field(k), F.lit("")), r"[\[\]\"']", ""))
    heading = F.nullif(F.trim(F.regexp_extract(body, r"(?m)^# +(.+)$", 1)), F.lit(""))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.md$", "")
    kind = F.lit("note")
    for prefix, value in sorted(PREFIX_TYPES.items(), key=lambda x: len(x[0])):
        kind = F.when(F.col("path").startswith(prefix), value).otherwise(kind)
    return files.select("path", F.coalesce(field("title"), heading, name).alias("title"), F.coalesce(field("type"), kind).alias("doc_type"), F.array_distinct(F.concat(listed("tags"), listed("domains"))).alias("tags"), F.coalesce(field("status"), F.lit("active")).alias("status"), body.alias("body"))


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def classify_files(found: DataFrame, registry: DataFrame) -> DataFrame:
    """(path, hash) against (path, hash): unchanged, changed, new or deleted (S3)."""
    a, b = found.select("path", F.col("hash").alias("now")), registry.select("path", F.col("hash").alias("was"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def latest(rows: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The last row of each key."""
    keys = [key] if isinstance(key, str) else key
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order]))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """`changes` win over `table`; of several for a key the one with the largest `at`."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest(both, key, "_new", "at").drop("_new")


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not deleted."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def unseen(batch: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """New names only, the first of each within the batch."""
    fresh = batch.join(stored.select(key).distinct(), key, "left_anti")
    return fresh.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_place = 1").drop("_place")


def select_work(candidates: DataFrame, marks: DataFrame, limit: int = 30) -> DataFrame:
    """Files without a mark, changed since, or whose facts never ran; the oldest first."""
    j = candidates.join(marks, "path", "left")
    due = F.col("mark").isNull() | (F.col("modified") > F.col("mark")) | ~F.coalesce("facts_done", F.lit(False))
    return j.filter(due).orderBy("modified", "path").limit(limit).select("path", "modified")


def read_log(queries: DataFrame, results: DataFrame) -> DataFrame:
    """One row for each result, or one with no note for a query that found nothing."""
    r = results.select(F.col("query_id").alias("q"), "doc_id", "place")
    return queries.join(r, F.col("query_id") == F.col("q"), "left").select("query_id", "session", "doc_id", "place", F.coalesce(F.col("session").rlike(TEST_SESSION), F.lit(False)).alias("is_test"))


def cut_errors(calls: DataFrame, chars: int = 200) -> DataFrame:
    """Meter rows with error texts cut."""
    return calls.withColumn("error", F.substring("error", 1, chars))


def list_notes(notes: DataFrame, doc_type: str | None = None, tag: str | None = None, limit: int = 50, offset: int = 0, superseded: bool = False) -> DataFrame:
    """Newest notes first."""
    if doc_type:
        notes = notes.filter(F.col("doc_type") == doc_type)
    if tag:
        notes = notes.filter(F.array_contains("tags", tag))
    if not superseded:
        notes = notes.filter("superseded_at IS NULL")
    return notes.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def by_ids(ids: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes of the ids, a miss kept."""
    return ids.join(notes.withColumnRenamed("id", "found"), F.col("id") == F.col("found"), "left")


def with_tags(notes: DataFrame, wanted: list[str], aliases: DataFrame) -> DataFrame:
    """Notes that carry every wanted tag in any spelling (P3); aliases (alias, tag) are a small dictionary."""
    canon = aliases.select(F.col("alias"), F.col("tag").alias("canonical"))
    asked = notes.sparkSession.createDataFrame([(w.strip().lower(),) for w in wanted], "w string").distinct().join(canon, F.col("w") == F.col("alias"), "left").select(F.coalesce("canonical", "w").alias("want")).distinct()
    held = notes.select("id", F.explode("tags").alias("t")).join(canon, F.col("t") == F.col("alias"), "left").select("id", F.coalesce("canonical", "t").alias("want")).distinct()
    need = asked.agg(F.count("*").alias("need"))
    hits = held.join(F.broadcast(asked), "want").groupBy("id").agg(F.count("*").alias("hits"))  # one row for each wanted tag
    full = hits.filter(F.col("hits") == need.first()[0])
    return notes.join(full.select("id"), "id", "left_semi")


def is_test(session: Column) -> Column:
    """Sessions of tests (P5)."""
    return F.coalesce(session.rlike(TEST_SESSION) | session.isin("test", "smoke", "fake"), F.lit(False))


def without_self_traffic(log: DataFrame, internal: Column) -> DataFrame:
    """Drop sessions that hinted on an internal prompt and never pulled."""
    hinted = log.filter((F.col("surface") == "hint") & internal).select("session").distinct()
    pulled = log.filter(~F.col("surface").isin("hint", "briefing")).select("session").distinct()
    return log.join(hinted.join(pulled, "session", "left_anti"), "session", "left_anti")


def is_nudge(prompt: Column) -> Column:
    """Prompts that ask to look in the store."""
    return F.coalesce(prompt.rlike(NUDGE), F.lit(False))


def admitted(prompt: Column) -> Column:
    """Prompts long enough for hints that are neither slash commands nor envelopes."""
    return F.coalesce((F.length(F.trim(prompt)) >= 20) & ~prompt.rlike(r"^\s*/") & ~prompt.rlike(ENVELOPE), F.lit(False))


def ticket(path: Column) -> Column:
    """The ticket id of the deepest path segment that holds one."""
    found = F.filter(F.transform(F.split(path, "/"), lambda x: F.regexp_extract(x, r"(?i)\b([a-z][a-z0-9]+-\d+)\b", 1)), lambda x: x != "")
    return F.lower(F.try_element_at(found, F.lit(-1)))


def merge_proposals(notes: DataFrame, proposals: DataFrame) -> DataFrame:
    """A proposed title, tag list or type wins where it is not empty; such notes are marked classified."""
    p = proposals.select(F.col("id").alias("pid"), F.col("title").alias("p_title"), F.col("tags").alias("p_tags"), F.col("doc_type").alias("p_type"))
    j = notes.join(p, F.col("id") == F.col("pid"), "left")
    filled = lambda new, old: F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old))
    return j.select("id", filled("p_title", "title").alias("title"), F.when(F.size("p_tags") > 0, F.col("p_tags")).otherwise(F.col("tags")).alias("tags"), filled("p_type", "doc_type").alias("doc_type"), F.col("pid").isNotNull().alias("classified"))


def queues(notes: DataFrame) -> DataFrame:
    """What is left to do for each note: classify, summarise, ask for aliases (P13). Columns: id, doc_type, content, summary, aliases."""
    todo = F.array_compact(F.array(F.when(F.col("doc_type") == "capture", F.lit("classify")), F.when(F.col("summary").isNull() & (F.length("content") >= 100), F.lit("summarise")), F.when(F.col("aliases").isNull(), F.lit("aliases"))))
    return notes.select("id", F.explode(todo).alias("queue"))


def slug(c: Column, length: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, length)


def captures(pages: DataFrame) -> DataFrame:
    """Web pages as markdown notes with front matter and a slug path, one for each path (S18). Columns: page_id, url, title, body."""
    path = F.concat(F.lit("inbox/"), F.coalesce(F.nullif(slug("title"), F.lit("")), F.concat(F.lit("page-"), "page_id")), F.lit(".md"))
    note = F.concat(F.lit("---\ntitle: "), "title", F.lit("\nsource: "), "url", F.lit("\ntype: capture\n---\n\n# "), "title", F.lit("\n\n"), "body", F.lit("\n"))
    rows = pages.select("page_id", path.alias("path"), note.alias("note"))
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy("path").orderBy("page_id"))).filter("_place = 1").drop("_place")


#: Other captures: folder, length of the slug, whether the day leads the file's name, type, own tags, first line of the body, and
#: whether a later one replaces an earlier one of its path (else the first stays).
CAPTURES = {
    "video": ("sources/youtube", 60, True, "source", ("youtube",), "# ", False),
    "bookmark": ("sources/x-bookmarks", 50, False, "source", ("x", "bookmark"), "# ", False),
    "session": ("builds/sessions", 40, True, "session", ("terminal", "session"), "# ", True),
    "fix": ("builds/fixes", 50, True, "fix", ("fix", "terminal"), "# Fix: ", True),
}


def head_lines(fields: dict[str, Column]) -> Column:
    """A note's front matter: a line for each field that is not null."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), c)) for k, c in fields.items()]
    return F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n---\n"))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))


def captured(rows: DataFrame, kind: str, held: DataFrame | None = None) -> DataFrame:
    """Video transcripts, bookmarks, sessions or fixes as (id, path, note), one for each path.

    Columns: id (order of arrival), title, day, clock (HHmm, sessions only), url, project, tags (array), sections
    (array<struct<head, text>>, of which empty ones are left out). `held` has the paths that are there already."""
    folder, length, dated, doc_type, own, first, replaces = CAPTURES[kind]
    name = F.substring(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), 1, length)
    stamp = F.concat_ws("-", *[F.col(c) for c in ("day", *(["clock"] if kind == "session" else []))])
    path = F.concat(F.lit(folder + "/"), F.concat(stamp, F.lit("-"), name) if dated else name, F.lit(".md"))
    tags = F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in own]))
    head = head_lines({"title": quoted(F.col("title")), "type": F.lit(doc_type), "url": quoted(F.col("url")), "created": quoted(F.col("day")), "updated": quoted(F.col("day")), "project": F.col("project"), "tags": F.concat(F.lit("["), F.array_join(tags, ", "), F.lit("]")), "status": F.lit("active" if replaces else "inbox")})
    parts = F.transform(F.filter("sections", lambda x: F.coalesce(x["text"], F.lit("")) != ""), lambda x: F.concat(F.lit("\n## "), x["head"], F.lit("\n"), x["text"], F.lit("\n")))
    note = F.concat(head, F.lit("\n" + first), "title", F.lit("\n"), F.array_join(parts, ""))
    each = rows.select("id", path.alias("path"), note.alias("note"))
    pick = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("id") if replaces else F.asc("id")))
    once = each.withColumn("_place", pick).filter("_place = 1").drop("_place")
    return once if replaces or held is None else once.join(held.select("path"), "path", "left_anti")


#: Folders of note types; others go to the inbox.
FOLDERS = {"capture": "inbox", "research": "research", "idea": "ideas", "workflow": "workflows", "lesson": "agents/lessons", "fix": "builds/fixes", "decision": "decisions", "session": "builds/sessions"}


def built(writes: DataFrame, related: DataFrame) -> DataFrame:
    """(id, path, note) of notes to write: folder by type, dated slug, front matter, and the related notes as links.

    `writes`: id, title, doc_type, content, tags (comma list), project, source, tier, ref, day; `related`: id, place, title,
    path, score."""
    pairs = [x for k, v in FOLDERS.items() for x in (F.lit(k), F.lit(v))]
    folder = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("doc_type")), F.lit("inbox"))
    path = F.concat(folder, F.lit("/"), "day", F.lit("-"), slug(F.col("title")), F.lit(".md"))
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    shown = F.regexp_replace(F.format_string("%.2f", F.col("score")), r"\.?0+$", "")
    line = F.concat(F.lit("- [["), base, F.lit("]] — "), "title", F.lit(" ("), shown, F.lit(")"))
    lists = related.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("rows")).select("id", F.array_join(F.transform("rows", lambda x: x["line"]), "\n").alias("links"))
    json = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    head = head_lines({"title": json(F.coalesce("title", F.lit(""))), "type": F.col("doc_type"), "created": quoted(F.col("day")), "updated": quoted(F.col("day")), "tags": F.concat(F.lit("["), F.array_join(split_tags(F.col("tags")), ", "), F.lit("]")), "project": F.lower(F.trim("project")), "source": F.when(F.col("source").isNotNull(), json(F.col("source"))), "tier": F.col("tier"), "tier_ref": F.when(F.col("ref").isNotNull(), json(F.col("ref"))), "status": F.lit("active")})
    more = F.when(F.col("links").isNotNull(), F.concat(F.lit("\n\n## Related\n"), "links")).otherwise("")
    return writes.join(lists, "id", "left").select("id", path.alias("path"), F.concat(head, F.lit("\n"), "content", more).alias("note"))


def text_records(rows: DataFrame) -> DataFrame:
    """Text records with defaults for what they leave out: title, type, no tags (S8). Columns: id, title, doc_type, tags, text."""
    blank = lambda c, default: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))
    return rows.select("id", blank("title", "untitled").alias("title"), blank("doc_type", "text").alias("doc_type"), split_tags(F.col("tags")).alias("tags"), F.coalesce("text", F.lit("")).alias("content"))


def routed(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Notes without a file, with a folder by type and a path whose slug is made unique by -2, -3, ...."""
    lone = notes.join(files.select(F.col("doc_id").alias("id")), "id", "left_anti")
    folder = F.lit("notes")
    for kind, name in (("research", "research"), ("decision", "decisions"), ("session", "sessions"), ("state", "projects")):
        folder = F.when(F.col("doc_type") == kind, name).otherwise(folder)
    named = lone.select("id", folder.alias("folder"), F.coalesce(F.nullif(slug("title"), F.lit("")), F.lit("untitled")).alias("slug"))
    k = F.row_number().over(Window.partitionBy("folder", "slug").orderBy("id"))
    return named.select("id", F.concat("folder", F.lit("/"), "slug", F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise(""), F.lit(".md")).alias("path"))


def bookmarks(files: DataFrame) -> DataFrame:
    """(path, content) split into (path, n, title, url, body) at headings that are links."""
    lines = files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("pos", "line"))
    head = r"^#{1,3} \[([^\]]+)\]\(([^)]+)\)"
    counted = lines.withColumn("n", F.sum(F.col("line").rlike(head).cast("int")).over(Window.partitionBy("path").orderBy("pos")))
    own = counted.filter("n > 0").groupBy("path", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    first = F.col("rows")[0]["line"]
    body = F.array_join(F.transform(F.slice("rows", F.lit(2), F.size("rows")), lambda x: x["line"]), "\n")
    return own.select("path", "n", F.regexp_extract(first, head, 1).alias("title"), F.regexp_extract(first, head, 2).alias("url"), F.trim(body).alias("body"))


def fan_out(intake: DataFrame, folders: dict[str, str]) -> DataFrame:
    """A note for each accepted class of an intake note (S27). Columns: id, title, classes."""
    pairs = [x for k, v in folders.items() for x in (F.lit(k), F.lit(v))]
    each = intake.select("id", "title", F.explode(F.array_distinct("classes")).alias("class"))
    folder = F.try_element_at(F.create_map(*pairs), F.col("class"))
    return each.withColumn("folder", folder).filter("folder IS NOT NULL").select("id", "class", F.concat("folder", F.lit("/"), slug("title"), F.lit(".md")).alias("path"))


def updated(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Changed notes: tags normalised; the tier's date moves only if the tier does (S25). `changes`: id, tags (comma list), tier, at."""
    c = changes.select(F.col("id").alias("cid"), F.col("tags").alias("c_tags"), F.col("tier").alias("c_tier"), "at")
    j = notes.join(c, F.col("id") == F.col("cid"), "left")
    tier = F.coalesce("c_tier", "tier")
    return j.select("id", F.when(F.col("c_tags").isNotNull(), split_tags(F.col("c_tags"))).otherwise(F.col("tags")).alias("tags"), tier.alias("tier"), F.when(tier.eqNullSafe(F.col("tier")), F.col("tier_at")).otherwise(F.col("at")).alias("tier_at"))


def undecided(decisions: DataFrame, logged: DataFrame) -> DataFrame:
    """Decisions whose note is not in the log yet."""
    return decisions.join(logged.select("doc_id").distinct(), "doc_id", "left_anti")
