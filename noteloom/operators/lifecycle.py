"""Standing of notes: tiers, supersession and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import tier_rank
from .tags import mentions

FLOOR = "inferred"
# Families of provenance, the first whose pattern a source has; what counts as a reference.
FAMILIES = {
    "none": r"^$",
    "harvest": r"(?i)^(?:harvest|sweep|auto)[:_-]?",
    "web": r"(?i)^(?:https?://.*|web$)",
    "manual": r"(?i)^manual$",
    "session": r"(?i)^session\b",
    "file": r"(?i)\.md$",
}
COMMIT = r"(?:commit|sha|git)[:=][0-9a-f]{7,40}|(?=[0-9]*[a-f])[0-9a-f]{7,40}"
CHANGE_URL = r"[^ ]*/(?:pull|pulls|merge_requests|pull-requests)/[1-9]\d*[^ ]*"
CHANGE_NUMBER = r"(?:[\w.-]+/[\w.-]+)?#[1-9]\d*"
TEST_FILE = r"(?=(?:[\w./-]*[/._-])?(?:tests?|specs?|__tests__)(?:[/._-]|[^\w./-]|$))[\w./-]+\.[a-z]{1,5}"
#: A reference between blanks, without the brackets, quotes and stops around it.
REFERENCE = rf"(?i)(?:^| )[(\"'`<\[]*(?:{COMMIT}|{CHANGE_URL}|{CHANGE_NUMBER}|{TEST_FILE})[)\"'`>\].,;:!?]*(?: |$)"
MOST_CHARS = 500


def family(source: Column) -> Column:
    """The provenance family of a source (L1)."""
    s = F.trim(F.coalesce(source, F.lit("")))
    return F.coalesce(*[F.when(s.rlike(pattern), name) for name, pattern in FAMILIES.items()], F.lit("other"))


def tier_of_source(source: Column, proven: dict[str, str] | None = None) -> Column:
    """What a source proves by itself (L1): the floor, but for families that `proven` lists."""
    out = F.lit(FLOOR)
    for name, tier in (proven or {}).items():
        out = F.when(family(source) == name, tier).otherwise(out)
    return out


def reference(ref: Column) -> Column:
    """The reference on one line if it names a commit, a change request or a test file; else null (L2)."""
    line = F.trim(F.regexp_replace(ref, r"\s+", " "))
    return F.when(F.length(line).between(1, MOST_CHARS) & line.rlike(REFERENCE), line)


def resolved_tier(tier: Column, ref: Column) -> Column:
    """A known tier; verified only with a reference (L3)."""
    known = F.when(tier.isin("inferred", "observed", "verified"), tier).otherwise(FLOOR)
    return F.when((known == "verified") & reference(ref).isNull(), FLOOR).otherwise(known)


def rejected(writes: DataFrame) -> DataFrame:
    """Writes that claim too much, with the reason (L4). Columns: id, tier, source, ref."""
    t = F.col("tier")
    reason = F.when(t.isNotNull() & ~t.isin("inferred", "observed", "verified"), "unknown_tier").when((family(F.col("source")) == "harvest") & (t != FLOOR), "unattended_above_floor").when((t == "verified") & reference(F.col("ref")).isNull(), "unsupported")
    return writes.withColumn("reason", reason).filter("reason IS NOT NULL")


def backfilled(notes: DataFrame, proven: dict[str, str]) -> DataFrame:
    """(id, family, was, tier): notes that their source raises."""
    better = tier_of_source(F.col("source"), proven)
    return notes.select("id", family(F.col("source")).alias("family"), F.col("tier").alias("was"), better.alias("tier")).filter(tier_rank(F.col("tier")) > tier_rank(F.col("was")))


def promoted(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, tier, ref, outcome) of promotion requests: upwards only, with evidence."""
    r = requests.select("id", F.col("tier").alias("wanted"), "confirmed_by")
    j = r.join(notes.select("id", "tier"), "id", "left")
    outcome = F.when(F.col("tier").isNull(), "no_note").when(F.trim(F.coalesce("confirmed_by", F.lit(""))) == "", "no_evidence").when((F.col("wanted") == "verified") & reference(F.col("confirmed_by")).isNull(), "no_reference").when(tier_rank(F.col("wanted")) <= tier_rank(F.col("tier")), "not_upwards").otherwise("promoted")
    return j.withColumn("outcome", outcome).select("id", F.when(F.col("outcome") == "promoted", F.col("wanted")).otherwise(F.col("tier")).alias("tier"), "outcome")


def superseded(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, outcome) of requests to retire notes or to bring them back (L7). Columns: id, replacement_id, unset."""
    have = notes.select(F.col("id").alias("rid"))
    live = notes.select("id", F.col("superseded_at").isNotNull().alias("gone"))
    j = requests.join(live, "id", "left").join(have, F.col("replacement_id") == F.col("rid"), "left")
    outcome = F.when(F.col("gone").isNull(), "no_note").when(F.col("unset"), F.when(F.col("gone"), "restored").otherwise("not_superseded")).when(F.col("replacement_id") == F.col("id"), "self").when(F.col("replacement_id").isNotNull() & F.col("rid").isNull(), "no_replacement").otherwise("superseded")
    return j.select("id", outcome.alias("outcome"))


def supersession_candidates(facts: DataFrame, notes: DataFrame) -> DataFrame:
    """(id, replacement, old, new): notes that name a subject and its retired value while a newer one names the current value.

    Facts: subject_name, object_name, valid_to, key. Mentions come from the n-gram join, not from comparing texts with names."""
    old = facts.filter("valid_to IS NOT NULL").select("key", "subject_name", F.col("object_name").alias("old"))
    new = facts.filter("valid_to IS NULL").select("key", F.col("object_name").alias("new"))
    moves = old.join(new, "key").filter("old <> new").distinct()
    names = moves.select(F.explode(F.array("subject_name", "old", "new")).alias("name")).distinct()
    m = mentions(notes, names.select(F.col("name").alias("entity"), "name"))
    dated = m.join(notes.filter("superseded_at IS NULL").select("id", "created_at"), "id")
    named = lambda what, i, t: dated.select(F.col("entity").alias(what), F.col("id").alias(i), F.col("created_at").alias(t))
    stale = moves.join(named("subject_name", "id", "at"), "subject_name").join(named("old", "oid", "o_at"), "old").filter("id = oid").drop("oid", "o_at")
    fresh = moves.join(named("subject_name", "rid", "r_at"), "subject_name").join(named("new", "nid", "n_at"), "new").filter("rid = nid").groupBy("key", "old", "new").agg(F.max(F.struct("r_at", "rid")).alias("best"))
    pairs = stale.join(fresh, ["key", "old", "new"]).filter((F.col("best.r_at") > F.col("at")) & (F.col("best.rid") != F.col("id")))
    return pairs.groupBy("id").agg(F.max_by(F.struct(F.col("best.rid").alias("replacement"), "old", "new"), F.col("best")).alias("p")).select("id", "p.replacement", "p.old", "p.new")


def promotions(marked: DataFrame, notes: DataFrame, logged: DataFrame) -> DataFrame:
    """Inferred live notes that a followed push named, with the earliest such event, not decided before."""
    hit = marked.filter("in_window AND class IS NULL").select("event", "at", F.explode("docs").alias("doc_id"))
    first = hit.groupBy("doc_id").agg(F.min_by("event", F.struct("at", "event")).alias("event"))
    able = notes.filter("superseded_at IS NULL AND tier = 'inferred'").select(F.col("id").alias("doc_id"))
    return first.join(able, "doc_id", "left_semi").join(logged.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "event", F.lit("observed").alias("tier"))


def label(tier: Column) -> Column:
    """A tier as shown; only the floor carries a mark."""
    t = F.when(tier.isin("observed", "verified"), tier).otherwise(FLOOR)
    return F.when(t == FLOOR, F.concat(F.lit("⚠ "), t)).otherwise(t)
