"""L: standing, supersession and promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteloom.operators import lifecycle as L
from noteloom.sources import views as V

from .base import query
from .reports import MARKED, marked

FAMILY = "CASE page_id % 7 WHEN 0 THEN 'web' WHEN 1 THEN 'harvest' WHEN 2 THEN 'manual' WHEN 3 THEN 'session' WHEN 4 THEN 'file' WHEN 5 THEN 'none' ELSE 'other' END"


def sourced(spark, sf_dir):
    k = F.col("page_id") % 7
    s = F.when(k == 0, F.col("url")).when(k == 1, "harvest:x").when(k == 2, " Manual").when(k == 3, "Session 2024").when(k == 4, "a/b.MD").when(k == 5, " ").otherwise("thing")
    return V.read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), s.alias("source"), F.when(F.col("page_id") % 2 == 0, "inferred").otherwise("observed").alias("tier"))


@query("SELECT page_id AS id, " + FAMILY + " AS family FROM pages")
def l1_family(spark, sf_dir):
    return sourced(spark, sf_dir).select("id", L.family(F.col("source")).alias("family"))


REFS = ["commit:abcdef1", "1234567", "see a1b2c3d.", "x/y#12", "https://h/o/r/pull/5", "tests/test_a.py", "src/a.py", "looked fine"]
GOOD = "event_id % 8 IN (0, 2, 3, 4, 5)"


def writes(spark, sf_dir):
    e = F.col("event_id")
    refs = F.array(*[F.lit(r) for r in REFS])
    return V.read(spark, sf_dir, "events").select(e.alias("id"), F.element_at(refs, (e % 8 + 1).cast("int")).alias("ref"), F.when(e % 3 == 0, "verified").when(e % 3 == 1, "observed").otherwise("sure").alias("tier"), F.when(e % 5 == 0, "harvest:1").otherwise("manual").alias("source"))


@query(f"SELECT event_id AS id, {GOOD} AS named, CASE WHEN event_id % 3 = 1 THEN 'observed' WHEN event_id % 3 = 0 AND {GOOD} THEN 'verified' ELSE 'inferred' END AS tier FROM events")
def l2_l3_tiers(spark, sf_dir):
    return writes(spark, sf_dir).select("id", L.reference(F.col("ref")).isNotNull().alias("named"), L.resolved_tier(F.col("tier"), F.col("ref")).alias("tier"))


@query(f"SELECT event_id AS id, CASE WHEN event_id % 3 = 2 THEN 'unknown_tier' WHEN event_id % 5 = 0 THEN 'unattended_above_floor' ELSE 'unsupported' END AS reason FROM events WHERE event_id % 3 = 2 OR event_id % 5 = 0 OR (event_id % 3 = 0 AND NOT ({GOOD}))")
def l4_rejected(spark, sf_dir):
    return L.rejected(writes(spark, sf_dir)).select("id", "reason")


@query(f"SELECT page_id AS id, {FAMILY} AS family, 'observed' AS tier FROM pages WHERE page_id % 2 = 0 AND page_id % 7 = 2")
def l5_backfilled(spark, sf_dir):
    return L.backfilled(sourced(spark, sf_dir), {"manual": "observed"}).select("id", "family", "tier")


@query(", r AS (SELECT event_id * 3 AS id, CASE WHEN event_id % 2 = 0 THEN 'verified' ELSE 'observed' END AS wanted, event_id % 8 AS k FROM events) SELECT r.id, CASE WHEN n.id IS NULL THEN 'no_note' WHEN wanted = 'verified' AND k NOT IN (0, 2, 4) THEN 'no_reference' WHEN (wanted = 'observed' AND tier <> 'inferred') OR tier = 'verified' THEN 'not_upwards' ELSE 'promoted' END AS outcome FROM r LEFT JOIN notes n ON r.id = n.id", ("notes",))
def l6_promoted(spark, sf_dir):
    w = writes(spark, sf_dir).select((F.col("id") * 3).alias("id"), F.when(F.col("id") % 2 == 0, "verified").otherwise("observed").alias("tier"), F.col("ref").alias("confirmed_by"))
    return L.promoted(V.notes(spark, sf_dir), w).select("id", "outcome")


@query(", r AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN doc_id WHEN doc_id % 4 = 1 THEN 100000000 WHEN doc_id % 4 = 2 THEN 1 END AS rep, doc_id % 3 = 0 AS unset FROM labels) SELECT r.id, CASE WHEN unset THEN CASE WHEN superseded_at IS NOT NULL THEN 'restored' ELSE 'not_superseded' END WHEN rep = r.id THEN 'self' WHEN rep = 100000000 THEN 'no_replacement' ELSE 'superseded' END AS outcome FROM r JOIN notes n ON r.id = n.id", ("notes",))
def l7_superseded(spark, sf_dir):
    d = F.col("doc_id")
    r = V.read(spark, sf_dir, "labels").select(d.alias("id"), F.when(d % 4 == 0, d).when(d % 4 == 1, 100_000_000).when(d % 4 == 2, 1).alias("replacement_id"), (d % 3 == 0).alias("unset"))
    return L.superseded(V.notes(spark, sf_dir), r)


@query(""", moves(k, s, old, new) AS (VALUES (0, 'the', 'oningti', 'and'), (1, 'that', 'was', 'from'), (2, 'les', 'une', 'par')),
t AS (SELECT id, created_at, lower(title || chr(10) || content) AS x FROM notes WHERE superseded_at IS NULL),
m AS (SELECT t.id, t.created_at, name FROM t, (SELECT s AS name FROM moves UNION SELECT old FROM moves UNION SELECT new FROM moves) n WHERE regexp_matches(x, '(^|[^a-z0-9_-])' || name || '($|[^a-z0-9_-])')),
stale AS (SELECT k, a.id, a.created_at FROM moves JOIN m a ON a.name = s JOIN m b ON b.name = old AND a.id = b.id),
fresh AS (SELECT k, old, new, max({'at': a.created_at, 'id': a.id}) AS best FROM moves JOIN m a ON a.name = s JOIN m b ON b.name = new AND a.id = b.id GROUP BY ALL)
SELECT stale.id, arg_max(best.id, best) AS replacement FROM stale JOIN fresh USING (k) WHERE best['at'] > created_at AND best.id <> stale.id GROUP BY stale.id""", ("notes",))
def l8_candidates(spark, sf_dir):
    moves = [("0", "the", "oningti", "and"), ("1", "that", "was", "from"), ("2", "les", "une", "par")]
    rows = [(k, s, o, "2024-01-01") for k, s, o, _ in moves] + [(k, s, n, None) for k, s, _, n in moves]
    return L.supersession_candidates(spark.createDataFrame(rows, "key string, subject_name string, object_name string, valid_to string"), V.notes(spark, sf_dir)).select("id", "replacement")


@query(MARKED + ", hit AS (SELECT event, ts, unnest(docs) AS doc_id FROM marked WHERE in_window AND class IS NULL AND surface IN ('hint', 'briefing')) SELECT doc_id, arg_min(event, (ts, event)) AS event, 'observed' AS tier FROM hit WHERE doc_id IN (SELECT id FROM notes WHERE superseded_at IS NULL AND tier = 'inferred') AND doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id", ("notes", "retrievals"))
def l9_promotions(spark, sf_dir):
    m = marked(spark, sf_dir).filter("surface IN ('hint', 'briefing')")
    return L.promotions(m, V.notes(spark, sf_dir), V.read(spark, sf_dir, "labels"))


@query("SELECT id, CASE tier WHEN 'inferred' THEN '⚠ inferred' ELSE tier END AS label FROM notes", ("notes",))
def l10_labels(spark, sf_dir):
    return V.notes(spark, sf_dir).select("id", L.label(F.col("tier")).alias("label"))
