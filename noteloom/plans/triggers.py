"""C: command triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteloom.operators import triggers as C
from noteloom.sources import views as V

from .base import query

#: A session's commands: each event runs one of a few shapes, some behind wrappers, pipes or quotes.
SHAPES = ["git push origin m{0}", "sudo git push --force", "echo 'git push' | wc -l", "cd /x && npm run build-{0}", "FOO=1 env npm run test", "ls -la"]
CMDS = "WITH cmd AS (SELECT event_id AS pos, 'u' || user_id AS session, event_id % 6 AS k, event_id % 40 AS m FROM events)"


def commands(spark, sf_dir):
    e = V.read(spark, sf_dir, "events")
    shapes = F.array(*[F.lit(s) for s in SHAPES])
    text = F.replace(F.element_at(shapes, (F.col("event_id") % 6 + 1).cast("int")), F.lit("{0}"), (F.col("event_id") % 40).cast("string"))
    return e.select(F.col("event_id").alias("pos"), F.concat(F.lit("u"), "user_id").alias("session"), text.alias("command"))


@query(CMDS + ", s AS (SELECT DISTINCT k, m FROM cmd) SELECT unnest(CASE k WHEN 0 THEN ['git push origin m' || m] WHEN 1 THEN ['git push --force'] WHEN 2 THEN ['echo ''git push''', 'wc -l'] WHEN 3 THEN ['cd /x', 'npm run build-' || m] WHEN 4 THEN ['npm run test'] ELSE ['ls -la'] END) AS segment, k::INTEGER AS k FROM (SELECT DISTINCT k, CASE WHEN k IN (0, 3) THEN m ELSE 0 END AS m FROM s)")
def c1_segments(spark, sf_dir):
    c = commands(spark, sf_dir)
    k = c.groupBy("command").agg(F.min(F.col("pos") % 6).cast("int").alias("k"))
    return C.corpus_segments(c).join(k, "command").select("segment", "k")


@query(CMDS + " SELECT id, count(*) AS hits, count(DISTINCT session) AS sessions FROM (SELECT 1 AS id, session FROM cmd WHERE k IN (0, 1) UNION ALL SELECT 2, session FROM cmd WHERE k = 3 AND m = 15 UNION ALL SELECT 3, session FROM cmd WHERE k = 4) GROUP BY id".replace("1 AS id", "1::BIGINT AS id"))
def c2_matches(spark, sf_dir):
    c = commands(spark, sf_dir)
    p = spark.createDataFrame([(1, ["git push"]), (2, ["npm run", "build-15"]), (3, ["npm", "test"]), (4, ["push"])], "id long, parts array<string>")
    return C.matched(C.corpus_segments(c), p).join(c, "command").groupBy("id").agg(F.count("*").alias("hits"), F.countDistinct("session").alias("sessions"))


@query("SELECT doc_id AS id, 'run git push/now' AS parts, source || chr(10) || 'git x' AS code FROM documents")
def c3_c4_code(spark, sf_dir):
    d = V.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.lit("  Run  Git push && && NOW ").alias("proposal"))
    p = C.proposals(d)
    code = d.select("id", C.code_text(F.concat(F.lit("text `git x` more\n```sh\n"), "source", F.lit("```\n`open\nnot`"))).alias("code"))
    return p.join(code, "id").select("id", F.array_join("parts", "/").alias("parts"), "code")


@query(CMDS + """, st AS (SELECT count(*) AS n, count(DISTINCT session) AS s FROM cmd), pat AS (SELECT 'npm run/build-7' AS parts, count(*) FILTER (k = 3 AND m = 7) AS hits, count(DISTINCT session) FILTER (k = 3 AND m = 7) AS sessions FROM cmd
UNION ALL SELECT 'git push', count(*) FILTER (k IN (0, 1)), count(DISTINCT session) FILTER (k IN (0, 1)) FROM cmd UNION ALL SELECT 'git push origin m3', count(*) FILTER (k = 0 AND m = 3), count(DISTINCT session) FILTER (k = 0 AND m = 3) FROM cmd),
r AS (SELECT doc_id AS id, parts, hits, sessions, row_number() OVER (PARTITION BY doc_id ORDER BY sessions, hits, parts) AS place FROM documents, pat, st WHERE doc_id % 100 = 0 OR (n >= 500 AND s >= 20 AND hits >= 1 AND sessions <= 0.05 * s)) SELECT id, parts, hits, sessions, place::INTEGER AS place FROM r WHERE place <= 3""")
def c5_vetted(spark, sf_dir):
    c = commands(spark, sf_dir)
    n = V.notes(spark, sf_dir).select("id", "title", F.concat(F.lit("`npm run build-7` and `git push` and `git push origin m3`\n"), "content").alias("content"))
    each = n.select("id", F.explode(F.array(F.lit("npm run && build-7"), F.lit("git push"), F.lit("git push origin m3"), F.lit("rm -rf"))).alias("proposal"))
    return C.vetted(C.proposals(each).withColumn("pinned", F.col("id") % 100 == 0), n, c).select("id", F.array_join("parts", "/").alias("parts"), "hits", "sessions", "place")


def index(spark):
    return spark.createDataFrame([(1, ["git push"], 50), (1, ["git push", "--force"], 5), (2, ["npm run"], 9), (3, ["ls"], 2)], "id long, parts array<string>, hits long")


@query(CMDS + " SELECT DISTINCT session, pos, k::INTEGER AS k, CASE WHEN k < 2 THEN 1 WHEN k IN (3, 4) THEN 2 ELSE 3 END::BIGINT AS id, CASE k WHEN 0 THEN 50 WHEN 1 THEN 5 WHEN 5 THEN 2 ELSE 9 END::BIGINT AS hits FROM cmd WHERE k <> 2")
def c6_notes_for(spark, sf_dir):
    c = commands(spark, sf_dir)
    return c.join(C.notes_for(c, index(spark)), "command").select("session", "pos", (F.col("pos") % 6).cast("int").alias("k"), "id", "hits")


@query(CMDS + """, f AS (SELECT session, pos, CASE WHEN k < 2 THEN 1 WHEN k IN (3, 4) THEN 2 ELSE 3 END::BIGINT AS id FROM cmd WHERE k <> 2), n AS (SELECT *, row_number() OVER (PARTITION BY session, id ORDER BY pos) AS nth FROM f),
t AS (SELECT *, sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY pos, id ROWS UNBOUNDED PRECEDING) AS turn FROM n) SELECT session, pos, id, nth = 1 AND turn <= 2 AS shown FROM t""")
def c7_decisions(spark, sf_dir):
    c = commands(spark, sf_dir)
    return C.decisions(c, C.notes_for(c, index(spark)))


@query(", t AS (SELECT id, title, tier, id % 5 AS k FROM notes WHERE superseded_at IS NULL AND doc_type <> 'state' AND id % 5 <> 4 AND id % 5 <> 3), p AS (SELECT *, unnest(CASE k WHEN 0 THEN [1] WHEN 1 THEN [1, 2] ELSE [] END) AS x FROM t) SELECT id, title, tier, CASE x WHEN 1 THEN 'git push/m' || id ELSE 'ls' END AS parts, CASE x WHEN 1 THEN id ELSE 2 END AS hits FROM p", ("notes",))
def s21_index(spark, sf_dir):
    n = V.notes(spark, sf_dir).withColumn("doc_type", F.when(F.col("doc_type") == "state", "archive").otherwise(F.col("doc_type")))
    own = F.format_string('{"parts": ["git push", "m%d"], "hits": %d}', "id", "id")
    k = F.col("id") % 5
    n = n.withColumn("triggers", F.when(k == 0, F.concat(F.lit("["), own, F.lit("]"))).when(k == 1, F.concat(F.lit("["), own, F.lit(', {"parts": ["ls"], "hits": 2}]'))).when(k == 2, "[]").when(k == 3, "[{broken"))
    return C.built_index(n).select("id", "title", "tier", F.array_join("parts", "/").alias("parts"), "hits")


@query("SELECT event_id AS pos, CASE event_id % 3 WHEN 0 THEN 'cat <<EOF > m' || event_id || chr(10) || 'ls' WHEN 1 THEN 'cat <<-''A'' <<B' || chr(10) || 'done ' || event_id ELSE 'cat <<EOF' || chr(10) || 'open ' || event_id END AS command FROM events")
def x1_heredocs(spark, sf_dir):
    """Closed, two in a queue, and not closed."""
    e, k, n = V.read(spark, sf_dir, "events"), F.col("event_id") % 3, F.lit("\n")
    one = F.concat(F.lit("cat <<EOF > m"), "event_id", n, F.lit("git push\n EOF\nls"))
    two = F.concat(F.lit("cat <<-'A' <<B\nB\nA\nA\nB\ndone "), "event_id")
    text = F.when(k == 0, one).when(k == 1, two).otherwise(F.concat(F.lit("cat <<EOF\nopen "), "event_id"))
    return e.select(F.col("event_id").alias("pos"), C.without_heredocs(text).alias("command"))
