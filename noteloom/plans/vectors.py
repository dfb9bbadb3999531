"""V: vectors. The tables' vectors are far apart, so thresholds here are lower than the store's own. Queries are the rows
whose id is divisible by 20, against all rows but their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteloom.operators import search as S
from noteloom.operators import vectors as X
from noteloom.sources import views as V

from .base import VIEWS, query
from .search import ASKED, FOUND, INDEX, RANKED, asked

COS = ", cos AS (SELECT a.id AS query_id, b.id AS id, list_cosine_similarity(a.v, b.v) AS s FROM vectors a, vectors b)"
LINKS = COS + """, pairs AS (SELECT query_id AS from_id, id AS to_id, round(s, 3) AS score, CASE WHEN round(s, 3) >= 0.4 THEN 'near-dup' ELSE 'related' END AS kind FROM cos WHERE query_id < id AND s >= 0.3),
links AS (SELECT from_id, to_id, score, kind FROM (SELECT *, row_number() OVER (PARTITION BY from_id, kind ORDER BY score DESC, to_id) AS k FROM pairs) WHERE kind = 'near-dup' OR k <= 3)"""


def queries_and_corpus(spark, sf_dir):
    v = V.vectors(spark, sf_dir)
    return v.filter("id % 20 = 0"), v


@query(COS + " SELECT query_id, id, round(s, 6) AS score FROM cos WHERE query_id % 20 = 0 AND query_id <> id AND s >= 0.3", ("vectors",))
def v1_cosine(spark, sf_dir):
    q, c = queries_and_corpus(spark, sf_dir)
    return X.similar(q, c, least=0.3, apart=True).select("query_id", "id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, length(substr(text, 1, 2000)) AS n FROM documents")
def v2_embeddable(spark, sf_dir):
    body = F.concat("text", F.lit("\n\n## Related\n- [[x]]\n"))
    return V.read(spark, sf_dir, "documents").select("doc_id", F.length(X.embeddable(body)).cast("long").alias("n"))


@query("SELECT id % 100 AS document_id, label AS chunk_index, max(id) AS id FROM vectors GROUP BY ALL", ("vectors",))
def v3_newest(spark, sf_dir):
    rows = V.vectors(spark, sf_dir).select("id", (F.col("id") % 100).alias("document_id"), F.col("label").alias("chunk_index"), "v")
    return X.newest_chunks(rows).select("document_id", "chunk_index", "id")


@query(COS + ", r AS (SELECT query_id, c.id, s, tier, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, c.id) AS k FROM cos c JOIN notes n ON c.id = n.id WHERE query_id % 20 = 0 AND query_id <> c.id AND superseded_at IS NULL) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY floor(s * 100 + 0.5) DESC, CASE tier WHEN 'inferred' THEN 1 WHEN 'observed' THEN 2 ELSE 3 END DESC, s DESC, id)::INTEGER AS place, id, round(s, 6) AS score FROM r WHERE k <= 10", ("notes", "vectors"))
def v4_semantic(spark, sf_dir):
    q, c = queries_and_corpus(spark, sf_dir)
    return X.semantic(q, c, V.notes(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(COS + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS k FROM cos WHERE query_id % 20 = 0 AND query_id <> id) SELECT query_id, k::INTEGER AS place, id, round(s, 6) AS score FROM r WHERE k <= 5", ("vectors",))
def v5_nearest(spark, sf_dir):
    q, c = queries_and_corpus(spark, sf_dir)
    return X.similar(q, c, 5, apart=True).select("query_id", "place", "id", F.round("score", 6).alias("score"))


@query(COS + """, r AS (SELECT query_id, id, round(s, 3) AS score FROM cos WHERE query_id % 20 = 0 AND query_id <> id), d AS (SELECT query_id, 'duplicate' AS kind, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place, id, score FROM r WHERE score >= 0.4),
n AS (SELECT query_id, 'near' AS kind, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place, id, score FROM r WHERE score >= 0.3 AND score < 0.4 AND query_id NOT IN (SELECT query_id FROM d))
SELECT query_id, kind, place::INTEGER AS place, id, score FROM d WHERE place <= 5 UNION ALL SELECT query_id, kind, place::INTEGER, id, score FROM n WHERE place <= 3""", ("vectors",))
def v6_v7_verdicts(spark, sf_dir):
    q, c = queries_and_corpus(spark, sf_dir)
    return X.verdicts(X.similar(q, c, 5, apart=True, digits=3), 0.4, 0.3)


@query(COS + INDEX + ASKED + FOUND + RANKED + """, vec AS (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS k FROM cos WHERE query_id IN (SELECT query_id FROM q) AND query_id <> id),
j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.score AS r, b.s AS s FROM placed a FULL JOIN (SELECT * FROM vec WHERE k <= 20) b ON a.query_id = b.query_id AND a.id = b.id),
g AS (SELECT *, CASE WHEN r IS NOT NULL AND s IS NOT NULL THEN 0 WHEN s IS NOT NULL THEN 1 ELSE 2 END AS grp FROM j), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grp, s DESC NULLS LAST, r NULLS LAST, id) AS place FROM g)
SELECT query_id, place::INTEGER AS place, id, grp FROM p WHERE place <= 30""", ("notes", "vectors"))
def v8_hybrid(spark, sf_dir):
    q, v = asked(spark, sf_dir), V.vectors(spark, sf_dir)
    found = X.similar(v.join(q.select(F.col("query_id").alias("id")), "id", "left_semi"), v, 20, apart=True)
    return X.hybrid(S.search(q, V.notes(spark, sf_dir)), found, 30)


def links(spark, sf_dir):
    return X.all_links(V.vectors(spark, sf_dir), near_dup=0.4, related=0.3)


@query(LINKS + " SELECT from_id, to_id, score, kind FROM links", ("vectors",))
def v9_links(spark, sf_dir):
    return links(spark, sf_dir)


@query(LINKS + " SELECT from_id, to_id, kind, score FROM links", ("vectors",))
def v10_edges(spark, sf_dir):
    x = links(spark, sf_dir)
    return X.edges(x.unionByName(x.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "score", "kind")))


@query(LINKS + ", both_ AS (SELECT from_id AS id, to_id AS other, score FROM links UNION SELECT to_id, from_id, score FROM links) SELECT id, other, score, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS place FROM both_) WHERE place <= 5", ("vectors",))
def v11_neighbours(spark, sf_dir):
    return X.neighbours(links(spark, sf_dir)).select("id", "other", "score", "place")


@query(LINKS + " SELECT from_id, to_id, score, a.title AS from_title, b.title AS to_title FROM links JOIN notes a ON from_id = a.id JOIN notes b ON to_id = b.id WHERE kind = 'near-dup' ORDER BY score DESC, from_id, to_id LIMIT 10", ("notes", "vectors"))
def v12_near_dup_pairs(spark, sf_dir):
    return X.near_dup_pairs(links(spark, sf_dir), V.notes(spark, sf_dir)).select("from_id", "to_id", "score", "from_title", "to_title")


@query("WITH RECURSIVE " + VIEWS["vectors"] + """, held AS (SELECT * FROM vectors WHERE id % 20 = 0), come AS (SELECT id, v, row_number() OVER (ORDER BY id) AS k FROM vectors WHERE id % 20 <> 0),
best AS (SELECT c.id, arg_max(h.id, (list_cosine_similarity(c.v, h.v), -h.id)) AS nearest, max(list_cosine_similarity(c.v, h.v)) AS s FROM come c, held h GROUP BY c.id),
near AS (SELECT a.id, list(b.id) AS others FROM come a JOIN come b ON b.id < a.id WHERE list_cosine_similarity(a.v, b.v) >= 0.35 GROUP BY a.id),
cand AS (SELECT c.k, c.id, s >= 0.35 AS stored, coalesce(others, []) AS others FROM come c JOIN best USING (id) LEFT JOIN near USING (id)),
walk(k, admitted) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT c.k, CASE WHEN stored OR list_has_any(admitted, others) THEN admitted ELSE list_append(admitted, c.id) END FROM walk w JOIN cand c ON c.k = w.k + 1),
done AS (SELECT admitted FROM walk ORDER BY k DESC LIMIT 1) SELECT b.id, NOT list_contains((SELECT admitted FROM done), b.id) AS refused, nearest, round(s, 3) AS score FROM best b""")
def v13_admissions(spark, sf_dir):
    v = V.vectors(spark, sf_dir)
    return X.admissions(v.filter("id % 20 <> 0"), v.filter("id % 20 = 0"), 0.35)
