"""K: tags and bridges."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteloom.operators import tags as K
from noteloom.operators.notes import split_tags
from noteloom.sources import views as V

from .base import query

#: Notes with four tags, so that pairs occur: source, language, type, and a mark of every third note.
TAGS = ", tagged AS (SELECT id, unnest(list_distinct([tags[1], tags[2], doc_type, CASE WHEN id % 3 = 0 THEN 'marks' ELSE 'mark' END])) AS tag FROM notes), total AS (SELECT tag, count(DISTINCT id) AS n FROM tagged GROUP BY tag), size AS (SELECT count(DISTINCT id) AS n FROM tagged)"
ROUND2 = "floor(({}) * 100 + 0.5) / 100"


def tagged(spark, sf_dir):
    n = V.notes(spark, sf_dir)
    tags = F.concat("tags", F.array("doc_type", F.when(F.col("id") % 3 == 0, "marks").otherwise("mark")))
    return K.note_tags(n.withColumn("tags", tags))


@query("SELECT doc_id, lang || ',' || source || ',x y' AS tags FROM documents")
def k1_split(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.upper("lang"), F.lit(", "), "source", F.lit(",, X Y,"), "lang")
    return V.read(spark, sf_dir, "documents").select("doc_id", F.array_join(split_tags(raw), ",").alias("tags"))


@query(TAGS + ", c AS (SELECT DISTINCT id, CASE tag WHEN 'marks' THEN 'mark' WHEN 'de' THEN 'german' ELSE tag END AS tag FROM tagged) SELECT tag, count(*) AS n FROM c GROUP BY tag", ("notes",))
def k2_canonical(spark, sf_dir):
    aliases = spark.createDataFrame([("marks", "mark"), ("de", "german")], "alias string, target string")
    return K.canonical(tagged(spark, sf_dir), aliases).distinct().groupBy("tag").agg(F.count("*").alias("n"))


@query(TAGS + " SELECT tag, n FROM total ORDER BY n DESC, tag LIMIT 15", ("notes",))
def k3_counts(spark, sf_dir):
    return K.counts(tagged(spark, sf_dir), 15)


@query(TAGS + " SELECT a.tag AS shorter, b.tag AS longer FROM total a, total b WHERE b.tag = a.tag || 's' OR starts_with(b.tag, a.tag || '-')", ("notes",))
def k4_k5_alias_candidates(spark, sf_dir):
    return K.alias_candidates(tagged(spark, sf_dir))


@query(TAGS + f""", co AS (SELECT t.tag, count(*) AS cooccur FROM tagged t JOIN tagged x ON t.id = x.id AND x.tag = 'mark' AND t.tag <> 'mark' GROUP BY t.tag HAVING count(*) >= 2),
l AS (SELECT co.tag, cooccur, {ROUND2.format("cooccur * (SELECT n FROM size) / ((SELECT n FROM total WHERE tag = 'mark') * total.n)")} AS lift FROM co JOIN total USING (tag))
SELECT tag, cooccur, lift, {ROUND2.format("lift * log2(1 + cooccur)")} AS score FROM l ORDER BY score DESC, cooccur DESC, tag LIMIT 15""", ("notes",))
def k6_neighbours(spark, sf_dir):
    return K.neighbours(tagged(spark, sf_dir), "mark")


@query(TAGS + f""", co AS (SELECT x.tag AS a, y.tag AS b, count(*) AS cooccur FROM tagged x JOIN tagged y ON x.id = y.id AND x.tag < y.tag GROUP BY ALL HAVING count(*) >= 3),
l AS (SELECT a, b, cooccur, {ROUND2.format("cooccur * (SELECT n FROM size) / (p.n * q.n)")} AS lift FROM co JOIN total p ON a = p.tag JOIN total q ON b = q.tag WHERE NOT (a || 's' = b OR b || 's' = a OR starts_with(a, b || '-') OR starts_with(b, a || '-')))
SELECT a, b, cooccur, lift, {ROUND2.format("lift * log2(1 + cooccur)")} AS score FROM l ORDER BY score DESC, cooccur DESC, a, b LIMIT 10""", ("notes",))
def k7_strongest(spark, sf_dir):
    return K.strongest(tagged(spark, sf_dir))


#: Facts over the words of the benchmark's passages, letters and digits only: each word and the two after it as one name.
TOLD = """, w AS (SELECT list_filter([regexp_replace(y, '[^a-z0-9]', '', 'g') FOR y IN string_split(lower(text), ' ')], lambda y: y <> '') AS x FROM benchmark), f AS (SELECT x[i] AS subject, x[i + 1] || ' ' || x[i + 2] AS object FROM (SELECT x, unnest(range(1, len(x) - 1)) AS i FROM w)),
e AS (SELECT name AS entity, name FROM (SELECT subject AS name FROM f UNION ALL SELECT object FROM f WHERE object <> subject) GROUP BY name HAVING count(*) >= 2 AND length(name) >= 3 AND name NOT IN ('en', 'research')),
m AS (SELECT id, entity FROM (SELECT id, lower(title || chr(10) || content) AS t FROM notes), e WHERE contains(t, name) AND regexp_matches(t, '(^|[^a-z0-9_-])' || regexp_escape(name) || '($|[^a-z0-9_-])'))"""
MENTIONS = TAGS + TOLD


def candidates(spark, sf_dir):
    w = F.filter(F.transform(F.split(F.lower("text"), " "), lambda x: F.regexp_replace(x, "[^a-z0-9]", "")), lambda x: x != "")
    at = F.when(F.size(w) > 2, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    three = F.explode(F.transform(at, lambda i: F.struct(F.get(w, i).alias("subject"), F.concat(F.get(w, i + 1), F.lit(" "), F.get(w, i + 2)).alias("object"))))
    f = V.read(spark, sf_dir, "benchmark").select(three.alias("f")).select("f.*")
    names = f.select(F.explode(F.array("subject", "object")).alias("entity")).distinct().withColumn("name", F.col("entity"))
    return K.entity_candidates(names, f, ["en", "research"])


@query(MENTIONS + " SELECT entity, count(*) AS df FROM m GROUP BY entity", ("notes",))
def k8_mentions(spark, sf_dir):
    return K.mentions(V.notes(spark, sf_dir), candidates(spark, sf_dir)).groupBy("entity").agg(F.count("*").alias("df"))


@query(MENTIONS + f""", c AS (SELECT entity, count(*) AS df, count_if(id IN (SELECT id FROM tagged WHERE tag = 'en'))::BIGINT AS n_from, count_if(id IN (SELECT id FROM tagged WHERE tag = 'research'))::BIGINT AS n_to FROM m GROUP BY entity)
SELECT entity, df, n_from, n_to, {ROUND2.format("log2(1 + least(n_from, n_to)) * log2((SELECT n FROM size)::DOUBLE / df)")} AS strength FROM c WHERE n_from > 0 AND n_to > 0 AND {ROUND2.format("log2(1 + least(n_from, n_to)) * log2((SELECT n FROM size)::DOUBLE / df)")} > 0 ORDER BY strength DESC, least(n_from, n_to) DESC, entity LIMIT 10""", ("notes",))
def k9_bridges(spark, sf_dir):
    t = tagged(spark, sf_dir)
    n = t.agg(F.countDistinct("id")).first()[0]
    return K.bridge_entities(K.mentions(V.notes(spark, sf_dir), candidates(spark, sf_dir)), t, "en", "research", n)


@query(TAGS + ", s AS (SELECT id, bool_or(tag = 'en') AS a, bool_or(tag = 'research') AS b FROM tagged GROUP BY id) SELECT count_if(a)::BIGINT AS docs_from, count_if(b)::BIGINT AS docs_to, count_if(a AND b)::BIGINT AS overlap FROM s", ("notes",))
def k9_stats(spark, sf_dir):
    return K.tunnel_stats(tagged(spark, sf_dir), "en", "research")


@query(TAGS + " SELECT id, title FROM notes WHERE id IN (SELECT id FROM tagged WHERE tag = 'en') AND id IN (SELECT id FROM tagged WHERE tag = 'research') ORDER BY created_at DESC, id LIMIT 10", ("notes",))
def k9_bridge_notes(spark, sf_dir):
    return K.bridge_notes(V.notes(spark, sf_dir), tagged(spark, sf_dir), "en", "research").select("id", "title")
