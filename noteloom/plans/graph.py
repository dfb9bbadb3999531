"""G: the fact graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteloom.functions import predicates as P
from noteloom.operators import graph as G
from noteloom.sources import views as V

from .base import query

#: Spellings that claims use, with what they fold to and whether the ends swap.
SPELLINGS = [("Status", "status", 0), ("deploys-to", "deployed_to", 0), ("is source_of", "source_of", 0), ("owned by", "owns", 1), ("merged_into", "merged_to", 0), ("Implemented_by", "implements", 1), ("fixed_in", "fixes", 1), ("kind_of", "is", 0), ("requires", "depends_on", 0), ("state", "state", 0), ("authored_by", "authored", 1), ("uses", "uses", 0)]
CLAIMS = "WITH spell(k, spelled, folded, swaps) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}', {c})" for i, (a, b, c) in enumerate(SPELLINGS)) + """),
claims AS (SELECT o_orderkey AS id, 'tkt-' || (o_orderkey % 200) AS subject, spelled AS predicate, folded, swaps, CASE o_custkey % 3 WHEN 0 THEN 'Repo ' || (o_custkey % 7) WHEN 1 THEN 'pr #' || (o_custkey % 9) || ', pr #' || (o_custkey % 5 + 10) ELSE o_orderstatus END AS object, CAST(o_orderdate AS DATE) AS valid_from FROM orders JOIN spell ON o_orderkey % 12 = k),
turned AS (SELECT id, CASE WHEN swaps = 1 THEN object ELSE subject END AS subject, folded AS predicate, CASE WHEN swaps = 1 THEN subject ELSE object END AS object, valid_from FROM claims)
"""
ID = "coalesce(nullif(regexp_replace(regexp_replace(replace(lower({0}), '''', ''), '[\\s_./-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), trim(replace(lower({0}), '''', '')))"


def claims(spark, sf_dir):
    o = V.read(spark, sf_dir, "orders")
    c = F.col("o_custkey")
    names = F.array(*[F.lit(a) for a, _, _ in SPELLINGS])
    obj = F.when(c % 3 == 0, F.concat(F.lit("Repo "), c % 7)).when(c % 3 == 1, F.concat(F.lit("pr #"), c % 9, F.lit(", pr #"), c % 5 + 10)).otherwise(F.col("o_orderstatus"))
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("tkt-"), F.col("o_orderkey") % 200).alias("subject"), F.element_at(names, (F.col("o_orderkey") % 12 + 1).cast("int")).alias("predicate"), obj.alias("object"), F.to_date("o_orderdate").alias("valid_from"))


@query("SELECT c_custkey, " + ID.format("CASE c_custkey % 4 WHEN 0 THEN replace(c_name, '#', ' - ') WHEN 1 THEN '..' WHEN 2 THEN 'It''s v2/' || c_custkey || '.py' ELSE c_name || ' ' END") + " AS id FROM customer")
def g1_entity_id(spark, sf_dir):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.replace("c_name", F.lit("#"), F.lit(" - "))).when(k == 1, "..").when(k == 2, F.concat(F.lit("It's v2/"), "c_custkey", F.lit(".py"))).otherwise(F.concat("c_name", F.lit(" ")))
    return V.read(spark, sf_dir, "customer").select("c_custkey", G.entity_id(name).alias("id"))


@query(", a AS (SELECT 'customer_' || c_custkey AS alias, 'nation_' || c_nationkey AS target FROM customer WHERE c_custkey % 2 = 0) SELECT f.id, coalesce(a.target, f.subject) AS subject FROM facts f LEFT JOIN a ON f.subject = a.alias", ("facts",))
def g2_resolved(spark, sf_dir):
    c = V.read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0")
    a = c.select(F.concat(F.lit("customer_"), "c_custkey").alias("alias"), F.concat(F.lit("Nation "), "c_nationkey").alias("target"))
    return G.resolved(V.facts(spark, sf_dir).select("id", "subject"), "subject", a)


@query(CLAIMS + "SELECT id, subject, predicate, object FROM turned")
def g3_g4_triples(spark, sf_dir):
    return G.canonical_triples(claims(spark, sf_dir)).select("id", "subject", "predicate", "object")


@query(CLAIMS + "SELECT predicate <> 'source_of' AS listed, count(*) AS n FROM turned GROUP BY 1")
def g5_vocabulary(spark, sf_dir):
    return G.canonical_triples(claims(spark, sf_dir)).groupBy(G.in_vocabulary(F.col("predicate")).alias("listed")).agg(F.count("*").alias("n"))


NAMES = "n(name) AS (VALUES " + ", ".join(f"('{n}')" for n in P.vocabulary()) + "), kin(head, form) AS (VALUES " + ", ".join(f"('{h}', '{f}')" for h in sorted({n.partition("_")[0] for n in P.vocabulary()}) for f in sorted(P.family(h))) + ")"
GRAMS = "list_distinct([substr({0}, i, 2) FOR i IN range(1, length({0}))])"


@query(CLAIMS.rstrip() + f""", {NAMES}, p AS (SELECT DISTINCT predicate FROM claims), r AS (SELECT predicate, regexp_replace(regexp_replace(regexp_replace(replace(lower(predicate), chr(39), ''), '[\\s-]+', '_', 'g'), '^_+|_+$', '', 'g'), '^(is|are|was|were|be|been|being)_', '') AS raw FROM p),
s AS (SELECT predicate, name, CASE WHEN raw = name THEN 1.0 ELSE 2.0 * len(list_intersect({GRAMS.format("raw")}, {GRAMS.format("name")})) / (len({GRAMS.format("raw")}) + len({GRAMS.format("name")})) + CASE WHEN EXISTS (SELECT 1 FROM kin WHERE head = split_part(name, '_', 1) AND form = split_part(raw, '_', 1)) THEN 0.5 ELSE 0.0 END END AS score FROM r, n),
k AS (SELECT *, row_number() OVER (PARTITION BY predicate ORDER BY score DESC, name) AS place FROM s) SELECT predicate, place::INTEGER AS place, name, round(score, 6) AS score FROM k WHERE place <= 3""")
def g6_nearest(spark, sf_dir):
    return G.nearest_predicates(claims(spark, sf_dir).select("predicate"))


@query(CLAIMS + ", f AS (SELECT id, " + ID.format("subject") + " AS subject, predicate, " + ID.format("object") + " AS object FROM turned) SELECT min(id) AS id, subject, predicate, object FROM f WHERE id % 2 = 1 AND (subject, predicate, object) NOT IN (SELECT subject, predicate, object FROM f WHERE id % 2 = 0) GROUP BY ALL")
def g7_inserted(spark, sf_dir):
    c = claims(spark, sf_dir)
    done = G.canonical_triples(c.filter("id % 2 = 0"))
    held = done.select(G.entity_id(F.col("subject")).alias("subject"), "predicate", G.entity_id(F.col("object")).alias("object"), F.lit(None).cast("date").alias("valid_to"))
    return G.inserted(c.filter("id % 2 = 1"), held).select("id", "subject", "predicate", "object")


@query(", q AS (SELECT 'customer_' || c_custkey AS entity FROM customer UNION ALL SELECT 'f' UNION ALL SELECT 'customer'), low AS (SELECT id, subject, lower(object) AS object, valid_from, valid_to FROM facts WHERE valid_from <= DATE '1996-06-30' AND (valid_to IS NULL OR valid_to >= DATE '1996-06-30')) SELECT entity, id, 'outgoing' AS direction FROM q JOIN low ON entity = subject UNION ALL SELECT entity, id, 'incoming' FROM q JOIN low ON entity = object", ("facts",))
def g8_facts_of(spark, sf_dir):
    c = V.read(spark, sf_dir, "customer").select(F.concat(F.lit("customer_"), "c_custkey").alias("entity"))
    q = c.unionByName(spark.createDataFrame([("f",), ("customer",)], "entity string"))
    f = V.facts(spark, sf_dir).withColumn("object", F.lower("object"))
    return G.facts_of(q, f, F.lit("1996-06-30").cast("date")).select("entity", "id", "direction")


@query(", r AS (SELECT id, subject AS entity, row_number() OVER (PARTITION BY subject ORDER BY valid_to IS NULL DESC, valid_from DESC NULLS LAST, id) AS place FROM facts) SELECT entity, id, place::INTEGER AS place FROM r WHERE place <= 5", ("facts",))
def g9_page(spark, sf_dir):
    f = V.facts(spark, sf_dir)
    return G.page(G.facts_of(f.select(F.col("subject").alias("entity")), f), cap=5).select("entity", "id", "place")


@query("WITH e AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'cust-' WHEN 1 THEN 'Cust' ELSE 'cust_' END || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN 's' ELSE '' END AS subject FROM orders), h AS (SELECT subject AS entity, count(*) AS facts, regexp_replace(regexp_replace(lower(subject), '[^a-z0-9]+', '', 'g'), 's$', '') AS key FROM e GROUP BY ALL) SELECT a.entity AS asked, b.entity, b.facts FROM h a JOIN h b USING (key) WHERE a.entity <> b.entity AND a.entity LIKE 'cust_%' AND starts_with(a.entity, 'cust_')")
def g10_nearby(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 3 == 0, "cust-").when(k % 3 == 1, "Cust").otherwise("cust_"), "o_custkey", F.when(k % 2 == 0, "s").otherwise(""))
    f = V.read(spark, sf_dir, "orders").select(k.alias("id"), name.alias("subject"), name.alias("object"))
    return G.nearby(f.select(F.col("subject").alias("entity")).filter(F.col("entity").startswith("cust_")).distinct(), f)


@query(", q AS (SELECT subject, object, CASE WHEN id % 2 = 0 THEN DATE '1990-01-01' ELSE DATE '2030-01-01' END AS ended FROM facts WHERE valid_to IS NULL) SELECT CASE WHEN ended < DATE '2000-01-01' THEN 'ended_before_valid_from' ELSE 'invalidated' END AS outcome, count(*) AS n FROM q GROUP BY 1", ("facts",))
def g11_invalidated(spark, sf_dir):
    f = V.facts(spark, sf_dir)
    ended = F.when(F.col("id") % 2 == 0, "1990-01-01").otherwise("2030-01-01").cast("date")
    _, judged = G.invalidated(f, f.filter("valid_to IS NULL").select("subject", "predicate", "object", ended.alias("ended")))
    return judged.groupBy("outcome").agg(F.count("*").alias("n"))


@query(", r AS (SELECT subject AS entity, id, row_number() OVER (PARTITION BY subject ORDER BY valid_from NULLS LAST, id) AS place FROM facts) SELECT entity, id, place::INTEGER AS place FROM r WHERE place <= 3", ("facts",))
def g12_timeline(spark, sf_dir):
    f = V.facts(spark, sf_dir)
    return G.timeline(f.select(F.col("subject").alias("entity")).distinct(), f, 3).select("entity", "id", "place")


@query("SELECT count(*) AS facts, count_if(valid_to IS NULL)::BIGINT AS current, 'status' AS predicates, (SELECT count(*) FROM (SELECT subject FROM facts UNION SELECT object FROM facts)) AS entities FROM facts", ("facts",))
def g13_stats(spark, sf_dir):
    return G.graph_stats(V.facts(spark, sf_dir))


@query(CLAIMS + "SELECT arg_min(id, (valid_from, id)) AS id, subject, predicate, object FROM turned GROUP BY subject, predicate, object")
def g14_deduped(spark, sf_dir):
    f = G.canonical_triples(claims(spark, sf_dir)).withColumn("valid_to", F.lit(None).cast("date"))
    return G.deduped(f).select("id", "subject", "predicate", "object")


@query("""WITH RECURSIVE m AS (SELECT DISTINCT 'customer_' || o_custkey AS source, 'customer_' || (o_custkey // 10) AS target FROM orders WHERE o_custkey >= 10),
chain AS (SELECT source, target FROM m UNION SELECT chain.source, m.target FROM chain JOIN m ON chain.target = m.source),
ends AS (SELECT source, target FROM chain WHERE target NOT IN (SELECT source FROM m))
SELECT DISTINCT coalesce(target, subject) AS subject, object FROM (SELECT 'customer_' || o_custkey AS subject, o_orderstatus AS object FROM orders) LEFT JOIN ends ON subject = source""")
def g15_merged(spark, sf_dir):
    """Each customer merges into the one whose number lacks the last digit: chains of merges."""
    f = V.facts(spark, sf_dir).withColumn("valid_to", F.lit(None).cast("date"))
    k = F.regexp_extract("subject", r"(\d+)$", 1).cast("long")
    m = f.filter(k >= 10).select(F.col("subject").alias("source"), F.concat(F.lit("customer_"), F.floor(k / 10)).alias("target")).distinct()
    facts, _ = G.merged(f, spark.createDataFrame([], "alias string, target string"), m)
    return facts.select("subject", "object")


NAMED = "WITH e AS (SELECT o_orderkey AS id, CASE o_orderkey % 2 WHEN 0 THEN 'cust-' ELSE 'cust_' END || o_custkey AS subject FROM orders), h AS (SELECT subject AS entity, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT entity, n, replace(entity, '-', '_') AS key FROM h)"


def named_facts(spark, sf_dir):
    name = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "cust-").otherwise("cust_"), "o_custkey")
    return V.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), name.alias("subject"), F.lit("status").alias("predicate"), F.concat(F.lit("s_"), F.lower("o_orderstatus")).alias("object"), F.lit(None).cast("date").alias("valid_to"))


@query(NAMED + ", b AS (SELECT key, arg_min(entity, (-n, entity)) AS target FROM k GROUP BY key) SELECT entity AS source, target FROM k JOIN b USING (key) WHERE entity <> target")
def g16_merge_plan(spark, sf_dir):
    f = named_facts(spark, sf_dir)
    return G.merge_plan(f.select(F.col("subject").alias("entity")).distinct(), f)


@query(NAMED + "SELECT 'not_canonical' AS check, count_if(entity LIKE '%-%') AS n FROM h UNION ALL SELECT 'orphan_ends', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'duplicate_live', count(*) FROM (SELECT 1 FROM e JOIN orders ON id = o_orderkey GROUP BY subject, o_orderstatus HAVING count(*) > 1) UNION ALL SELECT 'unresolved_aliases', 1 UNION ALL SELECT 'aliased_entities', 0".replace("count_if(entity LIKE '%-%')", "count_if(entity LIKE '%-%')::BIGINT"))
def g17_audit(spark, sf_dir):
    f = named_facts(spark, sf_dir)
    return G.audit(f.select(F.col("subject").alias("entity")).distinct(), f, spark.createDataFrame([("x", "nobody")], "alias string, target string"))


@query("""WITH f AS (SELECT o_orderkey AS id, 'c' || (o_custkey % 50) AS s, CASE o_orderkey % 2 WHEN 0 THEN 'merged_into' ELSE 'merged_to' END AS p, o_orderstatus AS o, o_orderdate AS d FROM orders),
w AS (SELECT *, row_number() OVER (PARTITION BY s, o ORDER BY CAST(d AS DATE), id) AS k, bool_or(p <> 'merged_to') OVER (PARTITION BY s, o) AS a FROM f)
SELECT CASE WHEN k > 1 AND a THEN 'drop' WHEN p <> 'merged_to' THEN 'rewrite' ELSE 'keep' END AS action, count(*) AS n FROM w GROUP BY 1""")
def g18_fold_plan(spark, sf_dir):
    o = V.read(spark, sf_dir, "orders")
    f = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("subject"), F.when(F.col("o_orderkey") % 2 == 0, "merged_into").otherwise("merged_to").alias("predicate"), F.col("o_orderstatus").alias("object"), F.to_date("o_orderdate").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return G.fold_plan(f).groupBy("action").agg(F.count("*").alias("n"))


@query(CLAIMS + """, t AS (SELECT c.id, t.subject, t.predicate, lower(trim(t.object)) AS key, c.valid_from, c.id % 5 <> 0 AS live, c.subject <> t.subject OR c.predicate <> t.predicate OR c.object <> t.object AS moves FROM claims c JOIN turned t ON c.id = t.id),
n AS (SELECT *, bool_or(live AND NOT moves) OVER (PARTITION BY subject, predicate, key) AS held, row_number() OVER (PARTITION BY subject, predicate, key, live, moves ORDER BY valid_from, id) AS k FROM t) SELECT CASE WHEN NOT moves THEN 'keep' WHEN live AND (held OR k > 1) THEN 'merge' ELSE 'fold' END AS action, count(*) AS n FROM n GROUP BY 1""")
def g19_fold_directions(spark, sf_dir):
    f = claims(spark, sf_dir).withColumn("valid_to", F.when(F.col("id") % 5 == 0, F.col("valid_from"))).withColumn("valid_from", F.col("valid_from").cast("string"))
    return G.fold_directions(f).groupBy("action").agg(F.count("*").alias("n"))


@query(CLAIMS + "SELECT id, unnest(CASE WHEN object LIKE 'pr #%' THEN string_split(object, ', ') ELSE [object] END) AS object FROM claims")
def g20_split(spark, sf_dir):
    return G.split_objects(claims(spark, sf_dir)).select("id", "object")


@query("SELECT o_orderkey AS id, o_custkey % 3 <> 1 AS same FROM orders")
def g21_same_entity(spark, sf_dir):
    k = F.col("o_custkey")
    a = F.concat(F.lit("web-app PR #"), k)
    b = F.when(k % 3 == 0, F.concat(F.lit("pr #"), k)).when(k % 3 == 1, F.concat(F.lit("billing PR #"), k)).otherwise(F.concat(F.lit(" WEB-APP pr #"), k))
    return V.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), G.same_entity(a, b).alias("same"))


@query(CLAIMS + ", f AS (SELECT " + ID.format("subject") + " AS subject, predicate, unnest(CASE WHEN object LIKE 'pr #%' THEN string_split(object, ', ') ELSE [object] END) AS object FROM turned WHERE predicate IN ('status', 'state')) SELECT subject, predicate, count(DISTINCT " + ID.format("object") + ") AS objects FROM f GROUP BY ALL HAVING objects > 1")
def g22_conflicts(spark, sf_dir):
    return G.conflicts(claims(spark, sf_dir)).select("subject", "predicate", F.size("objects").cast("long").alias("objects"))


@query(", held AS (SELECT subject || '_co' AS subject, lower(object) AS key FROM facts WHERE valid_to IS NULL), b AS (SELECT o_orderkey AS arrival, 'customer_' || o_custkey || '_co' AS subject, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS object, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS valid_from FROM orders), j AS (SELECT b.*, h.key IS NOT NULL AS there, row_number() OVER (PARTITION BY b.subject, lower(b.object) ORDER BY arrival) AS k FROM b LEFT JOIN held h ON b.subject = h.subject AND lower(b.object) = h.key) SELECT CASE WHEN there OR k > 1 THEN 'skipped' ELSE 'added' END AS status, arrival, subject, 'status' AS predicate, object, valid_from, CAST(NULL AS VARCHAR) AS valid_to, CASE WHEN there OR k > 1 THEN 'duplicate' END AS reason FROM j", ("facts",))
def g23_consolidated(spark, sf_dir):
    """Subjects that are no work items, so that a status may hold many values."""
    f = V.facts(spark, sf_dir).filter("valid_to IS NULL").select(F.concat("subject", F.lit("_co")).alias("subject"), "predicate", "object", F.col("valid_from").cast("string").alias("valid_from"))
    batch = V.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("arrival"), F.concat(F.lit("Customer "), "o_custkey", F.lit(" Co")).alias("subject"), F.lit("Status").alias("predicate"), F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("object"), F.to_date("o_orderdate").cast("string").alias("valid_from"))
    return G.consolidate(f, batch)


@query(", held AS (SELECT subject, lower(object) AS key, object, CAST(valid_from AS VARCHAR) AS since FROM facts WHERE valid_to IS NULL), b AS (SELECT max(o_orderkey) AS arrival, 'customer_' || o_custkey AS subject, CASE WHEN o_custkey % 3 = 0 THEN 'X' ELSE 'O' END AS object, CAST(CAST(max_by(o_orderdate, o_orderkey) AS DATE) AS VARCHAR) AS valid_from FROM orders GROUP BY o_custkey), j AS (SELECT b.*, h.key, h.object AS was, h.since FROM b JOIN held h ON b.subject = h.subject), d AS (SELECT *, CASE WHEN key <> lower(object) AND since > valid_from THEN 'stale_observation' WHEN key = lower(object) THEN 'duplicate' END AS reason FROM j) SELECT CASE WHEN reason IS NULL THEN 'added' ELSE 'skipped' END AS status, arrival, subject, object, reason FROM d UNION ALL SELECT 'invalidated', arrival, subject, was, 'single_valued_predicate_took_new_object' FROM d WHERE reason IS NULL", ("facts",))
def g25_late_observations(spark, sf_dir):
    """One new status for each customer, some older than the held one."""
    f = V.facts(spark, sf_dir).filter("valid_to IS NULL").select("subject", "predicate", "object", F.col("valid_from").cast("string").alias("valid_from"))
    o = V.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("arrival"), F.max_by("o_orderdate", "o_orderkey").alias("at"))
    batch = o.select("arrival", F.concat(F.lit("Customer "), "o_custkey").alias("subject"), F.lit("Status").alias("predicate"), F.when(F.col("o_custkey") % 3 == 0, "X").otherwise("O").alias("object"), F.to_date("at").cast("string").alias("valid_from"))
    return G.consolidate(f, batch).select("status", "arrival", "subject", "object", "reason")


@query(CLAIMS.rstrip() + ", f AS (SELECT id, CASE WHEN predicate = 'requires' THEN subject WHEN swaps = 1 THEN object ELSE subject END AS subject, CASE predicate WHEN 'requires' THEN 'uses' ELSE folded END AS predicate FROM claims) SELECT predicate, count(*) AS n FROM f GROUP BY predicate")
def g26_overrides(spark, sf_dir):
    """The rule table with an alias of one's own, one whose target is folded itself and so is left out, and a mirrored spelling that
    is refused, as it would turn a single-valued name round."""
    rules = P.Rules(aliases={"requires": "uses", "state": "needs"}, inverses={"status": "supports"})
    return G.canonical_triples(claims(spark, sf_dir), rules).groupBy("predicate").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT o_orderkey AS request, 'tkt_' || o_custkey AS subject, CASE WHEN o_orderkey % 2 = 0 THEN 'open' ELSE lower(o_orderstatus) END AS object, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS valid_from FROM orders),
h AS (SELECT 'tkt_' || c_custkey AS subject, unnest(CASE c_custkey % 3 WHEN 0 THEN ['open'] WHEN 1 THEN ['f', 'held'] ELSE ['held'] END) AS object, CAST(1992 + c_custkey % 6 AS VARCHAR) || '-06-15' AS since FROM customer),
j AS (SELECT request, bool_or(coalesce(q.object = h.object, FALSE)) AS there, bool_or(coalesce(q.object <> h.object AND since > valid_from, FALSE)) AS newer, count_if(q.object <> h.object)::BIGINT AS against FROM q LEFT JOIN h USING (subject) GROUP BY request)
SELECT request, CASE WHEN newer THEN 'refused' WHEN there THEN 'exists' ELSE 'added' END AS outcome, CASE WHEN newer THEN 0 ELSE against END AS retires FROM j""")
def g24_single_inserts(spark, sf_dir):
    o, k = V.read(spark, sf_dir, "orders"), F.col("c_custkey")
    asked = o.select(F.col("o_orderkey").alias("request"), F.concat(F.lit("TKT-"), "o_custkey").alias("subject"), F.lit("status").alias("predicate"), F.when(F.col("o_orderkey") % 2 == 0, "Open").otherwise(F.col("o_orderstatus")).alias("object"), F.to_date("o_orderdate").cast("string").alias("valid_from"))
    values = F.when(k % 3 == 0, F.array(F.lit("open"))).when(k % 3 == 1, F.array(F.lit("F"), F.lit("held"))).otherwise(F.array(F.lit("held")))
    held = V.read(spark, sf_dir, "customer").select(k.alias("c_custkey"), F.posexplode(values).alias("n", "object"))
    held = held.select((k * 2 + F.col("n")).alias("id"), F.concat(F.lit("tkt_"), k).alias("subject"), F.lit("status").alias("predicate"), "object", F.concat((1992 + k % 6).cast("string"), F.lit("-06-15")).alias("valid_from"))
    return G.single_inserts(held, asked)[0]


@query("WITH e AS (SELECT o_orderkey AS id, 'cust_' || o_custkey AS eid, 'cust_' || o_custkey || CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '_vip' WHEN 2 THEN '_77' WHEN 3 THEN 'x' ELSE '_#9_12' END AS name FROM orders) SELECT id, name = eid OR (starts_with(name, eid || '_') AND NOT regexp_matches(substr(name, length(eid) + 2), '^#?[0-9]+(_[0-9]+)*$')) AS qualified FROM e")
def p10_qualified(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    eid = F.concat(F.lit("cust_"), "o_custkey")
    name = F.concat(eid, F.when(k == 0, "").when(k == 1, "_vip").when(k == 2, "_77").when(k == 3, "x").otherwise("_#9_12"))
    return V.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), G.qualified(name, eid).alias("qualified"))
