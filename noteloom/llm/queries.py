"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scanned

    return scanned(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .mixing import planned

    plan = planned(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import formatted

    return formatted(table(spark, sf_dir, "conversations"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged_reports

    return damaged_reports(table(spark, sf_dir, "conversations"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_counts

    return line_counts(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT payload_digest, max(page_id) AS latest FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN w.latest IS NULL OR p.page_id = w.latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> w.latest THEN w.latest END AS refers_to, TRUE AS intact
FROM p LEFT JOIN w ON p.payload_digest = w.payload_digest AND p.payload_bytes >= 1000
"""


OP7_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
), c AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY pos) AS turns FROM t GROUP BY conv_id
), longer AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM c)
), kept AS (
  SELECT min(conv_id) AS conv_id FROM c WHERE turns NOT IN (SELECT turns FROM longer) GROUP BY turns
)
SELECT t.conv_id, count(*) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY ALL
"""

OP11_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), hashed AS (  -- crc32, bit by bit
  SELECT *, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::UBIGINT)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)::UBIGINT[]), lambda d, i: xor(d >> 1, 3988292384::UBIGINT * (d & 1))))) % 20 AS kind
  FROM keyed
), broken AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS initial FROM broken
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
                 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
         lead(initial) OVER (PARTITION BY c ORDER BY pos) AS next
  FROM numbered
), counted AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM faulty GROUP BY c
), ins(p, m, letters, added) AS (  -- states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
  VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), (0, 2, 'I', 'user:' || chr(10)), (1, 2, 'I', 'user:' || chr(10)), (3, 2, 'I', 'user:' || chr(10)),
         (2, 3, 'I', 'assistant:' || chr(10)), (0, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))
), act(m, q, letter, needs, given) AS (
  VALUES (0, 0, 'D', '', ''), (1, 1, 'D', '', ''), (2, 2, 'D', '', ''), (3, 3, 'D', '', ''), (0, 1, 'K', 's', ''),
         (0, 2, 'K', 'u', ''), (1, 2, 'K', 'u', ''), (3, 2, 'K', 'u', ''), (2, 3, 'K', 'a', ''),
         (0, 2, 'R', '', 'user'), (1, 2, 'R', '', 'user'), (3, 2, 'R', '', 'user'), (2, 3, 'R', '', 'assistant')
), best AS (
  SELECT c, 0::BIGINT AS pos, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'made': ''} AS b FROM counted
  UNION ALL
  SELECT best.c, f.pos, act.q, min({
    'cost': best.b.cost + 3 * length(ins.letters) + CASE act.letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN act.letter <> 'D' AND f.fault = 3 THEN 3 ELSE 0 END,
    'audit': best.b.audit || ins.letters || act.letter,
    'made': best.b.made || ins.added || CASE act.letter WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10) ELSE act.given || ':' || f.text || chr(10) END})
  FROM best JOIN faulty AS f ON f.c = best.c AND f.pos = best.pos + 1 JOIN ins ON ins.p = best.q JOIN act ON act.m = ins.m
  WHERE act.letter = 'D' OR f.fault IN (0, 3) AND (act.letter = 'R' OR f.initial = act.needs)
  GROUP BY best.c, f.pos, act.q
), done AS (
  SELECT best.c, min({'cost': b.cost + 3 * length(letters), 'audit': b.audit || letters, 'made': b.made || added}) AS b
  FROM best JOIN counted USING (c) JOIN ins ON ins.p = best.q WHERE best.pos = counted.n AND ins.m IN (0, 3) GROUP BY best.c
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(b.made[1:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS c FROM conversations) LEFT JOIN counted USING (c) LEFT JOIN done USING (c)
"""

OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, m
  FROM w, range(1, 6) AS sizes(m), unnest(range(1, len(ws) - m + 2)) AS places(i)
), f AS (
  SELECT lang, phrase, m, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100
), whole AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), c AS (
  SELECT * FROM f WHERE m >= 2 AND NOT EXISTS (
    SELECT 1 FROM f AS longer WHERE longer.lang = f.lang AND longer.m > f.m AND longer.a >= f.a AND contains(' ' || longer.phrase || ' ', ' ' || f.phrase || ' '))
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM c, range(1, 5) AS ks(k) WHERE k < m
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, n, x.a AS l, y.a AS r, k, (1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts JOIN whole USING (lang) JOIN f AS x ON x.lang = cuts.lang AND x.phrase = first JOIN f AS y ON y.lang = cuts.lang AND y.phrase = rest
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""

OP13_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d
), k AS (
  SELECT rid, place, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), shared AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10
), kept AS (
  SELECT rid, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY place) AS text FROM k WHERE key NOT IN (SELECT key FROM shared) GROUP BY rid
)
SELECT doc_id, len(lines) AS n_lines, len(lines) - coalesce(n_kept, 0) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

#: Sizes follow the contract's words; the copies themselves draw on a hash that DuckDB does not have, so op6 has no SQL.


def queries() -> dict:
    return {f.__name__: f for f in (op1_secrets, op2_html, op3_warc, op4_simhash, op5_ann, op6_mixing, op7_chat, op8_packing, op9_quality, op10_token_counts, op11_repair, op12_phrases, op13_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op7_chat": OP7_SQL, "op11_repair": OP11_SQL, "op12_phrases": OP12_SQL, "op13_line_dedup": OP13_SQL}
