"""Queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramql.llm import clusters, conversations, near_duplicates, neighbours, packing, pii, splitting, tokens
from engramql.storage import table


def p1_found(spark, d):
    return near_duplicates.near_pairs(near_duplicates.word_records(table(spark, d, "node"), table(spark, d, "episode")))


def p1_groups(spark, d):
    return near_duplicates.near_groups(near_duplicates.word_records(table(spark, d, "node"), table(spark, d, "episode")))


def p3_found(spark, d):
    return pii.mentions(pii.texts(table(spark, d, "episode"), table(spark, d, "raw_calendar_event")), table(spark, d, "name_part"))


def p3_redacted(spark, d):
    return pii.redacted(pii.texts(table(spark, d, "episode"), table(spark, d, "raw_calendar_event")), table(spark, d, "name_part"))


def p4_found(spark, d):
    return conversations.left_out_sessions(table(spark, d, "episode"))


def p4_turns(spark, d):
    return conversations.conversations(table(spark, d, "episode"))


def p6_found(spark, d):
    return clusters.cluster_members(clusters.memory_vectors(table(spark, d, "node")))


def p6_clusters(spark, d):
    return clusters.cluster_descriptions(clusters.memory_vectors(table(spark, d, "node")))


def p7_found(spark, d):
    return neighbours.nearest_pairs(table(spark, d, "node"), table(spark, d, "knn_probe"))


def p7_ranked(spark, d):
    found = neighbours.nearest(neighbours.live_vectors(table(spark, d, "node")), table(spark, d, "knn_probe"))
    return found.select("probe_id", "other_id", F.round("cos", 6).alias("cos"), F.col("rank").cast("int").alias("rank"))


def p8_ids(spark, d):
    return tokens.encode_texts(table(spark, d, "documents"))


def p9_containers(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


def p10_pieces(spark, d):
    return splitting.split_documents(table(spark, d, "documents"))


_WORDS = r"""
WITH records AS (
  SELECT 'node' AS rec_kind, id, arg_max(value, landed_at) AS text FROM node GROUP BY id
  UNION ALL
  SELECT 'episode', id, arg_max(content, landed_at) FROM episode GROUP BY id
), sets AS (
  SELECT rec_kind, id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS words FROM records WHERE text IS NOT NULL AND id IS NOT NULL
), kept AS (SELECT rec_kind, id, words, len(words) AS n FROM sets WHERE len(words) >= 16),
flat AS (SELECT rec_kind, id, n, unnest(words) AS word FROM kept),
common AS (
  SELECT a.rec_kind, a.id AS a_id, b.id AS b_id, a.n AS na, b.n AS nb, count(*) AS shared
  FROM flat a JOIN flat b ON a.rec_kind = b.rec_kind AND a.word = b.word AND a.id < b.id AND a.n * 10 >= b.n * 7 AND b.n * 10 >= a.n * 7
  GROUP BY ALL
)
"""

_PAIRS = "SELECT rec_kind, a_id, b_id FROM common WHERE shared * 10 >= (na + nb - shared) * 7"

_GROUPS = (
    _WORDS.replace("WITH records", "WITH RECURSIVE records")
    + f""", member AS (SELECT rec_kind, id, min(id) OVER (PARTITION BY rec_kind, list_sort(words)) AS class_id FROM kept), pairs AS ({_PAIRS}),
link AS (SELECT DISTINCT p.rec_kind, c.class_id AS a, d.class_id AS b FROM (SELECT rec_kind, a_id, b_id FROM pairs UNION ALL SELECT rec_kind, b_id, a_id FROM pairs) p
  JOIN member c ON c.rec_kind = p.rec_kind AND c.id = p.a_id JOIN member d ON d.rec_kind = p.rec_kind AND d.id = p.b_id WHERE c.class_id <> d.class_id),
reach AS (SELECT rec_kind, a, b FROM link UNION SELECT r.rec_kind, r.a, l.b FROM reach r JOIN link l ON l.rec_kind = r.rec_kind AND l.a = r.b),
grp AS (SELECT rec_kind, a, min(b) AS other FROM reach GROUP BY 1, 2), cnt AS (SELECT rec_kind, a, count(*) AS links FROM link GROUP BY 1, 2)
SELECT m.rec_kind, m.id, m.class_id, least(m.class_id, coalesce(g.other, m.class_id)) AS group_id, coalesce(c.links, 0) AS links
FROM member m LEFT JOIN grp g ON g.rec_kind = m.rec_kind AND g.a = m.class_id LEFT JOIN cnt c ON c.rec_kind = m.rec_kind AND c.a = m.class_id"""
)

_SESSIONS = r"""
WITH rows AS (
  SELECT id, ts, source, external_id, lower(trim(session_id)) AS session_id, landed_at, content,
    CASE WHEN regexp_replace(lower(role), '[^\p{L}\p{N}]+', '', 'g') IN ('user', 'usr', 'human', 'person', 'enduser') THEN 0
         WHEN regexp_replace(lower(role), '[^\p{L}\p{N}]+', '', 'g') IN ('tool', 'tools', 'toolresult', 'tooluse', 'function', 'functioncall') THEN 1
         WHEN regexp_replace(lower(role), '[^\p{L}\p{N}]+', '', 'g') IN ('assistant', 'asst', 'ai', 'bot', 'chatbot', 'model', 'llm', 'aiassistant') THEN 2
         ELSE 3 END AS rank
  FROM episode WHERE source IN ('claude-code', 'telegram', 'conversation') AND trim(coalesce(session_id, '')) <> ''
), by_id AS (
  SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY id ORDER BY landed_at, ts, content) = 1
), once AS (
  SELECT * FROM by_id QUALIFY external_id IS NULL OR row_number() OVER (PARTITION BY source, external_id ORDER BY landed_at, id) = 1
), kept AS (
  SELECT *, row_number() OVER w AS pos, sum((rank = 0)::INT) OVER w AS turn
  FROM once WHERE regexp_matches(coalesce(content, ''), '[^\s]')
  WINDOW w AS (PARTITION BY session_id ORDER BY ts NULLS FIRST, rank, id ROWS UNBOUNDED PRECEDING)
), turns AS (
  SELECT session_id, turn, bool_or(rank = 2) AS answered, bool_or(rank = 3 OR coalesce(ts, 0) <= 0) AS bad, bool_or(pos = 1 AND rank <> 0) AS headless
  FROM kept GROUP BY session_id, turn
), states AS (
  SELECT session_id, bool_or(bad) OR bool_or(headless) AS broken, bool_or(turn > 0 AND NOT answered) AS unanswered FROM turns GROUP BY session_id
)
"""

_REASONS = """SELECT * FROM (
  SELECT s.session_id, CASE WHEN t.session_id IS NULL THEN 'empty' WHEN broken THEN 'broken' WHEN unanswered THEN 'unanswered' END AS reason
  FROM (SELECT DISTINCT session_id FROM once) s LEFT JOIN states t ON t.session_id = s.session_id
) WHERE reason IS NOT NULL
"""

_TURNS = """SELECT session_id, pos - 1 AS turn, id, ts, CASE rank WHEN 0 THEN 'user' WHEN 1 THEN 'tool' WHEN 2 THEN 'assistant' END AS role, content FROM kept
WHERE session_id IN (SELECT session_id FROM states WHERE NOT coalesce(broken, false) AND NOT coalesce(unanswered, false))"""

_VECTORS = r"""
WITH last AS (SELECT * FROM node QUALIFY row_number() OVER (PARTITION BY id ORDER BY landed_at DESC) = 1),
usable AS (
  SELECT id, type, origin, embedding::DOUBLE[] AS v FROM last
  WHERE NOT coalesce(tombstoned, false) AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)
"""

_CLUSTERS = (
    _VECTORS
    + r"""
, pool AS (SELECT * FROM usable WHERE type IN ('fact', 'entity') AND coalesce(origin, '') <> 'inferred'),
near AS (SELECT a.id, b.id AS other FROM pool a JOIN pool b ON a.type = b.type WHERE list_cosine_similarity(a.v, b.v) >= 0.75 OR a.id = b.id),
grouped AS (SELECT id AS node_id, min(other) AS first_id, count(*) AS n FROM near GROUP BY id)
"""
)

_NEAREST = (
    _VECTORS
    + r"""
, scored AS (
  SELECT p.id AS probe_id, o.id AS other_id, list_cosine_similarity(p.v, o.v) AS cos
  FROM usable p JOIN usable o ON p.id <> o.id WHERE p.id IN (SELECT node_id FROM knn_probe)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY round(cos, 9) DESC, other_id) AS rank FROM scored QUALIFY rank <= 10
)
"""
)


def queries():
    return {
        "p1_found": p1_found,
        "p1_groups": p1_groups,
        "p3_found": p3_found,
        "p3_redacted": p3_redacted,
        "p4_found": p4_found,
        "p4_turns": p4_turns,
        "p6_found": p6_found,
        "p6_clusters": p6_clusters,
        "p7_found": p7_found,
        "p7_ranked": p7_ranked,
        "p8_ids": p8_ids,
        "p9_containers": p9_containers,
        "p10_pieces": p10_pieces,
    }


def oracle_sql():
    return {
        "p1_found": _WORDS + _PAIRS,
        "p1_groups": _GROUPS,
        "p4_found": _SESSIONS + _REASONS,
        "p4_turns": _SESSIONS + _TURNS,
        "p6_found": _CLUSTERS + "SELECT first_id, node_id FROM grouped WHERE n >= 3",
        "p6_clusters": _CLUSTERS
        + """, sized AS (SELECT g.*, p.type, count(*) OVER (PARTITION BY first_id) AS size, row_number() OVER (PARTITION BY first_id ORDER BY n DESC, node_id) AS rank FROM grouped g JOIN pool p ON p.id = g.node_id WHERE n >= 3)
SELECT first_id, min(type) AS type, max(size) AS size, string_agg(node_id, ' ' ORDER BY rank) FILTER (rank <= 3) AS typical FROM sized GROUP BY first_id""",
        "p7_found": _NEAREST + "SELECT DISTINCT least(probe_id, other_id) AS a_id, greatest(probe_id, other_id) AS b_id FROM ranked",
        "p7_ranked": _NEAREST + "SELECT probe_id, other_id, round(cos, 6) AS cos, rank::INT AS rank FROM ranked",
    }
