"""Queries of scopes, sidecar tables, key-value pairs and small text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramql.functions import parsing as J
from engramql.functions import scalars as S
from engramql.operators import mutations as U
from engramql.operators import provenance as P
from engramql.plans import model as M
from engramql.plans.registry import Registry
from engramql.storage import table

reg = Registry()
_TOUCH = "touch AS (SELECT DISTINCT v.node_id AS id, p.cwd FROM mem_events v JOIN episodes p ON p.id = v.episode_id WHERE v.node_id IS NOT NULL)"
_SLUG = "lower(regexp_extract(rtrim(trim(coalesce(cwd, '')), '/'), '^/(?:Users|home)/[^/]+(?:/([^/]+))?', 1))"
_SCOPES = f"{_TOUCH}, sl AS (SELECT id, {_SLUG} AS g FROM touch), sc AS (SELECT id, CASE WHEN count(DISTINCT g) FILTER (g NOT IN ('', 'resume')) = 1 THEN max(g) FILTER (g NOT IN ('', 'resume')) ELSE 'global' END AS scope FROM sl GROUP BY id)"
WANTED = "klealainer-board"


@reg.query("scope_keep", f"WITH {_SCOPES} SELECT l.id FROM live l LEFT JOIN sc ON sc.id = l.id WHERE sc.scope IS NULL OR sc.scope IN ('{WANTED}', 'global')", "live mem_events episodes")
def scope_keep(spark, d):
    """Nodes that a session of one project may see."""
    stamps = P.scope_stamps(M.mem_events(spark, d), M.episodes(spark, d, "cwd")).withColumnRenamed("node_id", "id")
    return M.live(spark, d).join(stamps, "id", "left").where(F.col("scope").isNull() | F.col("scope").isin(WANTED, "global")).select("id")


@reg.query("embedding_guard", "SELECT id, CASE WHEN left(id, 1) < '8' THEN embedding[1] = 1 ELSE coalesce(embedding[1] = 1, false) END AS replaced, CASE WHEN left(id, 1) < '8' THEN value_hash ELSE embedded_hash END AS embedded_hash FROM (SELECT * REPLACE (CASE WHEN left(id, 1) < '8' THEN [1::FLOAT] ELSE embedding END AS embedding) FROM live)", "live")
def embedding_guard(spark, d):
    """M2: vectors made of an older value change nothing."""
    n = M.live(spark, d, "value_hash", "embedding", "embedded_hash")
    h = F.when(F.substring("id", 1, 1) < "8", F.col("value_hash")).otherwise("stale")
    v = n.select("id", h.alias("value_hash"), F.array_repeat(F.lit(1.0).cast("float"), 64).alias("vector"))
    out = U.set_embeddings(n, v)
    return out.select("id", F.coalesce(F.get("embedding", F.lit(0)) == 1, F.lit(False)).alias("replaced"), "embedded_hash")


@reg.query("scope_sidecar", f"WITH {_SCOPES} SELECT s.id AS node_id, CASE WHEN left(s.id, 1) < '8' THEN 'moved' ELSE s.scope END AS scope, 1::BIGINT AS created_at, CASE WHEN left(s.id, 1) < '8' THEN 2 ELSE 1 END::BIGINT AS updated_at FROM sc s", "mem_events episodes")
def scope_sidecar(spark, d):
    """M5, M7: a merge that keeps the first creation time."""
    one = F.lit(1).cast("bigint")
    rows = P.scope_stamps(M.mem_events(spark, d), M.episodes(spark, d, "cwd")).select("node_id", "scope", one.alias("created_at"), one.alias("updated_at"))
    new = rows.where(F.substring("node_id", 1, 1) < "8").select("node_id", F.lit("moved").alias("scope"), (one + 1).alias("created_at"), (one + 1).alias("updated_at"))
    return U.upsert_sidecar(rows, new, ["node_id"], once=("created_at",))


@reg.query("consolidation_marks", "SELECT source, sum((coalesce(consolidated, false) OR left(id, 1) = 'b')::INT)::BIGINT AS done, sum((source_inference_id IS NOT NULL OR left(id, 1) = 'c')::INT)::BIGINT AS referring FROM episodes GROUP BY 1", "episodes")
def consolidation_marks(spark, d):
    """M6."""
    e = M.episodes(spark, d, "source", "consolidated", "source_inference_id")
    out = U.mark_consolidated(e, e.where(F.col("id").startswith("b")), e.where(F.col("id").startswith("c")).select("id", F.lit("found").alias("source_inference_id")))
    return out.groupBy("source").agg(F.sum(F.col("consolidated").cast("bigint")).alias("done"), F.sum(F.col("source_inference_id").isNotNull().cast("bigint")).alias("referring"))


@reg.query("pending_markers", "SELECT 'pending:' || scope AS key, count(*)::VARCHAR AS value FROM documents WHERE scope IS NOT NULL AND left(scope, 1) <> 'a' GROUP BY scope")
def pending_markers(spark, d):
    """Markers by key prefix, those that were worked off deleted."""
    scopes = table(spark, d, "documents").where("scope IS NOT NULL").groupBy("scope").agg(F.count(F.lit(1)).cast("string").alias("value"))
    meta = scopes.select(F.concat(F.lit("pending:"), "scope").alias("key"), "value").unionByName(scopes.select(F.concat(F.lit("other:"), "scope").alias("key"), "value"))
    done = scopes.where(F.substring("scope", 1, 1) == "a").select(F.concat(F.lit("pending:"), "scope").alias("key"), F.lit(None).cast("string").alias("value"))
    return U.put_meta(meta, done).where(F.col("key").startswith("pending:"))


@reg.query(
    "time_texts",
    "SELECT id, strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, '[' || strftime(make_timestamp(ts * 1000), '%Y-%m-%d') || '] ' || source AS dated, (ts // 3600000) % 24 >= 22 OR (ts // 3600000) % 24 < 7 AS quiet, CASE WHEN role IN ('meeting', 'payment') THEN role ELSE 'other' END AS action FROM episodes WHERE ts > 0",
    "episodes",
)
def time_texts(spark, d):
    """F29, F30, F31, F34."""
    e = M.episodes(spark, d, "ts", "source", "role").where("ts > 0")
    hour = F.floor(F.col("ts") / 3_600_000) % 24
    return e.select("id", S.utc_iso(F.col("ts")).alias("iso"), S.date_prefixed(F.col("source"), F.col("ts")).alias("dated"), S.in_quiet_hours(hour, 22, 7).alias("quiet"), S.action_type(F.col("role")).alias("action"))


@reg.query("content_ids", r"SELECT doc_id, coalesce(title, '') || '#' || left(sha256(text), 16) AS external_id, regexp_extract(text, '(?s)^---.*?\ntype:\s*(\S+)', 1) AS note_type FROM documents WHERE text IS NOT NULL")
def content_ids(spark, d):
    """S13, J9."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", S.content_external_id(F.coalesce("title", F.lit("")), F.col("text")).alias("external_id"), F.regexp_extract("text", r"(?s)^---.*?\ntype:\s*(\S+)", 1).alias("note_type"))


@reg.query(
    "safe_verdicts",
    """WITH v AS (SELECT id, event_type, magnitude, node_id FROM mem_events WHERE node_id IS NOT NULL)
    SELECT id, CASE WHEN event_type IN ('confirm', 'extend') AND id % 3 <> 0 THEN event_type ELSE 'unrelated' END AS relation,
    CASE WHEN event_type IN ('confirm', 'extend') AND id % 3 <> 0 THEN round(greatest(0, least(1, magnitude / 50)), 6) WHEN event_type = 'unrelated' THEN round(greatest(0, least(1, magnitude / 50)), 6) ELSE 0 END AS magnitude FROM v""",
    "mem_events",
)
def safe_verdicts(spark, d):
    """Answers of a judge, some with unknown relations or ids that were not offered."""
    e = M.mem_events(spark, d).where("node_id IS NOT NULL")
    named = F.when(F.col("id") % 3 == 0, "elsewhere").otherwise(F.col("node_id"))
    answer = F.to_json(F.struct(named.alias("best_candidate_id"), F.col("event_type").alias("relation"), (F.col("magnitude") / 50).alias("magnitude")))
    v = e.select("id", J.verdict(answer, F.array("node_id")).alias("v"))
    return v.select("id", F.col("v.relation").alias("relation"), F.round("v.magnitude", 6).alias("magnitude"))


queries = lambda: dict(reg.functions)
oracle_sql = lambda: dict(reg.sql)
