"""Belief revision and mutation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramql.config import DAY_MS, DEFAULT
from engramql.functions import scalars as S
from engramql.operators import analytics as A
from engramql.operators import belief as B
from engramql.operators import mutations as U
from engramql.plans import model as M
from engramql.plans.registry import Registry

reg = Registry()
_OK = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_EFF = f"s * exp(-0.05e0 * greatest(0, {M.NOW} - last_access) / {float(DAY_MS)}e0)"
_NOM = f"""nom AS (SELECT c.id AS claim_id, n.id AS node_id, list_cosine_similarity(c.embedding::DOUBLE[], n.embedding::DOUBLE[]) AS cos FROM (SELECT * FROM live WHERE type = 'insight' AND {_OK}) c JOIN (SELECT * FROM live WHERE type IN ('fact', 'entity') AND {_OK}) n ON c.id <> n.id),
top5 AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY round(cos, 6) DESC, node_id) AS pos FROM nom QUALIFY pos <= 5)"""
_NORM = r"regexp_replace(trim(lower({0})), '\s+', ' ', 'g')"


def _claims(spark, d):
    live = M.live(spark, d, "type", "value", "embedding")
    return live.where("type = 'insight'"), live.where("type IN ('fact', 'entity')")


@reg.query("claim_nominations", f"WITH {_NOM} SELECT claim_id, node_id, round(cos, 5) AS cos FROM top5", "live")
def claim_nominations(spark, d):
    """G22, JN17: insights stand for claims."""
    claims, nodes = _claims(spark, d)
    return B.nominate(claims, nodes).select("claim_id", "node_id", F.round("cos", 5).alias("cos"))


@reg.query(
    "claim_routes",
    f"""WITH {_NOM}, j AS (SELECT t.*, {_NORM.format('c.value')} = {_NORM.format('n.value')} AS eq FROM top5 t JOIN live c ON c.id = t.claim_id JOIN live n ON n.id = t.node_id),
    b AS (SELECT claim_id, bool_or(eq) AS same, max(cos) AS best FROM j GROUP BY 1)
    SELECT l.id AS claim_id, CASE WHEN b.same THEN 'confirm' WHEN b.best IS NULL OR round(b.best, 6) < 0.3 THEN 'unrelated' ELSE 'judge' END AS route FROM live l LEFT JOIN b ON b.claim_id = l.id WHERE l.type = 'insight'""",
    "live",
)
def claim_routes(spark, d):
    """Fast path and gate before the judge."""
    claims, nodes = _claims(spark, d)
    return B.gated(claims, B.nominate(claims, nodes), nodes).select("claim_id", "route")


@reg.query("claims_applied")
def claims_applied(spark, d):
    """The insights of the snapshot as claims of one pass."""
    claims, nodes = _claims(spark, d)
    routes = B.gated(claims, B.nominate(claims, nodes), nodes)
    decided = routes.join(claims.select(F.col("id").alias("claim_id"), "value"), "claim_id").select(
        "claim_id", "route", F.when(F.col("route") != "unrelated", F.col("node_id")).alias("node_id"), "value", F.lit("observed").alias("origin"), F.lit("user").alias("role"),
        F.substring("claim_id", 1, 8).alias("session_id"), F.col("claim_id").alias("episode_id"), F.lit(False).alias("hard_keep"), F.lit(0.5).alias("salience"), F.lit(M.NOW).alias("ts"),
    )
    full = M.live(spark, d, "value", "s", "c", "last_access", "prev_value", "pending_contradictions")
    return B.apply_claims(decided, full).select("node_id", "claim_id", "action", F.round("s", 6).alias("s"), F.round("c", 6).alias("c"))


@reg.query(
    "route_contradiction",
    f"""WITH r AS (SELECT e.id, e.magnitude / 100 AS magnitude, {_EFF} * n.c AS resistance FROM mem_events e JOIN live n ON n.id = e.node_id WHERE e.event_type LIKE 'contradict%')
    SELECT id, CASE WHEN magnitude / greatest(resistance, 1e-9) < 0.8 THEN 'hold' WHEN magnitude / greatest(resistance, 1e-9) < 2.0 OR resistance < 0.3 THEN 'reconcile' ELSE 'append-new' END AS action FROM r""",
    "live mem_events",
)
def route_contradiction(spark, d):
    """F15."""
    n = M.live(spark, d, "s", "c", "last_access")
    e = M.mem_events(spark, d).where(F.col("event_type").startswith("contradict")).select("id", F.col("node_id"), (F.col("magnitude") / 100).alias("magnitude"))
    j = e.join(n.select(F.col("id").alias("node_id"), "s", "c", "last_access"), "node_id")
    return j.select("id", S.route_contradiction(F.col("magnitude"), S.effective_strength(F.col("s"), F.col("last_access"), M.NOW) * F.col("c")).alias("action"))


@reg.query(
    "strengthen_fold",
    f"""WITH h AS (SELECT node_id AS id, ts, row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, id DESC) - 1 AS after, max(ts) OVER (PARTITION BY node_id) AS e FROM mem_events WHERE event_type = 'confirm' AND node_id IS NOT NULL),
    p AS (SELECT id, sum(0.1e0 * pow(0.9e0, after) * exp(-0.05e0 * (e - ts) / {float(DAY_MS)}e0)) AS gain, count(*) AS k, max(e) AS e, min(ts) AS b FROM h GROUP BY id)
    SELECT p.id, round(n.s * pow(0.9e0, k) * exp(-0.05e0 * (greatest(0, b - n.last_access) + e - b) / {float(DAY_MS)}e0) + gain, 6) AS s, round(1 - (1 - n.c) * pow(0.95e0, k), 9) AS c, k FROM p JOIN live n ON n.id = p.id""",
    "live mem_events",
)
def strengthen_fold(spark, d):
    """F18, ST7."""
    f = B.fold_confirmations(M.mem_events(spark, d), M.live(spark, d, "s", "c", "last_access"))
    return f.select("id", F.round("s", 6).alias("s"), F.round("c", 9).alias("c"), "k")


@reg.query(
    "oscillations",
    f"SELECT id FROM live WHERE prev_value IS NOT NULL AND {_NORM.format('value')} = {_NORM.format('prev_value')}",
    "live",
)
def oscillations(spark, d):
    """F16."""
    n = M.live(spark, d, "value", "prev_value")
    return n.where(F.col("prev_value").isNotNull() & S.is_oscillation(F.col("value"), F.col("prev_value"))).select("id")


@reg.query(
    "node_upsert",
    f"""WITH ch AS (SELECT id, CASE WHEN left(id, 1) < '8' THEN value || ' (revised)' ELSE value END AS value, 0.7e0 AS c FROM live WHERE left(id, 1) IN ('0', '3', '9', 'c'))
    SELECT n.id, sha256(coalesce(ch.value, n.value)) = n.value_hash AS same, ch.id IS NOT NULL AND sha256(ch.value) <> n.value_hash AS dropped,
    CASE WHEN ch.id IS NOT NULL AND sha256(ch.value) <> n.value_hash THEN n.value ELSE n.prev_value END AS prev_value,
    CASE WHEN ch.id IS NOT NULL THEN coalesce(n.origin <> 'inferred', NULL) ELSE n.training_eligible END AS eligible FROM live n LEFT JOIN ch ON ch.id = n.id""",
    "live",
)
def node_upsert(spark, d):
    """M1."""
    live = M.live(spark, d, *U.NODE)
    ch = live.where(F.substring("id", 1, 1).isin("0", "3", "9", "c")).select(
        "id", "type", F.when(F.substring("id", 1, 1) < "8", F.concat("value", F.lit(" (revised)"))).otherwise(F.col("value")).alias("value"), "origin", "s", F.lit(0.7).alias("c"), "last_access"
    )
    out = U.upsert_nodes(live, ch)
    old = live.select("id", F.col("value_hash").alias("old_hash"))
    j = out.join(old, "id")
    changed = F.col("value_hash") != F.col("old_hash")
    return j.select("id", (F.sha2("value", 256) == F.col("old_hash")).alias("same"), changed.alias("dropped"), "prev_value", F.col("training_eligible").alias("eligible"))


@reg.query("edge_upsert", "WITH ch AS (SELECT src, dst, rel, w / 2 AS w FROM edges WHERE rel = 'uses') SELECT e.rel, count(*) AS n, round(sum(coalesce(ch.w, e.w)), 4) AS w FROM edges e LEFT JOIN ch USING (src, dst, rel) WHERE e.rel <> 'ref' GROUP BY 1", "edges")
def edge_upsert(spark, d):
    """M4."""
    e = M.edges(spark, d)
    out = U.upsert_edges(e, e.where("rel = 'uses'").withColumn("w", F.col("w") / 2), e.where("rel = 'ref'"))
    out = out.where("rel IS NOT NULL")  # rel <> 'ref' is not true of null
    return out.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), A.rounded_sum("w", 4).alias("w"))


@reg.query("tombstone_merge", "SELECT type, sum((coalesce(tombstoned, false) OR left(id, 1) = 'a')::INT)::BIGINT AS dead, sum((coalesce(training_eligible, false) AND left(id, 1) <> 'a')::INT)::BIGINT AS eligible FROM nodes GROUP BY 1", "nodes")
def tombstone_merge(spark, d):
    """M3."""
    n = M.nodes(spark, d, "type", "tombstoned", "training_eligible").fillna(False, ["tombstoned", "training_eligible"])
    out = U.tombstone(n, n.where(F.col("id").startswith("a")))
    return out.groupBy("type").agg(F.sum(F.col("tombstoned").cast("bigint")).alias("dead"), F.sum(F.col("training_eligible").cast("bigint")).alias("eligible"))


@reg.query("eviction_sweep", f"WITH gone AS (SELECT id FROM nodes WHERE coalesce(tombstoned, false) AND {_EFF} < 0.05 AND {M.NOW} - last_access > {30 * DAY_MS}) SELECT (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM gone)) AS nodes, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)) AS edges", "nodes edges")
def eviction_sweep(spark, d):
    """G32, G33."""
    n = M.nodes(spark, d, "s", "last_access", "tombstoned")
    eff = S.effective_strength(F.col("s"), F.col("last_access"), M.NOW)
    gone = n.where(F.coalesce("tombstoned", F.lit(False)) & (eff < DEFAULT.evict_strength) & (M.NOW - F.col("last_access") > DEFAULT.evict_age_ms)).select("id")
    nodes, edges, _ = U.evict(n, gone, M.edges(spark, d), {})
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))))  # one row each


queries = lambda: dict(reg.functions)
oracle_sql = lambda: dict(reg.sql)
