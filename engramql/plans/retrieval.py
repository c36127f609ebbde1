"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramql.config import DAY_MS, DEFAULT
from engramql.functions import scalars as S
from engramql.functions.vectors import usable
from engramql.operators import provenance
from engramql.operators import retrieval as R
from engramql.plans import model as M
from engramql.plans.registry import Registry

reg = Registry()
TERMS = ("retry", "budget", "cursor")
_TERMS_SQL = "(VALUES ('retry'), ('budget'), ('cursor')) q(term)"
_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_Q = f"q AS (SELECT embedding::DOUBLE[] AS q FROM live WHERE {_USABLE} ORDER BY id LIMIT 1)"
_SCORED = f"{_Q}, scored AS (SELECT id, list_cosine_similarity(embedding::DOUBLE[], q) AS cos FROM live, q WHERE {_USABLE})"
_BM25 = rf"""tok AS (SELECT id, regexp_extract_all(lower(coalesce(value, '')), '[\p{{L}}\p{{N}}]+') AS t FROM live),
doc AS (SELECT id, t, len(t)::DOUBLE AS dl FROM tok WHERE len(t) > 0),
tf AS (SELECT id, dl, term, len(list_filter(t, lambda x: x = term))::DOUBLE AS tf FROM doc, {_TERMS_SQL}),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM doc),
dfs AS (SELECT term, sum((tf > 0)::INT)::DOUBLE AS df FROM tf GROUP BY term),
bm AS (SELECT id, sum(greatest(ln((n - df + 0.5e0) / (df + 0.5e0)), 1e-6) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score
       FROM tf JOIN dfs USING (term), st GROUP BY id HAVING max(tf) > 0)"""


def query_vector(spark, d) -> list[float]:
    """The vector of the live node with the smallest id: one row."""
    return M.live(spark, d, "embedding").where(usable(F.col("embedding"), 64)).orderBy("id").select("embedding").first()[0]


@reg.query("topk_cosine", f"WITH {_SCORED} SELECT id, round(cos, 6) AS cos FROM scored ORDER BY round(cos, 9) DESC, id LIMIT 10", "live")
def topk_cosine(spark, d):
    """R1, R2, F12, P2, P10."""
    return R.top(R.cosine_scores(M.live(spark, d, "embedding"), query_vector(spark, d)), "cos", 10).select("id", F.round("cos", 6).alias("cos"))


@reg.query(
    "topk_tombstoned",
    f"WITH {_Q} SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cos FROM nodes, q WHERE tombstoned AND {_USABLE} ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], q), 9) DESC, id LIMIT 10",
    "live",
)
def topk_tombstoned(spark, d):
    """R3."""
    dead = M.nodes(spark, d, "embedding", "tombstoned").where("tombstoned")
    return R.top(R.cosine_scores(dead, query_vector(spark, d)), "cos", 10).select("id", F.round("cos", 6).alias("cos"))


@reg.query(
    "tri_state",
    f"""WITH {_Q}, s AS (SELECT id, coalesce(tombstoned, false) AS dead, list_cosine_similarity(embedding::DOUBLE[], q) AS cos FROM nodes, q WHERE {_USABLE}),
    b AS (SELECT * FROM s WHERE cos >= 0.7 ORDER BY dead, round(cos, 9) DESC, id DESC LIMIT 1)
    SELECT coalesce((SELECT CASE WHEN dead THEN 'deleted' ELSE 'ok' END FROM b), 'unreachable') AS state, (SELECT id FROM b) AS id, (SELECT round(cos, 6) FROM b) AS cos""",
    "live",
)
def tri_state(spark, d):
    """R9."""
    return R.tri_state(M.nodes(spark, d, "embedding", "tombstoned"), query_vector(spark, d))


@reg.query("bm25_topk", f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, id LIMIT 20", "live")
def bm25_topk(spark, d):
    """R4, F13, JN7."""
    return R.top(R.bm25(M.live(spark, d, "value"), "value", TERMS), "score", 20).select("id", F.round("score", 6).alias("score"))


@reg.query(
    "prefix_search",
    r"""WITH tok AS (SELECT id, regexp_extract_all(lower(coalesce(value, '')), '[\p{L}\p{N}]+') AS t FROM live),
    doc AS (SELECT id, len(t)::DOUBLE AS dl, len(list_filter(t, lambda x: starts_with(x, 'sche')))::DOUBLE AS tf FROM tok WHERE len(t) > 0),
    st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, sum((tf > 0)::INT)::DOUBLE AS df FROM doc)
    SELECT id, round(greatest(ln((n - df + 0.5e0) / (df + 0.5e0)), 1e-6) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)), 6) AS score FROM doc, st WHERE tf > 0
    ORDER BY round(greatest(ln((n - df + 0.5e0) / (df + 0.5e0)), 1e-6) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)), 9) DESC, id LIMIT 20""",
    "live",
)
def prefix_search(spark, d):
    """R21."""
    return R.top(R.bm25(M.live(spark, d, "value"), "value", ["sche"], prefix=True), "score", 20).select("id", F.round("score", 6).alias("score"))


_HYBRID = f"""{_SCORED}, {_BM25},
c AS (SELECT id, cos, row_number() OVER (ORDER BY round(cos, 9) DESC, id) - 1 AS rank FROM scored QUALIFY rank < 30),
b AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM bm QUALIFY rank < 30),
fused AS (SELECT id, sum(1e0 / (60 + rank + 1)) AS fused FROM (SELECT id, rank FROM c UNION ALL SELECT id, rank FROM b) GROUP BY id),
best AS (SELECT f.id, f.fused, coalesce(c.cos, 0) AS cos FROM fused f LEFT JOIN c ON c.id = f.id ORDER BY round(f.fused, 9) DESC, f.id LIMIT 10)"""


@reg.query("rrf_hybrid", f"WITH {_HYBRID} SELECT id, round(fused, 6) AS fused, round(cos, 6) AS cos FROM best", "live")
def rrf_hybrid(spark, d):
    """R5, R6."""
    found = R.hybrid(M.live(spark, d, "embedding", "value"), query_vector(spark, d), TERMS, 10)
    return found.select("id", F.round("fused", 6).alias("fused"), F.round("cos", 6).alias("cos"))


_STALE = """stale AS (
  SELECT a.node_id AS id FROM mem_events a JOIN nodes e ON e.id = a.node_id AND e.type = 'entity'
  JOIN mem_events b ON a.episode_id = b.episode_id JOIN nodes f ON f.id = b.node_id AND f.type = 'fact'
  GROUP BY a.node_id HAVING NOT bool_or(NOT coalesce(f.tombstoned, false)))"""
_SUPPORT = "support AS (SELECT v.node_id AS id, max(p.ts) AS ts FROM mem_events v JOIN episodes p ON p.id = v.episode_id WHERE v.node_id IS NOT NULL GROUP BY 1)"
_RANKED = f"""{_SCORED}, {_STALE}, {_SUPPORT},
best AS (SELECT id, cos FROM scored ORDER BY round(cos, 9) DESC, id LIMIT 10),
kept AS (SELECT b.id, b.cos, s.ts, row_number() OVER (ORDER BY round(b.cos, 9) DESC, b.id) - 1 AS rank FROM best b LEFT JOIN support s ON s.id = b.id WHERE b.cos >= 0.3 AND b.id NOT IN (SELECT id FROM stale))"""


@reg.query("ranked_stale_filtered", f"WITH {_RANKED} SELECT id, round(cos, 6) AS cos, rank::BIGINT AS rank FROM kept", "live mem_events episodes")
def ranked_stale_filtered(spark, d):
    """R7 with JN4."""
    best = R.top(R.cosine_scores(M.live(spark, d, "embedding"), query_vector(spark, d)), "cos", DEFAULT.ranked_k).where(F.col("cos") >= DEFAULT.ranked_floor)
    stale = provenance.stale_entities(M.mem_events(spark, d), M.nodes(spark, d, "type", "tombstoned"))
    return R.ranked(best.join(stale, "id", "left_anti"), "cos").select("id", F.round("cos", 6).alias("cos"), F.col("rank").cast("bigint").alias("rank"))


@reg.query(
    "temporal_reorder",
    f"""WITH {_RANKED}, slots AS (SELECT rank AS slot, row_number() OVER (ORDER BY rank) AS pos FROM kept WHERE ts IS NOT NULL),
    ordered AS (SELECT *, row_number() OVER (ORDER BY ts DESC, rank) AS pos FROM kept WHERE ts IS NOT NULL)
    SELECT o.id, s.slot::BIGINT AS rank, o.ts FROM ordered o JOIN slots s USING (pos) UNION ALL SELECT id, rank::BIGINT, ts FROM kept WHERE ts IS NULL""",
    "live mem_events episodes",
)
def temporal_reorder(spark, d):
    """R7 with dates, JN6, F30."""
    events = M.mem_events(spark, d)
    best = R.top(R.cosine_scores(M.live(spark, d, "embedding"), query_vector(spark, d)), "cos", DEFAULT.ranked_k).where(F.col("cos") >= DEFAULT.ranked_floor)
    stale = provenance.stale_entities(events, M.nodes(spark, d, "type", "tombstoned"))
    kept = R.ranked(best.join(stale, "id", "left_anti"), "cos").join(provenance.latest_support(events, M.episodes(spark, d, "ts")), "id", "left")
    return R.temporal_slots(kept.select("id", "rank", "ts"), "ts").select("id", F.col("rank").cast("bigint").alias("rank"), "ts")


_EFF = f"s * exp(-0.05e0 * greatest(0, {M.NOW} - last_access) / {float(DAY_MS)}e0)"


@reg.query(
    "effective_strength",
    f"SELECT id, round({_EFF}, 6) AS eff, round(exp(-0.05e0 * ({M.NOW} - last_access) / {float(DAY_MS)}e0), 6) AS recency FROM live",
    "live",
)
def effective_strength(spark, d):
    """F1, F2."""
    n = M.live(spark, d, "s", "last_access")
    return n.select("id", F.round(S.effective_strength(F.col("s"), F.col("last_access"), M.NOW), 6).alias("eff"), F.round(S.recency(F.col("last_access"), M.NOW), 6).alias("recency"))


_SPREAD = f"""base AS (SELECT id, {_EFF} AS base FROM live WHERE coalesce(origin, '') <> 'inferred'),
seeds AS (SELECT * FROM base ORDER BY round(base, 9) DESC, id LIMIT 10),
boosts AS (SELECT e.dst AS id, sum(s.base * e.w * 0.5e0) AS boost FROM edges e JOIN seeds s ON s.id = e.src WHERE e.dst IN (SELECT id FROM live) GROUP BY 1),
act AS (SELECT coalesce(b.id, x.id) AS id, coalesce(b.base, 0) + coalesce(x.boost, 0) AS score FROM base b FULL JOIN boosts x ON x.id = b.id)"""


def _activated(spark, d):
    live = M.live(spark, d, "s", "last_access", "origin", "value")
    base = R.cueless_base(live.where(F.coalesce(F.col("origin") != "inferred", F.lit(True))), M.NOW)
    return live, R.spread(base, M.edges(spark, d), live)


@reg.query("spread_activation", f"WITH {_SPREAD} SELECT id, round(score, 6) AS score FROM act ORDER BY round(score, 9) DESC, id LIMIT 50", "live edges")
def spread_activation(spark, d):
    """G1, R8."""
    return _activated(spark, d)[1].orderBy(F.round("score", 9).desc(), "id").limit(50).select("id", F.round("score", 6).alias("score"))


_BUDGET = f"""{_SPREAD}, cand AS (SELECT a.id, a.score, l.value, length(l.value) AS chars, regexp_matches(l.value, '(?i)(\\balways\\b|\\bnever\\b)') AS hard FROM act a JOIN live l ON l.id = a.id WHERE l.value IS NOT NULL),
run AS (SELECT *, sum(chars) OVER (ORDER BY round(score, 9) DESC, id ROWS UNBOUNDED PRECEDING) AS total FROM cand WHERE NOT hard),
chosen AS (SELECT id, score, value, chars, hard FROM cand WHERE hard UNION ALL SELECT id, score, value, chars, hard FROM run WHERE total + (SELECT coalesce(sum(chars), 0) FROM cand WHERE hard) <= 20000)"""


def _chosen(spark, d):
    live, act = _activated(spark, d)
    scored = act.join(live.select("id", "value"), "id").where("value IS NOT NULL")
    scored = scored.withColumn("chars", F.length("value")).withColumn("hard", S.any_match(F.col("value"), (r"\balways\b", r"\bnever\b"), True))
    return R.within_budget(scored, 20_000)


@reg.query("token_budget", f"WITH {_BUDGET} SELECT id, round(score, 6) AS score, hard FROM chosen", "live edges")
def token_budget(spark, d):
    """Kept lines first, then by score within the budget."""
    return _chosen(spark, d).select("id", F.round("score", 6).alias("score"), "hard")


@reg.query(
    "injected_text",
    f"""WITH {_BUDGET}, t AS (SELECT string_agg(CASE WHEN hard THEN '[keep] ' ELSE '' END || value, chr(10) ORDER BY NOT hard, -round(score, 9), id) AS text FROM chosen)
    SELECT CASE WHEN length(text) <= 10000 THEN text ELSE regexp_replace(left(text, 10000), '\\n[^\\n]*$', '') END AS text FROM t""",
    "live edges",
)
def injected_text(spark, d):
    """R22."""
    return R.injected_text(_chosen(spark, d), 10_000)


@reg.query(
    "surface_rank",
    f"""WITH open_ AS (SELECT * FROM due WHERE (due_ms >= {M.DUE_NOW} - 10800000 OR recurrence_rule IS NOT NULL)
      AND NOT coalesce(outcome IN ('completed', 'dismissed', 'surfaced', 'seen') OR (outcome = 'snoozed' AND snooze_until_ms > {M.DUE_NOW}), false)),
    sc AS (SELECT o.node_id, o.action_type, CASE WHEN due_ms - {M.DUE_NOW} < 86400000 THEN 0 ELSE 1 END AS tier,
      0.5e0 * greatest(0e0, least(1e0, 1 - (due_ms - {M.DUE_NOW}) / 604800000e0)) + 0.5e0 * greatest(0e0, least(1e0, l.s)) AS score FROM open_ o JOIN live l ON l.id = o.node_id),
    shown AS (SELECT count(*) AS n FROM due WHERE outcome IN ('surfaced', 'seen') AND surfaced_ms >= {M.DUE_NOW} - 86400000 AND due_ms - surfaced_ms >= 86400000),
    p AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY round(score, 9) DESC, node_id) AS pos FROM sc)
    SELECT node_id, action_type, tier, round(score, 6) AS score FROM p, shown WHERE tier = 0 OR pos <= greatest(0, 5 - n)""",
    "live due",
)
def surface_rank(spark, d):
    """R11, P7, P8, F14, JN8."""
    return R.surface_rank(M.due(spark, d), M.live(spark, d, "s"), M.DUE_NOW)


@reg.query("replay_order", "SELECT id, row_number() OVER (ORDER BY coalesce(hard_keep, false) DESC, salience DESC, ts, id) AS pos FROM episodes WHERE NOT coalesce(consolidated, false) ORDER BY pos LIMIT 100", "episodes")
def replay_order(spark, d):
    """The head of the queue; the order is a top-k, never a global sort in one task."""
    from pyspark.sql import Window

    order = [F.coalesce("hard_keep", F.lit(False)).desc(), F.col("salience").desc_nulls_last(), F.col("ts").asc_nulls_last(), F.col("id")]
    e = M.episodes(spark, d, "hard_keep", "salience", "ts", "consolidated").where(~F.coalesce("consolidated", F.lit(False)))
    return e.orderBy(*order).limit(100).withColumn("pos", F.row_number().over(Window.orderBy(*order))).select("id", F.col("pos").cast("bigint").alias("pos"))


queries = lambda: dict(reg.functions)
oracle_sql = lambda: dict(reg.sql)
