"""Aggregation, evaluation and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramql.config import DAY_MS, DEFAULT
from engramql.functions import scalars as S
from engramql.operators import analytics as A
from engramql.operators import graph as G
from engramql.plans import model as M
from engramql.plans.registry import Registry
from engramql.storage import table

reg = Registry()
SINCE = 902_000_000_000
LABELS = ("confirm", "extend", "unrelated", "contradict")
_EFF = f"s * exp(-0.05e0 * greatest(0, {M.NOW} - last_access) / {float(DAY_MS)}e0)"


@reg.query(
    "ledger_rollup",
    f"""SELECT feature_tag, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, coalesce(sum(input_tokens) FILTER (ts >= {SINCE}), 0)::BIGINT AS recent_input_tokens,
    sum(output_tokens)::BIGINT AS output_tokens, coalesce(sum(output_tokens) FILTER (ts >= {SINCE}), 0)::BIGINT AS recent_output_tokens,
    sum(cache_tokens)::BIGINT AS cache_tokens, coalesce(sum(cache_tokens) FILTER (ts >= {SINCE}), 0)::BIGINT AS recent_cache_tokens,
    round(sum(cost), 2) AS cost, round(coalesce(sum(cost) FILTER (ts >= {SINCE}), 0), 2) AS recent_cost FROM ledger GROUP BY ROLLUP (feature_tag)""",
    "ledger",
)
def ledger_rollup(spark, d):
    """A1, S17."""
    return A.ledger_totals(M.ledger(spark, d), SINCE)


@reg.query("event_mix", "SELECT event_type, count(*) AS n FROM mem_events GROUP BY 1", "mem_events")
def event_mix(spark, d):
    """A2."""
    return A.counts(M.mem_events(spark, d), "event_type")


_CONF = "SELECT CASE WHEN event_type LIKE 'contradict%' THEN 'contradict' ELSE event_type END AS truth, CASE WHEN magnitude >= 60 THEN 'contradict' WHEN magnitude >= 40 THEN 'extend' WHEN magnitude >= 20 THEN 'confirm' ELSE 'unrelated' END AS guess, magnitude, event_type FROM mem_events"


def _judged(spark, d):
    m = F.col("magnitude")
    return M.mem_events(spark, d).select(
        F.when(F.col("event_type").startswith("contradict"), "contradict").otherwise(F.col("event_type")).alias("truth"),
        F.when(m >= 60, "contradict").when(m >= 40, "extend").when(m >= 20, "confirm").otherwise("unrelated").alias("guess"),
        "magnitude",
        "event_type",
    )


@reg.query("confusion_matrix", f"SELECT truth, {', '.join(f'sum((guess = {x!r})::INT)::BIGINT AS as_{x}' for x in LABELS)} FROM ({_CONF}) GROUP BY truth", "mem_events")
def confusion_matrix(spark, d):
    """A14."""
    return A.confusion(_judged(spark, d), "truth", "guess", LABELS)


@reg.query("accuracy_by_category", f"SELECT event_type, count(*) AS n, round(avg((truth = guess)::INT::DOUBLE), 6) AS accuracy FROM ({_CONF}) GROUP BY ROLLUP (event_type)", "mem_events")
def accuracy_by_category(spark, d):
    """A15."""
    return A.accuracy(_judged(spark, d), "event_type", F.col("truth") == F.col("guess"))


@reg.query(
    "percentile_ranks",
    """WITH v AS (SELECT event_type, magnitude, row_number() OVER (PARTITION BY event_type ORDER BY magnitude) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM mem_events WHERE magnitude IS NOT NULL), p AS (SELECT unnest([50, 90, 95, 99]) AS p)
    SELECT event_type, p, max(magnitude) FILTER (i = greatest(0, ceil(p * n / 100) - 1)) AS nearest, max(magnitude) FILTER (i = least(n - 1, floor(p * n / 100))) AS floor FROM v, p GROUP BY 1, 2""",
    "mem_events",
)
def percentile_ranks(spark, d):
    """A16."""
    return A.percentiles(M.mem_events(spark, d), "event_type", "magnitude", (50, 90, 95, 99))


@reg.query(
    "breakeven",
    "WITH c AS (SELECT source, avg(length(content)::DOUBLE) AS w, avg(salience) * 100 AS s FROM episodes WHERE content IS NOT NULL GROUP BY 1) SELECT source, n, round(w - s * n, 4) AS net FROM c, (SELECT unnest([1, 2, 5, 10, 20, 50]) AS n)",
    "episodes",
)
def breakeven(spark, d):
    """A17."""
    e = M.episodes(spark, d, "source", "content", "salience").where("content IS NOT NULL").groupBy("source").agg(F.avg(F.length("content").cast("double")).alias("w"), (F.avg("salience") * 100).alias("s"))
    return e.select("source", A.breakeven(F.col("w"), F.col("s"), (1, 2, 5, 10, 20, 50)).alias("x")).select("source", "x.n", "x.net")


@reg.query(
    "injection_efficiency",
    """WITH s AS (SELECT type, count(*) AS nodes, sum((NOT coalesce(tombstoned, false))::INT)::BIGINT AS live, sum(coalesce(tombstoned, false)::INT)::BIGINT AS dead, sum((prev_value IS NOT NULL)::INT)::BIGINT AS revised, sum(round(length(value) / 4e0))::BIGINT AS tokens FROM nodes GROUP BY 1)
    SELECT s.*, f AS factor, tokens * f AS projected FROM s, (SELECT unnest([1, 2, 5, 10]) AS f)""",
    "nodes",
)
def injection_efficiency(spark, d):
    """A18, F33."""
    dead = F.coalesce("tombstoned", F.lit(False))
    n = M.nodes(spark, d, "type", "value", "tombstoned", "prev_value").groupBy("type").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum((~dead).cast("bigint")).alias("live"), F.sum(dead.cast("bigint")).alias("dead"), F.sum(F.col("prev_value").isNotNull().cast("bigint")).alias("revised"), F.sum(S.token_proxy(F.col("value"))).alias("tokens")
    )
    return n.withColumn("factor", F.explode(F.array(*[F.lit(x) for x in (1, 2, 5, 10)]))).withColumn("projected", F.col("tokens") * F.col("factor"))


@reg.query("frontier_terciles", "WITH o AS (SELECT src AS id, count(*) AS degree FROM edges WHERE kind = 'relation' GROUP BY 1) SELECT id, degree, ntile(3) OVER (ORDER BY degree, id)::INT AS tercile FROM o", "edges")
def frontier_terciles(spark, d):
    """A19."""
    o = M.edges(spark, d).where("kind = 'relation'").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return A.terciles(o, "id", "degree")


_SKIP = "CASE source WHEN 'claude-code' THEN 0.5 WHEN 'gmail' THEN 0.4 WHEN 'granola' THEN 0.25 WHEN 'obsidian' THEN 0.2 WHEN 'conversation' THEN 0.2 WHEN 'gcal' THEN 0.3 ELSE CASE WHEN role = 'assistant' THEN 0.5 ELSE 0.2 END END"


@reg.query("skip_split", f"SELECT source, sum((salience < {_SKIP})::INT)::BIGINT AS below, sum((salience >= {_SKIP})::INT)::BIGINT AS above FROM episodes GROUP BY 1", "episodes")
def skip_split(spark, d):
    """A25."""
    e = M.episodes(spark, d, "source", "role", "salience")
    t = S.skip_threshold(F.col("source"), F.col("role"))
    return e.groupBy("source").agg(F.sum((F.col("salience") < t).cast("bigint")).alias("below"), F.sum((F.col("salience") >= t).cast("bigint")).alias("above"))


@reg.query("skip_gate", f"SELECT id FROM episodes WHERE NOT coalesce(consolidated, false) AND coalesce(origin, '') <> 'inferred' AND (salience >= {_SKIP} OR coalesce(hard_keep, false))", "episodes")
def skip_gate(spark, d):
    """P5: what a consolidation pass takes."""
    e = M.episodes(spark, d, "source", "role", "salience", "hard_keep", "consolidated", "origin")
    t = S.skip_threshold(F.col("source"), F.col("role"))
    fresh = ~F.coalesce("consolidated", F.lit(False)) & F.coalesce(F.col("origin") != "inferred", F.lit(True))
    return e.where(fresh & ((F.col("salience") >= t) | F.coalesce("hard_keep", F.lit(False)))).select("id")


@reg.query(
    "threshold_sweep",
    """WITH r AS (SELECT t AS threshold, round(avg((c >= t)::INT::DOUBLE), 6) AS pass_rate FROM nodes, (SELECT unnest([0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0]) AS t) WHERE c IS NOT NULL GROUP BY 1)
    SELECT threshold, pass_rate, coalesce(threshold = (SELECT max(threshold) FROM r WHERE pass_rate >= 0.75), false) AS chosen FROM r""",
    "nodes",
)
def threshold_sweep(spark, d):
    """A23."""
    return A.sweep(M.nodes(spark, d, "c"), "c", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8), 0.75)


@reg.query(
    "rank_report",
    """WITH step AS (SELECT src, dst, max(w) AS w FROM edges WHERE kind = 'relation' GROUP BY 1, 2), gold AS (SELECT src AS anchor, min(dst) AS gold FROM edges WHERE kind = 'relation' AND rel = 'uses' GROUP BY 1),
    r AS (SELECT src AS anchor, dst AS id, row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) AS rank FROM step WHERE src <> dst),
    j AS (SELECT g.anchor, r.rank, left(g.anchor, 1) AS bucket FROM gold g LEFT JOIN r ON r.anchor = g.anchor AND r.id = g.gold)
    SELECT bucket, count(*) AS n, round(avg(coalesce((rank <= 1)::INT, 0)::DOUBLE), 6) AS top1, round(avg(coalesce((rank <= 3)::INT, 0)::DOUBLE), 6) AS top3, round(avg(rank), 6) AS mean_rank FROM j GROUP BY 1""",
    "edges",
)
def rank_report(spark, d):
    """A24."""
    e = M.edges(spark, d)
    wanted = e.where("kind = 'relation' AND rel = 'uses'")
    found = G.best_paths(e, wanted.select(F.col("src").alias("id")).distinct(), 1)
    ranks = G.rank_of(found, wanted.groupBy(F.col("src").alias("anchor")).agg(F.min("dst").alias("gold")))
    return A.rank_metrics(ranks.withColumn("bucket", F.substring("anchor", 1, 1)), "rank", "bucket")


@reg.query(
    "recall_at_k",
    """WITH f AS (SELECT session_id, role, row_number() OVER (PARTITION BY session_id ORDER BY salience DESC, id) AS rank FROM episodes WHERE session_id IS NOT NULL),
    g AS (SELECT DISTINCT session_id FROM episodes WHERE session_id IS NOT NULL), h AS (SELECT g.session_id, min(rank) FILTER (role = 'assistant') AS first FROM g JOIN f USING (session_id) GROUP BY 1)
    SELECT k, round(avg(coalesce((first <= k)::INT, 0)::DOUBLE), 6) AS recall FROM h, (SELECT unnest([1, 5, 10]) AS k) GROUP BY 1""",
    "episodes",
)
def recall_at_k(spark, d):
    """The first assistant message among a session's most salient ones."""
    from pyspark.sql import Window

    e = M.episodes(spark, d, "session_id", "role", "salience").where("session_id IS NOT NULL")
    found = e.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("salience").desc_nulls_last(), "id"))).select("session_id", "role", "rank")
    gold = e.select("session_id").distinct().withColumn("role", F.lit("assistant"))
    return A.recall_at(found, gold, "session_id", "role", (1, 5, 10))


@reg.query(
    "snapshot_regression",
    "SELECT count(*) AS cases, sum((coalesce(value_hash = sha256(value), false))::INT)::BIGINT AS same, sum((coalesce(embedded_hash = value_hash, false))::INT)::BIGINT AS embedded FROM live",
    "live",
)
def snapshot_regression(spark, d):
    """Stored against recomputed hashes."""
    n = M.live(spark, d, "value", "value_hash", "embedded_hash")
    return n.agg(
        F.count(F.lit(1)).alias("cases"),
        F.sum(F.coalesce(F.col("value_hash") == F.sha2("value", 256), F.lit(False)).cast("bigint")).alias("same"),
        F.sum(F.coalesce(F.col("embedded_hash") == F.col("value_hash"), F.lit(False)).cast("bigint")).alias("embedded"),
    )


@reg.query(
    "arm_verdict",
    "WITH a AS (SELECT event_type, count(*) AS n, sum((magnitude >= 50)::INT)::BIGINT AS promoted FROM mem_events WHERE event_type IN ('confirm', 'extend') GROUP BY 1) SELECT round(max(n) FILTER (event_type = 'extend') / max(n) FILTER (event_type = 'confirm')::DOUBLE, 6) AS ratio, (max(n) FILTER (event_type = 'extend') / max(n) FILTER (event_type = 'confirm')::DOUBLE) BETWEEN 1.0 AND 1.5 AS within, max(promoted) FILTER (event_type = 'extend') AS promoted FROM a",
    "mem_events",
)
def arm_verdict(spark, d):
    """A26."""
    e = M.mem_events(spark, d)
    is_b, is_a = F.col("event_type") == "extend", F.col("event_type") == "confirm"
    g = e.agg(F.count_if(is_b).alias("b"), F.count_if(is_a).alias("a"), F.count_if(is_b & (F.col("magnitude") >= 50)).alias("promoted"))
    ratio = F.col("b") / F.col("a").cast("double")
    return g.select(F.round(ratio, 6).alias("ratio"), ratio.between(1.0, 1.5).alias("within"), "promoted")


@reg.query("ring_buffer", "SELECT id, event_type FROM mem_events ORDER BY id DESC LIMIT 50", "mem_events")
def ring_buffer(spark, d):
    """S15, ST8."""
    return A.ring(M.mem_events(spark, d).select("id", "event_type"), DEFAULT.trace_ring)


@reg.query("trace_tail", "SELECT id, event_type FROM mem_events WHERE id > 900 ORDER BY id LIMIT 500", "mem_events")
def trace_tail(spark, d):
    """What lies beyond a cursor, in order."""
    return M.mem_events(spark, d).select("id", "event_type").where("id > 900").orderBy("id").limit(500)


@reg.query("node_cascade", f"SELECT node_id, ts, event_type FROM mem_events WHERE node_id IS NOT NULL AND ts >= 1705000000000 ORDER BY ts, id, node_id LIMIT 24", "mem_events")
def node_cascade(spark, d):
    """G36."""
    e = M.mem_events(spark, d).where("node_id IS NOT NULL AND ts >= 1705000000000")
    return e.orderBy("ts", "id", "node_id").limit(24).select("node_id", "ts", "event_type")


@reg.query(
    "eviction_candidates",
    f"SELECT id, round({_EFF}, 6) AS eff FROM nodes WHERE coalesce(tombstoned, false) AND {_EFF} < 0.05 AND {M.NOW} - last_access > {30 * DAY_MS}",
    "nodes",
)
def eviction_candidates(spark, d):
    """P15, G32."""
    n = M.nodes(spark, d, "s", "last_access", "tombstoned")
    eff = S.effective_strength(F.col("s"), F.col("last_access"), M.NOW)
    return n.where(F.coalesce("tombstoned", F.lit(False)) & (eff < DEFAULT.evict_strength) & (M.NOW - F.col("last_access") > DEFAULT.evict_age_ms)).select("id", F.round(eff, 6).alias("eff"))


@reg.query("dirty_nodes", "SELECT id FROM live WHERE embedded_hash IS NULL AND trim(value) <> ''", "live")
def dirty_nodes(spark, d):
    """P4."""
    return M.live(spark, d, "value", "embedded_hash").where("embedded_hash IS NULL AND trim(value) <> ''").select("id")


@reg.query("clusterable_mix", "SELECT type, count(*) AS n FROM live WHERE coalesce(origin, '') <> 'inferred' AND type IN ('fact', 'entity') AND embedding IS NOT NULL GROUP BY 1", "live")
def clusterable_mix(spark, d):
    """P1, P2, P3."""
    n = M.live(spark, d, "type", "origin", "embedding").where("coalesce(origin, '') <> 'inferred' AND type IN ('fact', 'entity') AND embedding IS NOT NULL")
    return A.counts(n, "type")


@reg.query("distinct_scopes", "SELECT scope, count(*) AS n FROM documents WHERE scope IS NOT NULL AND scope <> 'global' AND NOT contains(scope, ':') AND NOT regexp_matches(scope, '^.{8}-.{4}-.{4}-.{4}-.{12}$') GROUP BY 1")
def distinct_scopes(spark, d):
    """P13, A12."""
    t = table(spark, d, "documents").where("scope IS NOT NULL AND scope <> 'global'").where(~F.col("scope").contains(":") & ~F.col("scope").rlike("^.{8}-.{4}-.{4}-.{4}-.{12}$"))
    return A.counts(t, "scope")


queries = lambda: dict(reg.functions)
oracle_sql = lambda: dict(reg.sql)
