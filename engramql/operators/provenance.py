"""Joins between the event log, episodes and nodes: scopes, support, staleness, echoes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramql.functions import scalars as S
from engramql.functions.vectors import dot, norm


def _touch(events: DataFrame, episodes: DataFrame) -> DataFrame:
    """(id, cwd) for each event of a node with an episode."""
    pairs = events.where("node_id IS NOT NULL AND episode_id IS NOT NULL").select("node_id", "episode_id").distinct()
    return pairs.join(episodes.select(F.col("id").alias("episode_id"), "cwd"), "episode_id").select(F.col("node_id").alias("id"), "cwd")


def project_ids(events: DataFrame, episodes: DataFrame, cwd: str) -> DataFrame:
    """Nodes touched from a working directory: the episodes are cut to it before the join."""
    return _touch(events, episodes.where(F.col("cwd") == cwd)).select("id").distinct()


def global_ids(events: DataFrame, episodes: DataFrame) -> DataFrame:
    """Nodes that no project directory touched."""
    own = F.max(F.when(F.coalesce("cwd", F.lit("")) != "", 1).otherwise(0))
    return _touch(events, episodes).groupBy("id").agg(own.alias("own")).where("own = 0").select("id")


def orphan_nodes(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Nodes that the event log does not know."""
    return nodes.select("id").join(events.select(F.col("node_id").alias("id")), "id", "left_anti")


def stale_entities(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entities whose sibling facts (same episode) are all tombstoned.

    Three existence tests in one pass: facts are counted per episode first, so
    an episode with many events is joined as one row per entity, not per pair.
    """
    seen = events.where("node_id IS NOT NULL AND episode_id IS NOT NULL").select("node_id", "episode_id").distinct()
    typed = seen.join(nodes.select(F.col("id").alias("node_id"), "type", "tombstoned"), "node_id")
    alive = F.sum(F.when(~F.coalesce("tombstoned", F.lit(False)), 1).otherwise(0))
    facts = typed.where("type = 'fact'").groupBy("episode_id").agg(F.count(F.lit(1)).alias("facts"), alive.alias("alive"))
    per = typed.where("type = 'entity'").join(facts, "episode_id").groupBy("node_id").agg(F.sum("alive").alias("alive"))
    return per.where("alive = 0").select(F.col("node_id").alias("id"))



def sibling_facts(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, sibling): live facts that share an episode with a node, each pair once."""
    seen = events.where("node_id IS NOT NULL AND episode_id IS NOT NULL").select("node_id", "episode_id").distinct()
    facts = nodes.where((F.col("type") == "fact") & ~F.coalesce("tombstoned", F.lit(False))).select(F.col("id").alias("node_id"))
    b = seen.join(facts, "node_id", "left_semi").select("episode_id", F.col("node_id").alias("sibling"))
    return seen.join(b, "episode_id").where("node_id <> sibling").select(F.col("node_id").alias("id"), "sibling").distinct()


def latest_support(events: DataFrame, episodes: DataFrame) -> DataFrame:
    """(id, ts): the latest episode behind each node."""
    pairs = events.where("node_id IS NOT NULL AND episode_id IS NOT NULL").select(F.col("node_id").alias("id"), "episode_id").distinct()
    return pairs.join(episodes.select(F.col("id").alias("episode_id"), "ts"), "episode_id").groupBy("id").agg(F.max("ts").alias("ts"))


def scope_stamps(events: DataFrame, episodes: DataFrame) -> DataFrame:
    """(node_id, scope): the only project among a node's episodes, else global."""
    scoped = _touch(events, episodes).select("id", S.cwd_scope(F.col("cwd")).alias("scope"))
    # distinct project scopes as min and max: no set grows with the node's events
    own = F.when(F.col("scope") != "global", F.col("scope"))
    g = scoped.groupBy(F.col("id").alias("node_id")).agg(F.min(own).alias("a"), F.max(own).alias("b"))
    return g.select("node_id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("global").alias("scope"))


def reconstruct(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Event log with the present value of its nodes."""
    return events.join(nodes.select(F.col("id").alias("node_id"), "value", "tombstoned"), "node_id", "left").select("id", "ts", "event_type", "node_id", "value", "tombstoned")


def echoes(episodes: DataFrame, window_ms: int, least: float) -> DataFrame:
    """(id, echo_of, cos): the best inferred episode within the window before each other one.

    A range join by time buckets of the window's width: an inferred episode
    goes to its own and the next bucket, so each pair meets in one bucket; a
    bucket that holds much is split by adaptive execution.  ``episodes`` has
    id, ts, origin and a vector column v, of which norms are taken once a row.
    """
    bucket = F.floor(F.col("ts") / window_ms)
    left = episodes.where("origin <> 'inferred' AND ts > 0 AND v IS NOT NULL").select("id", "ts", "v", norm(F.col("v")).alias("n"), bucket.alias("bucket"))
    right = episodes.where("origin = 'inferred' AND ts > 0 AND v IS NOT NULL").select(
        F.col("id").alias("echo_of"), F.col("ts").alias("ets"), F.col("v").alias("ev"), norm(F.col("v")).alias("en"), F.explode(F.array(bucket, bucket + 1)).alias("bucket")
    )
    cos = dot(F.col("v"), F.col("ev")) / (F.col("n") * F.col("en"))
    near = left.join(right, "bucket").where((F.col("ets") <= F.col("ts")) & (F.col("ets") >= F.col("ts") - window_ms)).withColumn("cos", cos)
    best = near.where(F.round("cos", 9) >= least).groupBy("id").agg(F.max(F.struct(F.round("cos", 9).alias("cos"), "ets", "echo_of")).alias("b"))
    return best.select("id", F.col("b.echo_of").alias("echo_of"), F.round("b.cos", 6).alias("cos"))


def first_of_series(events: DataFrame) -> DataFrame:
    """One record per recurring series (its first instance by start text), single events as they are."""
    master = F.coalesce(F.when(F.trim("recurring_event_id") != "", F.col("recurring_event_id")), F.col("id"))
    w = Window.partitionBy("account_id", "master").orderBy(F.coalesce("start_datetime", "start_date").asc_nulls_last(), "raw_id")
    return events.withColumn("master", master).withColumn("pos", F.row_number().over(w)).where("pos = 1").select("raw_id", "account_id", "master")


def cancelled_nodes(nodes: DataFrame, source_ids: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Nodes whose source event was cancelled: (id) to be tombstoned."""
    hit = source_ids.join(cancelled.select("source_event_id").distinct(), "source_event_id", "left_semi")
    return nodes.select("id").join(hit.select(F.col("node_id").alias("id")), "id", "left_semi")
