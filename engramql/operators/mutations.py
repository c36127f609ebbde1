"""Merges that give the next snapshot of a table; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramql.config import DEFAULT, Settings
from engramql.operators.versions import last_rows

NODE = ("id", "type", "value", "value_hash", "embedding", "embedded_hash", "origin", "s", "c", "last_access", "prev_value", "prev_ts", "pending_contradictions", "tombstoned", "training_eligible")


def upsert_nodes(nodes: DataFrame, changes: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Merge changed nodes (id, type, value, origin, s, c, last_access; optional prev_value of new ids).

    A changed value drops the vector and its hash and carries the old value and
    its time along.  Of several changes of an id the last by last_access counts.
    """
    have = set(changes.columns)
    new = last_rows(changes, ["id"], "last_access", ["value"])
    n = new.select("id", *[F.col(c).alias(f"n_{c}") for c in NODE if c in have and c != "id"], F.lit(True).alias("hit"))
    j = nodes.select(*NODE).join(n, "id", "full")
    pick = lambda c: F.coalesce(F.col(f"n_{c}"), F.col(c)) if c in have else F.col(c)
    value = pick("value")
    fresh = F.col("value").isNull() & F.col("value_hash").isNull()
    changed = F.coalesce("hit", F.lit(False)) & (F.sha2(value, 256) != F.coalesce("value_hash", F.lit("")))
    keep = lambda c: F.when(~changed, F.col(c))
    given = F.col("n_prev_value") if "prev_value" in have else F.lit(None).cast("string")
    dead = F.coalesce(pick("tombstoned"), F.lit(False))
    eligible = (pick("origin") != "inferred") & ~dead & (pick("c") >= cfg.training_confidence)
    return j.select(
        "id", pick("type").alias("type"), value.alias("value"), F.when(changed, F.sha2(value, 256)).otherwise(F.col("value_hash")).alias("value_hash"),
        keep("embedding").alias("embedding"), keep("embedded_hash").alias("embedded_hash"), pick("origin").alias("origin"),
        F.coalesce(pick("s"), F.lit(0.1)).alias("s"), F.coalesce(pick("c"), F.lit(0.5)).alias("c"), pick("last_access").alias("last_access"),
        F.when(changed & ~fresh, F.col("value")).when(fresh, given).otherwise(F.col("prev_value")).alias("prev_value"),
        F.when(changed & ~fresh, F.col("last_access")).otherwise(F.col("prev_ts")).alias("prev_ts"),
        F.coalesce(pick("pending_contradictions"), F.lit("[]")).alias("pending_contradictions"), dead.alias("tombstoned"),
        F.when(F.coalesce("hit", F.lit(False)), eligible).otherwise(F.col("training_eligible")).alias("training_eligible"),
    )


def set_embeddings(nodes: DataFrame, vectors: DataFrame, dim: int = 64) -> DataFrame:
    """Vectors (id, value_hash, vector) take effect only where the value is still the one they were made of, and of the right length."""
    v = vectors.where(F.size("vector") == dim).select("id", "value_hash", "vector").dropDuplicates(["id", "value_hash"])
    j = nodes.join(v, ["id", "value_hash"], "left")
    return j.select(
        *[
            F.when(F.col("vector").isNotNull(), F.col("vector")).otherwise(F.col("embedding")).alias(c)
            if c == "embedding"
            else F.when(F.col("vector").isNotNull(), F.col("value_hash")).otherwise(F.col("embedded_hash")).alias(c)
            if c == "embedded_hash"
            else F.col(c)
            for c in nodes.columns
        ]
    )


def tombstone(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Mark nodes deleted; row and vector stay."""
    hit = nodes.join(ids.select("id").distinct().withColumn("gone", F.lit(True)), "id", "left")
    now = F.coalesce("gone", F.lit(False))
    cols = {"tombstoned": F.col("tombstoned") | now, "training_eligible": F.col("training_eligible") & ~now}
    return hit.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in nodes.columns])


def upsert_edges(edges: DataFrame, changes: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Last write of each (src, dst, rel); ``removed`` names edges to drop."""
    both = edges.withColumn("o", F.lit(0)).unionByName(changes.select(*edges.columns).withColumn("o", F.lit(1)))
    kept = last_rows(both, ["src", "dst", "rel"], "o", ["last_access", "w"]).drop("o")
    return kept if removed is None else kept.join(removed.select("src", "dst", "rel").distinct(), ["src", "dst", "rel"], "left_anti")


def upsert_sidecar(rows: DataFrame, changes: DataFrame, keys: list[str], once: tuple[str, ...] = ()) -> DataFrame:
    """Replace rows by key; columns in ``once`` keep their first value."""
    n = last_rows(changes, keys, "updated_at")
    cols = [c for c in rows.columns if c not in keys]
    j = rows.select(*keys, *[F.col(c).alias(f"o_{c}") for c in cols], F.lit(True).alias("had")).join(n.select(*keys, *cols, F.lit(True).alias("hit")), keys, "full")
    value = lambda c: F.when(F.col("had") & (F.lit(c in once) | F.col("hit").isNull()), F.col(f"o_{c}")).otherwise(F.col(c))
    return j.select(*keys, *[value(c).alias(c) for c in cols])


def mark_consolidated(episodes: DataFrame, done: DataFrame, inferred_from: DataFrame | None = None) -> DataFrame:
    """Mark episodes done; (id, source_inference_id) in ``inferred_from`` fills empty references."""
    j = episodes.join(done.select("id").distinct().withColumn("done", F.lit(True)), "id", "left")
    cols = {"consolidated": F.coalesce("consolidated", F.lit(False)) | F.coalesce("done", F.lit(False))}
    if inferred_from is not None:
        j = j.join(inferred_from.groupBy("id").agg(F.max("source_inference_id").alias("found")), "id", "left")
        cols["source_inference_id"] = F.coalesce("source_inference_id", "found")
    return j.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in episodes.columns])


def evict(nodes: DataFrame, gone: DataFrame, edges: DataFrame, sidecars: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Nodes, edges and sidecars without evicted nodes, children first."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti").select(*edges.columns)
    kept = {k: v.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_anti").select(*v.columns) for k, v in sidecars.items()}
    return nodes.join(ids, "id", "left_anti").select(*nodes.columns), left, kept


def put_meta(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """Key-value pairs; a null value deletes the key."""
    both = meta.select("key", "value", F.lit(0).alias("o")).unionByName(changes.select("key", "value", F.lit(1).alias("o")))
    return last_rows(both, ["key"], "o", ["value"]).where("NOT (o = 1 AND value IS NULL)").select("key", "value")
