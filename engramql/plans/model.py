"""The memory tables over the test tables, once as DataFrames and once as SQL views.

nodes      last row of each id
live       nodes that are not tombstoned
edges      last row of each (src, dst, rel), ids stripped and lower-cased;
           'abstracts' rows lead from member to schema and are turned around,
           so that src is the schema
episodes   first row of each id
mem_events append-only event log: the rows of ``events``.  Ids of nodes and
           episodes lie in hash buckets, as many as there are rows of the
           smaller side; an event belongs to all ids of its bucket, so that at
           any size all episodes occur and all nodes but those of the tenth
           of the buckets whose events name no node.  Three events in a row
           share an episode bucket
due        dated nodes from ``orders``: the nodes of a bucket are due at the
           date of the order with its number
ledger     one row per call from ``lineitem``
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramql.operators.versions import first_rows, last_rows
from engramql.sources.store import SnapshotStore
from engramql.storage import shared_dir, table

#: The present, for queries: 2026-10-01 UTC.
NOW = 1_790_812_800_000
#: The present of dated nodes: 1998-06-15 UTC.
DUE_NOW = 897_868_800_000

EVENT_TYPES = {"signup": "confirm", "click": "extend", "view": "unrelated", "error": "contradict_hold", "purchase": "contradict_reconcile"}


def snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The node table of the memory: the last row of each id, made once from the delivered rows and kept in the store.

    It lies in the shared folder under a key of the delivered files (name, size,
    time of change), so other or newer files never meet an old snapshot.  Rows
    are in order of id; queries scan their columns of it without a shuffle.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/node.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(path)
    files = fs.listStatus(path) if status.isDirectory() else [status]
    key = hashlib.sha256("|".join(sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)).encode()).hexdigest()[:24]
    store = SnapshotStore(spark, f"{shared_dir(spark)}/snapshots/{key}")
    found = store.read("node")
    if found is None:
        last = last_rows(table(spark, d, "node"))
        try:
            store.publish("node", last.repartitionByRange("id").sortWithinPartitions("id"))
        except RuntimeError:  # another writer of the same snapshot was first
            pass
        found = store.read("node")
    return found


def nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Only the asked columns are read."""
    return snapshot(spark, d).select(*dict.fromkeys(["id", *columns]))


def live(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    keep = list(dict.fromkeys(["id", *columns]))
    return nodes(spark, d, *keep, "tombstoned").where(~F.coalesce("tombstoned", F.lit(False))).select(*keep)


def edges(spark: SparkSession, d: str) -> DataFrame:
    up = F.coalesce(F.col("kind") == "abstracts", F.lit(False))
    a, b = F.lower(F.trim("src")), F.lower(F.trim("dst"))
    ends = [F.when(up, b).otherwise(a).alias("src"), F.when(up, a).otherwise(b).alias("dst")]
    e = table(spark, d, "edge").select(*ends, "rel", "w", "last_access", "kind", "landed_at")
    e = e.where("src <> '' AND dst <> ''")
    return last_rows(e, ["src", "dst", "rel"], ties=["w", "last_access", "kind"]).drop("landed_at")


def episodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    keep = list(dict.fromkeys(["id", *columns]))
    return first_rows(table(spark, d, "episode").select(*dict.fromkeys([*keep, "landed_at"]))).select(*keep)


def bucket_of(key, buckets: int) -> F.Column:
    """The bucket of a text key: the first 32 bits of its digest, modulo."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % buckets


def bucket_count(*sizes: int) -> int:
    """As many buckets as the smaller side has rows: about one key each."""
    return max(1, min(sizes))


def _buckets(ids: DataFrame, buckets: int, name: str) -> DataFrame:
    return ids.where("id IS NOT NULL").distinct().select(bucket_of(F.col("id"), buckets).alias(name), "id")


def mem_events(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "events").count()  # row counts come from the file footers
    nb = bucket_count(total, table(spark, d, "node").count())
    eb = bucket_count(total // 3, table(spark, d, "episode").count())
    e = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv]), F.col("event_type")).alias("event_type"),
        F.col("value").alias("magnitude"), F.col("props").alias("payload"),
        F.when(F.col("event_id") % nb % 10 < 9, F.col("event_id") % nb).alias("nb"), (F.floor(F.col("event_id") / 3) % eb).alias("eb"),
    )
    n = _buckets(table(spark, d, "node").select("id"), nb, "nb").withColumnRenamed("id", "node_id")
    p = _buckets(table(spark, d, "episode").select("id"), eb, "eb").withColumnRenamed("id", "episode_id")
    return e.join(n, "nb", "left").join(p, "eb", "left").select("id", "ts", "event_type", "node_id", "episode_id", "magnitude", "payload")


def due(spark: SparkSession, d: str) -> DataFrame:
    b = bucket_count(table(spark, d, "orders").count(), table(spark, d, "node").count())
    o = table(spark, d, "orders").select((F.col("o_orderkey") % b).alias("bucket"), "o_orderkey", "o_orderdate", "o_orderpriority")
    best = o.groupBy("bucket").agg(F.min(F.struct("o_orderkey", "o_orderdate", "o_orderpriority")).alias("b"))
    action = F.when(F.col("b.o_orderpriority").startswith("1"), "deadline").when(F.col("b.o_orderpriority").startswith("2"), "meeting").otherwise("other")
    n = _buckets(table(spark, d, "node").select("id"), b, "bucket")
    return best.join(n, "bucket").select(
        F.col("id").alias("node_id"), F.unix_millis(F.col("b.o_orderdate").cast("timestamp")).alias("due_ms"), action.alias("action_type"),
        F.when(F.col("b.o_orderkey") % 5 == 0, "RRULE:FREQ=WEEKLY").alias("recurrence_rule"),
        F.when(F.col("b.o_orderkey") % 7 == 0, "dismissed").when(F.col("b.o_orderkey") % 7 == 1, "surfaced").when(F.col("b.o_orderkey") % 7 == 2, "snoozed").alias("outcome"),
        F.when(F.col("b.o_orderkey") % 7 == 2, F.lit(DUE_NOW) + (F.col("b.o_orderkey") % 3 - 1) * 3_600_000).alias("snooze_until_ms"),
        # when it was last shown, where it was: within 200 days before now
        F.when(F.col("b.o_orderkey") % 7 < 3, F.lit(DUE_NOW) - (F.col("b.o_orderkey") % 4800) * 3_600_000).alias("surfaced_ms"),
    )


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("feature_tag"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts"),
        F.col("l_quantity").cast("bigint").alias("input_tokens"), F.col("l_linenumber").cast("bigint").alias("output_tokens"),
        (F.col("l_partkey") % 50).alias("cache_tokens"), F.col("l_extendedprice").alias("cost"),
    )


VIEWS = {
    "nodes": "SELECT * EXCLUDE (landed_at) FROM node QUALIFY row_number() OVER (PARTITION BY id ORDER BY landed_at DESC NULLS LAST) = 1",
    "live": "SELECT * FROM nodes WHERE NOT coalesce(tombstoned, false)",
    "edges": """SELECT * EXCLUDE (landed_at) FROM (SELECT CASE WHEN kind = 'abstracts' THEN lower(trim(dst)) ELSE lower(trim(src)) END AS src, CASE WHEN kind = 'abstracts' THEN lower(trim(src)) ELSE lower(trim(dst)) END AS dst,
      rel, w, last_access, kind, landed_at FROM edge) WHERE src <> '' AND dst <> ''
      QUALIFY row_number() OVER (PARTITION BY src, dst, rel ORDER BY landed_at DESC NULLS LAST, w DESC NULLS LAST, last_access DESC NULLS LAST, kind DESC NULLS LAST) = 1""",
    "episodes": "SELECT * EXCLUDE (landed_at) FROM episode QUALIFY row_number() OVER (PARTITION BY id ORDER BY landed_at NULLS LAST) = 1",
    "mem_events": """SELECT e.event_id AS id, epoch_us(e.ts) // 1000 AS ts,
      CASE e.event_type WHEN 'signup' THEN 'confirm' WHEN 'click' THEN 'extend' WHEN 'view' THEN 'unrelated' WHEN 'error' THEN 'contradict_hold' WHEN 'purchase' THEN 'contradict_reconcile' END AS event_type,
      n.id AS node_id, p.id AS episode_id, e.value AS magnitude, e.props AS payload
      FROM events e
      CROSS JOIN (SELECT greatest(1, least((SELECT count(*) FROM events), (SELECT count(*) FROM node))) AS nb, greatest(1, least((SELECT count(*) FROM events) // 3, (SELECT count(*) FROM episode))) AS eb) z
      LEFT JOIN (SELECT DISTINCT id, ('0x' || left(md5(id), 8))::BIGINT AS h FROM node WHERE id IS NOT NULL) n ON n.h % z.nb = e.event_id % z.nb AND e.event_id % z.nb % 10 < 9
      LEFT JOIN (SELECT DISTINCT id, ('0x' || left(md5(id), 8))::BIGINT AS h FROM episode WHERE id IS NOT NULL) p ON p.h % z.eb = (e.event_id // 3) % z.eb""",
    "due": f"""SELECT n.id AS node_id, epoch_us(o.o_orderdate) // 1000 AS due_ms,
      CASE WHEN o.o_orderpriority LIKE '1%' THEN 'deadline' WHEN o.o_orderpriority LIKE '2%' THEN 'meeting' ELSE 'other' END AS action_type,
      CASE WHEN o.o_orderkey % 5 = 0 THEN 'RRULE:FREQ=WEEKLY' END AS recurrence_rule,
      CASE o.o_orderkey % 7 WHEN 0 THEN 'dismissed' WHEN 1 THEN 'surfaced' WHEN 2 THEN 'snoozed' END AS outcome,
      CASE WHEN o.o_orderkey % 7 = 2 THEN {DUE_NOW} + (o.o_orderkey % 3 - 1) * 3600000 END AS snooze_until_ms,
      CASE WHEN o.o_orderkey % 7 < 3 THEN {DUE_NOW} - (o.o_orderkey % 4800) * 3600000 END AS surfaced_ms
      FROM (SELECT *, o_orderkey % z.nb AS b, z.nb FROM orders, (SELECT greatest(1, least((SELECT count(*) FROM orders), (SELECT count(*) FROM node))) AS nb) z
            QUALIFY row_number() OVER (PARTITION BY b ORDER BY o_orderkey) = 1) o
      JOIN (SELECT DISTINCT id, ('0x' || left(md5(id), 8))::BIGINT AS h FROM node WHERE id IS NOT NULL) n ON n.h % o.nb = o.b""",
    "ledger": "SELECT l_returnflag AS feature_tag, epoch_us(l_shipdate) // 1000 AS ts, l_quantity::BIGINT AS input_tokens, l_linenumber::BIGINT AS output_tokens, l_partkey % 50 AS cache_tokens, l_extendedprice AS cost FROM lineitem",
}
NEEDS = {"live": ["nodes"]}


def with_views(names: list[str], sql: str) -> str:
    """``sql`` with the named views as common table expressions before its own."""
    wanted: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in wanted:
                wanted.append(x)
    if not wanted:
        return sql
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[14:]}"
    return f"WITH {views},\n{body[4:]}" if body.upper().startswith("WITH") else f"WITH {views}\n{body}"
