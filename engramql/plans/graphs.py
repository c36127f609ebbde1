"""Provenance and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramql.config import DAY_MS
from engramql.functions import scalars as S
from engramql.functions.seams import with_vectors
from engramql.operators import graph as G
from engramql.operators import provenance as P
from engramql.plans import model as M
from engramql.plans.registry import Registry
from engramql.sources import ingest
from engramql.storage import table

reg = Registry()
CWD = "/home/dev/klealainer-board"
#: Cosine from which a text is an echo.
ECHO = 0.85
_TOUCH = "touch AS (SELECT DISTINCT v.node_id AS id, v.episode_id, p.cwd FROM mem_events v JOIN episodes p ON p.id = v.episode_id WHERE v.node_id IS NOT NULL)"
_SLUG = "lower(regexp_extract(rtrim(trim(coalesce(cwd, '')), '/'), '^/(?:Users|home)/[^/]+(?:/([^/]+))?', 1))"
_SCOPE = f"CASE WHEN {_SLUG} IN ('', 'resume') THEN 'global' ELSE {_SLUG} END"


@reg.query("project_scope_ids", f"WITH {_TOUCH} SELECT DISTINCT id FROM touch WHERE cwd = '{CWD}'", "mem_events episodes")
def project_scope_ids(spark, d):
    """JN1, A12."""
    return P.project_ids(M.mem_events(spark, d), M.episodes(spark, d, "cwd"), CWD)


@reg.query("global_scope_ids", f"WITH {_TOUCH} SELECT id FROM touch GROUP BY id HAVING max((coalesce(cwd, '') <> '')::INT) = 0", "mem_events episodes")
def global_scope_ids(spark, d):
    """JN2."""
    return P.global_ids(M.mem_events(spark, d), M.episodes(spark, d, "cwd"))


@reg.query("orphan_nodes", "SELECT id FROM live WHERE id NOT IN (SELECT node_id FROM mem_events WHERE node_id IS NOT NULL)", "live mem_events")
def orphan_nodes(spark, d):
    """JN3."""
    return P.orphan_nodes(M.live(spark, d), M.mem_events(spark, d))


@reg.query(
    "stale_entities",
    """SELECT DISTINCT e.id FROM nodes e WHERE e.type = 'entity'
    AND EXISTS (SELECT 1 FROM mem_events a JOIN mem_events b ON a.episode_id = b.episode_id JOIN nodes f ON b.node_id = f.id WHERE a.node_id = e.id AND f.type = 'fact')
    AND NOT EXISTS (SELECT 1 FROM mem_events a JOIN mem_events b ON a.episode_id = b.episode_id JOIN nodes f ON b.node_id = f.id WHERE a.node_id = e.id AND f.type = 'fact' AND NOT coalesce(f.tombstoned, false))""",
    "nodes mem_events",
)
def stale_entities(spark, d):
    """JN4."""
    return P.stale_entities(M.mem_events(spark, d), M.nodes(spark, d, "type", "tombstoned"))


@reg.query(
    "sibling_facts",
    "SELECT DISTINCT a.node_id AS id, b.node_id AS sibling FROM mem_events a JOIN mem_events b ON a.episode_id = b.episode_id JOIN live f ON f.id = b.node_id AND f.type = 'fact' WHERE a.node_id <> b.node_id",
    "live mem_events",
)
def sibling_facts(spark, d):
    """JN5."""
    return P.sibling_facts(M.mem_events(spark, d), M.nodes(spark, d, "type", "tombstoned"))


@reg.query("latest_support_ts", "SELECT v.node_id AS id, max(p.ts) AS ts FROM mem_events v JOIN episodes p ON p.id = v.episode_id WHERE v.node_id IS NOT NULL GROUP BY 1", "mem_events episodes")
def latest_support_ts(spark, d):
    """JN6, A9."""
    return P.latest_support(M.mem_events(spark, d), M.episodes(spark, d, "ts"))


@reg.query("scope_stamp", f"WITH {_TOUCH}, s AS (SELECT id, {_SCOPE} AS scope FROM touch) SELECT id AS node_id, CASE WHEN count(DISTINCT scope) FILTER (scope <> 'global') = 1 THEN max(scope) FILTER (scope <> 'global') ELSE 'global' END AS scope FROM s GROUP BY id", "mem_events episodes")
def scope_stamp(spark, d):
    """G27, F7, F8."""
    return P.scope_stamps(M.mem_events(spark, d), M.episodes(spark, d, "cwd"))


@reg.query("corpus_reconstruct", "SELECT e.id, e.ts, e.event_type, e.node_id, n.value, n.tombstoned FROM mem_events e LEFT JOIN nodes n ON n.id = e.node_id", "nodes mem_events")
def corpus_reconstruct(spark, d):
    """JN15."""
    return P.reconstruct(M.mem_events(spark, d), M.nodes(spark, d, "value", "tombstoned"))


_WORD_COUNTS = """w AS (SELECT id, md5(unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+'))) AS h FROM episodes WHERE ts > 0 AND content IS NOT NULL),
    f AS (SELECT id, ('0x' || left(h, 4))::INT % 64 AS i, sum(CASE WHEN h[5] < '8' THEN 1 ELSE -1 END)::DOUBLE AS x FROM w GROUP BY 1, 2 HAVING x <> 0), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM f GROUP BY id)"""


@reg.query(
    "echo_interval_join",
    f"""WITH {_WORD_COUNTS}, p AS (SELECT e.id, e.ts, e.origin, n.n FROM episodes e JOIN n USING (id)),
    pairs AS (SELECT a.id, b.id AS echo_of, b.ts AS ets, a.n * b.n AS nn FROM p a JOIN p b ON b.ts BETWEEN a.ts - 86400000 AND a.ts WHERE a.origin <> 'inferred' AND b.origin = 'inferred'),
    near AS (SELECT q.id, q.echo_of, q.ets, sum(x.x * y.x) / any_value(q.nn) AS cos FROM pairs q JOIN f x ON x.id = q.id JOIN f y ON y.id = q.echo_of AND y.i = x.i GROUP BY 1, 2, 3)
    SELECT id, echo_of, round(cos, 6) AS cos FROM near WHERE round(cos, 9) >= {ECHO} QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(cos, 9) DESC, ets DESC, echo_of DESC) = 1""",
    "episodes",
)
def echo_interval_join(spark, d):
    """JN21, P6, ST4: embeddings of the whole contents by the stand-in model."""
    e = M.episodes(spark, d, "ts", "origin", "content").where("content IS NOT NULL AND ts > 0")
    return P.echoes(with_vectors(e, "content").drop("content"), DAY_MS, ECHO)


@reg.query(
    "series_first_instance",
    """SELECT raw_id, account_id, master FROM (SELECT *, coalesce(nullif(CASE WHEN trim(recurring_event_id) <> '' THEN recurring_event_id END, ''), id) AS master FROM (SELECT DISTINCT * FROM raw_calendar_event))
    QUALIFY row_number() OVER (PARTITION BY account_id, master ORDER BY coalesce(start_datetime, start_date) NULLS LAST, raw_id) = 1""",
)
def series_first_instance(spark, d):
    """S7."""
    e = table(spark, d, "raw_calendar_event").select("raw_id", "account_id", "id", "start_datetime", "start_date", "recurring_event_id").distinct()
    return P.first_of_series(e)


@reg.query(
    "calendar_cancellations",
    """WITH z AS (SELECT greatest(1, least((SELECT count(*) FROM raw_calendar_event), (SELECT count(*) FROM node))) AS nb),
    src AS (SELECT DISTINCT ('0x' || left(md5(id), 8))::BIGINT % nb AS b, id AS source_event_id FROM raw_calendar_event, z WHERE id IS NOT NULL)
    SELECT DISTINCT l.id FROM (SELECT id, ('0x' || left(md5(id), 8))::BIGINT % nb AS b FROM live, z) l JOIN src USING (b) WHERE src.source_event_id IN (SELECT id FROM raw_calendar_event WHERE status = 'cancelled')""",
    "live",
)
def calendar_cancellations(spark, d):
    """Nodes stand for the calendar events of their bucket."""
    raw = table(spark, d, "raw_calendar_event")
    b = M.bucket_count(raw.count(), table(spark, d, "node").count())
    e = raw.select("id", "status").where("id IS NOT NULL")
    live = M.live(spark, d)
    events = e.select(F.col("id").alias("source_event_id")).distinct().withColumn("b", M.bucket_of(F.col("source_event_id"), b))
    source = live.withColumn("b", M.bucket_of(F.col("id"), b)).join(events, "b").select(F.col("id").alias("node_id"), "source_event_id")
    return P.cancelled_nodes(live, source, e.where("status = 'cancelled'").select(F.col("id").alias("source_event_id"))).distinct()


_PULL = """z AS (SELECT median(epoch_us(landed_at)) AS m FROM raw_calendar_event), st AS (SELECT account_id, id, max(status) AS was FROM raw_calendar_event, z WHERE id IS NOT NULL AND account_id IS NOT NULL AND epoch_us(landed_at) < m GROUP BY 1, 2), pu AS (SELECT account_id, id, max(status) AS status FROM raw_calendar_event, z WHERE id IS NOT NULL AND account_id IS NOT NULL AND epoch_us(landed_at) >= m GROUP BY 1, 2)"""


@reg.query(
    "calendar_resync",
    f"""WITH {_PULL}, o AS (SELECT p.account_id, p.id, p.status, CASE WHEN s.id IS NULL AND NOT coalesce(status = 'cancelled', false) THEN 'new' WHEN status = 'cancelled' AND s.id IS NOT NULL AND NOT coalesce(was = 'cancelled', false) THEN 'cancelled'
      WHEN s.id IS NOT NULL AND status IS DISTINCT FROM was AND NOT coalesce(status = 'cancelled', false) THEN 'changed' END AS change FROM pu p LEFT JOIN st s ON s.account_id = p.account_id AND s.id = p.id)
    SELECT * FROM o WHERE change IS NOT NULL UNION ALL SELECT s.account_id, s.id, 'cancelled', 'cancelled' FROM st s LEFT JOIN pu p ON p.account_id = s.account_id AND p.id = s.id WHERE p.id IS NULL AND NOT coalesce(was = 'cancelled', false) AND s.account_id IN (SELECT account_id FROM pu)""",
)
def calendar_resync(spark, d):
    """S7, ST9: the later half of the delivered records as a whole pull after the token expired, against the earlier half."""
    raw = table(spark, d, "raw_calendar_event").where("account_id IS NOT NULL").withColumn("us", F.unix_micros(F.col("landed_at").cast("timestamp")))
    middle = F.broadcast(table(spark, d, "raw_calendar_event").agg(F.median(F.unix_micros(F.col("landed_at").cast("timestamp"))).alias("m")))  # one row
    half = raw.join(middle).select("account_id", "id", "status", (F.col("us") < F.col("m")).alias("early"))
    return ingest.pulled_events(half.where("early"), half.where("NOT early"), True)


_HOP = "edges WHERE kind = 'relation' AND rel"


@reg.query(
    "typed_reach_2hop",
    f"""WITH a AS (SELECT DISTINCT src FROM {_HOP} = 'uses'), h1 AS (SELECT e.src AS anchor, e.dst AS id, max(e.w) AS s FROM edges e WHERE e.kind = 'relation' AND e.rel = 'uses' GROUP BY 1, 2),
    h2 AS (SELECT h.anchor, e.dst AS id, max(h.s + e.w) AS score FROM h1 h JOIN edges e ON e.src = h.id AND e.kind = 'relation' AND e.rel = 'depends_on' GROUP BY 1, 2)
    SELECT anchor, id, round(score, 6) AS score FROM h2 QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY round(score, 9) DESC, id) <= 5""",
    "edges",
)
def typed_reach_2hop(spark, d):
    """G2, R14."""
    e = M.edges(spark, d)
    anchors = e.where("kind = 'relation' AND rel = 'uses'").select(F.col("src").alias("id")).distinct()
    return G.typed_reach(e, anchors, ["uses", "depends_on"], 5).select("anchor", "id", F.round("score", 6).alias("score"))


@reg.query(
    "best_path_rank",
    """WITH step AS (SELECT src, dst, max(w) AS w FROM edges WHERE kind = 'relation' GROUP BY 1, 2), a AS (SELECT DISTINCT src AS anchor FROM edges WHERE kind = 'relation' AND rel = 'prefers'),
    h1 AS (SELECT anchor, dst AS id, max(w) AS score FROM a JOIN step ON src = anchor GROUP BY 1, 2),
    h2 AS (SELECT anchor, dst AS id, max(score + w) AS score FROM h1 JOIN step ON src = id GROUP BY 1, 2),
    best AS (SELECT * FROM (SELECT *, 1 AS hops FROM h1 UNION ALL SELECT *, 2 FROM h2) WHERE id <> anchor QUALIFY row_number() OVER (PARTITION BY anchor, id ORDER BY round(score, 9) DESC, hops) = 1),
    r AS (SELECT anchor, id, row_number() OVER (PARTITION BY anchor ORDER BY round(score, 9) DESC, id) AS rank FROM best),
    gold AS (SELECT src AS anchor, min(dst) AS gold FROM edges WHERE kind = 'relation' AND rel = 'prefers' GROUP BY 1)
    SELECT g.anchor, g.gold, r.rank::INT AS rank FROM gold g LEFT JOIN r ON r.anchor = g.anchor AND r.id = g.gold""",
    "edges",
)
def best_path_rank(spark, d):
    """G31."""
    e = M.edges(spark, d)
    wanted = e.where("kind = 'relation' AND rel = 'prefers'")
    found = G.best_paths(e, wanted.select(F.col("src").alias("id")).distinct(), 2)
    return G.rank_of(found, wanted.groupBy(F.col("src").alias("anchor")).agg(F.min("dst").alias("gold")))


_DOCK = "('doc_link', 'doc_containment', 'doc_reference')"


@reg.query(
    "neighbor_docs",
    f"""WITH n AS (SELECT src AS id, dst AS other FROM edges WHERE kind IN {_DOCK} UNION SELECT dst, src FROM edges WHERE kind IN {_DOCK})
    SELECT id, other FROM n WHERE id <> other AND id IN (SELECT id FROM live WHERE type = 'doc') AND other IN (SELECT id FROM live WHERE type = 'doc') QUALIFY row_number() OVER (PARTITION BY id ORDER BY other) <= 15""",
    "live edges",
)
def neighbor_docs(spark, d):
    """JN14, G19, JN12."""
    return G.neighbour_docs(M.edges(spark, d), M.live(spark, d, "type").where("type = 'doc'"))


@reg.query("backlinks", f"SELECT dst AS id, src, min(kind) AS kind FROM edges WHERE kind IN ('cites', 'doc_link', 'doc_containment', 'doc_reference') AND src IN (SELECT id FROM live WHERE type = 'doc') AND dst IN (SELECT id FROM live) GROUP BY 1, 2", "live edges")
def backlinks(spark, d):
    """JN13."""
    return G.backlinks(M.edges(spark, d), M.live(spark, d, "type"))


@reg.query("degree", "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id", "edges")
def degree(spark, d):
    """A6."""
    return G.degrees(M.edges(spark, d))


@reg.query(
    "sideways",
    "WITH n AS (SELECT id, other, max(w) AS w FROM (SELECT src AS id, dst AS other, w FROM edges WHERE kind = 'schema_rel' UNION ALL SELECT dst, src, w FROM edges WHERE kind = 'schema_rel') WHERE id <> other GROUP BY 1, 2) SELECT id, other, w FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, other) <= 3",
    "edges",
)
def sideways(spark, d):
    """R17."""
    return G.fan_out(M.edges(spark, d), "schema_rel", 3)


@reg.query(
    "containment_ancestors",
    """WITH RECURSIVE step AS (SELECT DISTINCT dst AS child, src AS parent FROM edges WHERE kind = 'abstracts' AND src <> dst),
    up AS (SELECT child AS id, parent AS ancestor, 1 AS hops FROM step UNION SELECT u.id, s.parent, u.hops + 1 FROM up u JOIN step s ON s.child = u.ancestor WHERE u.hops < 8)
    SELECT id, ancestor, min(hops)::INT AS hops FROM up WHERE id <> ancestor GROUP BY 1, 2""",
    "edges",
)
def containment_ancestors(spark, d):
    """G13."""
    return G.ancestors(M.edges(spark, d))


@reg.query(
    "doc_tree",
    """WITH RECURSIVE dc AS (SELECT id FROM live WHERE type = 'doc'), step AS (SELECT DISTINCT dst AS child, src AS parent FROM edges WHERE kind = 'doc_containment' AND src <> dst AND src IN (SELECT id FROM dc) AND dst IN (SELECT id FROM dc)),
    up AS (SELECT child AS id, parent AS ancestor, 1 AS hops FROM step UNION SELECT u.id, s.parent, u.hops + 1 FROM up u JOIN step s ON s.child = u.ancestor WHERE u.hops < 8),
    near AS (SELECT id, ancestor, min(hops) AS hops FROM up WHERE id <> ancestor GROUP BY 1, 2), roots AS (SELECT id FROM dc WHERE id NOT IN (SELECT id FROM near))
    SELECT n.id, arg_min(ancestor, (hops, ancestor)) AS root, min(hops)::INT AS depth FROM near n JOIN roots r ON r.id = n.ancestor GROUP BY n.id UNION ALL SELECT id, id, 0 FROM roots""",
    "live edges",
)
def doc_tree(spark, d):
    """R18."""
    return G.doc_tree(M.edges(spark, d), M.live(spark, d, "type").where("type = 'doc'"))


_NAMES = "names AS (SELECT DISTINCT unnest([value, split_part(value, ' ', 1)]) AS name FROM live WHERE type = 'entity' AND value IS NOT NULL)"


@reg.query(
    "name_resolve",
    f"""WITH {_NAMES}, q AS (SELECT name, lower(name) AS q FROM names WHERE lower(name) <> ''), v AS (SELECT id, type, lower(value) AS v FROM live WHERE value IS NOT NULL),
    t AS (SELECT name, id, CASE WHEN type = 'entity' THEN 1 ELSE 2 END AS tier, length(v) AS len FROM q JOIN v ON q = v
      UNION ALL SELECT name, id, 3, length(v) FROM q JOIN v ON v.type = 'entity' AND contains(v, q) AND length(v) <= 3 * length(q))
    SELECT name, id, tier FROM t QUALIFY row_number() OVER (PARTITION BY name ORDER BY tier, len, id) = 1""",
    "live",
)
def name_resolve(spark, d):
    """Names of entities, whole and by their first word."""
    n = M.live(spark, d, "type", "value")
    names = n.where("type = 'entity' AND value IS NOT NULL").select(F.explode(F.array("value", F.split_part("value", F.lit(" "), F.lit(1)))).alias("name"))
    return G.resolve_names(names, n)


@reg.query(
    "link_anchors",
    r"""WITH links AS (SELECT DISTINCT lower(trim(unnest(regexp_extract_all(text, '\[\[([^\]\n]+)\]\]', 1)))) AS link FROM documents WHERE text IS NOT NULL),
    v AS (SELECT id, regexp_replace(trim(lower(value)), '\s+', ' ', 'g') AS v FROM live WHERE value IS NOT NULL)
    SELECT link, id FROM links JOIN v ON contains(v, link) WHERE length(link) >= 3 QUALIFY row_number() OVER (PARTITION BY link ORDER BY id) <= 5""",
    "live",
)
def link_anchors(spark, d):
    """JN16, J6: wiki links of the documents against node values."""
    links = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\]\n]+)\]\]"), F.lit(1))).alias("raw")).select(F.lower(F.trim("raw")).alias("link")).distinct()
    return G.link_anchors(links, M.live(spark, d, "value"), S.normalize_value(F.col("value")))


@reg.query("id_prefix_unique", "WITH p AS (SELECT DISTINCT left(id, 5) AS prefix FROM nodes) SELECT prefix, min(n.id) AS id FROM p JOIN nodes n ON starts_with(n.id, prefix) GROUP BY prefix HAVING count(*) = 1", "nodes")
def id_prefix_unique(spark, d):
    """P11."""
    n = M.nodes(spark, d)
    return G.unique_prefix(n.select(F.substring("id", 1, 5).alias("prefix")), n)


queries = lambda: dict(reg.functions)
oracle_sql = lambda: dict(reg.sql)
