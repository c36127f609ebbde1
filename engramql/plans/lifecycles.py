"""Queries of the writes that follow from a pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramql.config import DAY_MS
from engramql.functions import scalars as S
from engramql.operators import graph as G
from engramql.operators import lifecycle as L
from engramql.operators import provenance as P
from engramql.operators import structure as T
from engramql.operators.versions import last_rows
from engramql.plans import model as M
from engramql.plans.registry import Registry
from engramql.plans.structures import _MEMBERS, _NOISE, _SLUGS, COLUMNS, _documents
from engramql.plans.texts import _NORM
from engramql.storage import table

reg = Registry()
_OK = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_RELS = ", ".join(f"'{p}'" for p in G.PREDICATES)
_TRIPLES = f"""tri AS (SELECT CASE WHEN left(e.src, 1) < '8' THEN upper(a.value) ELSE split_part(a.value, ' ', 1) END AS subject, e.rel AS predicate, CASE WHEN left(e.dst, 1) < '8' THEN b.value ELSE split_part(b.value, ' ', 1) END AS object
  FROM edges e JOIN live a ON a.id = e.src JOIN live b ON b.id = e.dst WHERE e.kind = 'relation' AND e.rel IN ({_RELS}, 'extends'))"""


def _triples(spark, d):
    """What a model would read from an edge: the values of its ends as names, whole or by their first word."""
    v = M.live(spark, d, "value")
    e = M.edges(spark, d).where(F.col("kind") == "relation").where(F.col("rel").isin(*G.PREDICATES, "extends"))
    first = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    j = e.join(v.select(F.col("id").alias("src"), F.col("value").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("value").alias("b")), "dst")
    return j.select(
        F.when(F.substring("src", 1, 1) < "8", F.upper("a")).otherwise(first(F.col("a"))).alias("subject"), F.col("rel").alias("predicate"),
        F.when(F.substring("dst", 1, 1) < "8", F.col("b")).otherwise(first(F.col("b"))).alias("object"),
    )


@reg.query(
    "triple_edges",
    f"""WITH {_TRIPLES}, names AS (SELECT DISTINCT unnest([subject, object]) AS name FROM tri), q AS (SELECT name, lower(name) AS q FROM names WHERE name IS NOT NULL AND lower(name) <> ''),
    v AS (SELECT id, type, lower(value) AS v FROM live WHERE value IS NOT NULL),
    t AS (SELECT name, id, CASE WHEN type = 'entity' THEN 1 ELSE 2 END AS tier, length(v) AS len FROM q JOIN v ON q = v
      UNION ALL SELECT name, id, 3, length(v) FROM q JOIN v ON v.type = 'entity' AND contains(v, q) AND length(v) <= 3 * length(q)),
    r AS (SELECT name, id FROM t QUALIFY row_number() OVER (PARTITION BY name ORDER BY tier, len, id) = 1)
    SELECT DISTINCT a.id AS src, b.id AS dst, predicate AS rel, 0.1e0 AS w, 'relation' AS kind FROM tri JOIN r a ON a.name = subject JOIN r b ON b.name = object WHERE a.id <> b.id AND predicate IN ({_RELS})""",
    "live edges",
)
def triple_edges(spark, d):
    """Triples of names become edges of nodes."""
    return L.triple_edges(_triples(spark, d), M.live(spark, d, "type", "value"), M.NOW).drop("last_access")


_STATED = f"""older AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY landed_at DESC NULLS LAST) AS back FROM node), stated AS (SELECT id || '@1' AS id, CASE WHEN left(id, 1) < '8' THEN value || ' today' ELSE value END AS value, embedding FROM older WHERE back = 2 AND value IS NOT NULL),
c AS (SELECT s.*, sha256(value) AS h, (SELECT min(l.id) FROM live l WHERE l.value_hash = sha256(s.value)) AS same FROM stated s),
nom AS (SELECT c.id AS cid, c.value AS cv, l.*, list_cosine_similarity(c.embedding::DOUBLE[], l.embedding::DOUBLE[]) AS cos FROM (SELECT * FROM c WHERE same IS NULL AND {_OK}) c JOIN (SELECT * FROM live WHERE {_OK}) l ON l.id <> c.id),
top8 AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY round(cos, 6) DESC, id) AS pos FROM nom QUALIFY pos <= 8),
tok AS (SELECT *, regexp_extract_all(lower(cv), '[\\p{{L}}\\p{{N}}]+') AS x, regexp_extract_all(lower(value), '[\\p{{L}}\\p{{N}}]+') AS y FROM top8 WHERE round(cos, 6) >= 0.3 AND value_hash <> sha256(cv)),
hit AS (SELECT *, round(1 - len(list_intersect(list_distinct(x), list_distinct(y)))::DOUBLE / greatest(1, len(list_distinct(list_concat(x, y)))), 6) AS magnitude FROM tok
  WHERE len(x) > 3 AND len(y) > 3 AND x[1:3] = y[1:3] AND x <> y QUALIFY row_number() OVER (PARTITION BY cid ORDER BY pos) = 1),
rt AS (SELECT c.id AS claim_id, c.same, h.id AS node_id, h.value AS node_value, h.magnitude, CASE WHEN c.same IS NOT NULL THEN 'known' WHEN h.id IS NULL THEN 'insert'
  WHEN NOT (h.magnitude / greatest(h.s * exp(-0.05e0 * greatest(0, {M.NOW} - h.last_access) / {float(DAY_MS)}e0) * h.c, 1e-9) < 2.0 OR h.s * exp(-0.05e0 * greatest(0, {M.NOW} - h.last_access) / {float(DAY_MS)}e0) * h.c < 0.3) THEN 'append'
  WHEN {_NORM.replace('value', 'c.value')} = {_NORM.replace('value', 'h.prev_value')} THEN 'oscillation' ELSE 'reconcile' END AS action FROM c LEFT JOIN hit h ON h.cid = c.id)"""


@reg.query(
    "remember_routes",
    f"WITH {_STATED} SELECT claim_id, action, coalesce(same, 'r-' || claim_id) AS new_id, CASE WHEN action IN ('append', 'oscillation', 'reconcile') THEN node_id END AS old_id, CASE WHEN action = 'reconcile' THEN node_value END AS prev_value, CASE WHEN action IN ('append', 'oscillation', 'reconcile') THEN magnitude ELSE 0 END AS magnitude FROM rt",
    "live",
)
def remember_routes(spark, d):
    """The version before the last of each node is stated anew."""
    rows = table(spark, d, "node").select("id", "value", "embedding", "landed_at")
    last = last_rows(rows.select("id", "landed_at")).withColumnRenamed("landed_at", "newest")
    before = last_rows(rows.join(last, "id").where("landed_at < newest").drop("newest")).where("value IS NOT NULL")
    stated = before.select(F.concat("id", F.lit("@1")).alias("id"), F.when(F.substring("id", 1, 1) < "8", F.concat("value", F.lit(" today"))).otherwise(F.col("value")).alias("value"), "embedding")
    return L.remembered(stated, M.live(spark, d, "value", "value_hash", "embedding", "s", "c", "last_access", "prev_value"), M.NOW)


_STUBS = f"""{_SLUGS}, held AS (SELECT id, slug, CASE WHEN left(id, 1) IN ('0', '5', 'a') THEN ' ' ELSE value END AS value FROM docs),
dr AS (SELECT DISTINCT 'new-' || slug AS doc_id, slug FROM held UNION ALL SELECT DISTINCT 'extra-' || left(slug, 3), 'extra-' || left(slug, 3) FROM held),
f AS (SELECT slug, id, length(trim(coalesce(value, ''))) = 0 AS stub FROM held QUALIFY row_number() OVER (PARTITION BY slug ORDER BY id) = 1),
w AS (SELECT doc_id, dr.slug, CASE WHEN f.stub THEN f.id ELSE doc_id END AS written_id, CASE WHEN NOT f.stub THEN f.id END AS old_id, CASE WHEN f.stub THEN 'fill' WHEN f.id IS NOT NULL THEN 'replace' ELSE 'new' END AS action FROM dr LEFT JOIN f ON f.slug = dr.slug)"""


def _written(spark, d):
    blank = F.substring("id", 1, 1).isin("0", "5", "a")
    held = _documents(spark, d).select("id", "slug", F.when(blank, F.lit(" ")).otherwise(F.col("value")).alias("value"))
    extra = F.concat(F.lit("extra-"), F.substring("slug", 1, 3))
    drafts = held.select(F.concat(F.lit("new-"), "slug").alias("doc_id"), "slug").distinct().unionByName(held.select(extra.alias("doc_id"), extra.alias("slug")).distinct())
    return L.written_documents(drafts, held), held


@reg.query("doc_write", f"WITH {_STUBS} SELECT * FROM w", "live edges")
def doc_write(spark, d):
    """A draft for each slug, where a part of the documents are still stubs."""
    return _written(spark, d)[0]


@reg.query(
    "doc_write_edges",
    f"""WITH {_STUBS}, o AS (SELECT w.written_id, e.dst, e.kind FROM w JOIN edges e ON e.src = coalesce(w.old_id, w.written_id) WHERE e.kind IN ('cites', 'doc_link'))
    SELECT DISTINCT written_id AS src, dst, kind AS rel, 1e0 AS w, kind FROM o WHERE kind = 'cites' OR dst IN (SELECT id FROM held)""",
    "live edges",
)
def doc_write_edges(spark, d):
    """The references of the documents before, written anew."""
    written, held = _written(spark, d)
    e = M.edges(spark, d).where(F.col("kind").isin("cites", "doc_link")).select("src", F.col("dst").alias("target"), "kind")
    old = written.select("doc_id", F.coalesce("old_id", "written_id").alias("src")).join(e, "src")
    return L.written_edges(written, old.where("kind = 'cites'"), old.where("kind = 'doc_link'"), held, M.NOW).drop("last_access")


# the insights of the test tables derive from facts; the schemas of these are what an insight is of
_OWNED = """own AS (SELECT src, dst, kind, last_access FROM edges UNION SELECT i.src, a.src, 'derived_from', NULL FROM edges i JOIN edges a ON a.dst = i.dst AND a.kind = 'abstracts' WHERE i.kind = 'derived_from')"""
_REFLECT = f"""{_MEMBERS}, {_OWNED}, sz AS (SELECT schema_id, count(*) AS mass, avg(regexp_matches(coalesce(value, ''), '{_NOISE}')::INT::DOUBLE) AS noise, max(last_access) AS used FROM members GROUP BY 1),
ins AS (SELECT o.dst AS schema_id, min(i.id) AS iid FROM own o JOIN live i ON i.id = o.src AND i.type = 'insight' JOIN live s ON s.id = o.dst AND s.type = 'schema' WHERE o.kind = 'derived_from' GROUP BY 1),
su AS (SELECT o.src AS iid, max(n.last_access) AS su FROM own o JOIN nodes n ON n.id = o.dst AND n.type IN ('fact', 'entity') WHERE o.kind = 'derived_from' GROUP BY 1),
gn AS (SELECT o.src AS schema_id, max(n.last_access) AS gu FROM own o JOIN nodes n ON n.id = o.dst AND n.type IN ('fact', 'entity') AND coalesce(n.tombstoned, false) WHERE o.kind = 'abstracts' GROUP BY 1),
st AS (SELECT s.id AS schema_id, coalesce(mass, 0) AS mass, coalesce(noise, 0) AS noise, ins.iid AS insight_id, coalesce(greatest(coalesce(su, used), gu) > w.last_access, false) AS stale
  FROM live s LEFT JOIN sz ON sz.schema_id = s.id LEFT JOIN ins ON ins.schema_id = s.id LEFT JOIN live w ON w.id = ins.iid LEFT JOIN su ON su.iid = ins.iid LEFT JOIN gn ON gn.schema_id = s.id WHERE s.type = 'schema'),
rf AS (SELECT schema_id, mass, insight_id, CASE WHEN mass < 7 OR noise >= 0.5 THEN CASE WHEN insight_id IS NULL THEN 'none' ELSE 'dissolve' END WHEN insight_id IS NULL THEN CASE WHEN mass >= 10 THEN 'write' ELSE 'none' END WHEN stale THEN 'write' ELSE 'keep' END AS action FROM st)"""


def _reflections(spark, d):
    e = M.edges(spark, d)
    up = e.where("kind = 'abstracts'").select(F.col("dst").alias("m"), F.col("src").alias("s"))
    owned = e.where("kind = 'derived_from'").join(up, F.col("dst") == F.col("m")).select("src", F.col("s").alias("dst"), F.lit("derived_from").alias("kind"))
    every = e.select("src", "dst", "kind").unionByName(owned).distinct()
    n = M.nodes(spark, d, *COLUMNS, "tombstoned")
    return L.reflections(n, every), T.schema_members(e, n.where(~F.coalesce("tombstoned", F.lit(False))))


@reg.query("insight_reflection", f"WITH {_REFLECT} SELECT * FROM rf", "live edges")
def insight_reflection(spark, d):
    """G21, A3, A5."""
    return _reflections(spark, d)[0]


@reg.query(
    "insight_edges",
    f"WITH {_REFLECT}, td AS (SELECT schema_id, 'insight-' || schema_id || '-{M.NOW}' AS src FROM rf WHERE action = 'write') SELECT src, m.id AS dst, 1e0 AS w FROM td JOIN members m USING (schema_id) UNION SELECT src, schema_id, 1e0 FROM td",
    "live edges",
)
def insight_edges(spark, d):
    """What the insights to be written derive from."""
    found, members = _reflections(spark, d)
    return L.reflected(found, members, M.NOW)[1].select("src", "dst", "w")


@reg.query(
    "insight_nodes",
    f"""WITH {_REFLECT}, td AS (SELECT schema_id FROM rf WHERE action = 'write'), hd AS (SELECT m.*, row_number() OVER (PARTITION BY schema_id ORDER BY last_access DESC NULLS LAST, id) AS pos FROM members m JOIN td USING (schema_id) QUALIFY pos <= 5)
    SELECT 'insight-' || schema_id || '-{M.NOW}' AS id, string_agg(value, '; ' ORDER BY pos) AS value, 0.6e0 AS c FROM hd GROUP BY schema_id""",
    "live edges",
)
def insight_nodes(spark, d):
    """The insights to be written."""
    found, members = _reflections(spark, d)
    return L.reflected(found, members, M.NOW)[0].select("id", "value", "c")


_TOUCHING = """touch AS (SELECT DISTINCT v.node_id AS id, p.cwd FROM mem_events v JOIN episodes p ON p.id = v.episode_id WHERE v.node_id IS NOT NULL),
sl AS (SELECT id, lower(regexp_extract(rtrim(trim(coalesce(cwd, '')), '/'), '^/(?:Users|home)/[^/]+(?:/([^/]+))?', 1)) AS g FROM touch), sc AS (SELECT id, CASE WHEN count(DISTINCT g) FILTER (g NOT IN ('', 'resume')) = 1 THEN max(g) FILTER (g NOT IN ('', 'resume')) ELSE 'global' END AS scope FROM sl GROUP BY id),
tc AS (SELECT scope, e.src AS schema_id, s.value AS label, m.id, m.last_access FROM edges e JOIN live s ON s.id = e.src AND s.type = 'schema' JOIN live m ON m.id = e.dst JOIN sc ON sc.id = m.id WHERE e.kind = 'abstracts')"""


def _touching(spark, d):
    """(scope, schema_id, label, id, last_access): members in a scope of their own, below live schemas."""
    live = M.live(spark, d, "type", "value", "last_access")
    stamps = P.scope_stamps(M.mem_events(spark, d), M.episodes(spark, d, "cwd")).select(F.col("node_id").alias("id"), "scope")
    below = M.edges(spark, d).where("kind = 'abstracts'").select(F.col("src").alias("schema_id"), F.col("dst").alias("id")).distinct()
    named = below.join(live.where("type = 'schema'").select(F.col("id").alias("schema_id"), F.col("value").alias("label")), "schema_id")
    return named.join(live.select("id", "last_access"), "id").join(stamps, "id").select("scope", "schema_id", "label", "id", "last_access")


@reg.query(
    "scope_stubs",
    f"""WITH {_TOUCHING}, {_SLUGS}, own AS (SELECT DISTINCT scope, schema_id FROM tc WHERE scope NOT IN ('', 'global')), st AS (SELECT min(scope) AS scope, schema_id AS slug, 'chapter' AS kind FROM own GROUP BY schema_id UNION ALL SELECT DISTINCT scope, scope, 'landing' FROM own)
    SELECT * FROM st WHERE slug NOT IN (SELECT slug FROM docs)""",
    "live edges mem_events episodes",
)
def scope_stubs(spark, d):
    """G15, JN10."""
    return L.scope_stubs(_touching(spark, d), _documents(spark, d))


_SUBJECT = "scope || ':' || regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@reg.query(
    "subject_gates",
    f"""WITH {_TOUCHING}, sch AS (SELECT scope, schema_id, {_SUBJECT} AS slug, count(DISTINCT id) AS mass, list(last_access) AS used FROM tc WHERE label IS NOT NULL GROUP BY 1, 2, 3),
    sub AS (SELECT slug, max({M.NOW - 400 * DAY_MS} + ('0x' || left(schema_id, 2))::BIGINT * {DAY_MS}) AS at FROM sch WHERE left(schema_id, 1) < 'c' GROUP BY slug)
    SELECT scope, bool_or(mass >= 4 AND sub.at IS NULL) AS "create", bool_or(sub.at IS NOT NULL AND coalesce(len(list_filter(used, lambda t: t > sub.at)) >= 3, false)) AS refresh FROM sch LEFT JOIN sub USING (slug) GROUP BY scope""",
    "live edges mem_events episodes",
)
def subject_gates(spark, d):
    """Three in four schemas have a subject document, written at some time in the last 400 days."""
    t = _touching(spark, d).where("label IS NOT NULL")
    slug = F.concat("scope", F.lit(":"), S.subject_name(F.col("label")))
    schemas = t.groupBy("scope", "schema_id", slug.alias("slug")).agg(F.countDistinct("id").alias("mass"), F.collect_list("last_access").alias("used"))
    at = F.lit(M.NOW - 400 * DAY_MS) + F.conv(F.substring("schema_id", 1, 2), 16, 10).cast("bigint") * DAY_MS
    subjects = schemas.where(F.substring("schema_id", 1, 1) < "c").select("slug", at.alias("generated_at"))
    return L.subject_gates(schemas, subjects)


TOOLS = {
    "note": {"properties": {"text": "string", "tags": "array"}, "required": ["text"]},
    "score": {"properties": {"value": "number", "k": "integer"}, "required": ["value", "k"]},
    "flag": {"properties": {"on": "boolean", "props": "object"}, "required": ["on"]},
}
_CALL = """CASE event_type WHEN 'view' THEN '{"tool":"score","args":{"value":' || value::VARCHAR || ',"k":' || event_id % 7 || CASE event_id % 5 WHEN 0 THEN '.5}}' ELSE '}}' END
  WHEN 'click' THEN '{"tool":"note","args":{"text":' || CASE event_id % 3 WHEN 0 THEN '"' || event_type || '"' WHEN 1 THEN 'null' ELSE '12' END || ',"tags":[]}}'
  WHEN 'signup' THEN '{"tool":"flag","args":{"on":true,"props":' || props || CASE event_id % 4 WHEN 0 THEN ',"more":1}}' ELSE '}}' END
  WHEN 'error' THEN '{"tool":"drop","args":{}}' ELSE '{"tool":"note","args"' END"""


@reg.query(
    "tool_args",
    """SELECT event_id, CASE WHEN event_type = 'view' AND event_id % 5 <> 0 THEN 'score' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'note' WHEN event_type = 'signup' AND event_id % 4 <> 0 THEN 'flag' END AS tool FROM events""",
)
def tool_args(spark, d):
    """Proposals, some without an argument, of a wrong kind, with one too many, cut short or for another tool."""
    call = _CALL.replace("::VARCHAR", "").replace("value || ',", "cast(value AS string) || ',")
    rows = table(spark, d, "events").select("event_id", F.expr(call).alias("raw"))
    return L.checked_calls(rows, "event_id", "raw", TOOLS)


@reg.query(
    "gray_zone_bands",
    f"""WITH pool AS (SELECT id, {_NORM} AS v, embedding::DOUBLE[] AS e FROM live WHERE {_OK}), best AS (SELECT a.id AS x, b.id AS y, a.v AS va, b.v AS vb, round(list_cosine_similarity(a.e, b.e), 6) AS cos FROM pool a JOIN pool b ON a.id <> b.id
      QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.id) = 1),
    p AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, cos, CASE WHEN cos < 0.5 THEN 0 WHEN cos < 0.7 THEN 1 WHEN cos < 0.85 THEN 2 ELSE 3 END AS band FROM best WHERE cos >= 0.3 AND cos < 0.97 AND NOT coalesce(va = vb, false))
    SELECT a, b, cos, band FROM p QUALIFY row_number() OVER (PARTITION BY band ORDER BY cos, a, b) <= 12""",
    "live",
)
def gray_zone_bands(spark, d):
    """Best partners over all live vectors, a few of each band of cosines."""
    return L.gray_zone(M.live(spark, d, "value", "embedding"))


@reg.query(
    "density_fill",
    f"""WITH {_MEMBERS}, ov AS (SELECT count(*) AS shown FROM live WHERE type = 'schema'), sz AS (SELECT schema_id, count(*) AS n FROM members GROUP BY 1),
    rm AS (SELECT schema_id, coalesce(sum(n) OVER (ORDER BY n DESC, schema_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sz),
    op AS (SELECT schema_id, 600 - shown - before AS room FROM rm, ov WHERE shown < 600 AND before < 600 - shown)
    SELECT m.schema_id, m.id FROM members m JOIN op USING (schema_id) QUALIFY row_number() OVER (PARTITION BY m.schema_id ORDER BY m.id) <= any_value(room) OVER (PARTITION BY m.schema_id)""",
    "live edges",
)
def density_fill(spark, d):
    """Members revealed beside an overview of schemas alone."""
    live = M.live(spark, d, *COLUMNS)
    shown = live.where("type = 'schema'").agg(F.count(F.lit(1)).alias("shown"))
    return L.revealed(T.schema_members(M.edges(spark, d), live), shown)


queries = lambda: dict(reg.functions)
oracle_sql = lambda: dict(reg.sql)
