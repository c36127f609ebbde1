"""Structure queries: schemas, merging, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramql.functions import scalars as S
from engramql.operators import documents as D
from engramql.operators import graph as G
from engramql.operators import provenance as P
from engramql.operators import retrieval as R
from engramql.operators import structure as T
from engramql.plans import model as M
from engramql.plans.registry import Registry
from engramql.plans.retrieval import _BM25, TERMS
from engramql.plans.texts import _NORM

reg = Registry()
COLUMNS = ("type", "origin", "value", "embedding", "last_access")
_OK = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_MEMBERS = """members AS (SELECT DISTINCT e.src AS schema_id, m.id, m.type, m.value, m.embedding, m.last_access FROM edges e JOIN live s ON s.id = e.src AND s.type = 'schema'
  JOIN live m ON m.id = e.dst AND m.type IN ('fact', 'entity') AND coalesce(m.origin, '') <> 'inferred' WHERE e.kind = 'abstracts')"""
_CENTROIDS = f"""{_MEMBERS}, flat AS (SELECT schema_id, id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM members WHERE {_OK}),
  mean AS (SELECT schema_id, i, avg(x) AS x, count(*) AS n FROM flat GROUP BY 1, 2), cent AS (SELECT schema_id, max(n) AS n, list(x ORDER BY i) AS v FROM mean GROUP BY 1)"""
_NOISE = "|".join(f"(?:{p})" for p in S.NOISE)
_MASS = f"{_MEMBERS}, mass AS (SELECT schema_id, count(*) AS mass, avg(regexp_matches(coalesce(value, ''), '{_NOISE}')::INT::DOUBLE) AS noise FROM members GROUP BY 1)"
#: The slug of the document whose facts are gathered: entities with it in their name lead to linked facts.
SLUG = "service"
_DOCS = "documented AS (SELECT DISTINCT e.src AS schema_id FROM edges e JOIN live d ON d.id = e.dst AND d.type = 'doc' JOIN live s ON s.id = e.src AND s.type = 'schema')"


def _members(spark, d):
    return T.schema_members(M.edges(spark, d), M.live(spark, d, *COLUMNS))


@reg.query("schema_centroids", f"WITH {_CENTROIDS} SELECT schema_id, n, round(v[1], 6) AS c0, round(v[64], 6) AS c63, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS length FROM cent", "live edges")
def schema_centroids(spark, d):
    """A7."""
    c = T.centroids(_members(spark, d))
    length = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda acc, x: acc + x * x))
    return c.select("schema_id", "n", F.round(F.col("centroid")[0], 6).alias("c0"), F.round(F.col("centroid")[63], 6).alias("c63"), F.round(length, 6).alias("length"))


@reg.query("schema_cohesion", f"WITH {_MEMBERS}, ok AS (SELECT * FROM members WHERE {_OK}) SELECT a.schema_id, any_value(n) AS n, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cohesion FROM ok a JOIN ok b ON a.schema_id = b.schema_id AND a.id <> b.id JOIN (SELECT schema_id, count(*) AS n FROM ok GROUP BY 1) c ON c.schema_id = a.schema_id GROUP BY 1", "live edges")
def schema_cohesion(spark, d):
    """A8."""
    return T.cohesion(_members(spark, d)).select("schema_id", "n", F.round("cohesion", 6).alias("cohesion"))


@reg.query("schema_rel_pairs", f"WITH {_CENTROIDS} SELECT a.schema_id AS src, b.schema_id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS w FROM cent a JOIN cent b ON a.schema_id < b.schema_id WHERE round(list_cosine_similarity(a.v, b.v), 9) >= 0.8", "live edges")
def schema_rel_pairs(spark, d):
    """G9, JN18."""
    return T.schema_relations(_members(spark, d)).select("src", "dst", F.round("w", 6).alias("w"))


@reg.query("schema_rel_wide", f"WITH {_CENTROIDS} SELECT a.schema_id AS src, b.schema_id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS w FROM cent a JOIN cent b ON a.schema_id < b.schema_id WHERE round(list_cosine_similarity(a.v, b.v), 9) >= 0.5", "live edges")
def schema_rel_wide(spark, d):
    """G9, JN18 at 0.5, where the test tables have many pairs."""
    return T.schema_relations(_members(spark, d), 0.5).select("src", "dst", F.round("w", 6).alias("w"))


@reg.query("super_schemas")
def super_schemas(spark, d):
    """G10."""
    return T.super_schemas(T.centroids(_members(spark, d)))


@reg.query("schema_induction")
def schema_induction(spark, d):
    """Nodes outside any schema join the nearest one or form new ones."""
    live = M.live(spark, d, *COLUMNS)
    members = T.schema_members(M.edges(spark, d), live)
    loose = live.where("type IN ('fact', 'entity') AND coalesce(origin, '') <> 'inferred'").join(members.select("id").distinct(), "id", "left_anti")
    return T.induce_schemas(loose, T.centroids(members).select("schema_id", "centroid"))


@reg.query("schema_joins", f"WITH {_CENTROIDS}, loose AS (SELECT id, embedding::DOUBLE[] AS e FROM live WHERE type IN ('fact', 'entity') AND coalesce(origin, '') <> 'inferred' AND {_OK} AND id NOT IN (SELECT id FROM members)) SELECT l.id, c.schema_id FROM loose l, cent c WHERE round(list_cosine_similarity(l.e, c.v), 9) >= 0.75 QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY round(list_cosine_similarity(l.e, c.v), 9) DESC, c.schema_id) = 1", "live edges")
def schema_joins(spark, d):
    """The first step alone."""
    live = M.live(spark, d, *COLUMNS)
    members = T.schema_members(M.edges(spark, d), live)
    loose = live.where("type IN ('fact', 'entity') AND coalesce(origin, '') <> 'inferred'").join(members.select("id").distinct(), "id", "left_anti")
    return T.joined_schemas(loose, T.centroids(members), T.DEFAULT.schema_join)


@reg.query("schema_falsified", f"WITH {_MEMBERS} SELECT id FROM live WHERE type = 'schema' AND coalesce((SELECT count(*) FROM members m WHERE m.schema_id = live.id), 0) < 3", "live edges")
def schema_falsified(spark, d):
    """Schemas that lost their support."""
    return T.falsified(M.edges(spark, d), M.live(spark, d, *COLUMNS))


@reg.query("schema_mass_noise", f"WITH {_MASS} SELECT schema_id, mass, round(noise, 6) AS noise FROM mass", "live edges")
def schema_mass_noise(spark, d):
    """A3, A5, JN9."""
    return T.mass_and_noise(_members(spark, d)).select("schema_id", "mass", F.round("noise", 6).alias("noise"))


@reg.query(
    "promotion_hysteresis",
    f"""WITH {_MASS}, {_DOCS}, j AS (SELECT m.*, d.schema_id IS NOT NULL AS has_doc FROM mass m LEFT JOIN documented d USING (schema_id))
    SELECT schema_id, mass, round(noise, 6) AS noise, has_doc, CASE WHEN noise < 0.5 AND (mass >= 10 OR (mass >= 7 AND has_doc)) THEN 'promote' WHEN has_doc AND (noise >= 0.5 OR mass < 7) THEN 'withdraw' ELSE 'none' END AS action FROM j""",
    "live edges",
)
def promotion_hysteresis(spark, d):
    """G14, G16, G21."""
    e, live = M.edges(spark, d), M.live(spark, d, *COLUMNS)
    docs = e.join(live.where("type = 'doc'").select(F.col("id").alias("dst")), "dst", "left_semi").join(live.where("type = 'schema'").select(F.col("id").alias("src")), "src", "left_semi")
    p = T.promotion(T.mass_and_noise(T.schema_members(e, live)), docs.select(F.col("src").alias("schema_id")))
    return p.withColumn("noise", F.round("noise", 6))


@reg.query("schema_drift", f"WITH {_MEMBERS} SELECT m.schema_id, sum((m.last_access > s.last_access)::INT)::BIGINT AS touched FROM members m JOIN live s ON s.id = m.schema_id GROUP BY 1", "live edges")
def schema_drift(spark, d):
    """A4: members used after their schema."""
    live = M.live(spark, d, *COLUMNS)
    return T.drift(T.schema_members(M.edges(spark, d), live), live.where("type = 'schema'").select(F.col("id").alias("schema_id"), F.col("last_access").alias("generated_at")))


@reg.query(
    "insight_freshness",
    """WITH i AS (SELECT id, last_access AS written FROM live WHERE type = 'insight'), s AS (SELECT src AS id, dst FROM edges WHERE kind = 'derived_from')
    SELECT i.id, count(s.dst) AS sources, count(s.dst) = 0 OR coalesce(bool_or(s.dst IS NOT NULL AND (n.id IS NULL OR coalesce(n.tombstoned, false) OR n.last_access > i.written)), false) AS stale FROM i LEFT JOIN s ON s.id = i.id LEFT JOIN nodes n ON n.id = s.dst GROUP BY i.id""",
    "live edges",
)
def insight_freshness(spark, d):
    """G7, A10."""
    return T.insight_states(M.nodes(spark, d, "type", "tombstoned", "last_access"), M.edges(spark, d))


_DUPES = f"""ent AS (SELECT id, {_NORM} AS norm, embedding::DOUBLE[] AS v FROM live WHERE type IN ('entity', 'fact') AND prev_value IS NULL AND value IS NOT NULL AND {_OK}),
pairs AS (SELECT a.id AS a, b.id AS b FROM ent a JOIN ent b ON a.norm = b.norm AND a.id < b.id WHERE a.norm <> '' AND round(list_cosine_similarity(a.v, b.v), 9) >= 0.88)"""
_CANON = f"""{_DUPES}, both_ AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a, b FROM both_ UNION SELECT r.a, p.b FROM reach r JOIN both_ p ON p.a = r.b),
lab AS (SELECT a AS id, least(a, min(b)) AS label FROM reach GROUP BY a), deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id),
canon AS (SELECT l.id, first_value(l.id) OVER (PARTITION BY l.label ORDER BY coalesce(d.degree, 0) DESC, coalesce(n.c, 0) DESC, coalesce(n.last_access, 0), l.id) AS canonical FROM lab l JOIN live n ON n.id = l.id LEFT JOIN deg d ON d.id = l.id)"""


def _entities(spark, d):
    return M.live(spark, d, "type", "value", "prev_value", "embedding", "c", "last_access").where("type IN ('entity', 'fact')")


@reg.query("dedup_groups", f"WITH RECURSIVE {_DUPES}, both_ AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a, b FROM both_ UNION SELECT r.a, p.b FROM reach r JOIN both_ p ON p.a = r.b) SELECT a AS id, least(a, min(b)) AS label FROM reach GROUP BY a", "live")
def dedup_groups(spark, d):
    """G11, JN19."""
    from engramql.operators.components import components

    return components(T.duplicate_pairs(_entities(spark, d))).select(F.col("v").alias("id"), "label")


@reg.query("dedup_canonical", f"WITH RECURSIVE {_CANON} SELECT id, canonical FROM canon", "live edges")
def dedup_canonical(spark, d):
    """R15, G11."""
    n = _entities(spark, d)
    return T.canonical(T.duplicate_pairs(n), n, G.degrees(M.edges(spark, d)))


@reg.query("fact_dedup", f"WITH f AS (SELECT id, {_NORM} AS norm, embedding::DOUBLE[] AS v FROM live WHERE type = 'fact' AND prev_value IS NULL AND value IS NOT NULL AND {_OK} AND NOT regexp_matches(value, '(?i){'|'.join(f'(?:{p})' for p in S.POLLUTION)}')), p AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.norm = b.norm AND a.id < b.id WHERE a.norm <> '' AND round(list_cosine_similarity(a.v, b.v), 9) >= 0.88) SELECT id, min(other) AS label FROM (SELECT a AS id, least(a, b) AS other FROM p UNION ALL SELECT b, least(a, b) FROM p) GROUP BY id", "live")
def fact_dedup(spark, d):
    """G12."""
    from engramql.operators.components import components

    n = M.live(spark, d, "type", "value", "prev_value", "embedding").where("type = 'fact'").where(~S.is_pollution(F.col("value")))
    return components(T.duplicate_pairs(n)).select(F.col("v").alias("id"), "label")


@reg.query(
    "edge_rewire",
    f"""WITH RECURSIVE {_CANON}, gone AS (SELECT * FROM canon WHERE id <> canonical),
    m AS (SELECT coalesce(s.canonical, e.src) AS src, coalesce(t.canonical, e.dst) AS dst, rel, kind, w, last_access FROM edges e LEFT JOIN gone s ON s.id = e.src LEFT JOIN gone t ON t.id = e.dst)
    SELECT src, dst, rel, min(kind) AS kind, max(w) AS w, max(last_access) AS last_access FROM m WHERE src <> dst GROUP BY 1, 2, 3""",
    "live edges",
)
def edge_rewire(spark, d):
    """A13, G11."""
    e, n = M.edges(spark, d), _entities(spark, d)
    return T.rewired_edges(e, T.canonical(T.duplicate_pairs(n), n, G.degrees(e)))


@reg.query(
    "idf_pairs",
    f"""WITH {_MEMBERS}, tot AS (SELECT count(DISTINCT schema_id)::DOUBLE AS total FROM members), sh AS (SELECT DISTINCT schema_id AS s, id AS k FROM members),
    par AS (SELECT DISTINCT src AS parent, dst AS s FROM edges WHERE kind = 'abstracts' AND src <> dst), adj AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT src AS x, dst AS y FROM edges WHERE kind = 'schema_rel' UNION ALL SELECT p.s, q.s FROM par p JOIN par q ON p.parent = q.parent AND p.s < q.s)
      WHERE x <> y AND x IN (SELECT schema_id FROM members) AND y IN (SELECT schema_id FROM members)),
    nm AS (SELECT DISTINCT schema_id AS s, {_NORM} AS k FROM members WHERE type = 'entity' AND value IS NOT NULL),
    w1 AS (SELECT k, ln(total / count(*)) AS idf FROM sh, tot GROUP BY k, total), w2 AS (SELECT k, 0.5 * ln(total / count(*)) AS idf FROM nm, tot WHERE k <> '' GROUP BY k, total HAVING count(*) < total / 2),
    p AS (SELECT x.s AS a, y.s AS b, idf FROM sh x JOIN sh y ON x.k = y.k AND x.s < y.s JOIN w1 ON w1.k = x.k UNION ALL SELECT x.s, y.s, idf FROM nm x JOIN nm y ON x.k = y.k AND x.s < y.s JOIN w2 ON w2.k = x.k UNION ALL SELECT a, b, 0.3 FROM adj),
    sc AS (SELECT a, b, sum(idf) AS score FROM p GROUP BY 1, 2 HAVING round(sum(idf), 9) > 0),
    e AS (SELECT a, b, score, unnest([a, b]) AS e FROM sc), r AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY round(score, 9) DESC, a, b) AS pos FROM e)
    SELECT DISTINCT a, b, round(score, 6) AS score FROM r WHERE pos <= 7""",
    "live edges",
)
def idf_pairs(spark, d):
    """JN20, A11, R16, G13."""
    m = _members(spark, d)
    return T.subject_pairs(m, T.adjacent_subjects(M.edges(spark, d), m)).select("a", "b", F.round("score", 6).alias("score")).distinct()


@reg.query(
    "gather_facts",
    f"""WITH {_MEMBERS}, {_BM25}, top_ AS (SELECT schema_id FROM members GROUP BY 1 ORDER BY count(*) DESC, schema_id LIMIT 1), spine AS (SELECT id FROM members WHERE schema_id = (SELECT schema_id FROM top_)),
    sem AS (SELECT id FROM bm ORDER BY round(score, 9) DESC, id LIMIT 60), ent AS (SELECT id FROM live WHERE type = 'entity' AND contains(lower(value), '{SLUG}')),
    lnk AS (SELECT DISTINCT l.id FROM (SELECT src AS id, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges) e JOIN ent USING (id) JOIN live l ON l.id = e.other AND l.type = 'fact'),
    u AS (SELECT id, 0 AS o, 'scope' AS n FROM spine UNION SELECT id, 1, 'semantic' FROM sem UNION SELECT id, 2, 'linked' FROM lnk) SELECT id, string_agg(n, '+' ORDER BY o) AS via FROM u GROUP BY id""",
    "live edges",
)
def gather_facts(spark, d):
    """G18, G17."""
    e, live = M.edges(spark, d), M.live(spark, d, *COLUMNS)
    members = T.schema_members(e, live)
    top = members.groupBy("schema_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "schema_id").limit(1)
    spine = members.join(F.broadcast(top.select("schema_id")), "schema_id", "left_semi").select("id")  # one row
    semantic = R.top(R.bm25(live, "value", TERMS), "score", 60)
    return T.gather(spine, semantic, T.linked_facts(e, live, SLUG))


@reg.query("topics", f"WITH {_MEMBERS} SELECT m.schema_id, s.value AS label, count(*) AS members FROM members m JOIN live s ON s.id = m.schema_id GROUP BY 1, 2 ORDER BY members DESC, label, schema_id LIMIT 20", "live edges")
def topics(spark, d):
    """R19, A3."""
    live = M.live(spark, d, *COLUMNS)
    m = T.schema_members(M.edges(spark, d), live).groupBy("schema_id").agg(F.count(F.lit(1)).alias("members"))
    named = m.join(live.select(F.col("id").alias("schema_id"), F.col("value").alias("label")), "schema_id")
    return named.orderBy(F.desc("members"), "label", "schema_id").limit(20).select("schema_id", "label", "members")


@reg.query("level_of_detail", f"WITH {_MEMBERS} SELECT type, CASE WHEN type = 'schema' THEN 'schema' WHEN id IN (SELECT id FROM members) THEN 'member' ELSE 'haze' END AS level, count(*) AS n FROM live GROUP BY 1, 2", "live edges")
def level_of_detail(spark, d):
    """R20."""
    live = M.live(spark, d, *COLUMNS)
    m = T.schema_members(M.edges(spark, d), live).select("id").distinct().withColumn("m", F.lit(True))
    level = F.when(F.col("type") == "schema", "schema").when(F.col("m"), "member").otherwise("haze")
    return live.select("id", "type").join(m, "id", "left").groupBy("type", level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


_SLUGS = """docs AS (SELECT d.id, coalesce(min(s.id), min(e.src), 'hub-' || left(d.id, 2)) AS slug, d.value FROM live d LEFT JOIN edges e ON e.dst = d.id AND e.kind = 'doc_containment'
  LEFT JOIN edges c ON c.src = d.id AND c.kind = 'cites' LEFT JOIN live s ON s.id = c.dst AND s.type = 'schema' WHERE d.type = 'doc' GROUP BY d.id, d.value)"""


def _documents(spark, d):
    """Documents with a slug: a schema that they cite, else their container, else a hub."""
    e = M.edges(spark, d)
    live = M.live(spark, d, "type", "value")
    inside = e.where("kind = 'doc_containment'").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("container"))
    cited = e.where("kind = 'cites'").join(live.where("type = 'schema'").select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("schema"))
    docs = live.where("type = 'doc'").join(inside, "id", "left").join(cited, "id", "left")
    return docs.select("id", F.coalesce("schema", "container", F.concat(F.lit("hub-"), F.substring("id", 1, 2))).alias("slug"), "value")


@reg.query("doc_catalog", f"WITH {_SLUGS} SELECT x.id, x.slug, coalesce(nullif(s.value, ''), x.slug) AS label FROM docs x LEFT JOIN live s ON s.id = x.slug", "live edges")
def doc_catalog(spark, d):
    """JN11, F27."""
    names = M.live(spark, d, "value").select(F.col("id").alias("slug"), F.col("value").alias("name"))
    return _documents(spark, d).join(names, "slug", "left").select("id", "slug", F.coalesce(F.nullif("name", F.lit("")), "slug").alias("label"))


@reg.query("doc_queue", f"WITH {_SLUGS}, s AS (SELECT DISTINCT slug FROM docs), c AS (SELECT slug, CASE WHEN regexp_matches(slug, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') THEN 'chapter' WHEN contains(slug, ':') THEN 'subject' ELSE 'hub' END AS class FROM s), r AS (SELECT *, row_number() OVER (ORDER BY CASE class WHEN 'hub' THEN 0 WHEN 'subject' THEN 1 ELSE 2 END, slug) AS pos FROM c) SELECT slug, class, pos, pos <= 25 AS taken FROM r", "live edges")
def doc_queue(spark, d):
    """R13."""
    return T.document_queue(_documents(spark, d).select("slug").distinct(), 25)


@reg.query("junk_docs", f"WITH {_MASS}, {_SLUGS} SELECT x.id, CASE WHEN s.id IS NOT NULL THEN 'chapter-uuid' WHEN length(coalesce(x.value, '')) = 0 THEN 'empty-stub' WHEN m.noise >= 0.5 THEN 'noise-schema' END AS reason FROM docs x LEFT JOIN live s ON s.id = x.slug AND s.type = 'schema' LEFT JOIN mass m ON m.schema_id = x.slug WHERE s.id IS NOT NULL OR length(coalesce(x.value, '')) = 0 OR m.noise >= 0.5", "live edges")
def junk_docs(spark, d):
    """P14, G33."""
    live = M.live(spark, d, *COLUMNS)
    masses = T.mass_and_noise(T.schema_members(M.edges(spark, d), live))
    return T.junk_documents(_documents(spark, d), live.where("type = 'schema'").select("id"), masses)


@reg.query(
    "scope_schemas",
    """WITH touch AS (SELECT DISTINCT v.node_id AS id, p.cwd FROM mem_events v JOIN episodes p ON p.id = v.episode_id WHERE v.node_id IS NOT NULL),
    sl AS (SELECT id, lower(regexp_extract(rtrim(trim(coalesce(cwd, '')), '/'), '^/(?:Users|home)/[^/]+(?:/([^/]+))?', 1)) AS g FROM touch), sc AS (SELECT id, CASE WHEN count(DISTINCT g) FILTER (g NOT IN ('', 'resume')) = 1 THEN max(g) FILTER (g NOT IN ('', 'resume')) ELSE 'global' END AS scope FROM sl GROUP BY id)
    SELECT scope, count(DISTINCT e.src) AS schemas, count(DISTINCT m.id) AS members FROM edges e JOIN live s ON s.id = e.src AND s.type = 'schema' JOIN live m ON m.id = e.dst JOIN sc ON sc.id = m.id WHERE e.kind = 'abstracts' GROUP BY scope""",
    "live edges mem_events episodes",
)
def scope_schemas(spark, d):
    """JN10, G15."""
    live = M.live(spark, d, "type")
    stamps = P.scope_stamps(M.mem_events(spark, d), M.episodes(spark, d, "cwd")).select(F.col("node_id").alias("dst"), "scope")
    below = M.edges(spark, d).where("kind = 'abstracts'").select("src", "dst").join(live.where("type = 'schema'").select(F.col("id").alias("src")), "src", "left_semi").join(live.select(F.col("id").alias("dst")), "dst", "left_semi")
    return below.join(stamps, "dst").groupBy("scope").agg(F.countDistinct("src").alias("schemas"), F.countDistinct("dst").alias("members"))


@reg.query("vector_index", f"SELECT id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length FROM live WHERE {_OK}", "live")
def vector_index(spark, d):
    """S19."""
    return D.vector_table(M.live(spark, d, "embedding"), 64).select("id", F.round("length", 6).alias("length"))


_CITE = """txt AS (SELECT src AS doc_id, string_agg('see /fact/' || CASE WHEN left(dst, 1) < '6' THEN dst WHEN left(dst, 1) < 'c' THEN left(dst, 5) ELSE 'zz' || dst END, ' ' ORDER BY dst) AS text FROM edges WHERE kind = 'cites' GROUP BY 1),
refs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '/fact/([0-9A-Za-z-]{4,64})', 1)) AS ref FROM txt)"""


@reg.query(
    "citation_check",
    f"""WITH {_CITE}, ex AS (SELECT r.*, n.id AS hit, coalesce(n.tombstoned, false) AS dead FROM refs r LEFT JOIN nodes n ON n.id = lower(r.ref)),
    pre AS (SELECT e.doc_id, e.ref, min(n.id) AS pid, bool_or(coalesce(n.tombstoned, false)) AS pdead FROM ex e JOIN nodes n ON starts_with(n.id, lower(e.ref)) WHERE e.hit IS NULL GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT e.doc_id, e.ref, coalesce(e.hit, p.pid) AS id, CASE WHEN coalesce(e.hit, p.pid) IS NULL THEN 'invented' WHEN CASE WHEN e.hit IS NOT NULL THEN e.dead ELSE p.pdead END THEN 'deleted' ELSE 'ok' END AS state FROM ex e LEFT JOIN pre p USING (doc_id, ref)""",
    "nodes edges",
)
def citation_check(spark, d):
    """Texts that cite the targets of their edges by id, by prefix or wrongly."""
    c = F.substring("dst", 1, 1)
    name = F.when(c < "6", F.col("dst")).when(c < "c", F.substring("dst", 1, 5)).otherwise(F.concat(F.lit("zz"), "dst"))
    e = M.edges(spark, d).where("kind = 'cites'").select(F.col("src").alias("doc_id"), F.concat(F.lit("see /fact/"), name).alias("x"))
    texts = e.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("x")), " ").alias("text"))
    return D.citations(texts, M.nodes(spark, d, "tombstoned"))


_GLOSSES = "(VALUES " + ", ".join(f"('{p}', {i}, '{q}')" for i, (p, q) in enumerate(G.PREDICATES.items())) + ") gl(predicate, no, question)"
_CUES = f"""cue AS (SELECT id, md5(unnest(regexp_extract_all(lower(value), '[\\p{{L}}\\p{{N}}]+'))) AS h FROM live WHERE value IS NOT NULL), glo AS (SELECT no, md5(unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}]+'))) AS h FROM {_GLOSSES}),
cv AS (SELECT id, ('0x' || left(h, 4))::INT % 64 AS i, sum(CASE WHEN h[5] < '8' THEN 1 ELSE -1 END)::DOUBLE AS x FROM cue GROUP BY 1, 2 HAVING x <> 0), gv AS (SELECT no, ('0x' || left(h, 4))::INT % 64 AS i, sum(CASE WHEN h[5] < '8' THEN 1 ELSE -1 END)::DOUBLE AS x FROM glo GROUP BY 1, 2 HAVING x <> 0),
cn AS (SELECT id, sqrt(sum(x * x)) AS n FROM cv GROUP BY id), gn AS (SELECT no, sqrt(sum(x * x)) AS n FROM gv GROUP BY no),
sim AS (SELECT c.id, g.no, sum(c.x * g.x) / any_value(cn.n * gn.n) AS cos FROM cv c JOIN gv g USING (i) JOIN cn ON cn.id = c.id JOIN gn ON gn.no = g.no GROUP BY 1, 2),
pick AS (SELECT id, no FROM sim WHERE round(cos, 9) >= 0.35 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(cos, 9) DESC, no) = 1), asked AS (SELECT pick.id, predicate FROM pick JOIN {_GLOSSES} USING (no))"""


@reg.query(
    "predicate_paths",
    f"""WITH {_CUES}, e1 AS (SELECT a.id AS anchor, a.predicate, e.dst AS id, max(e.w) AS score FROM asked a JOIN edges e ON e.src = a.id AND e.rel = a.predicate AND e.kind = 'relation' GROUP BY ALL)
    SELECT anchor, predicate, id, round(score, 6) AS score FROM e1 QUALIFY row_number() OVER (PARTITION BY anchor, predicate ORDER BY round(score, 9) DESC, id) <= 5""",
    "live edges",
)
def predicate_paths(spark, d):
    """The value of each live node as a cue, the predicate that it asks for, and what lies along it from the node."""
    cues = D.seams.with_vectors(M.live(spark, d, "value").where("value IS NOT NULL"), "value").where("v IS NOT NULL")
    asked = D.predicates_of(cues, "v").select(F.col("id").alias("anchor"), "predicate")
    e = M.edges(spark, d).where("kind = 'relation'").select(F.col("src").alias("anchor"), F.col("rel").alias("predicate"), "dst", "w")
    found = asked.join(e, ["anchor", "predicate"]).groupBy("anchor", "predicate", F.col("dst").alias("id")).agg(F.max("w").alias("score"))
    return G.first_per(found, ["anchor", "predicate"], [F.round("score", 9).desc(), F.col("id")], 5).withColumn("score", F.round("score", 6))


@reg.query("cue_predicates", f"WITH {_CUES} SELECT predicate, count(*) AS n FROM asked GROUP BY 1", "live")
def cue_predicates(spark, d):
    """How many cues ask for each predicate."""
    cues = D.seams.with_vectors(M.live(spark, d, "value").where("value IS NOT NULL"), "value").where("v IS NOT NULL")
    return D.predicates_of(cues, "v").groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


queries = lambda: dict(reg.functions)
oracle_sql = lambda: dict(reg.sql)
