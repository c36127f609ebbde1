"""Writes that follow from what a pass found: typed edges, remembered facts, documents, insights, stubs.

Each function is a plan over snapshots and gives the changed rows; merging them
into a table is left to ``mutations``.  Where a write must pick one of several
rows (two live documents of a slug), the smallest id is taken.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramql.config import DEFAULT, Settings
from engramql.functions import scalars as S
from engramql.operators import belief, graph, structure

LIVE_EDGE = ("src", "dst", "rel", "w", "last_access", "kind")


def triple_edges(triples: DataFrame, nodes: DataFrame, now_ms: int, weight: float = 0.1) -> DataFrame:
    """Edges of extracted triples (subject, predicate, object) between live nodes that the names resolve to.

    Names are resolved once each, whatever the number of triples; a triple with
    an unknown end or both ends on one node gives no edge.
    """
    names = triples.select(F.explode(F.array("subject", "object")).alias("name")).where("name IS NOT NULL").distinct()
    found = graph.resolve_names(names, nodes).select("name", "id")
    ends = (
        triples.where(F.col("predicate").isin(*graph.PREDICATES))
        .join(found.select(F.col("name").alias("subject"), F.col("id").alias("src")), "subject")
        .join(found.select(F.col("name").alias("object"), F.col("id").alias("dst")), "object")
    )
    rows = ends.where("src <> dst").select("src", "dst", F.col("predicate").alias("rel")).distinct()
    return rows.select("src", "dst", "rel", F.lit(weight).alias("w"), F.lit(now_ms).cast("bigint").alias("last_access"), F.lit("relation").alias("kind"))


def contradicts(a: Column, b: Column) -> tuple[Column, Column]:
    """(whether, magnitude) of the stand-in judge: the same three opening words and another rest; one minus the shared words."""
    x, y = S.fts_tokens(a), S.fts_tokens(b)
    shared, every = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    hit = (F.size(x) > 3) & (F.size(y) > 3) & (F.slice(x, 1, 3) == F.slice(y, 1, 3)) & (x != y)
    return hit, F.round(1 - shared / F.greatest(F.lit(1), every), 6)


def remembered(claims: DataFrame, nodes: DataFrame, now_ms: int, cfg: Settings = DEFAULT, k: int = 8, judged: Callable[[Column, Column], tuple[Column, Column]] = contradicts) -> DataFrame:
    """(claim_id, action, new_id, old_id, prev_value, magnitude) of stated facts, applied at once.

    A value that a live node has already changes nothing ('known').  Of the k
    nearest live nodes above the floor, the first that the statement
    contradicts is revised: what would be held is reconciled, since the user
    said it (the old node is tombstoned, the new one names its value as the one
    before), unless the statement is the value before the old one
    ('oscillation'); 'append' leaves the old node.  All else is inserted.  New
    nodes start at s = 0.9, c = 0.95.
    """
    digest = F.sha2("value", 256)
    have = nodes.groupBy("value_hash").agg(F.min("id").alias("same"))
    c = claims.select("id", "value", "embedding", digest.alias("value_hash")).join(have, "value_hash", "left")
    near = belief.nominate(c.where("same IS NULL"), nodes, k).where(F.round("cos", 6) >= cfg.unrelated_below)
    state = nodes.select(F.col("id").alias("node_id"), F.col("value").alias("node_value"), F.col("value_hash").alias("node_hash"), "s", "c", "last_access", F.col("prev_value").alias("node_prev"))
    pairs = near.join(state, "node_id").join(c.select(F.col("id").alias("claim_id"), "value", "value_hash"), "claim_id").where("node_hash <> value_hash")
    hit, magnitude = judged(F.col("value"), F.col("node_value"))
    first = pairs.withColumn("magnitude", magnitude).where(hit).groupBy("claim_id").agg(F.min_by(F.struct("node_id", "node_value", "node_prev", "s", "c", "last_access", "magnitude"), "pos").alias("x"))
    j = c.select(F.col("id").alias("claim_id"), "value", "same").join(first, "claim_id", "left")
    resistance = S.effective_strength(F.col("x.s"), F.col("x.last_access"), now_ms, cfg.decay_per_day) * F.col("x.c")
    route = S.route_contradiction(F.col("x.magnitude"), resistance)
    back = F.coalesce(S.is_oscillation(F.col("value"), F.col("x.node_prev")), F.lit(False))
    action = (
        F.when(F.col("same").isNotNull(), "known").when(F.col("x").isNull(), "insert").when(route == "append-new", "append").when(back, "oscillation").otherwise("reconcile")
    )
    out = j.withColumn("action", action)
    return out.select(
        "claim_id", "action", F.coalesce("same", F.concat(F.lit("r-"), "claim_id")).alias("new_id"), F.when(F.col("action").isin("append", "oscillation", "reconcile"), F.col("x.node_id")).alias("old_id"),
        F.when(F.col("action") == "reconcile", F.col("x.node_value")).alias("prev_value"), F.coalesce(F.when(F.col("action").isin("append", "oscillation", "reconcile"), F.col("x.magnitude")), F.lit(0.0)).alias("magnitude"),
    )


def written_documents(drafts: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, slug, written_id, old_id, action): where each draft (doc_id, slug) goes.

    A live document of the slug that is still empty is filled in place; one
    with text is tombstoned and the draft becomes a new document.
    ``documents`` are live and have id, slug, value.
    """
    j = drafts.join(documents.select("id", "slug", (F.length(F.trim(F.coalesce("value", F.lit("")))) == 0).alias("stub")), "slug", "left").where(F.coalesce(F.col("id") != F.col("doc_id"), F.lit(True)))
    one = j.groupBy("doc_id", "slug").agg(F.min(F.struct("id", "stub")).alias("x"))
    missing = drafts.select("doc_id", "slug").join(one.select("doc_id"), "doc_id", "left_anti").withColumn("x", F.lit(None).cast(one.schema["x"].dataType))
    both = one.unionByName(missing)
    fill = F.coalesce(F.col("x.stub"), F.lit(False))
    return both.select(
        "doc_id", "slug", F.when(fill, F.col("x.id")).otherwise(F.col("doc_id")).alias("written_id"), F.when(~fill, F.col("x.id")).alias("old_id"),
        F.when(fill, "fill").when(F.col("x.id").isNotNull(), "replace").otherwise("new").alias("action"),
    )


def written_edges(written: DataFrame, cites: DataFrame, links: DataFrame, documents: DataFrame, now_ms: int) -> DataFrame:
    """'cites' and 'doc_link' edges of written drafts: cites (doc_id, target) as they are, links (doc_id, target) to live documents only."""
    alive = documents.select(F.col("id").alias("target"))
    rows = cites.select("doc_id", "target", F.lit("cites").alias("kind")).unionByName(links.join(alive, "target", "left_semi").select("doc_id", "target", F.lit("doc_link").alias("kind")))
    j = rows.distinct().join(written.select("doc_id", "written_id"), "doc_id")
    return j.select(F.col("written_id").alias("src"), F.col("target").alias("dst"), F.col("kind").alias("rel"), F.lit(1.0).alias("w"), F.lit(now_ms).cast("bigint").alias("last_access"), "kind")


def reflections(nodes: DataFrame, edges: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """(schema_id, mass, insight_id, action): what becomes of the insight of each live schema.

    'dissolve': the insight goes, since the schema fell below the low mark or
    is mostly noise.  'write': a schema at the high mark (or at the low one,
    where it has an insight) has none yet, or a member, living or deleted, was
    used after the insight was written.  'keep': nothing changed.  'none':
    there is no insight and none is due.  ``nodes`` has id, type, origin,
    value, embedding, last_access, tombstoned.
    """
    dead = F.coalesce("tombstoned", F.lit(False))
    live = nodes.where(~dead)
    members = structure.schema_members(edges, live)
    size = members.groupBy("schema_id").agg(F.count(F.lit(1)).alias("mass"), F.avg(S.is_noise(F.coalesce("value", F.lit(""))).cast("double")).alias("noise"), F.max("last_access").alias("used"))
    schemas = live.where("type = 'schema'").select(F.col("id").alias("schema_id"))
    insight = live.where("type = 'insight'").select(F.col("id").alias("src"), F.col("last_access").alias("written"))
    derived = edges.where("kind = 'derived_from'").select("src", "dst").distinct()
    owned = derived.join(insight, "src").join(schemas.select(F.col("schema_id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("schema_id")).agg(F.min(F.struct(F.col("src").alias("id"), "written")).alias("i"))
    sources = derived.join(nodes.where("type IN ('fact', 'entity')").select(F.col("id").alias("dst"), "last_access"), "dst").groupBy(F.col("src").alias("iid")).agg(F.max("last_access").alias("source_used"))
    gone = edges.where("kind = 'abstracts'").join(nodes.where(dead & F.col("type").isin("fact", "entity")).select(F.col("id").alias("dst"), "last_access"), "dst").groupBy(F.col("src").alias("schema_id")).agg(F.max("last_access").alias("gone_used"))
    j = schemas.join(size, "schema_id", "left").join(owned, "schema_id", "left").withColumn("iid", F.col("i.id")).join(sources, "iid", "left").join(gone, "schema_id", "left")
    mass, has = F.coalesce("mass", F.lit(0)), F.col("iid").isNotNull()
    newest = F.greatest(F.coalesce("source_used", "used"), "gone_used")
    stale = F.coalesce(newest > F.col("i.written"), F.lit(False))
    unfit = (mass < cfg.mass_low) | (F.coalesce("noise", F.lit(0.0)) >= cfg.noise_cap)
    # between the marks a schema without an insight is left alone, noise or not
    action = F.when(unfit & has, "dissolve").when(unfit | ((mass < cfg.mass_high) & ~has), "none").when(~has | stale, "write").otherwise("keep")
    return j.select("schema_id", mass.cast("bigint").alias("mass"), F.col("iid").alias("insight_id"), action.alias("action"))


def reflected(found: DataFrame, members: DataFrame, now_ms: int, compose: Callable[[Column], Column] = lambda values: F.array_join(values, "; "), lines: int = 5, ceiling: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the insights to be written: origin inferred, confidence at the ceiling, derived from schema and members.

    The text is composed of the ``lines`` members used last.
    """
    todo = found.where("action = 'write'").select("schema_id")
    m = members.join(todo, "schema_id", "left_semi")
    w = Window.partitionBy("schema_id").orderBy(F.desc_nulls_last("last_access"), "id")
    head = m.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= lines).groupBy("schema_id")
    text = head.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))
    name = F.concat(F.lit("insight-"), "schema_id", F.lit(f"-{now_ms}"))
    nodes = text.select(name.alias("id"), F.lit("insight").alias("type"), compose(F.col("values")).alias("value"), F.lit("inferred").alias("origin"), F.lit(0.1).alias("s"), F.lit(ceiling).alias("c"), F.lit(now_ms).cast("bigint").alias("last_access"))
    targets = m.select("schema_id", F.col("id").alias("dst")).unionByName(todo.select("schema_id", F.col("schema_id").alias("dst")))
    edges = targets.distinct().select(name.alias("src"), "dst", F.lit("derived_from").alias("rel"), F.lit(1.0).alias("w"), F.lit(now_ms).cast("bigint").alias("last_access"), F.lit("derived_from").alias("kind"))
    return nodes, edges


def scope_stubs(touching: DataFrame, documents: DataFrame) -> DataFrame:
    """(scope, slug, kind): empty documents that the promotion of each scope adds.

    ``touching`` has scope and schema_id.  A chapter for each schema and a
    landing page for each scope, where no live document has the slug; the
    global scope has none.  A schema of several scopes is one chapter, of the
    smallest of them.
    """
    own = touching.where("scope <> '' AND scope <> 'global'").select("scope", "schema_id").distinct()
    chapters = own.groupBy(F.col("schema_id").alias("slug")).agg(F.min("scope").alias("scope")).withColumn("kind", F.lit("chapter"))
    landing = own.select("scope").distinct().select(F.col("scope").alias("slug"), "scope", F.lit("landing").alias("kind"))
    return chapters.unionByName(landing).join(documents.select("slug").distinct(), "slug", "left_anti").select("scope", "slug", "kind")


def subject_gates(schemas: DataFrame, subjects: DataFrame, least: int = 4, drifted: int = DEFAULT.drift_threshold) -> DataFrame:
    """(scope, create, refresh): whether a scope is worth a look at its subjects.

    create: a schema of ``least`` members has no subject document; refresh: a
    subject whose schema is in the scope has ``drifted`` or more members used
    since it was written.  ``schemas`` has scope, slug (of the subject), mass,
    and used: the last accesses of its members; ``subjects`` slug and
    generated_at.
    """
    known = subjects.groupBy("slug").agg(F.max("generated_at").alias("at"))
    j = schemas.join(known, "slug", "left")
    later = F.size(F.filter("used", lambda t: t > F.col("at")))
    create = (F.col("mass") >= least) & F.col("at").isNull()
    refresh = F.col("at").isNotNull() & (later >= drifted)
    return j.groupBy("scope").agg(F.max(create).alias("create"), F.max(refresh).alias("refresh"))


#: Kinds of an argument's schema and the Python types that they take; a boolean is no number.
KINDS = {
    "string": lambda v: isinstance(v, str),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: not isinstance(v, bool) and isinstance(v, (int, float)) and float(v).is_integer(),
    "boolean": lambda v: isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
}


def valid_call(raw: str | None, tools: dict[str, dict]) -> dict | None:
    """A proposed call as {tool, args}, or None: an allowed tool, all required arguments, right kinds, nothing else.

    ``tools`` maps a name to {'properties': {argument: kind}, 'required': [...]}.
    """
    try:
        x = json.loads(raw) if raw is not None else None
    except ValueError:
        return None
    tool, args = (x.get("tool"), x.get("args")) if isinstance(x, dict) else (None, None)
    if not isinstance(tool, str) or tool not in tools or not isinstance(args, dict):
        return None
    kinds = tools[tool].get("properties", {})
    if any(args.get(r) is None for r in tools[tool].get("required", [])):
        return None
    ok = all(a in kinds and (kinds[a] not in KINDS or KINDS[kinds[a]](v)) for a, v in args.items())
    return {"tool": tool, "args": args} if ok else None


def checked_calls(rows: DataFrame, key: str, raw: str, tools: dict[str, dict]) -> DataFrame:
    """(key, tool): proposed calls with the tool that may be run, null for those refused; Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [valid_call(t, tools) for t in b.column(raw).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([x["tool"] if x else None for x in found], pa.string())], names=[key, "tool"])

    return rows.select(key, raw).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, tool string")


def gray_zone(nodes: DataFrame, bands: tuple[float, ...] = (0.3, 0.5, 0.7, 0.85, 0.97), per_band: int = 12, dim: int = 64) -> DataFrame:
    """(a, b, cos, band): the best partner of each live vector, where it is neither far nor the same; some of each band, the farthest first.

    A pair found from both ends counts once; pairs of one normalised value are
    left out.
    """
    best = belief.nominate(nodes, nodes, 1, dim).withColumn("cos", F.round("cos", 6)).where((F.col("cos") >= bands[0]) & (F.col("cos") < bands[-1]))
    value = nodes.select("id", S.normalize_value(F.col("value")).alias("v"))
    j = best.join(value.select(F.col("id").alias("claim_id"), F.col("v").alias("va")), "claim_id").join(value.select(F.col("id").alias("node_id"), F.col("v").alias("vb")), "node_id")
    pairs = j.where(~F.coalesce(F.col("va") == F.col("vb"), F.lit(False))).select(F.least("claim_id", "node_id").alias("a"), F.greatest("claim_id", "node_id").alias("b"), F.round("cos", 6).alias("cos")).distinct()
    band = F.lit(len(bands) - 2)
    for i in range(len(bands) - 3, -1, -1):
        band = F.when(F.col("cos") < bands[i + 1], i).otherwise(band)
    w = Window.partitionBy("band").orderBy("cos", "a", "b")
    return pairs.withColumn("band", band).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= per_band).drop("pos")


def revealed(members: DataFrame, overview: DataFrame, below: int = 600, target: int = 600) -> DataFrame:
    """(schema_id, id): members shown beside a sparse overview, largest schemas first, up to ``target`` nodes in all.

    ``overview`` has one row and the column shown: schemas and loose nodes.
    Sums run over schemas, of which at most ``target`` can matter.
    """
    sizes = members.groupBy("schema_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "schema_id").limit(target)
    w = Window.orderBy(F.desc("n"), "schema_id").rowsBetween(Window.unboundedPreceding, -1)
    room = sizes.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).join(F.broadcast(overview))  # one row
    open_ = room.where((F.col("shown") < below) & (F.col("before") < F.lit(target) - F.col("shown"))).select("schema_id", (F.lit(target) - F.col("shown") - F.col("before")).alias("left"))
    place = Window.partitionBy("schema_id").orderBy("id")
    kept = members.select("schema_id", "id").distinct().join(open_, "schema_id").withColumn("pos", F.row_number().over(place)).where(F.col("pos") <= F.col("left"))
    return kept.select("schema_id", "id")
