"""Graph operators over node and edge tables: traversal, neighbours, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramql.storage import cut

# The closed vocabulary of typed relations; the question beside each is this engine's own.
PREDICATES = {
    "built_by": "which person or team made and built it",
    "works_on": "on which project is somebody working",
    "part_of": "of what larger whole is it a part",
    "uses": "what does it use as a tool or library",
    "depends_on": "on what does it depend or rely",
    "runs_on": "on what machine or host runs it",
    "located_in": "in which place or folder is it located",
    "integrates_with": "with which other system is it integrated or connected",
    "supersedes": "what older thing does it supersede or replace",
    "prefers": "what does somebody prefer or like better",
    "evaluated": "which option was evaluated or compared for it",
    "configured_with": "with which option or value is it configured",
}
DOC_KINDS = ("doc_link", "doc_containment", "doc_reference")


def typed_reach(edges: DataFrame, anchors: DataFrame, path: list[str], k: int | None = None) -> DataFrame:
    """(anchor, id, score): ends of a predicate path with the best sum of weights.

    The path is known, so the hops are one plan: each is an equi-join followed
    by a partial maximum, which keeps one row per (anchor, node).
    """
    at = anchors.select(F.col("id").alias("anchor"), "id").withColumn("score", F.lit(0.0))
    for predicate in path:
        if predicate not in PREDICATES:
            return at.where("false")
        step = edges.where((F.col("rel") == predicate) & (F.col("kind") == "relation")).select("src", "dst", "w")
        at = at.join(step, at.id == step.src).groupBy("anchor", F.col("dst").alias("id")).agg(F.max(F.col("score") + F.col("w")).alias("score"))
    if k is None:
        return at
    w = Window.partitionBy("anchor").orderBy(F.round("score", 9).desc(), "id")
    return at.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).drop("pos")


def first_per(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each key in an order; Spark keeps as many a map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).drop("pos")


def best_paths(edges: DataFrame, anchors: DataFrame, depth: int) -> DataFrame:
    """(anchor, id, score, hops): best weight sum to each node within ``depth`` hops, any relation.

    Each level keeps the best row per (anchor, node); levels are unioned once.
    """
    step = edges.where("kind = 'relation'").groupBy("src", "dst").agg(F.max("w").alias("w"))
    at = anchors.select(F.col("id").alias("anchor"), "id").withColumn("score", F.lit(0.0))
    out = None
    for hop in range(1, depth + 1):
        at = at.join(step, at.id == step.src).groupBy("anchor", F.col("dst").alias("id")).agg(F.max(F.col("score") + F.col("w")).alias("score"))
        level = at.withColumn("hops", F.lit(hop))
        out = level if out is None else out.unionByName(level)
    w = Window.partitionBy("anchor", "id").orderBy(F.round("score", 9).desc(), "hops")
    return out.where("id <> anchor").withColumn("pos", F.row_number().over(w)).where("pos = 1").drop("pos")


def rank_of(found: DataFrame, gold: DataFrame) -> DataFrame:
    """(anchor, gold, rank): place of the wanted node among those found, null if absent."""
    w = Window.partitionBy("anchor").orderBy(F.round("score", 9).desc(), "id")
    return gold.join(found.withColumn("rank", F.row_number().over(w)).select("anchor", F.col("id").alias("gold"), "rank"), ["anchor", "gold"], "left")


def undirected(edges: DataFrame) -> DataFrame:
    """(id, other, kind, w): each edge from both ends; an OR in a join becomes two equi-joins."""
    one = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "kind", "w")
    two = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "kind", "w")
    return one.unionByName(two)


def neighbour_docs(edges: DataFrame, docs: DataFrame, most: int = 15) -> DataFrame:
    """(id, other): live documents next to each document over document edges, at most ``most``."""
    near = undirected(edges.where(F.col("kind").isin(*DOC_KINDS))).where("id <> other").select("id", "other").distinct()
    both = near.join(docs.select("id"), "id", "left_semi").join(docs.select(F.col("id").alias("other")), "other", "left_semi")
    w = Window.partitionBy("id").orderBy("other")
    return both.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select("id", "other")


def backlinks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, src, kind): live documents that link to or cite a live node, smallest kind of each pair."""
    link = edges.where(F.col("kind").isin(*DOC_KINDS, "cites"))
    docs = nodes.where("type = 'doc'").select(F.col("id").alias("src"))
    alive = nodes.select(F.col("id").alias("dst"))
    kept = link.join(docs, "src", "left_semi").join(alive, "dst", "left_semi")
    return kept.groupBy(F.col("dst").alias("id"), "src").agg(F.min("kind").alias("kind"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): both directions; a self loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def fan_out(edges: DataFrame, kind: str, most: int) -> DataFrame:
    """(id, other, w): the heaviest neighbours over one kind of edge, both directions."""
    near = undirected(edges.where(F.col("kind") == kind)).where("id <> other").groupBy("id", "other").agg(F.max("w").alias("w"))
    w = Window.partitionBy("id").orderBy(F.col("w").desc(), "other")
    return near.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select("id", "other", "w")


def ancestors(edges: DataFrame, kind: str = "abstracts", depth: int = 8) -> DataFrame:
    """(id, ancestor, hops): parents over ``kind`` (src is the parent) and theirs, shortest way.

    Rounds stop when nothing new is reached; the frontier only holds new pairs,
    so cycles end.
    """
    step = edges.where((F.col("kind") == kind) & (F.col("src") != F.col("dst"))).select(F.col("dst").alias("child"), F.col("src").alias("parent")).distinct()
    step = cut(step, "parents")
    seen = cut(step.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("hops")), "ancestors")
    new = seen
    for hop in range(2, depth + 1):
        reached = new.join(step, new.ancestor == step.child).select("id", F.col("parent").alias("ancestor")).distinct()
        fresh = reached.where("id <> ancestor").join(seen.select("id", "ancestor"), ["id", "ancestor"], "left_anti").withColumn("hops", F.lit(hop))
        new = cut(fresh, "frontier")
        if not new.limit(1).count():
            return seen
        seen = seen.unionByName(new)
    return seen


def doc_tree(edges: DataFrame, docs: DataFrame, depth: int = 8) -> DataFrame:
    """(id, root, depth): place of each document below its containment roots; the smallest root wins."""
    up = ancestors(edges.where("kind = 'doc_containment'").join(docs.select(F.col("id").alias("src")), "src", "left_semi").join(docs.select(F.col("id").alias("dst")), "dst", "left_semi"), "doc_containment", depth)
    inner = up.select("id").distinct()
    roots = docs.select("id").join(inner, "id", "left_anti").select(F.col("id").alias("ancestor"))
    placed = up.join(roots, "ancestor", "left_semi").groupBy("id").agg(F.min(F.struct("hops", "ancestor")).alias("b"))
    below = placed.select("id", F.col("b.ancestor").alias("root"), F.col("b.hops").alias("depth"))
    return below.unionByName(roots.select(F.col("ancestor").alias("id"), F.col("ancestor").alias("root"), F.lit(0).alias("depth")))


def pieces(v: Column, n: int) -> Column:
    """The distinct pieces of ``n`` characters of a text."""
    starts = F.when(F.length(v) >= n, F.sequence(F.lit(1), F.length(v) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(v, i, F.lit(n))))


def resolve_names(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, id, tier): exact entity, else exact node, else the shortest entity whose value contains the name.

    The third tier takes entities of at most three times the name's length, so
    that a name does not bind to a sentence.  Names of three characters and
    more meet the three-character pieces of those values; shorter ones, whose
    values have at most six characters, meet all their pieces of that length.
    Only pieces that some name begins with are joined, so nothing is lost.
    """
    low = nodes.select("id", "type", F.lower("value").alias("v")).where("v IS NOT NULL")
    q = names.select("name", F.lower("name").alias("q")).where("q <> ''").distinct()
    exact = q.join(low, q.q == low.v).select("name", "id", F.when(F.col("type") == "entity", 1).otherwise(2).alias("tier"), F.length("v").alias("len"))
    entities = low.where("type = 'entity' AND v <> ''")
    grams = entities.select("id", "v", F.explode(pieces(F.col("v"), 3)).alias("gram"))
    for n in (1, 2):
        grams = grams.unionByName(entities.where(F.length("v") <= 3 * n).select("id", "v", F.explode(pieces(F.col("v"), n)).alias("gram")))
    part = q.withColumn("gram", F.substring("q", 1, 3)).join(grams, "gram")
    part = part.where(F.contains("v", "q") & (F.length("v") <= 3 * F.length("q"))).select("name", "id", F.lit(3).alias("tier"), F.length("v").alias("len"))
    best = exact.unionByName(part).groupBy("name").agg(F.min(F.struct("tier", "len", "id")).alias("b"))
    return best.select("name", F.col("b.id").alias("id"), F.col("b.tier").alias("tier"))


def link_anchors(links: DataFrame, nodes: DataFrame, normal: Column, most: int = 5) -> DataFrame:
    """(link, id): up to ``most`` nodes whose normalised value contains a normalised link of three characters or more."""
    values = nodes.select("id", normal.alias("v")).where(F.length("v") >= 3)
    grams = values.select("id", "v", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("v") - 2), lambda i: F.substring(F.col("v"), i, F.lit(3))))).alias("gram"))
    q = links.where(F.length("link") >= 3).select("link", F.substring("link", 1, 3).alias("gram")).distinct()
    found = q.join(grams, "gram").where(F.contains("v", "link")).select("link", "id")
    w = Window.partitionBy("link").orderBy("id")
    return found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select("link", "id")


def unique_prefix(prefixes: DataFrame, nodes: DataFrame, least: int = 4) -> DataFrame:
    """(prefix, id): ids that a prefix of ``least`` characters or more names without doubt."""
    q = prefixes.where(F.length("prefix") >= least).select("prefix", F.substring("prefix", 1, least).alias("k")).distinct()
    n = nodes.select("id", F.substring("id", 1, least).alias("k"))
    hit = q.join(n, "k").where(F.col("id").startswith(F.col("prefix"))).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    return hit.where("n = 1").select("prefix", "id")
