"""Derived structure: centroids, cohesion, similar pairs, merging, schema induction, promotion, document graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramql.config import DEFAULT, Settings
from engramql.functions import scalars as S
from engramql.functions.vectors import cosine, raw_matrix, unit, usable
from engramql.operators.components import components
from engramql.storage import cut, read_shared, shared_files

BLOCK = 2048


def schema_members(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(schema_id, id, value, embedding): live, observed facts and entities below live schemas.

    ``nodes`` are live and have id, type, origin, value, embedding.
    """
    member = nodes.where("type IN ('fact', 'entity') AND coalesce(origin, '') <> 'inferred'").select(F.col("id").alias("dst"), "type", "value", "embedding", "last_access")
    schema = nodes.where("type = 'schema'").select(F.col("id").alias("src"))
    below = edges.where("kind = 'abstracts'").select("src", "dst").distinct()
    return below.join(schema, "src", "left_semi").join(member, "dst").select(F.col("src").alias("schema_id"), F.col("dst").alias("id"), "type", "value", "embedding", "last_access")


def vector_sums(rows: DataFrame, key: str, dim: int, unit_length: bool) -> DataFrame:
    """(key, n, total array<double>): sums of vectors per key.

    Each Arrow batch adds its vectors per key in numpy, so what is shuffled is
    one row per key and batch; those few are added as arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = raw_matrix(b.column("embedding"), dim).astype(np.float64)
            if unit_length:
                m = m / np.linalg.norm(m, axis=1, keepdims=True)
            names, at = np.unique(np.array(b.column(key).to_pylist(), dtype=object), return_inverse=True)
            sums = np.zeros((len(names), dim))
            np.add.at(sums, at, m)
            yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(np.bincount(at)), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=[key, "n", "total"])

    parts = rows.where(usable(F.col("embedding"), dim)).select(key, "embedding").mapInArrow(run, f"{key} string, n bigint, total array<double>")
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(F.collect_list("total"), zero, lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q))
    return parts.groupBy(key).agg(F.sum("n").alias("n"), total.alias("total"))


def centroids(members: DataFrame, dim: int = 64) -> DataFrame:
    """(schema_id, n, centroid): mean vector of the usable members."""
    s = vector_sums(members, "schema_id", dim, False)
    return s.select("schema_id", "n", F.transform("total", lambda x: x / F.col("n")).alias("centroid"))


def cohesion(members: DataFrame, dim: int = 64) -> DataFrame:
    """(schema_id, n, cohesion): mean pairwise cosine from the sum of unit vectors, without a pair."""
    s = vector_sums(members, "schema_id", dim, True).where("n > 1")
    square = F.aggregate("total", F.lit(0.0), lambda acc, x: acc + x * x)
    return s.select("schema_id", "n", ((square - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("cohesion"))


def similar_pairs(rows: DataFrame, key: str, vector: str, threshold: float, dim: int = 64) -> DataFrame:
    """(a, b, cos) with a < b: all pairs at the threshold, block against block.

    Vectors are written once, in blocks of about ``BLOCK`` rows; the task of a
    block reads the blocks that come after it and holds it against them as
    matrix products.  Nothing is shuffled but the rows themselves, and only
    pairs at the threshold leave a task.  Meant for derived rows (centroids),
    which are few beside the data.
    """
    count = max(1, -(-rows.count() // BLOCK))
    packed = rows.select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v")).withColumn("block", F.pmod(F.xxhash64("k"), F.lit(count)).cast("int"))
    blocks = cut(packed.groupBy("block").agg(F.collect_list("k").alias("ks"), F.flatten(F.collect_list("v")).alias("vs")), "blocks")
    files = shared_files(blocks)

    def sides(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        m = b.column("vs").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return np.array(b.column("ks").flatten().to_pylist(), dtype=object), m / np.where(length == 0, 1, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            for i in batch.column("block").to_pylist():
                own = sides(next(read_shared(files, ["block", "ks", "vs"], pc.field("block") == i)))
                for b in read_shared(files, ["block", "ks", "vs"], pc.field("block") >= i):
                    (ka, ma), (kb, mb) = own, sides(b)
                    cos = ma @ mb.T
                    x, y = np.nonzero(np.round(cos, 9) >= threshold)
                    a, c = ka[x], kb[y]
                    keep = (a < c) if b.column("block")[0].as_py() == i else (a != c)
                    low, high = np.where(a < c, a, c)[keep], np.where(a < c, c, a)[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(low, pa.string()), pa.array(high, pa.string()), pa.array(cos[x, y][keep])], names=["a", "b", "cos"])

    return blocks.select("block").repartition(count).mapInArrow(run, "a string, b string, cos double")


def schema_relations(members: DataFrame, threshold: float = DEFAULT.schema_rel_similarity, dim: int = 64) -> DataFrame:
    """(src, dst, w): similar schemas by centroid, the smaller id first."""
    return similar_pairs(cut(centroids(members, dim), "centroids"), "schema_id", "centroid", threshold, dim).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("cos").alias("w"))


def average_linkage(cos: np.ndarray, ids: list[str], cut_height: float) -> list[list[int]]:
    """Agglomerative clusters by average linkage on 1 - cosine; ties take the smallest pair of ids."""
    groups = {i: [i] for i in range(len(ids))}
    total = {(i, j): 1 - cos[i, j] for i in groups for j in groups if i < j}
    while len(groups) > 1:
        best = min(((total[i, j] / (len(groups[i]) * len(groups[j])), min(ids[x] for x in groups[i] + groups[j]), max(min(ids[x] for x in groups[i]), min(ids[x] for x in groups[j])), i, j) for (i, j) in total), default=None)
        if best is None or best[0] > cut_height:
            break
        i, j = best[3], best[4]
        for k in list(groups):
            if k not in (i, j):
                total[min(i, k), max(i, k)] = total[min(i, k), max(i, k)] + total.pop((min(j, k), max(j, k)))
        del total[i, j]
        groups[i] += groups.pop(j)
    return [sorted(g) for g in groups.values()]


def super_schemas(centroid_rows: DataFrame, cut_height: float = DEFAULT.cluster_cut, dim: int = 64) -> DataFrame:
    """(super_id, schema_id): clusters of two or more schemas.

    Clusters never span components of the graph of pairs within the cut (an
    average over pairs that are all farther is farther), so each component is
    clustered on its own.
    """
    rows = cut(centroid_rows.select(F.col("schema_id").alias("k"), F.col("centroid").alias("v")), "centroids")
    pairs = similar_pairs(rows, "k", "v", 1 - cut_height, dim)
    labels = components(pairs).select(F.col("v").alias("k"), "label")
    parts = labels.join(rows, "k")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k").reset_index(drop=True)
        m = np.stack(pdf["v"].map(np.asarray).to_list())
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        ids = pdf["k"].to_list()
        out = []
        for g in average_linkage(m @ m.T, ids, cut_height):
            if len(g) > 1:
                names = sorted(ids[i] for i in g)
                out += [("super::" + "|".join(names), n) for n in names]
        return pd.DataFrame(out, columns=["super_id", "schema_id"])

    return parts.groupBy("label").applyInPandas(run, "super_id string, schema_id string")


def duplicate_pairs(nodes: DataFrame, threshold: float = DEFAULT.entity_merge_similarity, dim: int = 64) -> DataFrame:
    """(a, b) with a < b: nodes of one normalised value and similar vectors, never revised before.

    Copies of one vector within a value are linked to their smallest id, and
    only distinct vectors meet, so a value held by very many nodes gives a
    star and not all pairs.
    """
    rows = nodes.where("prev_value IS NULL AND value IS NOT NULL").where(usable(F.col("embedding"), dim)).select("id", S.normalize_value(F.col("value")).alias("norm"), "embedding")
    rows = rows.where("norm <> ''")
    first = Window.partitionBy("norm", "embedding")
    star = rows.withColumn("rep", F.min("id").over(first))
    reps = star.where("id = rep").select("norm", "id", "embedding")
    a, b = reps.alias("a"), reps.alias("b")
    near = a.join(b, (F.col("a.norm") == F.col("b.norm")) & (F.col("a.id") < F.col("b.id"))).where(F.round(cosine(F.col("a.embedding"), F.col("b.embedding")), 9) >= threshold)
    return star.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).unionByName(near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")))


def canonical(pairs: DataFrame, nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """(id, canonical): of each group the node of highest degree, then confidence, then oldest, then smallest id."""
    groups = components(pairs)
    rated = groups.join(nodes.select(F.col("id").alias("v"), "c", "last_access"), "v").join(degree.select(F.col("id").alias("v"), "degree"), "v", "left")
    order = F.struct(-F.coalesce("degree", F.lit(0)), -F.coalesce("c", F.lit(0.0)), F.coalesce("last_access", F.lit(0)), F.col("v"))
    best = rated.groupBy("label").agg(F.min_by("v", order).alias("canonical"))
    return rated.join(best, "label").select(F.col("v").alias("id"), "canonical")


def rewired_edges(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges with merged nodes replaced; self loops go, parallel edges keep the largest weight and access."""
    gone = merged.where("id <> canonical")
    moved = edges.join(gone.select(F.col("id").alias("src"), F.col("canonical").alias("s2")), "src", "left").join(gone.select(F.col("id").alias("dst"), F.col("canonical").alias("d2")), "dst", "left")
    ends = moved.select(F.coalesce("s2", "src").alias("src"), F.coalesce("d2", "dst").alias("dst"), "rel", "kind", "w", "last_access").where("src <> dst")
    return ends.groupBy("src", "dst", "rel").agg(F.min("kind").alias("kind"), F.max("w").alias("w"), F.max("last_access").alias("last_access"))


def linked_groups(rows: DataFrame, threshold: float, dim: int = 64) -> DataFrame:
    """(v, label): components of the graph of pairs at ``threshold``, block against block; single rows are not there.

    Blocks are written once and read by the tasks that meet them.  A pair of
    blocks emits a line per row at most: its smallest linked row within the two
    blocks, by labels that run along links until they rest.
    """
    count = max(1, -(-rows.count() // (4 * BLOCK)))
    packed = rows.select("id", F.col("embedding").cast("array<float>").alias("embedding"), F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("block"))
    blocks = cut(packed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "embedding"))).alias("rows")), "blocks")
    files = shared_files(blocks)

    def links(ka: np.ndarray, kb: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, at = np.unique(np.concatenate([ka, kb]), return_inverse=True)  # the same row on both sides is one vertex
        r, c = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        near, p, q = near[np.ix_(r, c)], at[r], at[len(ka) + c]
        label, most = np.arange(len(names), dtype=np.int32), np.int32(len(names))
        while len(r):
            before = label.copy()
            np.minimum.at(label, p, np.where(near, label[q][None, :], most).min(1))
            np.minimum.at(label, q, np.where(near, label[p][:, None], most).min(0))
            label = label[label]
            if (label == before).all():
                break
        moved = np.flatnonzero(label != np.arange(len(names)))
        return names[label[moved]], names[moved]

    def side(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = b.column("rows").flatten()
        return np.array(x.field("id").to_pylist(), dtype=object), unit(raw_matrix(x.field("embedding"), dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            for i in batch.column("block").to_pylist():
                ka, ma = side(next(read_shared(files, ["rows"], pc.field("block") == i)))
                for b in read_shared(files, ["block", "rows"], pc.field("block") >= i):
                    kb, mb = side(b)
                    same = b.column("block")[0].as_py() == i
                    for s in range(0, len(ka), BLOCK):
                        for t in range(s if same else 0, len(kb), BLOCK):
                            a, c = links(ka[s : s + BLOCK], kb[t : t + BLOCK], ma[s : s + BLOCK] @ mb[t : t + BLOCK].T >= threshold)
                            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(c, pa.string())], names=["a", "b"])

    return components(blocks.select("block").repartition(count).mapInArrow(run, "a string, b string"))


def joined_schemas(loose: DataFrame, known: DataFrame, least: float, dim: int = 64) -> DataFrame:
    """(id, schema_id): loose nodes whose vector is at ``least`` or more to a known centroid, with the best of them.

    ``known`` has schema_id and centroid.  Centroids are written once, in
    blocks that each task reads one by one; the smallest id wins a tie.
    """
    count = max(1, -(-known.count() // BLOCK))
    packed = known.withColumn("block", F.pmod(F.xxhash64("schema_id"), F.lit(count)).cast("int")).groupBy("block")
    files = shared_files(cut(packed.agg(F.collect_list("schema_id").alias("ks"), F.flatten(F.collect_list("centroid")).alias("vs")), "centroids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = raw_matrix(b.column("embedding"), dim).astype(np.float64)
            u = u / np.linalg.norm(u, axis=1, keepdims=True)
            best, name = np.full(len(u), -2.0), np.full(len(u), None, dtype=object)
            for block in read_shared(files, ["ks", "vs"]):
                ks = np.array(block.column("ks").flatten().to_pylist(), dtype=object)
                m = block.column("vs").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                order = np.argsort(ks)
                ks, m = ks[order], m[order]
                length = np.linalg.norm(m, axis=1)
                cos = np.round((u @ m.T) / np.where(length == 0, 1, length), 9)
                at = cos.argmax(1)
                top, who = cos[np.arange(len(u)), at], ks[at]
                better = (top > best) | ((top == best) & np.array([x is None or w < x for w, x in zip(who, name)], dtype=bool))
                best, name = np.where(better, top, best), np.where(better, who, name)
            hit = np.flatnonzero(best >= least)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(hit)), pa.array(name[hit], pa.string())], names=["id", "schema_id"])

    return loose.where(usable(F.col("embedding"), dim)).select("id", "embedding").mapInArrow(run, "id string, schema_id string")


def induce_schemas(loose: DataFrame, known: DataFrame | None = None, cfg: Settings = DEFAULT, dim: int = 64) -> DataFrame:
    """(bucket, id): new schemas among nodes by greedy buckets in the order of ids.

    Nodes near a known centroid (schema_id, centroid) join it (bucket
    'known-<schema_id>').  The others join, in order of id, the first bucket
    whose running centroid is at the threshold t, as one pass over all of them
    would.  A bucket of n members has a sum of length n t at least, so who
    joins it is at t * t or more to one of its members: rows in different
    components of the graph at t * t never share a bucket, and components are
    read side by side.  A task keeps centroids only; buckets need enough
    members and cohesion, which is decided per bucket afterwards.
    """
    rows = loose.where(usable(F.col("embedding"), dim)).select("id", "embedding")
    bucket_at = cfg.schema_cohesion

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, sums, length = None, 0, np.zeros((1024, dim), dtype=np.float32), np.ones(1024, dtype=np.float32)
        for b in batches:
            u = unit(raw_matrix(b.column("embedding"), dim))
            names = []
            for block, v in zip(b.column("block").to_pylist(), u):
                if block != at:
                    at, n = block, 0
                near = sums[:n] @ v >= bucket_at * length[:n]
                choice = int(near.argmax()) if near.any() else n
                if choice == n:
                    if n == len(sums):
                        sums, length = np.concatenate([sums, np.zeros_like(sums)]), np.concatenate([length, np.ones_like(length)])
                    sums[n] = 0
                    n += 1
                sums[choice] += v
                length[choice] = np.linalg.norm(sums[choice])
                names.append(f"{block}-{choice}")  # block is the smallest id of the component
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), b.column("id"), b.column("embedding")], names=["schema_id", "id", "embedding"])

    joined = cut(joined_schemas(rows, known, cfg.schema_join, dim), "joined") if known is not None else None
    free = rows if joined is None else rows.join(joined.select("id"), "id", "left_anti")
    free = cut(free, "free")
    groups = linked_groups(free, bucket_at * bucket_at - 1e-4, dim)
    blocks = free.join(groups, free.id == groups.v).select(F.col("label").alias("block"), "id", "embedding").repartition("block").sortWithinPartitions("block", "id")
    found = cut(blocks.mapInArrow(greedy, "schema_id string, id string, embedding array<float>"), "buckets")
    good = cohesion(found, dim).where((F.col("n") >= cfg.schema_support) & (F.col("cohesion") >= cfg.schema_cohesion)).select("schema_id")
    kept = found.join(good, "schema_id", "left_semi").select("schema_id", "id")
    if joined is not None:
        kept = kept.unionByName(joined.select(F.concat(F.lit("known-"), "schema_id").alias("schema_id"), "id"))
    return kept.select(F.col("schema_id").alias("bucket"), "id").distinct()


def falsified(edges: DataFrame, nodes: DataFrame, support: int = DEFAULT.schema_support) -> DataFrame:
    """(id): live schemas with fewer than ``support`` surviving observed members."""
    alive = nodes.where("type = 'schema'").select("id")
    n = schema_members(edges, nodes).groupBy(F.col("schema_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return alive.join(n, "id", "left").where(F.coalesce("n", F.lit(0)) < support).select("id")


def mass_and_noise(members: DataFrame) -> DataFrame:
    """(schema_id, mass, noise): members and the share of them that is noise."""
    return members.groupBy("schema_id").agg(F.count(F.lit(1)).alias("mass"), F.avg(S.is_noise(F.coalesce("value", F.lit(""))).cast("double")).alias("noise"))


def promotion(masses: DataFrame, documented: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """(schema_id, mass, noise, action): two marks, so that a schema near them does not come and go."""
    has = documented.select("schema_id").distinct().withColumn("has_doc", F.lit(True))
    j = masses.join(has, "schema_id", "left").withColumn("has_doc", F.coalesce("has_doc", F.lit(False)))
    clean = F.col("noise") < cfg.noise_cap
    up = clean & ((F.col("mass") >= cfg.mass_high) | ((F.col("mass") >= cfg.mass_low) & F.col("has_doc")))
    action = F.when(up, "promote").when(F.col("has_doc") & (~clean | (F.col("mass") < cfg.mass_low)), "withdraw").otherwise("none")
    return j.select("schema_id", "mass", "noise", "has_doc", action.alias("action"))


def drift(members: DataFrame, generated: DataFrame) -> DataFrame:
    """(schema_id, touched): members used since the document was written."""
    return members.join(generated, "schema_id").groupBy("schema_id").agg(F.sum((F.col("last_access") > F.col("generated_at")).cast("bigint")).alias("touched"))


def insight_states(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, sources, stale): an insight is stale if a source is missing, deleted or used after it was written.

    ``nodes`` has id, type, tombstoned, last_access.
    """
    insight = nodes.where("type = 'insight' AND NOT coalesce(tombstoned, false)").select("id", F.col("last_access").alias("written"))
    src = edges.where("kind = 'derived_from'").select(F.col("src").alias("id"), "dst")
    seen = nodes.select(F.col("id").alias("dst"), "tombstoned", "last_access", F.lit(True).alias("there"))
    j = insight.join(src, "id", "left").join(seen, "dst", "left")
    bad = F.col("dst").isNotNull() & (F.col("there").isNull() | F.coalesce("tombstoned", F.lit(False)) | (F.col("last_access") > F.col("written")))
    return j.groupBy("id").agg(F.count("dst").alias("sources"), F.max(bad.cast("int")).alias("b")).select("id", "sources", ((F.col("sources") == 0) | (F.col("b") == 1)).alias("stale"))


def adjacent_subjects(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: subjects whose schemas are related or lie below one parent."""
    own = members.select(F.col("schema_id").alias("s")).distinct()
    related = edges.where("kind = 'schema_rel'").select(F.col("src").alias("x"), F.col("dst").alias("y"))
    up = edges.where("kind = 'abstracts' AND src <> dst").select(F.col("src").alias("parent"), F.col("dst").alias("s")).join(own, "s", "left_semi").distinct()
    below = up.alias("p").join(up.alias("q"), (F.col("p.parent") == F.col("q.parent")) & (F.col("p.s") < F.col("q.s"))).select(F.col("p.s").alias("x"), F.col("q.s").alias("y"))
    pairs = related.unionByName(below).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.join(own.withColumnRenamed("s", "a"), "a", "left_semi").join(own.withColumnRenamed("s", "b"), "b", "left_semi")


def subject_pairs(members: DataFrame, adjacent: DataFrame | None = None, most: int = 7, name_weight: float = 0.5, bonus: float = 0.3) -> DataFrame:
    """(a, b, score): related subjects by shared members and shared entity names, rarer ones count more.

    Pairs come from equi-joins on member and name.  Members of one subject
    alone, members of all and names in half of the subjects or more (weight 0)
    are dropped before the join.  Adjacent subjects score ``bonus`` more, with
    or without anything shared.  A pair stays if it is among the best of either
    end.
    """
    subjects = members.select(F.col("schema_id").alias("s")).distinct().agg(F.count(F.lit(1)).cast("double").alias("total"))

    def weighted(rows: DataFrame, zero_half: bool) -> DataFrame:
        df = rows.groupBy("k").agg(F.count(F.lit(1)).alias("df")).where("df > 1").join(F.broadcast(subjects))  # one row
        idf = F.log(F.col("total") / F.col("df"))
        kept = df.where(F.col("df") < F.col("total") / 2) if zero_half else df
        return rows.join(kept.select("k", idf.alias("idf")).where("idf > 0"), "k")

    shared = weighted(members.select(F.col("schema_id").alias("s"), F.col("id").alias("k")).distinct(), False)
    names = members.where("type = 'entity' AND value IS NOT NULL").select(F.col("schema_id").alias("s"), S.normalize_value(F.col("value")).alias("k")).where("k <> ''").distinct()
    named = weighted(names, True).withColumn("idf", F.col("idf") * name_weight)

    def pairs(rows: DataFrame) -> DataFrame:
        x, y = rows.alias("x"), rows.alias("y")
        j = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.s") < F.col("y.s")))
        return j.select(F.col("x.s").alias("a"), F.col("y.s").alias("b"), F.col("x.idf").alias("part"))

    parts = pairs(shared).unionByName(pairs(named))
    if adjacent is not None:
        parts = parts.unionByName(adjacent.select("a", "b", F.lit(bonus).alias("part")))
    scored = parts.groupBy("a", "b").agg(F.sum("part").alias("score")).where(F.round("score", 9) > 0)
    ends = scored.select("a", "b", "score", F.explode(F.array("a", "b")).alias("end"), F.lit(1).alias("one"))
    w = Window.partitionBy("end").orderBy(F.round("score", 9).desc(), "a", "b")
    return ends.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select("a", "b", "score").distinct()


def linked_facts(edges: DataFrame, live: DataFrame, slug: str) -> DataFrame:
    """(id): live facts one edge of any kind and direction away from live entities with the slug in their name."""
    named = live.where((F.col("type") == "entity") & F.contains(F.lower("value"), F.lit(slug.lower()))).select("id")
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    near = both.join(named, "id", "left_semi").select(F.col("other").alias("id")).distinct()
    return near.join(live.where("type = 'fact'").select("id"), "id", "left_semi")


def gather(spine: DataFrame, semantic: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, via): facts gathered in three ways, each with the ways that found it in a fixed order."""
    parts = [df.select("id", F.lit(i).alias("o"), F.lit(n).alias("name")) for i, (df, n) in enumerate(((spine, "scope"), (semantic, "semantic"), (linked, "linked")))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    return every.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("o", "name"))), lambda x: x["name"]), "+").alias("via"))


def junk_documents(docs: DataFrame, schemas: DataFrame, masses: DataFrame, cap: float = DEFAULT.noise_cap) -> DataFrame:
    """(id, reason): chapters of schemas, then empty stubs, then documents of noisy schemas; the first reason counts.

    ``docs`` has id, slug, value.
    """
    j = docs.join(schemas.select(F.col("id").alias("slug"), F.lit(True).alias("chapter")), "slug", "left").join(masses.select(F.col("schema_id").alias("slug"), "noise"), "slug", "left")
    reason = F.when(F.coalesce("chapter", F.lit(False)), "chapter-uuid").when(F.length(F.coalesce("value", F.lit(""))) == 0, "empty-stub").when(F.col("noise") >= cap, "noise-schema")
    return j.select("id", reason.alias("reason")).where("reason IS NOT NULL")


def document_queue(stubs: DataFrame, most: int) -> DataFrame:
    """(slug, class, pos, taken): hubs, then subjects, then chapters, by slug; the first ``most`` are taken.

    Places come from counts per class and a window within class and first
    characters, so no task orders all slugs.
    """
    kind = S.slug_class(F.col("slug"))
    order = F.when(kind == "hub", 0).when(kind == "subject", 1).otherwise(2)
    rows = stubs.select("slug", kind.alias("class"), order.alias("o"), F.substring("slug", 1, 2).alias("head"))
    sizes = rows.groupBy("o", "head").agg(F.count(F.lit(1)).alias("n"))
    start = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("o", "head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.withColumn("i", F.row_number().over(Window.partitionBy("o", "head").orderBy("slug"))).join(start.select("o", "head", "start"), ["o", "head"])
    pos = F.col("i") + F.col("start")
    return placed.select("slug", "class", pos.alias("pos"), (pos <= most).alias("taken"))
