"""Similarity clusters of vectors by density peaks.

Exact copies are one weighted row.  Rows lie in cells by their nearest pivot (a
bounded hash sample), cells in packs, and every pack of a type meets every other
once, read from the written table and not shuffled.  A cell is held against all
rows that its mean and widest angle do not rule out, so no pair at
``threshold`` is missed, whatever the pivots.  A first
pass counts each row's local density (weighted neighbours at ``threshold`` or
more), a second one, over rows with neighbours only, finds the nearest denser
row.  Peaks are chosen by their distance to the nearest denser row: beyond the
angle of ``threshold``.  Every other row points to its nearest denser row, and
the labels follow the pointers up to the peak (components of the pointer trees,
each of which has one peak).  A pair of packs emits at most a
line per row and cell, never its pairs.

Densities tie on purpose to the smaller id, so the result does not depend on
the order of rows.  The first pass grows with the square of the rows of a type
that lie far from every pivot.

Defined results: unusable vectors are left out; a row without neighbours is a
cluster of its own; null types form one type ''.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramql.functions.vectors import first_of_row, matrix, raw_matrix, unit
from engramql.llm.neighbours import SLACK, exact, live_vectors
from engramql.operators.components import components
from engramql.storage import cut, discard, read_shared, shared_files

#: At most so many pivots, a sample by hash; at 64 dimensions 1 MB.
MAX_PIVOTS = 4096
#: Rows of a pack (64 dimensions: 2 MB) and of a piece of a cell at most.
PACK, LEAF = 8192, 1024
#: Cosine to its pivot below which a row does not widen the pivot's cell.
CORE = 0.7


def leaf_labels(cos: np.ndarray, weight: np.ndarray, order: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Density peaks by their definition, over one matrix of cosines: (density, peak of each row).

    ``order`` decides equal densities: the smaller is taken as denser.
    """
    near = cos >= threshold
    np.fill_diagonal(near, False)
    density = near @ weight + weight
    rank = np.empty(len(cos), dtype=np.int64)
    by_density = np.lexsort((order, -density))
    rank[by_density] = np.arange(len(cos))
    denser = near & (rank[None, :] < rank[:, None])
    has = denser.any(1)
    parent = np.where(has, np.where(denser, cos, -2.0).argmax(1), np.arange(len(cos)))
    while True:
        up = parent[parent]
        if (up == parent).all():
            return density, parent
        parent = up


def keyed_vectors(vectors: DataFrame) -> DataFrame:
    """(id, type, embedding, h1, h2): two hashes of a vector stand for it where copies meet."""
    typed = vectors.select("id", F.coalesce("type", F.lit("")).alias("type"), "embedding")
    return typed.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit("second"), F.reverse("embedding")))


def weighted_rows(keyed: DataFrame) -> DataFrame:
    """Exact copies of one type as one row: (id: smallest, type, embedding, weight, h1, h2)."""
    g = keyed.groupBy("type", "h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"))
    return g.select("id", "type", "embedding", "weight", "h1", "h2")


PLACED = "cell int, id string, type string, vector binary, weight bigint"


def place_rows(rows: DataFrame, dim: int) -> DataFrame:
    """Each row with its cell: its nearest pivot, apart by whether it is within ``CORE`` of it.

    Cells decide only what lies beside what; no result depends on them.
    """
    wanted = int(min(MAX_PIVOTS, max(1, rows.count() // 128)))
    sample = rows.select("embedding", F.xxhash64("id", F.lit("pivot")).alias("h")).orderBy("h").limit(wanted).select("embedding").toArrow()
    pivots = matrix(sample.column("embedding"), dim) if sample.num_rows else np.zeros((1, dim), dtype=np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = raw_matrix(b.column("embedding"), dim)
            cos = unit(raw) @ pivots.T
            cell = cos.argmax(1) + np.where(cos.max(1) >= CORE, 0, len(pivots))
            vector = pa.array([x.tobytes() for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column("id"), b.column("type"), vector, b.column("weight")], names=["cell", "id", "type", "vector", "weight"])

    return rows.select("id", "type", "embedding", "weight").mapInArrow(run, PLACED)


def pack_rows(placed: DataFrame) -> DataFrame:
    """Rows of a type by cell in packs of at most ``PACK``: (type, pack, ids, vectors, cells, masses); pack is its first id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = np.array(b.column("type").to_pylist(), dtype=object)
            ends = [*(np.flatnonzero(types[1:] != types[:-1]) + 1), len(types)]
            for first, end in zip([0, *ends[:-1]], ends):
                for s in range(first, end, PACK):
                    t = b.slice(s, min(PACK, end - s))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([types[s]], pa.string()), t.column("id").slice(0, 1), pa.array([t.column("id").to_pylist()], pa.list_(pa.string())), pa.array([b"".join(t.column("vector").to_pylist())], pa.binary()),
                         pa.array([t.column("cell").to_pylist()], pa.list_(pa.int32())), pa.array([t.column("mass").to_pylist()], pa.list_(pa.int64()))],
                        names=["type", "pack", "ids", "vectors", "cells", "masses"],
                    )

    ordered = placed.repartitionByRange("type", "cell", "id").sortWithinPartitions("type", "cell", "id")
    return ordered.select("type", "id", "vector", "cell", "mass").mapInArrow(run, "type string, pack string, ids array<string>, vectors binary, cells array<int>, masses array<bigint>")


def near_rows(a: np.ndarray, b: np.ndarray, cells: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of ``a``, rows of ``b``, cosines) at the threshold, all of them, cell after cell of ``a``.

    A cell meets the rows of ``b`` that its mean and widest angle do not rule
    out.  Cosines next to the threshold are decided in double precision.
    """
    ua, ub = unit(a), unit(b)
    widest = np.arccos(threshold)
    starts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1)]
    for first, end in zip(starts, [*starts[1:], len(cells)]):
        for s in range(first, end, LEAF):
            x = ua[s : min(s + LEAF, end)]
            mean = x.astype(np.float64).mean(0)
            length = np.linalg.norm(mean)
            mean = mean / length if length > 1e-9 else np.eye(a.shape[1])[0]
            reach = np.arccos(np.clip((x @ mean).min(), -1, 1))
            at = np.flatnonzero(np.arccos(np.clip(ub @ mean.astype(np.float32), -1, 1)) <= widest + reach + 2e-3)
            cos = x @ ub[at].T
            r, c = np.nonzero(cos >= threshold - SLACK)
            near, r, c = cos[r, c].astype(np.float64), r + s, at[c]
            close = np.flatnonzero(near < threshold + SLACK)
            near[close] = exact(a[r[close]], b[c[close]])
            keep = near >= threshold
            yield r[keep], c[keep], near[keep]


def meet(packs: DataFrame, dim: int, threshold: float, found: Callable, schema: str) -> DataFrame:
    """Every pack of a type against every other and itself, once; ``found`` makes rows of a side's ids from pairs.

    A task holds one pack and reads the others one by one from the written
    table, so no vector is shuffled and a task has two packs in memory.  Of two
    packs, a hash of their names decides which meets the other, so tasks are of
    like size.
    """
    files = shared_files(packs)
    columns = ["pack", "ids", "vectors", "cells", "masses"]

    def parts(b: pa.RecordBatch) -> tuple:
        ids = np.array(b.column("ids")[0].as_py(), dtype=object)
        return ids, np.frombuffer(b.column("vectors")[0].as_py(), dtype=np.float32).reshape(-1, dim), np.array(b.column("masses")[0].as_py(), dtype=np.int64)

    def turn(a: str, b: str) -> bool:
        """Whether pack ``a`` is the one that meets ``b``."""
        x, y = sorted((a, b))
        return (zlib.crc32(f"{x}|{y}".encode()) & 1 == 0) == (a == x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for t in batches:
            for kind, pack in zip(t.column("type").to_pylist(), t.column("pack").to_pylist()):
                own = next(read_shared(files, columns, (pc.field("type") == kind) & (pc.field("pack") == pack)))
                a, cells = parts(own), np.array(own.column("cells")[0].as_py())
                others = [p for b in read_shared(files, ["pack"], pc.field("type") == kind) for p in b.column("pack").to_pylist()]
                mine = [p for p in others if p == pack or turn(pack, p)]
                for other in read_shared(files, columns, (pc.field("type") == kind) & pc.field("pack").isin(mine)):
                    b = parts(other)
                    sides = zip(a, b)
                    ids, vectors, masses = (list(x) for x in sides)
                    yield from found(ids, vectors, masses, near_rows(*vectors, cells, threshold), other.column("pack")[0].as_py() == pack)

    names = packs.select("type", "pack")
    return names.repartition(max(1, names.count())).mapInArrow(run, schema)


def neighbour_counts(packs: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(id, n): weights of the other rows at the threshold; rows without one are not there."""

    def found(ids, vectors, masses, pairs, same) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(x)) for x in ids]
        for r, c, _ in pairs:
            if same:
                r, c = r[r != c], c[r != c]
            n[0] += np.bincount(r, masses[1][c], len(n[0]))
            n[1] += np.bincount(c, masses[0][r], len(n[1]))
        for x, k in zip(ids[: 1 if same else 2], n):
            at = np.flatnonzero(k)
            yield pa.RecordBatch.from_arrays([pa.array(x[at], pa.string()), pa.array(k[at].astype(np.int64))], names=["id", "n"])

    return meet(packs, dim, threshold, found, "id string, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def denser_neighbours(packs: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(id, parent): the nearest denser row at the threshold; peaks are not there.  The mass of a row is its density."""

    def found(ids, vectors, masses, pairs, same) -> Iterator[pa.RecordBatch]:
        names = np.concatenate(ids)
        place = np.empty(len(names), dtype=np.int64)
        place[np.argsort(names, kind="stable")] = np.arange(len(names))
        order = np.split(place, [len(ids[0])])
        for r, c, cos in pairs:
            for x, y, p, q in ((0, 1, r, c), (1, 0, c, r))[: 1 if same else 2]:
                up = (masses[y][q] > masses[x][p]) | ((masses[y][q] == masses[x][p]) & (ids[y][q] < ids[x][p]))
                p, q, near = p[up], q[up], cos[up]
                most = np.full(len(ids[x]), -2.0)
                np.maximum.at(most, p, near)
                top = near >= most[p] - SLACK
                p, q = p[top], q[top]
                near = np.round(exact(vectors[x][p], vectors[y][q]), 9)
                at = first_of_row(p, near, order[y][q], 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[x][p[at]], pa.string()), pa.array(ids[y][q[at]], pa.string()), pa.array(near[at])], names=["id", "parent", "cos"])

    best = F.min_by("parent", F.struct(-F.col("cos"), F.col("parent")))
    return meet(packs, dim, threshold, found, "id string, parent string, cos double").groupBy("id").agg(best.alias("parent"))


def density_clusters(vectors: DataFrame, threshold: float = 0.75, dim: int = 64) -> DataFrame:
    """(label, id, type, density): each row with its cluster; label is the smallest id.

    density counts the rows of the type at the threshold, the row and copies included.
    """
    keyed = cut(keyed_vectors(vectors), "keyed")
    rows = cut(weighted_rows(keyed), "rows")
    placed = cut(place_rows(rows, dim), "placed")
    packs = cut(pack_rows(placed.withColumn("mass", F.col("weight"))), "packs")
    counts = cut(neighbour_counts(packs, dim, threshold), "counts")
    discard(packs)
    own = rows.select("id", "weight").join(counts, "id", "left").select("id", (F.col("weight") + F.coalesce("n", F.lit(0))).alias("density"))
    grouped = placed.join(counts, "id").withColumn("mass", F.col("weight") + F.col("n"))  # single rows are done
    packs = cut(pack_rows(grouped), "packs")
    discard(placed)
    links = cut(denser_neighbours(packs, dim, threshold).select(F.col("id").alias("a"), F.col("parent").alias("b")), "pointers")
    discard(packs)
    named = own.join(components(links), own.id == F.col("v"), "left").select(F.col("id").alias("rep"), F.coalesce("label", "id").alias("label"), F.col("density").cast("double").alias("density"))
    copies = rows.select(F.col("id").alias("rep"), "type", "h1", "h2").join(named, "rep").select("type", "h1", "h2", "label", "density")
    return keyed.select("id", "type", "h1", "h2").join(copies, ["type", "h1", "h2"]).select("label", "id", "type", "density")


def cluster_members(vectors: DataFrame, least: int = 3, **options) -> DataFrame:
    """(first_id, node_id) of clusters of at least ``least`` members."""
    found = cut(density_clusters(vectors, **options), "clusters")
    sizes = found.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return found.join(sizes, "label").select(F.col("label").alias("first_id"), F.col("id").alias("node_id"))


def cluster_descriptions(vectors: DataFrame, least: int = 3, typical: int = 3, **options) -> DataFrame:
    """(first_id, type, size, typical): the densest members describe each cluster.

    Spark keeps at most ``typical`` rows a cluster of each map task before the
    shuffle, so no cluster is collected.
    """
    found = cut(density_clusters(vectors, **options), "clusters")
    sizes = found.groupBy("label").agg(F.min("type").alias("type"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    w = Window.partitionBy("label").orderBy(F.desc("density"), "id")
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= typical)
    named = top.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), " ").alias("typical"))
    return sizes.join(named, "label").select(F.col("label").alias("first_id"), "type", "size", "typical")


def memory_vectors(node: DataFrame, dim: int = 64) -> DataFrame:
    """Live facts and entities that were not inferred, with usable vectors."""
    return live_vectors(node, dim, types=("fact", "entity"), without_origin="inferred")
