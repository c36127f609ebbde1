"""The k most similar vectors of each probe.

Vectors are projected (fitted on a bounded sample), and several shifted Hilbert
orderings of the projected cells are range-partitioned; a probe meets the rows
in a window around its place in each ordering.  The merged candidates are
reranked and give a floor for the probe's k-th cosine.  An exact pass follows:
rows lie packed in blocks along the first ordering, each with its mean
direction and widest angle, and a probe is held only against blocks that can
still hold something above its floor.  Tight neighbourhoods are thus settled by
the curves; only probes without close neighbours are held against most blocks.

Probes lie in packs of bounded size in a written table that the tasks of the
exact pass read; every row is shuffled once for each ordering and once for that
pass, nothing that grows with the data is broadcast, and no pair of rows is
emitted but the best k of a block.  Cosines are ranked in double precision, ties by the smaller id.

Defined results: vectors that are null, of another length, not finite or all
zero are not there; a probe that is not usable gives no row; fewer than k rows
give fewer neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramql.functions.vectors import best_of, first_of_row, matrix, raw_matrix, unit, usable
from engramql.operators.versions import last_rows
from engramql.storage import cut, read_shared, shared_files

#: Rows the projection is fitted on.
FIT_ROWS = 8192
#: Rows of a block and probes of a pack (64 dimensions: 0.5 and 1 MB).
BLOCK, PACK = 2048, 4096
#: Blocks that a task holds at once (64 dimensions: 64 MB with their unit rows).
HELD = 64
#: More than the error of a float32 cosine; what is nearer than this is decided in double precision.
SLACK = 1e-5


def live_vectors(node: DataFrame, dim: int = 64, types: tuple[str, ...] = (), without_origin: str | None = None) -> DataFrame:
    """(id, type, embedding) of live nodes with a usable vector, by last row."""
    last = last_rows(node.select("id", "type", "origin", "tombstoned", "embedding", "landed_at").where("id IS NOT NULL"), ties=["type", "origin", "tombstoned"])
    kept = last.where(~F.coalesce("tombstoned", F.lit(False)) & usable(F.col("embedding"), dim))
    if types:
        kept = kept.where(F.col("type").isin(*types))
    if without_origin:
        kept = kept.where(F.coalesce(F.col("origin") != without_origin, F.lit(True)))
    return kept.select("id", "type", "embedding")


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer cells (rows x axes, ``bits`` bits each), at most 63 bits.

    Skilling's transposition: undo excess work from the highest bit down, then
    Gray-encode and interleave.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    q = np.int64(1) << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(axes):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.int64(1) << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def fit_curves(vectors: DataFrame, dim: int, curves: int, axes: int, bits: int, seed: int = 17) -> list[tuple[np.ndarray, np.ndarray]]:
    """A projection and cell limits for each curve, from ``FIT_ROWS`` rows.

    The rows with the smallest hashes are taken, so the fit does not depend on
    the order of rows.  Curve c uses principal axes mixed by a random rotation
    (the first curve the axes themselves) and limits shifted by a random part
    of a cell.
    """
    rows = vectors.select("embedding", F.xxhash64("id").alias("h")).orderBy("h").limit(FIT_ROWS).select("embedding").toArrow()
    rng = np.random.default_rng(seed)
    if rows.num_rows == 0:
        return []
    m = matrix(rows.column("embedding"), dim).astype(np.float64)
    basis = np.linalg.eigh(np.cov(m.T))[1].T[::-1]  # dim x dim: the rows themselves are never decomposed
    out = []
    for c in range(curves):
        mix = np.eye(dim) if c == 0 else np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        wide = basis[: min(dim, 4 * axes)] if c else basis
        projection = (mix[: len(wide), : len(wide)] @ wide)[:axes] if c else wide[:axes]
        shift = rng.uniform(-0.5, 0.5, size=axes) if c else np.zeros(axes)
        steps = (np.arange(1, 2**bits)[:, None] + shift) / 2**bits
        p = m @ projection.T
        limits = np.stack([np.quantile(p[:, a], np.clip(steps[:, a], 0, 1)) for a in range(axes)])
        out.append((projection.astype(np.float32), limits))
    return out


def _keys(m: np.ndarray, curve: tuple[np.ndarray, np.ndarray], bits: int) -> np.ndarray:
    projection, limits = curve
    p = m @ projection.T
    cells = np.stack([np.searchsorted(limits[a], p[:, a]) for a in range(p.shape[1])], axis=1)
    return hilbert_keys(np.minimum(cells, 2**bits - 1), bits)


def place(vectors: DataFrame, curves: list, dim: int, bits: int) -> DataFrame:
    """(curve, hkey, id, probe, embedding): one row per curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column("embedding"), dim)
            for c, curve in enumerate(curves):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(m), c, dtype=np.int32)), pa.array(_keys(m, curve, bits)), b.column("id"), b.column("probe"), b.column("embedding")],
                    names=["curve", "hkey", "id", "probe", "embedding"],
                )

    return vectors.select("id", "probe", "embedding").mapInArrow(run, "curve int, hkey bigint, id string, probe boolean, embedding array<float>")


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def best_pairs(q: np.ndarray, m: np.ndarray, order: np.ndarray, r: np.ndarray, c: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, cosines) of the ``keep`` best of each row, by the rule of ``merge_best``."""
    cos = np.concatenate([exact(q[r[s : s + 65536]], m[c[s : s + 65536]]) for s in range(0, len(r), 65536)] or [np.empty(0)])
    at = first_of_row(r, np.round(cos, 9), order[c], keep)
    return r[at], c[at], cos[at]


PAIRS = "probe_id string, other_id string, cos double"


def window_pairs(placed: DataFrame, k: int, dim: int, window: int) -> DataFrame:
    """The best ``k`` rows within ``window`` places of each probe, per ordering."""

    def scan(ids: np.ndarray, probe: np.ndarray, m: np.ndarray, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        """Probes at lo..hi against the rows around them."""
        u = unit(m)
        for start in range(lo, hi, 512):
            end = min(start + 512, hi)
            at = start + np.flatnonzero(probe[start:end])
            if not len(at):
                continue
            first = max(0, start - window)
            cos = u[at] @ u[first : end + window].T
            cos[np.arange(len(at)), at - first] = -2
            r, c = best_of(cos, k, SLACK)
            keep = ids[at[r]] != ids[c + first]  # a row of another curve may be in the window
            near = m[first : end + window]
            r, c, cosines = best_pairs(m[at], near, np.argsort(np.argsort(ids[first : end + window])), r[keep], c[keep], k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at[r]], pa.string()), pa.array(ids[c + first], pa.string()), pa.array(cosines)], names=["probe_id", "other_id", "cos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, probe, m = np.empty(0, dtype=object), np.empty(0, dtype=bool), np.empty((0, dim), dtype=np.float32)
        done = 0  # probes before this place are served
        for b in batches:
            ids = np.concatenate([ids, b.column("id").to_numpy(zero_copy_only=False)])
            probe = np.concatenate([probe, b.column("probe").to_numpy(zero_copy_only=False)])
            m = np.concatenate([m, raw_matrix(b.column("embedding"), dim)])
            ready = max(done, len(ids) - window)
            yield from scan(ids, probe, m, done, ready)
            drop = max(0, ready - window)
            ids, probe, m, done = ids[drop:], probe[drop:], m[drop:], ready - drop
        yield from scan(ids, probe, m, done, len(ids))

    ordered = placed.repartitionByRange("curve", "hkey", "id").sortWithinPartitions("curve", "hkey", "id")
    return ordered.select("id", "probe", "embedding").mapInArrow(run, PAIRS)


def merge_best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each probe among pairs found in any way."""
    once = pairs.groupBy("probe_id", "other_id").agg(F.max("cos").alias("cos"))
    w = Window.partitionBy("probe_id").orderBy(F.round("cos", 9).desc(), "other_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_pass(first: DataFrame, packs: DataFrame, k: int, dim: int) -> DataFrame:
    """What lies above a probe's floor, from the blocks that can hold it.

    Rows come along the first ordering, each once; a task cuts them into blocks
    with their mean and widest angle, holds up to ``HELD`` of them and reads
    the written probe packs one by one.  A probe is held against a block only
    if its angle to the mean lets the block reach its floor.
    """
    files = shared_files(packs)

    def blocks(ids: pa.Array, m: np.ndarray) -> Iterator[tuple]:
        for s in range(0, len(m), BLOCK):
            x = m[s : s + BLOCK]
            u = unit(x)
            mean = u.astype(np.float64).mean(0)
            length = np.linalg.norm(mean)
            mean = mean / length if length > 1e-9 else np.eye(dim)[0]
            names = np.array(ids.slice(s, BLOCK).to_pylist(), dtype=object)
            yield names, np.argsort(np.argsort(names)), x, u, mean.astype(np.float32), float(np.arccos(np.clip((u @ mean).min(), -1, 1)))

    def against(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        for pack in read_shared(files, ["probe_ids", "probe_packed", "floors"]):
            probes = np.array(pack.column("probe_ids")[0].as_py(), dtype=object)
            q = np.frombuffer(pack.column("probe_packed")[0].as_py(), dtype=np.float32).reshape(-1, dim)
            floor, uq = np.array(pack.column("floors")[0].as_py()), unit(q)
            for ids, order, m, um, mean, reach in held:
                angle = np.arccos(np.clip(uq @ mean, -1, 1))
                live = np.flatnonzero(np.cos(np.maximum(0, angle - reach - 1e-4)) >= floor - SLACK)
                for s in range(0, len(live), 512):
                    at = live[s : s + 512]
                    cos = uq[at] @ um.T
                    r, c = best_of(cos, k + 1, SLACK)  # the probe itself may be among them
                    keep = (cos[r, c] >= floor[at[r]] - SLACK) & (probes[at[r]] != ids[c])
                    r, c, cosines = best_pairs(q[at], m, order, r[keep], c[keep], k)
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array(probes[at[r]], pa.string()), pa.array(ids[c], pa.string()), pa.array(cosines)], names=["probe_id", "other_id", "cos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            held += blocks(b.column("id"), raw_matrix(b.column("embedding"), dim))
            if len(held) >= HELD:
                yield from against(held)
                held = []
        if held:
            yield from against(held)

    ordered = first.repartitionByRange("hkey", "id").sortWithinPartitions("hkey", "id")
    return ordered.select("id", "embedding").mapInArrow(run, PAIRS)


def pack_probes(vectors: DataFrame, floors: DataFrame, dim: int) -> DataFrame:
    """Probes with their floors in packs of about ``PACK``: (pack, probe_ids, probe_packed, floors)."""
    probes = vectors.where("probe").join(floors, vectors.id == floors.probe_id, "left").select("id", "embedding", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    count = max(1, -(-vectors.where("probe").count() // PACK))
    packed = probes.select(F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("pack"), F.struct("id", "embedding", "floor").alias("r"))

    def run(table: pa.Table) -> pa.Table:
        r = table.column("r").combine_chunks()
        m = raw_matrix(r.field("embedding"), dim)
        return pa.Table.from_arrays(
            [table.column("pack").slice(0, 1), pa.array([r.field("id").to_pylist()], pa.list_(pa.string())), pa.array([m.tobytes()], pa.binary()), pa.array([r.field("floor").to_pylist()], pa.list_(pa.float64()))],
            names=["pack", "probe_ids", "probe_packed", "floors"],
        )

    return packed.groupBy("pack").applyInArrow(run, "pack int, probe_ids array<string>, probe_packed binary, floors array<double>")


def nearest(vectors: DataFrame, probe_ids: DataFrame, k: int = 10, dim: int = 64, curves: int = 5, axes: int = 8, bits: int = 7, window: int = 512, settle: bool = True) -> DataFrame:
    """(probe_id, other_id, cos, rank): the k most similar rows of each probe.

    ``settle`` adds the exact pass; without it the result is what the windows
    of the orderings found (their recall is in the README).
    ``vectors`` has id and embedding, all usable; ``probe_ids`` has node_id.
    """
    marks = probe_ids.select(F.col("node_id").alias("id")).where("id IS NOT NULL").distinct().withColumn("probe", F.lit(True))
    base = cut(vectors.select("id", "embedding").join(marks, "id", "left").select("id", F.coalesce("probe", F.lit(False)).alias("probe"), "embedding"), "vectors")
    fitted = fit_curves(base, dim, curves, axes, bits)
    if not fitted:
        return base.sparkSession.createDataFrame([], PAIRS + ", rank int")
    placed = place(base, fitted, dim, bits)
    near = cut(merge_best(window_pairs(placed, k, dim, window), k), "windows")
    floors = near.groupBy("probe_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("cos")).alias("floor"))
    if not settle:
        return near
    packs = cut(pack_probes(base, floors, dim), "probes")
    rest = exact_pass(place(base, fitted[:1], dim, bits), packs, k, dim)
    return merge_best(near.select("probe_id", "other_id", "cos").unionByName(rest), k)


def nearest_pairs(node: DataFrame, probes: DataFrame, k: int = 10, dim: int = 64) -> DataFrame:
    """(a_id, b_id), a_id < b_id: each pair of a probe and one of its k nearest, once."""
    found = nearest(live_vectors(node, dim), probes, k, dim)
    return found.select(F.least("probe_id", "other_id").alias("a_id"), F.greatest("probe_id", "other_id").alias("b_id")).distinct()
