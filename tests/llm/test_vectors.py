"""Nearest neighbours and density clusters against brute force."""

from datetime import datetime

import numpy as np
import pytest

import __spark_entry__ as entry
from engramql.llm import clusters as K
from engramql.llm import neighbours as N
from tests.oracle import compare

SCHEMA = "id string, type string, origin string, tombstoned boolean, embedding array<float>, landed_at timestamp, probe string, label string, weight string"
T = datetime(2025, 1, 1)


def nodes(spark, rows):
    return spark.createDataFrame([(*r, "p", "l", "w") for r in rows], SCHEMA)


def mixture(seed, n=900, dim=16, groups=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    m = centre[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.2, 3.0], n)[:, None]
    return m.astype(np.float32)


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_is_exact(spark, seed):
    m = mixture(seed)
    ids = [f"n{i:04d}" for i in range(len(m))]
    df = nodes(spark, [(i, "fact", "observed", False, v.tolist(), T) for i, v in zip(ids, m)])
    probes = spark.createDataFrame([(i,) for i in ids[::9]] + [(ids[0],), (None,), ("unknown",)], "node_id string")
    got = {}
    for r in N.nearest(N.live_vectors(df, 16), probes, 5, 16, window=40).collect():
        got.setdefault(r.probe_id, []).append((r["rank"], r.other_id))
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    assert set(got) == set(ids[::9])
    for p in got:
        at = ids.index(p)
        cos = u @ u[at]
        cos[at] = -2
        want = sorted(range(len(m)), key=lambda j: (-round(cos[j], 9), ids[j]))[:5]
        assert [o for _, o in sorted(got[p])] == [ids[j] for j in want]


def test_curve_windows_alone_find_close_neighbours(spark):
    """The recall of the orderings themselves, before the exact pass."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(60, 64))
    m = (np.repeat(centre, 25, axis=0) + rng.normal(size=(1500, 64)) * 0.05).astype(np.float32)
    ids = [f"n{i:04d}" for i in range(len(m))]
    base = nodes(spark, [(i, "fact", "observed", False, v.tolist(), T) for i, v in zip(ids, m)]).selectExpr("id", "id >= 'n1200' AS probe", "embedding")
    pairs = N.merge_best(N.window_pairs(N.place(base, N.fit_curves(base, 64, 3, 8, 7), 64, 7), 10, 64, 64), 10)
    found = {(r.probe_id, r.other_id) for r in pairs.collect()}
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    want = set()
    for at in range(1200, 1500):
        cos = u @ u[at]
        cos[at] = -2
        want |= {(ids[at], ids[j]) for j in np.argsort(-cos)[:10]}
    assert len(found & want) >= 0.9 * len(want)


def test_nearest_among_copies_takes_the_smaller_ids(spark):
    """Far more copies than k+2 in one block: the ids decide, and not the place in the block."""
    rng = np.random.default_rng(5)
    m = np.concatenate([np.repeat(rng.normal(size=(1, 16)), 300, axis=0), rng.normal(size=(600, 16))]).astype(np.float32)
    ids = [f"n{i:04d}" for i in rng.permutation(len(m))]
    df = nodes(spark, [(i, "fact", "observed", False, v.tolist(), T) for i, v in zip(ids, m)])
    probes = spark.createDataFrame([(i,) for i in ids[:900:30]], "node_id string")
    got = {}
    for r in N.nearest(N.live_vectors(df, 16), probes, 5, 16, window=40).collect():
        got.setdefault(r.probe_id, []).append((r["rank"], r.other_id))
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    for p in ids[:900:30]:
        cos = u @ u[ids.index(p)]
        want = sorted((j for j in range(len(m)) if ids[j] != p), key=lambda j: (-round(cos[j], 9), ids[j]))[:5]
        assert [o for _, o in sorted(got[p])] == [ids[j] for j in want]


def test_nominations_among_copies_take_the_smaller_ids(spark):
    from engramql.operators.belief import nominate

    ids = [f"n{i:03d}" for i in np.random.default_rng(6).permutation(200)]
    n = spark.createDataFrame([(i, [1.0, 0.0]) for i in ids], "id string, embedding array<float>")
    c = spark.createDataFrame([("claim", [1.0, 0.5])], "id string, embedding array<float>")
    assert sorted(r.node_id for r in nominate(c, n, 5, 2).collect()) == [f"n{i:03d}" for i in range(5)]


def test_hilbert_neighbours_differ_in_one_axis_by_one():
    for axes, bits in ((2, 4), (3, 3)):
        side = 2**bits
        cells = np.indices((side,) * axes).reshape(axes, -1).T
        order = np.argsort(N.hilbert_keys(cells, bits))
        assert sorted(N.hilbert_keys(cells, bits).tolist()) == list(range(side**axes))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_unusable_vectors(spark):
    ok = [1.0] + [0.0] * 63
    inf, nan = [float("inf")] * 64, [float("nan")] * 64
    rows = [("a", "fact", "observed", False, ok, T), ("b", None, None, None, ok, T), ("c", "fact", "observed", True, ok, T), ("d", "fact", "x", False, None, T), ("e", "fact", "x", False, [1.0], T), ("f", "fact", "x", False, [0.0] * 64, T), ("g", "fact", "x", False, inf, T), ("h", "fact", "x", False, nan, T), (None, "fact", "x", False, ok, T), ("i", "fact", "x", False, [None] + ok[1:], T)]
    df = nodes(spark, rows)
    assert {r.id for r in N.live_vectors(df).collect()} == {"a", "b"}
    pairs = N.nearest_pairs(df, spark.createDataFrame([("a",), ("c",)], "node_id string"))
    assert [tuple(r) for r in pairs.collect()] == [("a", "b")]


def test_empty(spark):
    none = nodes(spark, [])
    assert N.nearest_pairs(none, spark.createDataFrame([("a",)], "node_id string")).count() == 0
    assert K.cluster_members(K.memory_vectors(none)).count() == 0 and K.cluster_descriptions(K.memory_vectors(none)).count() == 0


def cliques(seed, sizes, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in enumerate(sizes):
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        for i in range(n):
            rows.append((f"g{g:03d}-{i:05d}", (c + rng.normal(size=dim) * 0.045).astype(np.float32), ("fact", "entity")[g % 2]))
    return rows


def test_clusters_against_brute_force(spark, monkeypatch):
    """Also where a cluster is larger than a leaf, and with exact copies."""
    monkeypatch.setattr(K, "LEAF", 64)
    rows = cliques(4, [400, 40, 5, 3, 3, 2, 2] + [1] * 250)
    rows += [(f"copy-{i:03d}", rows[401][1], rows[401][2]) for i in range(50)]
    df = nodes(spark, [(i, t, "observed", False, v.tolist(), T) for i, v, t in rows])
    m = np.array([v for _, v, _ in rows], dtype=np.float64)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = (u @ u.T >= 0.75) & (np.array([t for *_, t in rows])[:, None] == np.array([t for *_, t in rows])[None, :])
    want = {(min(rows[j][0] for j in np.flatnonzero(near[i])), rows[i][0]) for i in range(len(rows)) if near[i].sum() >= 3}
    got = [tuple(r) for r in K.cluster_members(K.memory_vectors(df)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    top = {r.first_id: r for r in K.cluster_descriptions(K.memory_vectors(df)).collect()}
    assert top["g000-00000"].size == 400 and len(top["g000-00000"].typical.split()) == 3


def test_clusters_are_those_of_the_definition(spark, monkeypatch):
    """Small groups at cosines little above the threshold among many rows: none is torn by pivots."""
    monkeypatch.setattr(K, "LEAF", 64)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(700, 64))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    noise = rng.normal(size=(2100, 64))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    m = np.concatenate([np.repeat(centre, 3, axis=0) + 0.5 * noise, rng.normal(size=(1900, 64))]).astype(np.float32)
    ids = [f"n{i:04d}" for i in rng.permutation(len(m))]
    df = nodes(spark, [(i, "fact", "observed", False, v.tolist(), T) for i, v in zip(ids, m)])
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    density, peak = K.leaf_labels(u @ u.T, np.ones(len(m)), np.argsort(np.argsort(ids)), 0.75)
    first = {}
    for i, p in zip(ids, peak):
        first[p] = min(i, first.get(p, i))
    want = {(first[p], i, d) for i, p, d in zip(ids, peak, density)}
    got = {(r.label, r.id, r.density) for r in K.density_clusters(K.memory_vectors(df)).collect()}
    assert len({label for label, *_ in want}) < 3500 and got == want


def test_density_peaks_of_a_leaf():
    u = np.array([[1, 0], [0.99, 0.14], [0.97, 0.24], [0, 1]])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    density, peak = K.leaf_labels(u @ u.T, np.ones(4), np.arange(4), 0.75)
    assert density.tolist() == [3, 3, 3, 1] and peak.tolist() == [0, 0, 0, 3]


@pytest.mark.parametrize("name", ["p6_found", "p7_found", "p7_ranked"])
def test_queries_against_sql(spark, data, name):
    a, b, *_ = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], data)
    assert a == b
