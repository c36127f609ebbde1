"""Retrieval, graph, structure, belief and mutation operators on small tables."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramql.config import settings
from engramql.functions import parsing as J
from engramql.functions import seams
from engramql.operators import analytics as A
from engramql.operators import belief as B
from engramql.operators import graph as G
from engramql.operators import mutations as U
from engramql.operators import provenance as P
from engramql.operators import retrieval as R
from engramql.operators import structure as T
from engramql.operators.components import components

EYE = np.eye(4).tolist()
EDGE = "src string, dst string, rel string, w double, last_access bigint, kind string"


def vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, "id string, embedding array<float>" + extra)


def test_topk_skips_other_lengths_and_breaks_ties(spark):
    df = vectors(spark, [("b", EYE[0]), ("a", EYE[0]), ("c", EYE[1]), ("d", [1.0]), ("e", None), ("f", [0.0] * 4), ("g", [float("nan")] * 4)])
    got = R.top(R.cosine_scores(df, EYE[0]), "cos", 3).collect()
    assert [(r.id, round(r.cos, 6)) for r in got] == [("a", 1.0), ("b", 1.0), ("c", 0.0)]


def test_tri_state(spark):
    df = vectors(spark, [("a", EYE[0], True), ("b", EYE[1], False)], ", tombstoned boolean")
    state = lambda q: R.tri_state(df, q).first()
    assert (state(EYE[0]).state, state(EYE[0]).id) == ("deleted", "a")
    assert (state(EYE[1]).state, state(EYE[1]).id) == ("ok", "b")
    assert state(EYE[2]).state == "unreachable"


def test_bm25_against_formula(spark):
    docs = [("a", "red red blue"), ("b", "red green"), ("c", "green"), ("d", None), ("e", "!!")]
    got = {r.id: r.score for r in R.bm25(spark.createDataFrame(docs, "id string, value string"), "value", ["red", "Red"]).collect()}
    idf = max(math.log((3 - 2 + 0.5) / (2 + 0.5)), 1e-6)
    want = lambda tf, dl: 2 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 2))
    assert got == {"a": pytest.approx(want(2, 3)), "b": pytest.approx(want(1, 2))}


def test_rrf(spark):
    one = spark.createDataFrame([("a", 0), ("b", 1)], "id string, rank int")
    two = spark.createDataFrame([("b", 0)], "id string, rank int")
    got = {r.id: r.score for r in R.rrf([(one, 1.0), (two, 2.0)]).collect()}
    assert got["a"] == pytest.approx(1 / 61) and got["b"] == pytest.approx(1 / 62 + 2 / 61)


def test_budget_is_a_prefix(spark):
    rows = [("a", 0.9, 5, False), ("b", 0.8, 6, False), ("c", 0.7, 1, False), ("k", 0.0, 4, True)]
    df = spark.createDataFrame(rows, "id string, score double, chars int, hard boolean")
    assert {r.id for r in R.within_budget(df, 10).collect()} == {"k", "a"}
    assert {r.id for r in R.within_budget(df, 16).collect()} == {"k", "a", "b", "c"}


def test_temporal_slots(spark):
    df = spark.createDataFrame([("a", 0, 5), ("b", 1, None), ("c", 2, 9)], "id string, rank int, ts bigint")
    assert {r.id: r.rank for r in R.temporal_slots(df, "ts").collect()} == {"c": 0, "b": 1, "a": 2}


def test_same_topk():
    assert R.same_topk([("a", 1.0), ("b", 0.5)], [("a", 1.0), ("c", 0.5)])
    assert not R.same_topk([("a", 1.0), ("b", 0.5)], [("z", 1.0), ("b", 0.5)])


def test_typed_reach(spark):
    e = spark.createDataFrame([("a", "b", "uses", 0.2, 0, "relation"), ("a", "b", "extends", 9.0, 0, "relation"), ("b", "c", "part_of", 0.3, 0, "relation"), ("a", "d", "uses", 0.5, 0, "relation"), ("d", "c", "part_of", 0.1, 0, "relation"), ("d", "x", "part_of", 5.0, 0, "cites")], EDGE)
    anchor = spark.createDataFrame([("a",)], "id string")
    assert [(r.id, round(r.score, 6)) for r in G.typed_reach(e, anchor, ["uses", "part_of"]).collect()] == [("c", 0.6)]
    assert G.typed_reach(e, anchor, ["uses", "unknown"]).count() == 0


def test_ancestors_end_on_cycles(spark):
    e = spark.createDataFrame([("p", "c", "abstracts", 0.1, 0, "abstracts"), ("g", "p", "abstracts", 0.1, 0, "abstracts"), ("c", "g", "abstracts", 0.1, 0, "abstracts")], EDGE)
    got = {(r.id, r.ancestor): r.hops for r in G.ancestors(e).collect()}
    assert got == {("c", "p"): 1, ("c", "g"): 2, ("p", "g"): 1, ("p", "c"): 2, ("g", "c"): 1, ("g", "p"): 2}


def test_resolve_names(spark):
    n = spark.createDataFrame([("1", "fact", "redis"), ("2", "entity", "Redis"), ("3", "entity", "postgres"), ("4", "fact", "the postgres server instance"), ("5", "fact", "postgre")], "id string, type string, value string")
    q = spark.createDataFrame([("REDIS",), ("postgr",), ("nothing",), ("",)], "name string")
    assert {r.name: (r.id, r.tier) for r in G.resolve_names(q, n).collect()} == {"REDIS": ("2", 1), "postgr": ("3", 3)}


def test_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("x", "x"), (None, "x")]
    got = {r.v: r.label for r in components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(41)} == {"n000"} and got["y"] == "x" and len(got) == 43
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_stale_entities(spark):
    nodes = spark.createDataFrame([("e1", "entity", False), ("e2", "entity", False), ("e3", "entity", False), ("f1", "fact", True), ("f2", "fact", False)], "id string, type string, tombstoned boolean")
    events = spark.createDataFrame([("e1", "p1"), ("f1", "p1"), ("e2", "p2"), ("f1", "p2"), ("f2", "p2"), ("e3", "p3"), (None, "p1")], "node_id string, episode_id string")
    assert {r.id for r in P.stale_entities(events, nodes).collect()} == {"e1"}


def test_echo_takes_best_then_newest(spark):
    day = 86_400_000
    rows = [("a", 2 * day, "observed", [1.0, 0.0]), ("old", day - 1, "inferred", [1.0, 0.0]), ("x", day + 5, "inferred", [1.0, 0.0]), ("y", day + 9, "inferred", [1.0, 0.0]), ("late", 2 * day + 1, "inferred", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, ts bigint, origin string, v array<double>")
    assert [(r.id, r.echo_of) for r in P.echoes(df, day, 0.85).collect()] == [("a", "y")]


def test_percentiles_two_ways(spark):
    df = spark.createDataFrame([("g", float(x)) for x in range(1, 11)], "g string, v double")
    got = {r.p: (r.nearest, r.floor) for r in A.percentiles(df, "g", "v", (50, 95)).collect()}
    assert got == {50: (5.0, 6.0), 95: (10.0, 10.0)}


def test_centroid_and_cohesion(spark):
    rows = spark.createDataFrame([("s", "a", EYE[0]), ("s", "b", EYE[1]), ("s", "c", [2.0, 0.0, 0.0, 0.0]), ("t", "d", EYE[2])], "schema_id string, id string, embedding array<float>")
    c = {r.schema_id: r.centroid for r in T.centroids(rows, 4).collect()}
    assert c["s"] == pytest.approx([1.0, 1 / 3, 0, 0])
    assert {r.schema_id: round(r.cohesion, 6) for r in T.cohesion(rows, 4).collect()} == {"s": round(1 / 3, 6)}


def test_similar_pairs(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(f"k{i:02d}", v.tolist()) for i, v in enumerate(m)], "k string, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(f"k{i:02d}", f"k{j:02d}") for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.9}
    assert {(r.a, r.b) for r in T.similar_pairs(df, "k", "v", 0.9, 4).collect()} == want


def test_average_linkage():
    u = np.array([[1, 0], [0.99, 0.14], [0, 1], [0.1, 0.99]])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    assert sorted(T.average_linkage(u @ u.T, ["a", "b", "c", "d"], 0.35)) == [[0, 1], [2, 3]]


def test_duplicates_and_rewiring(spark):
    n = spark.createDataFrame([("a", "Redis", None, EYE[0], 0.5, 1), ("b", " redis ", None, EYE[0], 0.9, 1), ("c", "redis", "old", EYE[0], 0.9, 1), ("d", "redis", None, EYE[1], 0.5, 1), ("e", "other", None, EYE[0], 0.5, 1)], "id string, value string, prev_value string, embedding array<float>, c double, last_access bigint")
    pairs = T.duplicate_pairs(n, 0.88, 4)
    assert {(r.a, r.b) for r in pairs.collect()} == {("a", "b")}
    e = spark.createDataFrame([("a", "x", "uses", 0.1, 5, "relation"), ("b", "x", "uses", 0.4, 3, "relation"), ("a", "b", "uses", 1.0, 0, "relation"), ("b", "y", "uses", 0.2, 0, "relation")], EDGE)
    merged = T.canonical(pairs, n, G.degrees(e))
    assert {r.id: r.canonical for r in merged.collect()} == {"a": "b", "b": "b"}
    assert {(r.src, r.dst, r.w, r.last_access) for r in T.rewired_edges(e, merged).collect()} == {("b", "x", 0.4, 5), ("b", "y", 0.2, 0)}


def test_induction_needs_support(spark):
    rows = [(f"a{i}", (np.array(EYE[0]) + 0.01 * i).tolist()) for i in range(4)] + [("z1", EYE[3]), ("z2", EYE[3])]
    got = T.induce_schemas(vectors(spark, rows), None, settings(), 4)
    assert {r.id for r in got.collect()} == {f"a{i}" for i in range(4)}
    centroids = spark.createDataFrame([("s", EYE[3]), ("r", (2 * np.array(EYE[3])).tolist()), ("zero", [0.0] * 4)], "schema_id string, centroid array<double>")
    known = T.induce_schemas(vectors(spark, rows), centroids, settings(), 4)
    assert {(r.bucket, r.id) for r in known.where("startswith(bucket, 'known')").collect()} == {("known-r", "z1"), ("known-r", "z2")}


def test_induction_is_that_of_one_pass(spark):
    """Members of one bucket meet whatever else is there."""
    rng = np.random.default_rng(9)
    centre, noise = rng.normal(size=(150, 64)), rng.normal(size=(900, 64))
    m = np.concatenate([np.repeat(centre, 6, axis=0) + 0.55 * noise, rng.normal(size=(300, 64))]).astype(np.float32)
    ids = [f"n{i:04d}" for i in rng.permutation(len(m))]
    sums, members = [], []
    for i in np.argsort(ids):
        v = m[i].astype(np.float64) / np.linalg.norm(m[i].astype(np.float64))
        near = [k for k, s in enumerate(sums) if s @ v / np.linalg.norm(s) >= 0.7]
        if near:
            sums[near[0]] += v
            members[near[0]].append(ids[i])
        else:
            sums.append(v.copy())
            members.append([ids[i]])
    want = {tuple(x) for s, x in zip(sums, members) if len(x) >= 3 and (s @ s - len(x)) / (len(x) * (len(x) - 1)) >= 0.7}
    got = {}
    for r in T.induce_schemas(vectors(spark, [(i, v.tolist()) for i, v in zip(ids, m)])).collect():
        got.setdefault(r.bucket, []).append(r.id)
    assert len(want) > 100 and {tuple(sorted(x)) for x in got.values()} == want


def test_claims_parse(spark):
    rows = [("a", '[{"value":"x y","type":"entity"},{"value":" "}]'), ("b", 'Sure: [{"value":"one"},{"value":"tw'), ("c", '{"items":[{"value":"q","due_at":"2025","action_type":"dance"}]}'), ("d", "nope"), ("e", None)]
    got = {(r.k, r.pos): r.claim for r in J.parse_claims(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()}
    assert {k: c.value for k, c in got.items()} == {("a", 0): "x y", ("b", 0): "one", ("c", 0): "q"}
    assert got[("c", 0)].action_type == "other" and got[("a", 0)].type == "entity"


def test_verdict_is_safe(spark):
    texts = ['{"relation":"contradict","best_candidate_id":"a","magnitude":7}', '{"relation":"confirm","best_candidate_id":"zz"}', "broken", '{"relation":"contradict","best_candidate_id":"b","magnitude":0.5,"contradicted_ids":["a","q"]}']
    df = spark.createDataFrame([(t, ["a", "b"]) for t in texts], "t string, c array<string>")
    got = [r.v for r in df.select(J.verdict(F.col("t"), F.col("c")).alias("v")).collect()]
    assert [(v.relation, v.magnitude, v.contradicted_ids) for v in got] == [("contradict", 1.0, ["a"]), ("unrelated", 0.0, []), ("unrelated", 0.0, []), ("contradict", 0.5, ["a"])]


def test_chunks_keep_the_text(spark):
    texts = ["", "one\ntwo\n" * 50, "x" * 95, "a\n\nb\n" + "y" * 33 + "\nend"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, r in zip(texts, df.select(J.text_chunks(F.col("t"), 20).alias("c")).collect()):
        assert "".join(r.c) == t and all(len(x) <= 20 for x in r.c)


def nodes_table(spark, rows):
    return spark.createDataFrame(rows, "id string, value string, s double, c double, last_access bigint, prev_value string, pending_contradictions string, embedding array<float>")


DECIDED = "claim_id string, route string, node_id string, value string, origin string, role string, session_id string, episode_id string, hard_keep boolean, salience double, ts bigint"


def test_apply_in_replay_order(spark):
    nodes = nodes_table(spark, [("n", "the port is 80", 0.9, 0.9, 0, None, "[]", EYE[0])])
    claim = lambda i, route, value, session, salience, role="user", origin="observed": (f"c{i}", route, "n", value, origin, role, session, f"e{i}", False, salience, 0)
    decided = spark.createDataFrame(
        [claim(1, "confirm", "the port is 80", "s1", 0.9), claim(2, "confirm", "the port is 80", "s1", 0.8, "assistant"), claim(3, "judge", "the port is 81", "s1", 0.3), claim(4, "judge", "the port is 81", "s2", 0.2), claim(5, "judge", "the port is 81", "s3", 0.1), ("c6", "unrelated", None, "new thing", "observed", "user", "s", "e6", False, 0.5, 0)],
        DECIDED,
    )
    got = {r.claim_id: r for r in B.apply_claims(decided, nodes).collect()}
    assert got["c1"].action == "confirm" and got["c1"].s == pytest.approx(0.91)
    assert got["c2"].action == "confirm_ignored"
    assert [got[c].action for c in ("c3", "c4", "c5")] == ["contradict_hold", "contradict_hold", "contradict_reconcile"]
    assert got["c5"].value == "the port is 81" and got["c5"].prev_value == "the port is 80" and json.loads(got["c5"].pending) == []
    assert (got["c6"].action, got["c6"].node_id) == ("unrelated", "n-c6")


def test_nominate_against_numpy(spark):
    rng = np.random.default_rng(2)
    n, c = rng.normal(size=(50, 4)), rng.normal(size=(7, 4))
    nodes = vectors(spark, [(f"n{i:02d}", v.tolist()) for i, v in enumerate(n)])
    claims = vectors(spark, [(f"c{i}", v.tolist()) for i, v in enumerate(c)])
    cos = (c / np.linalg.norm(c, axis=1, keepdims=True)) @ (n / np.linalg.norm(n, axis=1, keepdims=True)).T
    want = {(f"c{i}", f"n{j:02d}") for i in range(7) for j in np.argsort(-cos[i])[:5]}
    assert {(r.claim_id, r.node_id) for r in B.nominate(claims, nodes, 5, 4).collect()} == want


def test_fold_equals_steps(spark):
    day = 86_400_000
    nodes = spark.createDataFrame([("n", 0.4, 0.5, 2 * day)], "id string, s double, c double, last_access bigint")
    ts = [day, 5 * day, 6 * day, 6 * day]
    events = spark.createDataFrame([(i, t, "confirm", "n") for i, t in enumerate(ts)], "id bigint, ts bigint, event_type string, node_id string")
    s, last = 0.4, 2 * day
    for i, t in enumerate(ts):
        s = s * math.exp(-0.05 * max(0, t - last if i == 0 else t - ts[i - 1]) / day)
        s += 0.1 * (1 - s)
    got = B.fold_confirmations(events, nodes).first()
    assert got.s == pytest.approx(s) and got.k == 4


def full_node(spark, rows):
    return spark.createDataFrame(rows, "id string, type string, value string, value_hash string, embedding array<float>, embedded_hash string, origin string, s double, c double, last_access bigint, prev_value string, prev_ts bigint, pending_contradictions string, tombstoned boolean, training_eligible boolean")


def sha(x):
    import hashlib

    return hashlib.sha256(x.encode()).hexdigest()


def test_upsert_and_embedding_guard(spark):
    n = full_node(spark, [("a", "fact", "v1", sha("v1"), EYE[0], sha("v1"), "observed", 0.1, 0.7, 5, None, None, "[]", False, True), ("b", "fact", "w", sha("w"), EYE[1], sha("w"), "observed", 0.1, 0.7, 5, None, None, "[]", False, True)])
    ch = spark.createDataFrame([("a", "fact", "v2", "observed", 0.2, 0.5, 9), ("a", "fact", "v0", "observed", 0.2, 0.5, 7), ("c", "fact", "x", "inferred", 0.1, 0.9, 9)], "id string, type string, value string, origin string, s double, c double, last_access bigint")
    out = {r.id: r for r in U.upsert_nodes(n, ch).collect()}
    assert (out["a"].value, out["a"].prev_value, out["a"].prev_ts, out["a"].embedding, out["a"].training_eligible) == ("v2", "v1", 5, None, False)
    assert out["b"].embedding == EYE[1] and out["c"].prev_value is None and out["c"].training_eligible is False
    merged = U.upsert_nodes(n, ch)
    vec = spark.createDataFrame([("a", sha("v2"), EYE[2]), ("c", "stale", EYE[3]), ("b", sha("w"), [1.0])], "id string, value_hash string, vector array<float>")
    got = {r.id: r.embedding for r in U.set_embeddings(merged, vec, 4).collect()}
    assert got == {"a": EYE[2], "b": EYE[1], "c": None}


def test_sidecar_meta_marks(spark):
    old = spark.createDataFrame([("n", 1, 1)], "node_id string, generated_at bigint, updated_at bigint")
    new = spark.createDataFrame([("n", 9, 9), ("m", 3, 3)], old.schema)
    assert {(r.node_id, r.generated_at, r.updated_at) for r in U.upsert_sidecar(old, new, ["node_id"], ("generated_at",)).collect()} == {("n", 1, 9), ("m", 3, 3)}
    meta = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert {tuple(r) for r in U.put_meta(meta, spark.createDataFrame([("a", None), ("c", "3")], "key string, value string")).collect()} == {("b", "2"), ("c", "3")}


def test_seams():
    assert np.linalg.norm(seams.embed("a b c")) == pytest.approx(1.0)
    assert seams.judge("The port is 80", "the port is 80.").relation == "confirm"
    assert seams.judge("The port is 81", "the port is 80").relation == "contradict"
    assert seams.judge("cats sleep", "the port is 80").relation == "unrelated"
    assert [c.value for c in seams.extract("One two three. No. Four five six!")] == ["One two three.", "Four five six!"]


def test_citations_and_documents(spark):
    from engramql.operators import documents as D

    nodes = spark.createDataFrame([("abcd-1", False), ("abcd-2", False), ("ffff-1", True), ("eeee-1", False)], "id string, tombstoned boolean")
    texts = spark.createDataFrame([("d", "x /fact/ABCD-1, /fact/abcd /fact/eeee /fact/ffff-1 /fact/none-9"), ("e", None)], "doc_id string, text string")
    cited = D.citations(texts, nodes)
    assert {r.ref: (r.id, r.state) for r in cited.collect()} == {"ABCD-1": ("abcd-1", "ok"), "abcd": (None, "invented"), "eeee": ("eeee-1", "ok"), "ffff-1": ("ffff-1", "deleted"), "none-9": (None, "invented")}
    assert D.canonical_references(texts, cited).where("doc_id = 'd'").first().text == "x /fact/abcd-1,  /fact/eeee-1  "
    old = spark.createDataFrame([("d", "gone", "cites", 0.1, 0, "cites"), ("z", "gone", "cites", 0.1, 0, "cites")], EDGE)
    links = spark.createDataFrame([("d", "z")], "doc_id string, target string")
    assert {(r.src, r.dst, r.kind) for r in D.document_edges(old, cited, links, 5).collect()} == {("d", "abcd-1", "cites"), ("d", "eeee-1", "cites"), ("d", "z", "doc_link"), ("z", "gone", "cites")}
    assert D.predicate_of(seams.embed("what does this use"), D.gloss_vectors()) == "uses"
    assert D.predicate_of([0.0] * 64, D.gloss_vectors()) is None


def test_subject_proposals_and_daily_cap(spark):
    text = '```json\n[{"name":"Retry budget","schemas":[0,1,9,true]},{"name":"retry  BUDGET!","schemas":[0]},{"name":"x","schemas":[]},{"name":7}]\n```'
    assert J.subject_proposals(text, ["a", "b"]) == [{"name": "Retry budget", "slug": "retry-budget", "schemas": ["a", "b"]}]
    assert J.subject_proposals(None, []) == []
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 86_400_001)], "id string, ts bigint")
    assert {r.id for r in A.daily_cap(df, "ts", 2).collect()} == {"a", "b", "d"}


def test_budget_keeps_every_row_that_fits(spark):
    rows = [(f"{i:05d}", 1.0 - i / 20_000, 2, False) for i in range(6000)] + [(f"z{i}", 0.9999 - i / 1000, 0, False) for i in range(5)] + [("k", 0.1, 10, True)]
    df = spark.createDataFrame(rows, "id string, score double, chars int, hard boolean").repartition(4)
    for budget in (20, 11_000, 12_010, 12_009, 9):
        want, total = {"k"}, 10
        for r in sorted((r for r in rows if not r[3]), key=lambda r: (-round(r[1], 9), r[0])):
            total += r[2]
            if total > budget:
                break
            want.add(r[0])
        assert {r.id for r in R.within_budget(df, budget).collect()} == want


def test_surfacing_cap_counts_by_time_shown(spark):
    h = 3_600_000
    now = 1000 * h
    due = [(f"n{i}", now + (100 + i) * h, "other", None, None, None, None) for i in range(7)]
    shown = [
        ("a", now + 50 * h, "other", None, "surfaced", None, now - 2 * h),  # counts
        ("b", now - 1 * h, "other", None, "surfaced", None, now - 3 * h),  # was P0 when shown
        ("c", now + 50 * h, "other", None, "seen", None, now - 30 * h),  # shown too long ago
        ("d", now + 50 * h, "other", None, "dismissed", None, now - 2 * h),  # closed
    ]
    schema = "node_id string, due_ms bigint, action_type string, recurrence_rule string, outcome string, snooze_until_ms bigint, surfaced_ms bigint"
    nodes = spark.createDataFrame([(x[0], 0.5) for x in due + shown], "id string, s double")
    got = R.surface_rank(spark.createDataFrame(due + shown, schema), nodes, now)
    assert {r.node_id for r in got.collect()} == {"n0", "n1", "n2", "n3"}


def test_names_bind_to_entities_only(spark):
    n = spark.createDataFrame([("1", "fact", "Open AI is it"), ("2", "entity", "open ai key"), ("3", "entity", "Open AI"), ("4", "entity", "b"), ("5", "fact", "go"), ("6", "entity", "go on"), ("7", "entity", "x go along y"), ("8", "entity", None)], "id string, type string, value string")
    names = spark.createDataFrame([("OPEN AI",), ("open",), ("GO",), ("o",), ("zz",), ("",), ("n",)], "name string")
    got = {r.name: (r.id, r.tier) for r in G.resolve_names(names, n).collect()}
    assert got == {"OPEN AI": ("3", 1), "open": ("3", 3), "GO": ("5", 2)}
    n = n.unionByName(spark.createDataFrame([("9", "entity", "to")], n.schema))
    assert {r.name: (r.id, r.tier) for r in G.resolve_names(names, n).collect()}["o"] == ("9", 3)


def test_echoes_read_whole_texts(spark):
    from engramql.functions.seams import word_counts, with_vectors
    import numpy as np

    tail = " ".join(f"w{i}" for i in range(40))
    rows = [("a", 100, "observed", f"checked {tail}"), ("b", 90, "inferred", f"seen {tail}"), ("c", 95, "inferred", "checked nothing of that at all"), ("d", 80, "observed", None), ("e", 99, "inferred", ""), ("f", 300, "observed", f"seen {tail}")]
    df = with_vectors(spark.createDataFrame(rows, "id string, ts bigint, origin string, content string"), "content")
    got = {(r.id, r.echo_of): r.cos for r in P.echoes(df, 100, 0.85).collect()}
    a, b = word_counts(rows[0][3]), word_counts(rows[1][3])
    assert got == {("a", "b"): round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)}
