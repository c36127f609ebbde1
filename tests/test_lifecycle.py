"""Writes that follow from a pass, on small tables."""

import json

import pytest

from engramql.memory import Memory
from engramql.operators import lifecycle as L

EYE = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
NODE = "id string, type string, origin string, value string, embedding array<float>, last_access bigint, tombstoned boolean"
EDGE = "src string, dst string, kind string"


def test_triples_become_edges(spark):
    n = spark.createDataFrame([("1", "entity", "Open AI"), ("2", "entity", "Redis"), ("3", "fact", "redis is what open ai runs"), ("4", "entity", None)], "id string, type string, value string")
    t = spark.createDataFrame([("open ai", "uses", "REDIS"), ("open", "uses", "redis"), ("Redis", "uses", "redis"), ("redis", "likes", "open ai"), ("nobody", "uses", "redis"), (None, "uses", "redis")], "subject string, predicate string, object string")
    assert [tuple(r) for r in L.triple_edges(t, n, 5).collect()] == [("1", "2", "uses", 0.1, 5, "relation")]


def test_documents_are_filled_or_replaced(spark):
    docs = spark.createDataFrame([("a", "s1", " "), ("b", "s2", "text"), ("c", "s2", "other"), ("d", "s3", None), ("x", "s4", "own")], "id string, slug string, value string")
    drafts = spark.createDataFrame([("n1", "s1"), ("n2", "s2"), ("n3", "s3"), ("x", "s4"), ("n5", "s5")], "doc_id string, slug string")
    w = L.written_documents(drafts, docs)
    assert {tuple(r) for r in w.collect()} == {("n1", "s1", "a", None, "fill"), ("n2", "s2", "n2", "b", "replace"), ("n3", "s3", "d", None, "fill"), ("x", "s4", "x", None, "new"), ("n5", "s5", "n5", None, "new")}
    links = spark.createDataFrame([("n1", "b"), ("n1", "gone"), ("n1", "b")], "doc_id string, target string")
    assert {(r.src, r.dst, r.kind) for r in L.written_edges(w, links, links, docs, 1).collect()} == {("a", "b", "cites"), ("a", "gone", "cites"), ("a", "b", "doc_link")}


def test_reflection_marks(spark):
    nodes, edges = [], []

    def schema(name, mass, insight=None, used=1, dead=None):
        nodes.append((name, "schema", "observed", name, None, 1, False))
        for i in range(mass):
            nodes.append((f"{name}{i}", "fact", "observed", f"plain words {i}", None, used, False))
            edges.append((name, f"{name}{i}", "abstracts"))
        if insight:
            nodes.append((f"i-{name}", "insight", "inferred", "x", None, insight, False))
            edges.extend([(f"i-{name}", name, "derived_from"), (f"i-{name}", f"{name}0", "derived_from")])
        if dead:
            nodes.append((f"{name}dead", "fact", "observed", "y", None, dead, True))
            edges.append((name, f"{name}dead", "abstracts"))

    schema("a", 10), schema("b", 9), schema("c", 7, insight=5), schema("d", 6, insight=5), schema("e", 8, insight=5, used=9), schema("f", 8, insight=5, dead=9), schema("g", 0)
    got = {r.schema_id: (r.mass, r.action) for r in L.reflections(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)).collect()}
    assert got == {"a": (10, "write"), "b": (9, "none"), "c": (7, "keep"), "d": (6, "dissolve"), "e": (8, "write"), "f": (8, "write"), "g": (0, "none")}


def test_gates(spark):
    schemas = spark.createDataFrame([("p", "p:a", 4, [1, 2]), ("p", "p:b", 3, [9, 9, 9, None]), ("q", "q:c", 3, [1]), ("r", "r:d", 9, [9, 9, 1])], "scope string, slug string, mass bigint, used array<bigint>")
    subjects = spark.createDataFrame([("p:b", 5), ("r:d", 5)], "slug string, generated_at bigint")
    assert {r.scope: (r["create"], r.refresh) for r in L.subject_gates(schemas, subjects).collect()} == {"p": (True, True), "q": (False, False), "r": (False, False)}


@pytest.mark.parametrize(
    "raw, ok",
    [
        ('{"tool":"t","args":{"a":"x","n":2.0}}', True), ('{"tool":"t","args":{"a":"x","n":2.5}}', False), ('{"tool":"t","args":{"a":"x","b":true}}', True), ('{"tool":"t","args":{"a":"x","b":1}}', False), ('{"tool":"t","args":{"a":null}}', False),
        ('{"tool":"t","args":{}}', False), ('{"tool":"u","args":{"a":"x"}}', False), ('{"tool":"t","args":{"a":"x","z":1}}', False), ('{"tool":"t","args":["a"]}', False), ('{"tool":"t"', False), ("null", False), (None, False), ('{"tool":["t"],"args":{"a":"x"}}', False), ('{"tool":"t","args":{"a":"x","n":true}}', False),
    ],
)
def test_calls(raw, ok):
    tools = {"t": {"properties": {"a": "string", "n": "integer", "b": "boolean"}, "required": ["a"]}}
    assert L.valid_call(raw, tools) == (json.loads(raw) if ok else None)


def test_remembered_routes(spark):
    claim = spark.createDataFrame([("k", "same here", EYE[0]), ("i", "something else entirely", EYE[1]), ("r", "the port is 80 now", EYE[0]), ("o", "the port is 99 again", EYE[0])], "id string, value string, embedding array<float>")
    n = [("n1", "the port is 81", EYE[0], 0.5, 0.5, 0, "the  PORT is 99 again"), ("n2", "same here", EYE[2], 0.5, 0.5, 0, None)]
    nodes = spark.createDataFrame(n, "id string, value string, embedding array<float>, s double, c double, last_access bigint, prev_value string").selectExpr("*", "sha2(value, 256) AS value_hash")
    import engramql.operators.belief as belief

    old, belief.nominate.__defaults__ = belief.nominate.__defaults__, (5, 4)
    try:
        got = {r.claim_id: (r.action, r.new_id, r.old_id, r.prev_value) for r in L.remembered(claim, nodes, 0).collect()}
    finally:
        belief.nominate.__defaults__ = old
    assert got == {"k": ("known", "n2", None, None), "i": ("insert", "r-i", None, None), "r": ("reconcile", "r-r", "n1", "the port is 81"), "o": ("oscillation", "r-o", "n1", None)}


def test_remember_revises_and_passes_write_triples(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/m")
    day = 86_400_000
    assert m.remember("the build server listens on port 8080", "s", day) == {"unrelated": 1}
    assert m.remember("the build server listens on port 9090", "s", 2 * day) == {"contradict_reconcile": 1}
    node = m.live.first()
    assert (node.value, node.prev_value, node.s, node.c) == ("the build server listens on port 9090", "the build server listens on port 8080", 0.9, 0.95) and m.live.count() == 1 and m.nodes.count() == 2
    assert m.remember("the build server listens on port 8080", "s", 3 * day) == {"contradict_oscillation": 1}
    m.remember("Redis", "s", 3 * day), m.remember("Gateway", "s", 3 * day)
    m.add(spark.createDataFrame([("Remember this. Gateway uses Redis.", "user", "s9", 4 * day, "claude-code")], "content string, role string, session_id string, ts bigint, source string"), 4 * day)
    m.consolidate(5 * day)
    names = {r.id: r.value for r in m.nodes.collect()}
    assert [(names[r.src], r.rel, names[r.dst]) for r in m.edges.where("rel = 'uses'").collect()] == [("Gateway", "uses", "Redis")]


def test_recall_follows_the_predicate_asked_for(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/m")
    m.remember("Gateway", "s", 1), m.remember("Redis", "s", 2)
    m.add(spark.createDataFrame([("Remember this now. Gateway uses Redis.", "user", "s9", 3, "claude-code")], "content string, role string, session_id string, ts bigint, source string"), 3)
    m.consolidate(4)
    found = {r.value: r.via for r in m.recall("what does Gateway use as a tool").collect()}
    assert found["Redis"] == "along"
