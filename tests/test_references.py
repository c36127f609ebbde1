from datetime import datetime as dt

from engramql.operators import references as R

EDGE = "src string, dst string, rel string, landed_at timestamp, extra string"
NODE = "id string, tombstoned boolean, landed_at timestamp, src string"
EPISODE = "id string, source_inference_id string, landed_at timestamp, key string"


def t(day):
    return dt(2025, 1, day)


def tables(spark, nodes, edges, episodes):
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), spark.createDataFrame(episodes, EPISODE)


def test_states(spark):
    node, edge, episode = tables(
        spark,
        [("a", False, t(1), ""), ("b", False, t(1), ""), ("b", True, t(3), ""), ("c", False, t(9), ""), ("d", None, t(1), None), ("e", True, t(1), ""), ("e", False, t(2), "")],
        [("a", " B ", "x", t(2), "q"), ("a", " B ", "x", t(4), "q"), ("a", "b", "x", t(2), None), ("c", "a", "x", t(5), ""), ("a", "zz", None, t(2), ""), ("", None, "x", t(2), ""), ("A", "d", "x", t(2), ""), ("e", "e", "x", t(2), "")],
        [("p", None, t(2), ""), ("q", "P", t(1), ""), ("r", " ", t(1), ""), ("s", "gone", t(1), ""), ("s", None, t(1), ""), (None, "p", t(3), "")],
    )
    found = {tuple(r) for r in R.find_orphans(node, edge, episode).select("field", "from_id", "to_id", "rel", "state").collect()}
    assert found == {
        ("edge.dst", "a", " B ", "x", "deleted"),
        ("edge.dst", "a", "b", "x", "deleted"),
        ("edge.src", "c", "a", "x", "late"),
        ("edge.dst", "a", "zz", None, "missing"),
        ("edge.src", "", None, "x", "missing"),
        ("edge.dst", "", None, "x", "missing"),
        ("episode.source_inference_id", "q", "P", "", "late"),
        ("episode.source_inference_id", "s", "gone", "", "missing"),
    }
    report = {(r.field, r.month, r.state): r.n for r in R.orphan_report(node, edge, episode).collect()}
    assert report[("edge.dst", "2025-01", "deleted")] == 2 and sum(report.values()) == 8


def test_deltas_add_up(spark):
    node, edge, episode = tables(spark, [("a", False, t(1), "")], [("a", "b", "x", t(2), "")], [])
    refs = R.edge_references(edge)
    state = R.apply_deltas(R.node_existence(node), R.reference_deltas(refs))
    assert {r.key for r in R.orphan_keys(state).collect()} == {"b"}
    later = R.apply_deltas(state, R.node_existence(spark.createDataFrame([("b", False, t(5), "")], NODE)))
    assert R.orphan_keys(later).count() == 0
    withdrawn = R.apply_deltas(state, R.reference_deltas(refs, -1))
    assert R.orphan_keys(withdrawn).count() == 0


def test_empty_tables(spark):
    assert R.find_orphans(*tables(spark, [], [], [])).count() == 0


def test_hot_key(spark):
    nodes = [("hot", True, t(1), "")] + [(f"n{i}", False, t(1), "") for i in range(300)]
    edges = [(f"n{i}", "hot", "x", t(2), "") for i in range(300)]
    assert R.find_orphans(*tables(spark, nodes, edges, [])).where("state = 'deleted'").count() == 300


def test_state_follows_later_rows(spark):
    """Tombstone -1, return +1, repeats and old rows 0; the folded state equals that of all rows at once."""
    node, edge, _ = tables(spark, [("a", False, t(1), "")], [("x", "A ", "r", t(2), "")], [])
    none = R.episode_references(spark.createDataFrame([], EPISODE))
    held = R.edge_references(edge).where("field = 'edge.dst'").select(*R.HELD, "at")
    state = R.apply_deltas(R.node_existence(node), R.reference_deltas(held))
    seen_nodes, seen_edges = [("a", False, t(1), "")], [("x", "A ", "r", t(2), "")]

    def step(nodes, edges):
        nonlocal state, held
        seen_nodes.extend(nodes)
        seen_edges.extend(edges)
        n, e, _ = tables(spark, nodes, edges, [])
        refs = R.edge_references(e).where("field = 'edge.dst'").unionByName(none)
        state, held = R.advance(state, held, refs, R.node_existence(n), R.episode_existence(spark.createDataFrame([], EPISODE)))
        rows = {r.key: (r.refs, r.live) for r in state.collect()}
        n, e, _ = tables(spark, seen_nodes, seen_edges, [])
        whole = R.apply_deltas(R.node_existence(n), R.reference_deltas(R.edge_references(e).where("field = 'edge.dst'")))
        assert rows == {r.key: (r.refs, r.live) for r in whole.collect()}
        return rows["a"], {r.key for r in R.orphan_keys(state).collect()}

    assert step([("a", True, t(3), "")], []) == ((1, 0), {"a"})
    assert step([("a", True, t(3), "")], [("x", "A ", "r", t(2), ""), ("x", "A ", "r", t(4), "")]) == ((1, 0), {"a"})
    assert step([("a", False, t(2), "")], [("x", "a", "r", t(4), "")]) == ((2, 0), {"a"})
    assert step([("a", False, t(5), "")], [("y", "b", None, t(4), "")]) == ((2, 1), {"b"})
    assert step([("b", False, t(6), "")], [("y", "b", None, t(4), "")]) == ((2, 1), set())
    state, held = R.withdraw(state, held, held.where("to_id = 'a'"))
    assert {r.key: r.refs for r in state.collect()} == {"a": 1, "b": 1} and held.count() == 2
