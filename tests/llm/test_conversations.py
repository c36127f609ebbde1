import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

import __spark_entry__ as entry
from engramql.llm import conversations as C
from tests.oracle import compare

SCHEMA = "id string, ts bigint, role string, source string, external_id string, session_id string, landed_at timestamp, content string, rank string, part string"
T0 = datetime(2025, 1, 1)


def table(spark, rows):
    return spark.createDataFrame([(*r, "?", None) for r in rows], SCHEMA)


def row(i, ts, role, session, content="hi", source="telegram", ext=None, day=0):
    return (i, ts, role, source, ext, session, T0 + timedelta(days=day), content)


def reasons(spark, rows):
    return {r.session_id: r.reason for r in C.left_out_sessions(table(spark, rows)).collect()}


def test_reasons(spark):
    rows = [
        row("1", 10, "User", "ok"), row("2", 10, "tool", " OK "), row("3", 10, "A.I.", "ok"),
        row("4", 1, "user", "empty", " \n"), row("5", 2, "assistant", "empty", None),
        row("6", 1, "narrator", "bad"), row("7", 1, "user", "badts"), row("8", None, "assistant", "badts"), row("9", 0, "user", "zero"),
        row("10", 5, "assistant", "headless"), row("11", 6, "human", "headless"), row("12", 1, "user", "open"), row("13", 2, "assistant", "open"), row("14", 3, "user", "open"),
        row("15", 1, "user", "gap"), row("16", 2, "tool", "gap"), row("17", 3, "user", "gap"), row("18", 4, "assistant", "gap"),
        row("19", 1, "user", "other", source="gmail"), row("20", 1, "user", " "), row("21", 1, "user", None),
        row("22", 1, None, "nullrole"), row("23", 1, "user", "ignored"), row("24", 2, "narrator", "ignored", ""), row("25", 3, "assistant", "ignored"),
    ]
    assert reasons(spark, rows) == {"empty": "empty", "bad": "broken", "badts": "broken", "zero": "broken", "headless": "broken", "open": "unanswered", "gap": "unanswered", "nullrole": "broken"}


def test_repeats_are_one_message(spark):
    rows = [
        row("a", 1, "user", "s", day=1), row("a", 9, "narrator", "s", day=2), row("b", 2, "assistant", "s", ext="x", day=1), row("c", 3, "user", "s", ext="x", day=2),
        row("d", 4, "user", "t", ext="x", source="conversation", day=0), row("e", 5, "ai", "t", day=0),
    ]
    assert reasons(spark, rows) == {}
    turns = C.conversations(table(spark, rows)).orderBy("session_id", "turn").collect()
    assert [(r.session_id, r.turn, r.id, r.role) for r in turns] == [("s", 0, "a", "user"), ("s", 1, "b", "assistant"), ("t", 0, "d", "user"), ("t", 1, "e", "assistant")]


def plain(messages):
    """The rules one message after the other."""
    kept = [m for m in messages if m[2]]
    if not kept:
        return "empty"
    if any(r == 3 or t <= 0 for t, r, _ in kept) or kept[0][1] != 0:
        return "broken"
    waiting = False
    for _, r, _ in kept:
        if r == 0:
            if waiting:
                return "unanswered"
            waiting = True
        elif r == 2:
            waiting = False
    return "unanswered" if waiting else None


@pytest.mark.parametrize("seed", range(30))
def test_runs_compose(spark, seed):
    """Summaries of any cut into runs fold to what the rules say."""
    r = random.Random(seed)
    sessions = {f"s{k}": [(r.choice([1, 1, 1, 1, 1, 1, 1, 0]) * (n + 1), r.choices([0, 1, 2, 3], [4, 2, 4, 0.2])[0], r.random() < 0.8) for n in range(r.randint(1, 9))] for k in range(40)}
    frame = pd.DataFrame([(s, t, rank, has) for s, ms in sorted(sessions.items()) for t, rank, has in ms], columns=["session_id", "ts", "rank", "has_text"])
    cuts = sorted(r.sample(range(1, len(frame)), 12))
    parts = []
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(frame)])):
        s = C.run_summaries(frame.iloc[a:b].reset_index(drop=True))
        parts.append(s.assign(part=n // 3, run=n % 3))
    df = pd.concat(parts)[[c.split()[0] for c in C.SUMMARY.split(", ")]]
    if seed < 5:
        got = {x.session_id: x.reason for x in C.fold(spark.createDataFrame(df, C.SUMMARY)).collect()}
        assert got == {s: plain(ms) for s, ms in sessions.items()}
    whole = C.run_summaries(frame)
    assert dict(zip(whole["session_id"], whole["n"])) == {s: sum(h for *_, h in ms) for s, ms in sessions.items()}


def test_one_large_session(spark):
    rows = [row(f"{i:05d}", i + 1, ("user", "assistant")[i % 2], "hot") for i in range(4000)] + [row("z", 1, "user", "x"), row("y", 2, "ai", "x")]
    t = C.conversations(table(spark, rows).repartition(7))
    turns = [(r.turn, r.id) for r in t.where("session_id = 'hot'").orderBy("turn").collect()]
    assert turns == [(i, f"{i:05d}") for i in range(4000)]


def test_empty(spark):
    assert reasons(spark, []) == {} and C.conversations(table(spark, [])).count() == 0


def test_query_against_sql(spark, data):
    a, b, *_ = compare(spark, "p4_found", entry.queries()["p4_found"], entry.oracle_sql()["p4_found"], data)
    assert a == b


@pytest.mark.parametrize("name", ["p4_turns", "p6_clusters", "p1_groups"])
def test_tables_against_sql(spark, data, name):
    a, b, *_ = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], data)
    assert a == b
