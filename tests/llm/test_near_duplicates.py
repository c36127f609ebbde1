import random
from datetime import datetime

import numpy as np
import pytest
import regex

import __spark_entry__ as entry
from engramql.llm import near_duplicates as N
from tests.oracle import compare

WORDS = regex.compile(r"[\p{L}\p{N}]+")
SCHEMA = "rec_kind string, id string, text string, words string, cls string, a bigint"


def brute(rows, least=16):
    sets = [(k, i, set(WORDS.findall(t.lower()))) for k, i, t in rows if t is not None and i is not None]
    sets = [x for x in sets if len(x[2]) >= least]
    out = set()
    for x in range(len(sets)):
        for y in range(x + 1, len(sets)):
            a, b = sets[x], sets[y]
            n = len(a[2] & b[2])
            if a[0] == b[0] and 10 * n >= 7 * (len(a[2]) + len(b[2]) - n):
                out.add((a[0], min(a[1], b[1]), max(a[1], b[1])))
    return out


def corpus(seed, n=220):
    r = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    rare = [f"w{i}é" for i in range(90)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            words = rows[r.randrange(len(rows))][2].split()
            for _ in range(r.randint(0, 6)):
                at = r.randrange(len(words))
                words[at] = r.choice([r.choice(rare), "", r.choice(common), words[at].upper()])
            if r.random() < 0.3:
                r.shuffle(words)
        else:
            words = r.sample(rare, r.randint(6, 30)) + common[: r.randint(4, 12)]
        rows.append((r.choice(["node", "episode"]), f"id{i:04d}", " ".join(w for w in words if w)))
    return rows


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    got = [tuple(x) for x in N.near_pairs(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed, cell", [(1, 1500), (2, 1500), (3, 4), (4, 1)])
def test_against_brute_force(spark, monkeypatch, seed, cell):
    """Also with tiny cells, where two to four words make a cell."""
    monkeypatch.setattr(N, "CELL", cell)
    rows = corpus(seed)
    want = brute(rows)
    assert want and found(spark, rows) == want


def test_nulls_copies_and_long_texts(spark):
    base = " ".join(f"t{i}" for i in range(20))
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [("node", f"c{i}", base) for i in range(30)] + [("node", None, base), ("node", "n", None), ("node", "e", ""), ("node", "s", "too short"), ("episode", "c0", base), ("node", "l1", long), ("node", "l2", long + " and more")]
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == set()
    assert N.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bound_is_never_above_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(-(2**62), 2**62, 80)
        a, b = (np.unique(rng.choice(pool, rng.integers(16, 60))) for _ in range(2))
        bound = int(np.bitwise_count(N.unary_counts(a) ^ N.unary_counts(b)).sum())
        assert bound <= len(np.setxor1d(a, b))


def test_last_value_counts(spark):
    t = lambda d: datetime(2025, 1, d)
    node = spark.createDataFrame([("a", "old", t(1), 1), ("a", "new", t(2), 1), (None, "x", t(1), 1), ("b", None, t(1), 1)], "id string, value string, landed_at timestamp, text bigint")
    episode = spark.createDataFrame([("a", "e", t(1)), ("a", "e", t(1))], "id string, content string, landed_at timestamp")
    assert {tuple(r) for r in N.word_records(node, episode).collect()} == {("node", "a", "new"), ("episode", "a", "e")}


def test_groups(spark):
    words = [f"t{i}" for i in range(40)]
    chain = [" ".join(words[i : i + 30]) for i in range(0, 10, 3)]
    rows = [("node", f"n{i}", t) for i, t in enumerate(chain)] + [("node", "copy", chain[0]), ("node", "alone", " ".join(f"q{i}" for i in range(20)))]
    got = {r.id: r for r in N.near_groups(spark.createDataFrame([(*r, "", "", 0) for r in rows], SCHEMA)).collect()}
    assert len({got[f"n{i}"].group_id for i in range(4)}) == 1
    assert got["copy"].class_id == got["n0"].class_id == "copy" and got["copy"].links == got["n0"].links == 1
    assert got["n1"].links == 2 and got["alone"].links == 0 and got["alone"].group_id == "alone"


def test_query_against_sql(spark, data):
    a, b, *_ = compare(spark, "p1_found", entry.queries()["p1_found"], entry.oracle_sql()["p1_found"], data)
    assert a == b
