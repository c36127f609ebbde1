"""edge_upsert: halves of weights add up to ties of the fourth digit, and rel can be null."""

import datetime
import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tests.oracle import compare

COLUMNS = {"src": pa.string(), "dst": pa.string(), "rel": pa.string(), "w": pa.float64(), "last_access": pa.int64(), "kind": pa.string(), "landed_at": pa.timestamp("us")}


def write(folder, rows):
    """Rows of (src, dst, rel, w)."""
    t = datetime.datetime(2026, 1, 1)
    full = [dict(zip(COLUMNS, (*r, 1, "relation", t))) for r in rows]
    pq.write_table(pa.Table.from_pylist(full, schema=pa.schema(list(COLUMNS.items()))), f"{folder}/edge.parquet")
    return str(folder)


@pytest.fixture
def layout(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda parts: spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    for k, v in before.items():
        spark.conf.set(k, v)


def test_ties_do_not_depend_on_the_layout(spark, tmp_path, layout):
    rng = random.Random(7)
    rows, want = [], {}
    for case in range(8):
        units = [rng.randrange(1000, 10000) for _ in range(200)]
        units[0] += 1 - sum(units) % 2  # odd, so that the sum of the halves ends with 5 in the fifth place
        rows += [(f"{case}a{i}", "b", "uses", u / 10000) for i, u in enumerate(units)]
        folder = tmp_path / str(case)
        folder.mkdir()
        want[write(folder, rows[-200:])] = float((Decimal(sum(units)) / 20000).quantize(Decimal("0.0001"), ROUND_HALF_UP))
    for parts in (1, 3):
        layout(parts)
        got = {f: entry.queries()["edge_upsert"](spark, f).collect()[0].w for f in want}
        assert got == want


def test_null_rel_and_values_beyond_decimals(spark, tmp_path):
    rows = [
        ("a", "b", None, 0.5), ("a", "b", "uses", 0.3), ("a", "c", "uses", None), ("a", "c", "ref", 0.3), ("a", "b", "cites", math.nan), ("a", "c", "cites", 0.3),
        ("a", "b", "extends", math.inf), ("a", "b", "prefers", 1e300), ("a", "b", "runs_on", 1e-300), ("a", "b", "part_of", None), ("a", "b", "built_by", -0.25),
    ]
    got, want, *_ = compare(spark, "edge_upsert", entry.queries()["edge_upsert"], entry.oracle_sql()["edge_upsert"], write(tmp_path, rows))
    assert got == want and len(got[1]) == 7
