"""Aggregates over the event log, the ledger and evaluation results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger_totals(ledger: DataFrame, since_ms: int) -> DataFrame:
    """Per feature and in total (feature null): recent and all-time sums, from one pass."""
    recent = F.col("ts") >= since_ms
    sums = []
    for c in ("input_tokens", "output_tokens", "cache_tokens", "cost"):
        value = F.sum(c) if c != "cost" else F.round(F.sum(c), 2)
        part = F.sum(F.when(recent, F.col(c)).otherwise(0)) if c != "cost" else F.round(F.sum(F.when(recent, F.col(c)).otherwise(0.0)), 2)
        sums += [value.alias(c), part.alias(f"recent_{c}")]
    return ledger.rollup("feature_tag").agg(F.count(F.lit(1)).alias("calls"), *sums)


def rounded_sum(c: str, digits: int) -> Column:
    """Sum of doubles, rounded half up, the same in any order of rows: added as decimals of 18 places, so a tie is no matter of chance.

    A group with a value that such a decimal cannot hold (not finite, 10^10 or more) is added as doubles.
    """
    held = F.col(c).try_cast("decimal(28,18)")
    return F.when(F.count(c) == F.count(held), F.round(F.sum(held), digits).cast("double")).otherwise(F.round(F.sum(c), digits))


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, truth: str, guess: str, labels: Sequence[str]) -> DataFrame:
    """One row per true label, one column per guessed label."""
    hits = [F.sum((F.col(guess) == x).cast("bigint")).alias(f"as_{x}") for x in labels]
    return df.groupBy(truth).agg(*hits)


def accuracy(df: DataFrame, category: str, correct: Column) -> DataFrame:
    """Share of correct rows per category and in total (category null)."""
    return df.rollup(category).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(correct.cast("double")), 6).alias("accuracy"))


def percentiles(df: DataFrame, group: str, value: str, points: Sequence[int]) -> DataFrame:
    """(group, p, nearest, floor): nearest rank (ceil(p/100 n) - 1) and floor rank (floor(p/100 n)), both exact.

    Ranks come from a window per group, so the values are sorted once.
    """
    w = Window.partitionBy(group).orderBy(value)
    placed = df.where(F.col(value).isNotNull()).select(group, value, (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(group)).alias("n"))
    p = placed.withColumn("p", F.explode(F.array(*[F.lit(x) for x in points])))
    near = F.greatest(F.lit(0), F.ceil(F.col("p") * F.col("n") / 100) - 1)
    low = F.least(F.col("n") - 1, F.floor(F.col("p") * F.col("n") / 100))
    return p.groupBy(group, "p").agg(F.max(F.when(F.col("i") == near, F.col(value))).alias("nearest"), F.max(F.when(F.col("i") == low, F.col(value))).alias("floor"))


def breakeven(write: Column, save: Column, points: Sequence[int]) -> Column:
    """Exploded (n, net) of what remains of a cost after n uses."""
    return F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.round(write - save * n, 4).alias("net")) for n in points]))


def terciles(df: DataFrame, key: str, by: str) -> DataFrame:
    """(key, by, tercile) as ntile(3) over (by, key).

    A global ntile would sort in one task; places are counted per value of
    ``by`` instead (few distinct values), and rows are ranked within a value.
    """
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("m"))
    w = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    # degrees have few distinct values compared with rows: this window is over them
    start = sizes.withColumn("start", F.coalesce(F.sum("m").over(w), F.lit(0))).withColumn("n", F.sum("m").over(Window.partitionBy()))
    placed = df.join(start, by).withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(key)) + F.col("start"))
    small, extra = F.floor(F.col("n") / 3), F.col("n") % 3
    wide = extra * (small + 1)
    tile = F.when(F.col("pos") <= wide, F.floor((F.col("pos") - 1) / (small + 1)) + 1).otherwise(extra + F.floor((F.col("pos") - wide - 1) / small) + 1)
    return placed.select(key, by, tile.cast("int").alias("tercile"))


def sweep(df: DataFrame, score: str, thresholds: Sequence[float], wanted: float) -> DataFrame:
    """(threshold, pass_rate, chosen): share at or above each threshold; chosen marks the highest with ``wanted`` or more."""
    grid = df.where(F.col(score).isNotNull()).select(score, F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    rates = grid.groupBy("threshold").agg(F.round(F.avg((F.col(score) >= F.col("threshold")).cast("double")), 6).alias("pass_rate"))
    best = rates.where(F.col("pass_rate") >= wanted).agg(F.max("threshold").alias("best"))
    return rates.join(F.broadcast(best)).select("threshold", "pass_rate", F.coalesce(F.col("threshold") == F.col("best"), F.lit(False)).alias("chosen"))  # best is one row


def bands(df: DataFrame, score: str, edges: Sequence[float], per_band: int, key: str) -> DataFrame:
    """The first ``per_band`` rows of each score band [edge, next edge)."""
    band = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:]):
        band = F.when((F.col(score) >= lo) & (F.col(score) < hi), f"{lo}-{hi}").otherwise(band)
    w = Window.partitionBy("band").orderBy(F.round(score, 9).desc(), key)
    return df.withColumn("band", band).where("band IS NOT NULL").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= per_band).drop("pos")


def rank_metrics(df: DataFrame, rank: str, group: str) -> DataFrame:
    """(group, n, top1, top3, mean_rank) over ranks, null for not found."""
    r = F.col(rank)
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.coalesce((r <= 1).cast("double"), F.lit(0.0))), 6).alias("top1"),
        F.round(F.avg(F.coalesce((r <= 3).cast("double"), F.lit(0.0))), 6).alias("top3"),
        F.round(F.avg(r), 6).alias("mean_rank"),
    )


def recall_at(found: DataFrame, gold: DataFrame, key: str, item: str, ks: Sequence[int]) -> DataFrame:
    """(k, recall): share of keys with a wanted item among their first k."""
    hit = found.join(gold, [key, item], "left_semi").groupBy(key).agg(F.min("rank").alias("first"))
    all_keys = gold.select(key).distinct().join(hit, key, "left")
    grid = all_keys.select("first", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return grid.groupBy("k").agg(F.round(F.avg(F.coalesce((F.col("first") <= F.col("k")).cast("double"), F.lit(0.0))), 6).alias("recall"))


def ring(df: DataFrame, most: int, order: str = "id") -> DataFrame:
    """The newest ``most`` rows: a top-k, so nothing else is kept."""
    return df.orderBy(F.col(order).desc()).limit(most)


def daily_cap(df: DataFrame, at: str, most: int, key: str = "id") -> DataFrame:
    """The first ``most`` rows of each UTC day of an epoch-millisecond column."""
    day = F.floor(F.col(at) / 86_400_000)
    w = Window.partitionBy("day").orderBy(at, key)
    return df.withColumn("day", day).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).drop("day", "pos")
