"""Ranked retrieval: exact cosine top-k, BM25, rank fusion, decay ranking and token budgets.

Every ranking ends in a total order (score, then id).  A single query is a
literal in the scan: no join, no shuffle but that of the final top-k.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramql.config import DEFAULT, Settings
from engramql.functions import scalars as S
from engramql.functions.vectors import raw_matrix, usable


def cosine_scores(df: DataFrame, query: Sequence[float], *carry: str) -> DataFrame:
    """(id, *carry, cos) of rows with a usable vector of the query's length.

    Vectors go to numpy in Arrow batches; arithmetic is in double precision.
    """
    dim = len(query)
    q = np.asarray(query, dtype=np.float64)
    q = q / np.linalg.norm(q) if np.linalg.norm(q) else q
    keep = ["id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = raw_matrix(b.column("embedding"), dim).astype(np.float64)
            n = np.sqrt((m * m).sum(1))
            cos = (m @ q) / np.where(n == 0, 1, n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(cos)], names=[*keep, "cos"])

    rows = df.where(usable(F.col("embedding"), dim)).select(*keep, "embedding")
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{fields}, cos double")


def top(df: DataFrame, score: str, k: int) -> DataFrame:
    """The k best rows; Spark keeps k rows a task and merges them."""
    return df.orderBy(F.round(score, 9).desc(), "id").limit(k)


def ranked(df: DataFrame, score: str, name: str = "rank") -> DataFrame:
    """Rank from 0 over few rows (a top-k result)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.round(score, 9).desc(), "id")) - 1)


def tri_state(nodes: DataFrame, query: Sequence[float], floor: float = DEFAULT.deleted_similarity) -> DataFrame:
    """One row (state, id, cos): the best live match, else the best deleted one, else 'unreachable'.

    One scan; the best row of each side is a bounded aggregate.
    """
    s = cosine_scores(nodes, query, "tombstoned")
    dead = F.coalesce("tombstoned", F.lit(False))
    best = s.agg(
        F.max(F.when(~dead & (F.col("cos") >= floor), F.struct(F.round("cos", 9).alias("cos"), F.col("id")))).alias("alive"),
        F.max(F.when(dead & (F.col("cos") >= floor), F.struct(F.round("cos", 9).alias("cos"), F.col("id")))).alias("gone"),
    )
    state = F.when(F.col("alive").isNotNull(), "ok").when(F.col("gone").isNotNull(), "deleted").otherwise("unreachable")
    pick = F.coalesce("alive", "gone")
    return best.select(state.alias("state"), pick["id"].alias("id"), F.round(pick["cos"], 6).alias("cos"))


def bm25(df: DataFrame, text: str, terms: Sequence[str], k1: float = 1.2, b: float = 0.75, prefix: bool = False) -> DataFrame:
    """(id, score) of rows that hold at least one of the terms; repeated terms count again.

    Corpus statistics are one aggregate row; a second pass scores.  Both passes
    are maps over the text column, so nothing but sums is shuffled.
    """
    tokens = df.select("id", S.fts_tokens(F.coalesce(F.col(text), F.lit(""))).alias("tok")).where(F.size("tok") > 0)
    distinct = list(dict.fromkeys(t.lower() for t in terms))

    def hits(t: str) -> Column:
        return F.size(F.filter("tok", lambda x: x.startswith(t) if prefix else x == t)).cast("double")

    counted = tokens.select("id", F.size("tok").cast("double").alias("dl"), *[hits(t).alias(f"tf{i}") for i, t in enumerate(distinct)])
    stats = counted.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(distinct))]
    )
    score = F.lit(0.0)
    for i, t in enumerate(distinct):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        tf = F.col(f"tf{i}")
        times = sum(x.lower() == t for x in terms)
        score = score + F.lit(float(times)) * idf * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")))
    some = F.greatest(*[F.col(f"tf{i}") for i in range(len(distinct))], F.lit(0.0)) > 0
    return counted.where(some).join(F.broadcast(stats)).select("id", score.alias("score"))  # stats is one row


def rrf(lists: Sequence[tuple[DataFrame, float]], k: int = DEFAULT.rrf_k) -> DataFrame:
    """(id, score): reciprocal rank fusion of lists (id, rank from 0) with their weights."""
    parts = [df.select("id", (F.lit(w) / (F.lit(k) + F.col("rank") + 1)).alias("part")) for df, w in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.sum("part").alias("score"))


def hybrid(nodes: DataFrame, query: Sequence[float], terms: Sequence[str], k: int, text: str = "value", strength: Column | None = None, cfg: Settings = DEFAULT) -> DataFrame:
    """(id, fused, cos): cosine and BM25 candidates (3k each) fused, cosine 0 for text-only ones.

    With ``strength`` and a positive weight the strongest rows are a third list.
    """
    cos = ranked(top(cosine_scores(nodes, query), "cos", 3 * k), "cos")
    words = ranked(top(bm25(nodes, text, terms), "score", 3 * k), "score")
    lists = [(cos, 1.0), (words, 1.0)]
    if strength is not None and cfg.fuse_strength > 0:
        lists.append((ranked(top(nodes.select("id", strength.alias("st")), "st", 3 * k), "st"), cfg.fuse_strength))
    fused = rrf(lists, cfg.rrf_k).withColumnRenamed("score", "fused")
    return top(fused.join(cos.select("id", "cos"), "id", "left").select("id", "fused", F.coalesce("cos", F.lit(0.0)).alias("cos")), "fused", k)


def temporal_slots(df: DataFrame, dated: str) -> DataFrame:
    """Dated rows exchanged among their places so that the newest comes first; ``df`` has rank and is a top-k result."""
    is_dated = F.col(dated).isNotNull()
    slots = df.where(is_dated).select(F.col("rank").alias("slot"), F.row_number().over(Window.orderBy("rank")).alias("pos"))
    order = df.where(is_dated).withColumn("pos", F.row_number().over(Window.orderBy(F.col(dated).desc(), "rank"))).drop("rank")
    moved = order.join(slots, "pos").drop("pos").withColumnRenamed("slot", "rank")
    return moved.unionByName(df.where(~is_dated))


def cueless_base(live: DataFrame, now_ms: int, cfg: Settings = DEFAULT) -> DataFrame:
    score = F.lit(cfg.rank_w_strength) * S.effective_strength(F.col("s"), F.col("last_access"), now_ms, cfg.decay_per_day) + F.lit(cfg.rank_w_recency) * S.recency(
        F.col("last_access"), now_ms, cfg.decay_per_day
    )
    return live.withColumn("base", score)


def spread(base: DataFrame, edges: DataFrame, live: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """(id, score): base scores and one hop of activation from the best seeds.

    Seeds are few (a constant), so Spark ships them to the edges; boosts add to
    a snapshot of the scores, so the order of edges does not matter.
    """
    seeds = base.select("id", "base").orderBy(F.round("base", 9).desc(), "id").limit(cfg.spread_seeds)
    boosts = (
        edges.join(F.broadcast(seeds.withColumnRenamed("id", "src")), "src")  # at most spread_seeds rows
        .select(F.col("dst").alias("id"), (F.col("base") * F.col("w") * F.lit(cfg.spread_decay)).alias("boost"))
        .groupBy("id").agg(F.sum("boost").alias("boost"))
        .join(live.select("id"), "id", "left_semi")
    )
    return base.select("id", "base").join(boosts, "id", "full").select("id", (F.coalesce("base", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).alias("score"))


def within_budget(scored: DataFrame, budget_chars: int, kept: str = "hard", length: str = "chars") -> DataFrame:
    """Kept rows always; others by score until the first that no longer fits.

    Lengths add up along the order, so the rows that fit are a prefix.  Of rows
    of positive length it has at most ``budget_chars``, so a top-k of one more
    holds the first that does not fit; only it is summed in one task.  Every
    row before that one is taken, rows of no length included.
    """
    keep = scored.where(F.col(kept))
    used = keep.agg(F.coalesce(F.sum(length), F.lit(0)).alias("used"))
    others = scored.where(~F.col(kept)).withColumn("place", F.struct((-F.round("score", 9)).alias("score"), "id"))
    first = others.where(F.col(length) > 0).select("place", length).orderBy("place").limit(budget_chars + 1)
    total = F.sum(length).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    over = first.withColumn("total", total).join(F.broadcast(used)).where(F.col("total") + F.col("used") > budget_chars)  # used is one row
    end = F.broadcast(over.agg(F.min("place").alias("end")).join(used))  # one row
    fits = F.coalesce(F.col("place") < F.col("end"), F.col("used") <= budget_chars)
    return keep.unionByName(others.join(end).where(fits).select(*scored.columns))


def injected_text(chosen: DataFrame, limit_chars: int) -> DataFrame:
    """One row (text): lines in rank order, '[keep]' before kept ones, cut at the last line that fits whole."""
    line = F.concat(F.when(F.col("hard"), "[keep] ").otherwise(""), F.col("value"))
    rows = chosen.select(F.struct((~F.col("hard")).alias("h"), (-F.round("score", 9)).alias("s"), "id", line.alias("line")).alias("r"))
    rows = rows.orderBy("r").limit(limit_chars + 2)  # each line takes a character at least, so no more can be seen
    text = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "\n").alias("text"))
    head = F.substring("text", 1, limit_chars)
    clipped = F.regexp_replace(head, r"\n[^\n]*$", "")
    return text.select(F.when(F.length("text") <= limit_chars, F.col("text")).otherwise(clipped).alias("text"))


def surface_rank(due: DataFrame, nodes: DataFrame, now_ms: int, cap: int = 5, grace_ms: int = 3 * 3_600_000) -> DataFrame:
    """Dated live nodes by tier and score; the later tier is capped by what was shown in the last day.

    An occurrence counts against the cap where it was shown (``surfaced_ms``)
    within the last day, its outcome is open ('surfaced' or 'seen') and it was
    due a day or more after it was shown; others bypassed the cap then.
    """
    seen = F.col("outcome")
    hidden = seen.isin("completed", "dismissed", "surfaced", "seen") | ((seen == "snoozed") & (F.col("snooze_until_ms") > now_ms))
    open_ = due.where((F.col("due_ms") >= now_ms - grace_ms) | F.col("recurrence_rule").isNotNull()).where(~F.coalesce(hidden, F.lit(False)))
    scored = open_.join(nodes.select(F.col("id").alias("node_id"), "s"), "node_id").select(
        "node_id", "action_type", S.surface_tier(F.col("due_ms"), now_ms).alias("tier"), S.surface_score(F.col("due_ms"), F.col("s"), now_ms).alias("score")
    )
    counts = seen.isin("surfaced", "seen") & (F.col("surfaced_ms") >= now_ms - 86_400_000) & (F.col("due_ms") - F.col("surfaced_ms") >= 86_400_000)
    shown = due.where(counts).agg(F.count(F.lit(1)).alias("shown"))
    w = Window.partitionBy("tier").orderBy(F.round("score", 9).desc(), "node_id")
    # tiers are two, so the capped one is cut to the cap before it is ranked
    later = scored.where("tier = 1").orderBy(F.round("score", 9).desc(), "node_id").limit(cap)
    placed = scored.where("tier = 0").unionByName(later).withColumn("pos", F.row_number().over(w)).join(F.broadcast(shown))  # shown is one row
    return placed.where((F.col("tier") == 0) | (F.col("pos") <= F.greatest(F.lit(0), F.lit(cap) - F.col("shown")))).select("node_id", "action_type", "tier", F.round("score", 6).alias("score"))


def same_topk(a: list[tuple[str, float]], b: list[tuple[str, float]], tolerance: float = 1e-6) -> bool:
    """Whether two top-k results are equal up to ties at the last score."""
    if len(a) != len(b):
        return False
    if not a:
        return True
    last = min(min(s for _, s in a), min(s for _, s in b))
    sure = lambda xs: {i for i, s in xs if s > last + tolerance}
    return sure(a) == sure(b)
