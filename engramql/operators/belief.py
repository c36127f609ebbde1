"""Belief revision: nomination of candidates, judging, routing and application.

Claims of a pass are nominated against the snapshot in bulk.  Claims that name
the same node depend on each other and are applied in replay order within that
node; claims of different nodes do not, so nodes are processed in parallel.
What one claim of a pass adds is seen by the next pass, not by its neighbours.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramql.config import DAY_MS, DEFAULT, Settings
from engramql.functions import scalars as S
from engramql.functions import seams
from engramql.functions.vectors import best_of, first_of_row, raw_matrix, usable
from engramql.storage import cut, read_shared, shared_files

BLOCK, PACK = 4096, 512


def nominate(claims: DataFrame, nodes: DataFrame, k: int = DEFAULT.candidate_k, dim: int = 64) -> DataFrame:
    """(claim_id, node_id, cos, pos): the k nearest nodes of each claim, exactly; ranked by cosines of six digits, given in full.

    Claims are written once, in packs of about ``PACK``; nodes stay where they
    are, and each task holds up to ``BLOCK`` of them against the packs that it
    reads one by one.  A block returns k rows a claim, so no node is shuffled.
    """
    c = claims.where(usable(F.col("embedding"), dim)).select(F.col("id").alias("claim_id"), "embedding")
    count = max(1, -(-c.count() // PACK))
    packed = c.withColumn("pack", F.pmod(F.xxhash64("claim_id"), F.lit(count))).groupBy("pack").agg(F.collect_list("claim_id").alias("ids"), F.flatten(F.collect_list("embedding")).alias("vectors"))
    files = shared_files(cut(packed, "claims"))

    def against(ids: pa.Array, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(np.argsort(np.array(ids.to_pylist(), dtype=object)))
        length = np.linalg.norm(m, axis=1)
        for pack in read_shared(files, ["ids", "vectors"]):
            a = pack.column("vectors").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            cos = (a @ m.T) / (np.linalg.norm(a, axis=1)[:, None] * length[None, :])
            near = np.round(cos, 6)  # the order below, so ties are kept whole until ids decide
            rows, cols = best_of(near, k + 1, 0.0)
            at = first_of_row(rows, near[rows, cols], order[cols], k + 1)
            rows, cols = rows[at], cols[at]
            yield pa.RecordBatch.from_arrays([pack.column("ids").flatten().take(pa.array(rows)), ids.take(pa.array(cols)), pa.array(cos[rows, cols])], names=["claim_id", "node_id", "cos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = raw_matrix(b.column("embedding"), dim).astype(np.float64)
            for s in range(0, b.num_rows, BLOCK):
                yield from against(b.column("id").slice(s, BLOCK), m[s : s + BLOCK])

    rows = nodes.where(usable(F.col("embedding"), dim)).select("id", "embedding")
    found = rows.mapInArrow(run, "claim_id string, node_id string, cos double").where("claim_id <> node_id")
    w = Window.partitionBy("claim_id").orderBy(F.round("cos", 6).desc(), "node_id")
    return found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def gated(claims: DataFrame, nominations: DataFrame, nodes: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """(claim_id, route, node_id, cos): 'confirm' for an equal value, 'unrelated' below the floor, else 'judge' with the best candidate."""
    named = nominations.join(nodes.select(F.col("id").alias("node_id"), F.col("value").alias("node_value")), "node_id").join(claims.select(F.col("id").alias("claim_id"), "value"), "claim_id")
    equal = S.normalize_value(F.col("value")) == S.normalize_value(F.col("node_value"))
    best = named.groupBy("claim_id").agg(
        F.min(F.when(equal, F.struct("pos", "node_id", F.round("cos", 6).alias("cos")))).alias("same"), F.min(F.struct("pos", "node_id", F.round("cos", 6).alias("cos"))).alias("first")
    )
    pick = F.coalesce("same", "first")
    route = F.when(F.col("same").isNotNull(), "confirm").when(F.coalesce(F.col("first.cos"), F.lit(-1.0)) < cfg.unrelated_below, "unrelated").otherwise("judge")
    return claims.select(F.col("id").alias("claim_id")).join(best, "claim_id", "left").select("claim_id", F.coalesce(route, F.lit("unrelated")).alias("route"), pick["node_id"].alias("node_id"), pick["cos"].alias("cos"))


APPLIED = "node_id string, claim_id string, action string, value string, s double, c double, last_access bigint, prev_value string, pending string, tombstoned boolean, magnitude double, seq int"


def apply_claims(decided: DataFrame, nodes: DataFrame, cfg: Settings = DEFAULT, judge: Callable[[str, str], seams.Verdict] = seams.judge_both_ways) -> DataFrame:
    """One row per claim with the node's state after it; rows of a node are in replay order (seq).

    ``decided`` has claim_id, route, node_id, value, origin, role, session_id,
    episode_id, hard_keep, salience, ts.  Claims without a candidate add a node
    of their own (its id is a digest of episode and claim, so a repeated run
    adds nothing new).  Rows come sorted by node and replay order, so a task
    keeps one node's state at a time, however many claims name it.
    """
    state = nodes.select(F.col("id").alias("node_id"), F.col("value").alias("node_value"), "s", "c", "last_access", "prev_value", "pending_contradictions")
    rows = decided.join(state, "node_id", "left")
    key = F.coalesce("node_id", F.concat(F.lit("new:"), "claim_id"))
    keyed = rows.withColumn("k", key).withColumn("first", F.coalesce("hard_keep", F.lit(False)))
    columns = ["k", "node_id", "claim_id", "route", "value", "origin", "role", "session_id", "episode_id", "ts", "node_value", "s", "c", "last_access", "prev_value", "pending_contradictions"]
    ordered = keyed.repartition("k").sortWithinPartitions("k", F.desc("first"), F.desc_nulls_last("salience"), "ts", "claim_id").select(*columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, st, seq = None, None, 0
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.k != at:
                    at, seq = r.k, 0
                    st = None if pd.isna(r.node_id) else {"value": r.node_value, "s": r.s, "c": r.c, "last": int(r.last_access or 0), "prev": r.prev_value, "pending": json.loads(r.pending_contradictions or "[]")}
                seq += 1
                row = step(st, r, cfg, judge)
                if row["node_id"] is None:
                    row["node_id"] = r.node_id
                elif st is not None and row["replaced"]:
                    at = None  # the node is gone: later claims of it start a state of their own
                row.pop("replaced")
                out.append({**row, "claim_id": r.claim_id, "seq": seq})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in APPLIED.split(", ")])

    return ordered.mapInPandas(run, APPLIED)


def step(st: dict | None, r, cfg: Settings, judge: Callable[[str, str], seams.Verdict]) -> dict:
    """Apply one claim to a node's state, which is changed in place."""
    ts = int(r.ts or 0)
    base = {"node_id": None, "action": "", "value": None, "s": 0.1, "c": 0.5, "last_access": ts, "prev_value": None, "pending": "[]", "tombstoned": False, "magnitude": 0.0, "replaced": False}

    def new(action: str, **more) -> dict:
        return base | {"node_id": f"n-{r.claim_id}", "action": action, "value": r.value} | more

    if st is None or r.route == "unrelated":
        return new("unrelated")
    verdict = seams.Verdict("confirm") if r.route == "confirm" else judge(r.value, st["value"] or "")

    def shown(action: str, magnitude: float = 0.0) -> dict:
        return base | {"action": action, "value": st["value"], "s": st["s"], "c": st["c"], "last_access": st["last"], "prev_value": st["prev"], "pending": json.dumps(st["pending"]), "magnitude": magnitude}

    if verdict.relation == "confirm":
        if r.origin == "inferred" or r.role == "assistant":
            return shown("confirm_ignored")
        decayed = st["s"] * math.exp(-cfg.decay_per_day * max(0, ts - st["last"]) / DAY_MS)
        st["s"], st["c"] = decayed + cfg.strength_gain * (1 - decayed), st["c"] + cfg.confidence_gain * (1 - st["c"])
        st["last"] = max(st["last"], ts)
        return shown("confirm")
    if verdict.relation == "extend":
        return new("extend")
    if verdict.relation == "unrelated":
        return new("unrelated")
    eff = st["s"] * math.exp(-cfg.decay_per_day * max(0, ts - st["last"]) / DAY_MS)
    resistance = eff * st["c"]
    ratio = verdict.magnitude / max(resistance, 1e-9)
    action = "hold" if ratio < cfg.band_low else "reconcile" if ratio < cfg.band_high or resistance < cfg.append_resistance else "append-new"
    norm = lambda x: " ".join((x or "").lower().split())
    if action == "reconcile" and st["prev"] and norm(st["prev"]) == norm(r.value):
        action = "hold"  # back to the value before: an oscillation
    if action == "hold":
        st["pending"].append({"episode_id": r.episode_id, "session_id": r.session_id, "origin": r.origin})
        sessions = {p.get("session_id") for p in st["pending"] if p.get("origin") != "inferred"}
        if len(sessions) < cfg.contradiction_sessions:
            return shown("contradict_hold", verdict.magnitude)
        action = "reconcile"
    if action == "append-new":
        return new("contradict_append", magnitude=verdict.magnitude)
    old = st["value"]
    st.update(prev=old, value=r.value, pending=[], last=max(st["last"], ts))
    return shown("contradict_reconcile", verdict.magnitude)


def fold_confirmations(events: DataFrame, nodes: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """(id, s, c, k): strength and confidence after a node's confirmations in order of time.

    Decay and gain make a linear recurrence, so the fold is a sum: a
    confirmation followed by m others counts gain x (1 - gain)^m, decayed from
    its time on.  No state is carried from row to row.
    """
    hits = events.where("event_type = 'confirm' AND node_id IS NOT NULL").select(F.col("node_id").alias("id"), "ts", F.col("id").alias("eid"))
    w = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("eid"))
    placed = hits.withColumn("after", F.row_number().over(w) - 1).withColumn("end", F.max("ts").over(Window.partitionBy("id")))
    keep = 1 - cfg.strength_gain
    age = (F.col("end") - F.col("ts")) / F.lit(float(DAY_MS))
    parts = placed.groupBy("id").agg(
        F.sum(F.lit(cfg.strength_gain) * F.pow(F.lit(keep), F.col("after")) * F.exp(F.lit(-cfg.decay_per_day) * age)).alias("gain"), F.count(F.lit(1)).alias("k"), F.max("end").alias("end"), F.min("ts").alias("start")
    )
    j = parts.join(nodes.select("id", "s", "c", "last_access"), "id")
    # before the first confirmation the clock does not run backwards
    since = F.greatest(F.lit(0), F.col("start") - F.col("last_access")) + F.col("end") - F.col("start")
    s = F.col("s") * F.pow(F.lit(keep), F.col("k")) * F.exp(F.lit(-cfg.decay_per_day) * since / F.lit(float(DAY_MS))) + F.col("gain")
    return j.select("id", s.alias("s"), S.strengthened_times(F.col("c"), cfg.confidence_gain, F.col("k")).alias("c"), "k")
