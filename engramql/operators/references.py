"""Orphan references: keys that are referred to and do not exist.

State per (target, key) is a pair of signed counts kept from change deltas:
``refs`` (references that hold) and ``live`` (1 while a live target exists,
else 0), with ``known`` (1 once any row with the key landed) and the landing
times of the first and the last such row.  Deltas of any kind are unioned and
summed per key, so the state is one partial aggregation and one shuffle,
whatever the number of references to a hot key.  Keys with positive ``refs``
and no ``live`` form the current orphan report.

Later rows are folded in without a second look at old rows: existence deltas
are taken against the stored state (+1 for a key that comes to life, -1 for a
tombstone, 0 for what changes nothing or is older than what is stored), and
reference deltas only from references that are not held yet (``advance``), so
a row delivered again adds nothing.

Null, empty and blank ends are references to nothing (state 'missing'); rows
delivered again add no reference.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramql.functions.text import blank, match_key

STATE = ["target", "key", "refs", "live", "known", "first_at", "last_at"]
HELD = ["target", "key", "field", "from_id", "to_id", "rel"]


def edge_references(edge: DataFrame) -> DataFrame:
    """(target, key, field, from_id, to_id, rel, at): both ends of each written edge.

    A written (src, dst, rel) counts once, from its first landing on.
    """
    written = edge.groupBy("src", "dst", "rel").agg(F.min("landed_at").alias("at"))
    ends = F.array(
        F.struct(F.lit("edge.src").alias("field"), match_key(F.col("src")).alias("key")),
        F.struct(F.lit("edge.dst").alias("field"), match_key(F.col("dst")).alias("key")),
    )
    return written.withColumn("end", F.explode(ends)).select(
        F.lit("node").alias("target"), F.coalesce("end.key", F.lit("")).alias("key"), "end.field",
        F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "rel", "at",
    )


def episode_references(episode: DataFrame) -> DataFrame:
    """References of episodes to the episode they were inferred from.

    Null or blank is no reference.  The landing time is that of the first row
    of the referring episode, with or without the reference.
    """
    own = episode.select(match_key(F.col("id")).alias("own"), "id", "source_inference_id", "landed_at")
    first = own.groupBy("own").agg(
        F.min("landed_at").alias("at"),
        F.collect_set(F.when(~blank(F.col("source_inference_id")), F.struct("id", "source_inference_id"))).alias("held"),
    )
    return first.withColumn("h", F.explode("held")).select(
        F.lit("episode").alias("target"), match_key(F.col("h.source_inference_id")).alias("key"),
        F.lit("episode.source_inference_id").alias("field"),
        F.col("h.id").alias("from_id"), F.col("h.source_inference_id").alias("to_id"), F.lit("").alias("rel"), "at",
    )


def node_existence(node: DataFrame) -> DataFrame:
    """What the rows say of each node, as deltas to an empty state: live 1, or 0 where the last row is a tombstone."""
    return node.groupBy(match_key(F.col("id")).alias("key")).agg(
        F.min("landed_at").alias("first_at"), F.max("landed_at").alias("last_at"),
        F.max_by(F.coalesce("tombstoned", F.lit(False)), F.struct("landed_at", F.coalesce("tombstoned", F.lit(False)))).alias("dead"),
    ).where("key IS NOT NULL").select(
        F.lit("node").alias("target"), "key", F.lit(0).cast("bigint").alias("refs"),
        F.when(F.col("dead"), 0).otherwise(1).cast("bigint").alias("live"), F.lit(1).cast("bigint").alias("known"), "first_at", "last_at",
    )


def episode_existence(episode: DataFrame) -> DataFrame:
    """Existence deltas of episodes, which are never deleted."""
    return episode.groupBy(match_key(F.col("id")).alias("key")).agg(F.min("landed_at").alias("first_at"), F.max("landed_at").alias("last_at")).where("key IS NOT NULL").select(
        F.lit("episode").alias("target"), "key", F.lit(0).cast("bigint").alias("refs"),
        F.lit(1).cast("bigint").alias("live"), F.lit(1).cast("bigint").alias("known"), "first_at", "last_at",
    )


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """Reference deltas; ``sign=-1`` takes withdrawn references back."""
    return refs.select(
        "target", "key", F.lit(sign).cast("bigint").alias("refs"), F.lit(0).cast("bigint").alias("live"),
        F.lit(0).cast("bigint").alias("known"), F.lit(None).cast("timestamp").alias("first_at"), F.lit(None).cast("timestamp").alias("last_at"),
    )


def apply_deltas(*deltas: DataFrame) -> DataFrame:
    """Sum deltas (and an earlier state, which has the same columns) per key."""
    total = deltas[0].select(*STATE)
    for d in deltas[1:]:
        total = total.unionByName(d.select(*STATE))
    return total.groupBy("target", "key").agg(
        F.sum("refs").alias("refs"), F.sum("live").alias("live"), F.max("known").alias("known"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )


def existence_deltas(existence: DataFrame, state: DataFrame) -> DataFrame:
    """Signed deltas of later rows (``node_existence`` or ``episode_existence`` of them) against a stored state.

    Rows older than the last one stored change nothing; of rows of one time a
    tombstone counts.
    """
    old = state.select("target", "key", F.col("live").alias("was"), F.col("last_at").alias("was_at"))
    at, was_at = F.coalesce("last_at", F.lit("0001-01-01").cast("timestamp")), F.coalesce("was_at", F.lit("0001-01-01").cast("timestamp"))
    now = F.when(F.col("was_at").isNull() | (at > was_at), F.col("live")).when(at == was_at, F.least("live", "was")).otherwise(F.col("was"))
    return existence.join(old, ["target", "key"], "left").select("target", "key", "refs", (now - F.coalesce("was", F.lit(0))).alias("live"), "known", "first_at", "last_at")


def _same(a: DataFrame, b: DataFrame, columns: list[str]):
    match = F.lit(True)
    for c in columns:
        match &= a[c].eqNullSafe(b[c])
    return match


def new_references(refs: DataFrame, held: DataFrame) -> DataFrame:
    """References that are not among those held: each once, so a repeated delivery counts once."""
    once = refs.groupBy(*HELD).agg(F.min("at").alias("at"))
    return once.join(held, _same(once, held, HELD), "left_anti")


def advance(state: DataFrame, held: DataFrame, refs: DataFrame, *existence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, held references) after later rows: their references and what they say of existence.

    An earlier landing time of a held reference is taken over.
    """
    fresh = new_references(refs, held)
    said = existence[0]
    for e in existence[1:]:
        said = said.unionByName(e)
    after = apply_deltas(state, existence_deltas(said, state), reference_deltas(fresh))
    return after, held.select(*HELD, "at").unionByName(refs.select(*HELD, "at")).groupBy(*HELD).agg(F.min("at").alias("at"))


def withdraw(state: DataFrame, held: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, held references) without references that were taken back; what is not held changes nothing."""
    real = held.join(gone, _same(held, gone, HELD), "left_semi")
    return apply_deltas(state, reference_deltas(real, -1)), held.join(gone, _same(held, gone, HELD), "left_anti")


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys with positive references and zero existence."""
    return state.where((F.col("refs") > 0) & (F.col("live") <= 0))


def orphan_references(refs: DataFrame, state: DataFrame) -> DataFrame:
    """Each reference to nothing, with its state: missing, deleted or late.

    A reference is late where the first row of its target landed after it.  The
    join is an equi-join on (target, key) whose state side has one row a key; a
    hot key on the other side is split by adaptive execution.
    """
    keys = state.where("refs > 0").select("target", "key", "live", "known", "first_at")
    state_of = (
        F.when(F.coalesce("known", F.lit(0)) == 0, "missing").when(F.col("key") == "", "missing")
        .when(F.col("live") <= 0, "deleted").when(F.col("first_at") > F.col("at"), "late")
    )
    return refs.join(keys, ["target", "key"], "left").withColumn("state", state_of).where("state IS NOT NULL")


def all_references(edge: DataFrame, episode: DataFrame) -> DataFrame:
    return edge_references(edge).unionByName(episode_references(episode))


def reference_state(node: DataFrame, episode: DataFrame, refs: DataFrame) -> DataFrame:
    return apply_deltas(node_existence(node), episode_existence(episode), reference_deltas(refs))


def find_orphans(node: DataFrame, edge: DataFrame, episode: DataFrame) -> DataFrame:
    """(field, from_id, to_id, rel, state, at) of each reference to nothing."""
    refs = all_references(edge, episode)
    found = orphan_references(refs, reference_state(node, episode, refs))
    return found.select("field", "from_id", "to_id", "rel", "state", "at")


def orphan_report(node: DataFrame, edge: DataFrame, episode: DataFrame) -> DataFrame:
    """Orphan references counted per table, field, state and month of landing."""
    found = find_orphans(node, edge, episode)
    return found.groupBy(
        F.substring_index("field", ".", 1).alias("table_name"), "field", F.date_format("at", "yyyy-MM").alias("month"), "state"
    ).agg(F.count(F.lit(1)).alias("n"))
