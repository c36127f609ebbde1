"""Connected components by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramql.storage import cut, discard


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, label): the smallest vertex of the component of each vertex in ``edges`` (a, b).

    Each round every vertex takes the smallest label among itself and its
    neighbours, then the label of that label (pointer jumping), so the rounds
    grow with the logarithm of the longest chain.  Null ends and self loops add
    nothing.  Each round is a written table in the shared folder; nothing but
    one number a round reaches the driver.
    """
    pairs = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    both = cut(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    written = labels
    for _ in range(rounds):
        near = both.join(labels.select(F.col("v").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("near"))
        hooked = labels.join(near, labels.v == near.a).select("v", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = hooked.select(F.col("v").alias("label"), F.col("label").alias("far"))
        stepped = cut(hooked.join(jump, "label", "left").select("v", F.least("label", F.coalesce("far", "label")).alias("label"), "was"), "labels")
        changed = stepped.where("label <> was").limit(1).count()
        discard(written)
        written, labels = stepped, stepped.select("v", "label")
        if not changed:
            discard(both)
            return labels
    raise RuntimeError(f"no fixed point within {rounds} rounds")
