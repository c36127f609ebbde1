"""Items of varying length into containers of fixed capacity, sum-of-squares rule.

Items are placed one by one.  A level array counts the open containers at each
fill; an item goes to the fill (or to a new container) that minimises the sum
of the squared counts of partially filled containers, so no fill becomes common
and later items find what they need.  Ties take the fullest container.

Items hash to shards of about ``SHARD`` items that are packed independently.
What shards leave half empty is packed again: containers below ``refill`` of
the capacity give their items back, which go to shards anew, until one shard
has done them all or a round would have more than half of the items of the one
before (which then stay as they are), so the rounds end.

Defined results: items of 0 tokens need no room and have a null container; an
item above the capacity is cut into pieces of exactly the capacity, each its
own full container, and the rest; no other item is cut.  Repeated sizes are
told apart by the item key, which must be unique.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramql.llm.tokens import count_tokens
from engramql.storage import cut

SHARD = 16384
CAPACITY = 2048


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each size (all within 1..capacity), in the order given."""
    level = np.zeros(capacity + 1, dtype=np.int64)  # open containers by fill
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        # change of the sum of squares from leaving fill h and reaching fill h + s; a full container no longer counts
        change = 2 * level[s : capacity + 1] + 1
        change[-1] = 0
        left = 1 - 2 * level[: capacity - s + 1]
        left[0] = 0
        total = change + left
        total[1:][level[1 : capacity - s + 1] == 0] = 1 << 40
        h = capacity - s - int(total[::-1].argmin())
        if h:
            number = open_at[h].pop()
            level[h] -= 1
        else:
            number = made
            made += 1
        if h + s < capacity:
            open_at[h + s].append(number)
            level[h + s] += 1
        out[i] = number
    return out


ITEM = "item string, piece int, first_token bigint, tokens bigint"


def pack_shards(items: DataFrame, capacity: int, shards: int, round_no: int) -> DataFrame:
    """Items with (round, shard, slot), packed per shard in the order of their hash."""

    def run(table: pa.Table) -> pa.Table:
        slot = sum_of_squares(table.column("tokens").to_numpy(), capacity)
        fill = np.bincount(slot, table.column("tokens").to_numpy())
        return pa.Table.from_arrays(
            [*(table.column(c) for c in ("item", "piece", "first_token", "tokens", "shard")), pa.array(slot), pa.array(fill[slot].astype(np.int64))],
            names=["item", "piece", "first_token", "tokens", "shard", "slot", "fill"],
        )

    def ordered(table: pa.Table) -> pa.Table:
        return run(table.sort_by([("h", "ascending"), ("item", "ascending"), ("piece", "ascending")]))

    hashed = items.withColumn("h", F.xxhash64("item", "piece", F.lit(round_no))).withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int"))
    return hashed.groupBy("shard").applyInArrow(ordered, ITEM + ", shard int, slot bigint, fill bigint").withColumn("round", F.lit(round_no))


def fill_containers(sizes: DataFrame, capacity: int = CAPACITY, refill: float = 0.97, shard: int = SHARD) -> DataFrame:
    """(item, piece, first_token, tokens, container): ``sizes`` has item (string) and n.

    piece counts the parts of an item from 0; first_token is where the part
    begins within the item.
    """
    whole = (F.col("n") / capacity).cast("bigint")
    pieces = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0))),
        lambda i: F.struct(i.cast("int").alias("piece"), (i * capacity).alias("first_token"), F.least(F.lit(capacity).cast("bigint"), F.col("n") - i * capacity).alias("tokens")),
    )
    items = cut(sizes.withColumn("p", F.explode(pieces)).select("item", "p.piece", "p.first_token", "p.tokens"), "items")
    done = [
        items.where(F.col("tokens") <= 0).withColumn("container", F.lit(None).cast("string")),
        items.where(F.col("tokens") == capacity).withColumn("container", F.concat_ws("-", F.lit("full"), "item", "piece")),
    ]
    rest = items.where((F.col("tokens") > 0) & (F.col("tokens") < capacity))
    round_no, waiting = 0, rest.count()
    while True:
        shards = max(1, -(-waiting // shard))
        packed = cut(pack_shards(rest, capacity, shards, round_no), f"packed{round_no}")
        low = packed.where(F.col("fill") < refill * capacity)
        again = low.count() if shards > 1 else 0
        # sizes that leave room in every container (all above half of it, say) gain nothing from another round
        last = shards == 1 or 2 * again > waiting
        named = F.concat_ws("-", "round", "shard", "slot")
        kept = packed if last else packed.where(F.col("fill") >= refill * capacity)
        done.append(kept.select("item", "piece", "first_token", "tokens", named.alias("container")))
        if last:
            break
        rest, waiting = low.select("item", "piece", "first_token", "tokens"), again
        round_no += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, first_token, tokens, container) of the whole corpus."""
    sizes = count_tokens(documents, path).select(F.col("doc_id").cast("string").alias("item"), "n").where("item IS NOT NULL")
    packed = fill_containers(sizes, capacity)
    return packed.withColumn("doc_id", F.col("item").cast("bigint")).select("doc_id", "piece", "first_token", "tokens", "container")
