"""Near-duplicate records: all pairs of word sets at a Jaccard similarity.

1.  Word sets.  A record is the set of distinct runs of letters and digits of
    its lower-cased text.  Records of one kind with equal sets are one class.
2.  Fingerprint.  Words hash to segments; a class keeps the number of its words
    in each of 64 segments, clamped to 4 and written in unary code over four
    longs.  The Manhattan distance of two such vectors is then the bit count of
    their XOR, and never more than the number of words the sets do not share,
    so a pair beyond the allowed difference is no pair: an exact lower bound.
3.  Grid.  Segment counts alone put every text of a template into one cell, so
    a cell is the group of the rarest shared segments at word width: classes
    meet where their rarest common words are equal.  Two sets of similarity t
    share a word within their first n - ceil(t n) + 1 words by rarity, a second
    one within one word more, and so on; a cell is one word if that word is
    rare, else the two, three or four rarest, until the expected cell is small.
    The rule depends on the words alone, so both sides agree and no pair is
    lost.  Rarity comes from a table of counts over ``2**SKETCH_BITS`` hash
    buckets, which has a fixed size whatever the corpus.
4.  Range join.  Within a cell, classes whose sizes and Manhattan bound allow it
    are candidates; the pair is taken in its first common cell only.
5.  Exact check.  Candidates are compared word by word.

Defined results: null texts have no words; records below ``least`` words are
left out; null ids are left out; a record delivered again is one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramql.operators.components import components
from engramql.operators.versions import last_rows
from engramql.storage import cut

#: Buckets of the rarity table: 2**18 counts, 2 MB.
SKETCH_BITS = 18
#: A cell whose expected size is at most this is not refined further.
CELL = 1500
#: Words that a cell combines at most.
DEPTH = 4
LONGS = 4


def word_hashes(text: Column) -> Column:
    """Sorted 64-bit hashes of the distinct words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def word_records(node: DataFrame, episode: DataFrame) -> DataFrame:
    """(rec_kind, id, text): nodes by the value of the last row, episodes by id."""
    nodes = last_rows(node.select("id", "value", "landed_at"), ties=["value"]).select(F.lit("node").alias("rec_kind"), "id", F.col("value").alias("text"))
    episodes = last_rows(episode.select("id", "content", "landed_at"), ties=["content"]).select(F.lit("episode").alias("rec_kind"), "id", F.col("content").alias("text"))
    return nodes.unionByName(episodes).where("id IS NOT NULL AND text IS NOT NULL")


def word_classes(records: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Members (rec_kind, cls, id) and classes (cls, words): one class per word set.

    The class key is made of two independent hashes of the whole set and its
    kind.
    """
    hashed = records.select("rec_kind", "id", word_hashes(F.col("text")).alias("words")).where(F.size("words") >= least)
    cls = F.struct(F.xxhash64("rec_kind", "words"), F.xxhash64(F.lit("second"), F.col("words"), F.col("rec_kind")))
    keyed = cut(hashed.select("rec_kind", "id", F.concat(F.hex(cls["col1"]), F.lit("-"), F.hex(cls["col2"])).alias("cls"), "words"), "members")
    return keyed.select("rec_kind", "cls", "id"), keyed.groupBy("cls").agg(F.first("words").alias("words"), F.first("rec_kind").alias("rec_kind"))


def rarity_table(classes: DataFrame) -> np.ndarray:
    """Counts of words over 2**SKETCH_BITS hash buckets: at most that many numbers reach the driver."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            w = b.column("words").flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(w & (size - 1), minlength=size)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = classes.select("words").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size, dtype=np.int64)
    table[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return table


def unary_counts(words: np.ndarray) -> np.ndarray:
    """Segment counts of a set in unary code: LONGS longs of 16 segments, 4 bits each."""
    segments = 16 * LONGS
    counts = np.minimum(np.bincount((words >> 40) & (segments - 1), minlength=segments), 4)
    nibbles = (np.uint64(1) << counts.astype(np.uint64)) - np.uint64(1)
    return np.bitwise_or.reduce(nibbles.reshape(LONGS, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)


def _mix(a: np.uint64 | np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b + np.uint64(0x9E3779B97F4A7C15) + (a << np.uint64(6)) + (a >> np.uint64(2)))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def cells(words: np.ndarray, counts: np.ndarray, total: int, over: int, under: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell keys of a set whose words are in order of rarity, and whether each is early.

    ``counts`` are the rarity counts in that order.  Level l combines l words;
    position p is open to the last word of level l while p < n - need + l.  The
    smaller set of a pair shares more of its own words (2 over n / (over +
    under) at least), so its first common cell is early: within n - that + l.
    """
    n = len(words)
    need = -(-over * n // under)
    early_need = -(-2 * over * n // (over + under))
    w = words.astype(np.uint64)
    share = counts / max(1, total)
    keys, early = [], []
    level = 1
    at = np.arange(min(n, n - need + 1))
    key, expect = w[at], counts[at].astype(np.float64)
    while len(at):
        done = (expect <= CELL) | (level == DEPTH) | (n - need + level >= n)
        keys.append(key[done])
        early.append(at[done] < n - early_need + level)
        at, key, expect = at[~done], key[~done], expect[~done]
        if not len(at):
            break
        level += 1
        end = min(n, n - need + level)
        length = np.maximum(0, end - 1 - at)
        src = np.repeat(np.arange(len(at)), length)
        nxt = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + at[src] + 1
        key, expect, at = _mix(key[src], w[nxt]), expect[src] * share[nxt], nxt
    return np.concatenate(keys), np.concatenate(early)


def cell_rows(classes: DataFrame, table: np.ndarray, total: int, over: int, under: int) -> DataFrame:
    """(cell, size, cls_no, c0..): a row for each class and cell.

    size is twice the number of words, plus one where the cell is not early.
    """
    mask = (1 << SKETCH_BITS) - 1
    names = ["cell", "size", "cls_no", *[f"c{i}" for i in range(LONGS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("words")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            number = b.column("cls_no").to_numpy()
            kinds = b.column("salt").to_numpy().astype(np.uint64)
            keys, sizes, codes = [], [], []  # a list of each class
            for i, end in enumerate(ends):
                words = flat[ends[i - 1] if i else 0 : end]
                counts = table[words & mask]
                order = np.lexsort((words, counts))
                k, early = cells(words[order], counts[order], total, over, under)
                keys.append(k ^ kinds[i])
                sizes.append(2 * len(words) + ~early)
                codes.append(unary_counts(words))
            lengths = np.array([len(k) for k in keys])
            if not len(lengths):
                continue
            code = np.array(codes).view(np.int64)  # classes x LONGS
            at = np.repeat(np.arange(len(lengths)), lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(number[at]), *[pa.array(code[at, i]) for i in range(LONGS)]], names=names
            )

    return classes.select("words", "cls_no", "salt").mapInArrow(run, "cell bigint, size int, cls_no bigint, " + ", ".join(f"c{i} bigint" for i in range(LONGS)))


def joined_in_cells(placed: DataFrame, over: int, under: int) -> DataFrame:
    """(a, b): classes that share a cell and pass size and Manhattan bound.

    Rows come sorted by cell and size; step s holds each row against the row s
    places on while both lie in one cell, in flat arrays.  The left row is the
    smaller one, so it must be early, and it is done with its cell once the
    sizes are too far apart.  A cell that reaches over batches is carried along.
    """

    def pairs(cell: np.ndarray, size: np.ndarray, number: np.ndarray, code: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        n = size >> 1
        at = np.flatnonzero((size & 1) == 0)
        step = 1
        while True:
            at = at[at + step < len(cell)]
            to = at + step
            x, y = n[at], n[to]
            # d words not shared of x + y: the similarity is at least over/under while d <= (x + y)(under - over)/(under + over)
            most = (x + y) * (under - over) // (under + over)
            ok = (cell[at] == cell[to]) & (y - x <= most)
            at, to, most = at[ok], to[ok], most[ok]
            if not len(at):
                break
            s, t = at, to
            d = np.zeros(len(s), dtype=np.int64)
            for i in range(LONGS):
                d += np.bitwise_count(code[i][s] ^ code[i][t])
                good = d <= most
                s, t, d, most = s[good], t[good], d[good], most[good]
            if len(s):
                a.append(np.minimum(number[s], number[t]))
                b.append(np.maximum(number[s], number[t]))
            step += 1
        if not a:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            a, b = pairs(columns[0], columns[1], columns[2], [c.view(np.uint64) for c in columns[3:]])
            if len(a):
                both = np.unique(np.stack([a, b], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            if held:
                columns = [np.concatenate([x, y]) for x, y in zip(held, columns)]
            cell = columns[0]
            last = int(np.searchsorted(cell, cell[-1]))
            yield from emit([c[:last] for c in columns])
            held = [c[last:] for c in columns]
        if held:
            yield from emit(held)

    together = placed.repartition("cell").sortWithinPartitions("cell", "size", "cls_no")
    return together.mapInArrow(run, "a bigint, b bigint").distinct()


def similar_classes(classes: DataFrame, over: int = 7, under: int = 10) -> DataFrame:
    """(a, b, shared, union): pairs of classes at similarity over/under or more, each once."""
    table = rarity_table(classes)
    total = classes.count()
    placed = cell_rows(classes, table, total, over, under)
    candidates = cut(joined_in_cells(placed, over, under), "candidates")
    words = classes.select("cls_no", "words")
    left = candidates.join(words.select(F.col("cls_no").alias("a"), F.col("words").alias("wa")), "a")
    both = left.join(words.select(F.col("cls_no").alias("b"), F.col("words").alias("wb")), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    counted = both.select("a", "b", shared.alias("shared"), (F.size("wa") + F.size("wb") - shared).alias("union"))
    return counted.where(F.col("shared") * under >= F.col("union") * over)


def numbered_classes(records: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Members and classes with a long number that is the same on every run over the same written table."""
    members, classes = word_classes(records, least)
    numbered = classes.select(F.conv(F.substring_index("cls", "-", 1), 16, -10).cast("bigint").alias("half"), "cls", "words", "rec_kind")
    # the first hash half numbers the class; halves that meet are told apart by rank
    rank = F.row_number().over(Window.partitionBy("half").orderBy("cls"))
    numbered = numbered.withColumn("r", rank).select(F.when(F.col("r") == 1, F.col("half")).otherwise(F.xxhash64("cls", "r")).alias("cls_no"), "cls", "words", F.xxhash64("rec_kind").alias("salt"))
    return members, cut(numbered, "classes")


def near_pairs(records: DataFrame, least: int = 16, over: int = 7, under: int = 10) -> DataFrame:
    """(rec_kind, a_id, b_id), a_id < b_id: every pair of records at the similarity.

    Pairs between classes are expanded over their members only here, at the
    very end.
    """
    members, classes = numbered_classes(records, least)
    pairs = similar_classes(classes, over, under).select("a", "b")
    own = members.join(classes.select("cls", "cls_no"), "cls").select("rec_kind", "cls_no", "id")
    own = cut(own, "own")
    across = (
        pairs.join(own.select(F.col("cls_no").alias("a"), F.col("id").alias("x"), "rec_kind"), "a")
        .join(own.select(F.col("cls_no").alias("b"), F.col("id").alias("y")), "b")
        .select("rec_kind", F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"))
    )
    within = own.alias("s").join(own.alias("t"), (F.col("s.cls_no") == F.col("t.cls_no")) & (F.col("s.id") < F.col("t.id"))).select("s.rec_kind", F.col("s.id").alias("a_id"), F.col("t.id").alias("b_id"))
    return across.unionByName(within)


def near_groups(records: DataFrame, least: int = 16, over: int = 7, under: int = 10) -> DataFrame:
    """(rec_kind, id, class_id, group_id, links): one row per record.

    class_id: smallest id of the records with the same words; group_id:
    smallest id of the group of linked classes; links: similar classes of the
    record's class.
    """
    members, classes = numbered_classes(records, least)
    pairs = cut(similar_classes(classes, over, under).select("a", "b"), "pairs")
    own = members.join(classes.select("cls", "cls_no"), "cls").select("rec_kind", "cls_no", "id")
    firsts = own.groupBy("cls_no").agg(F.min("id").alias("class_id"))
    links = pairs.select(F.col("a").alias("cls_no")).union(pairs.select("b")).groupBy("cls_no").agg(F.count(F.lit(1)).alias("links"))
    roots = components(pairs).select(F.col("v").alias("cls_no"), F.col("label").alias("root"))
    rooted = firsts.join(roots, "cls_no", "left").withColumn("root", F.coalesce("root", "cls_no"))
    grouped = rooted.join(rooted.groupBy("root").agg(F.min("class_id").alias("group_id")), "root").select("cls_no", "class_id", "group_id")
    return own.join(grouped, "cls_no").join(links, "cls_no", "left").select("rec_kind", "id", "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
