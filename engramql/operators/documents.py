"""Documents and remembered answers: citations, writing, predicate questions, snapshots of answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramql.config import DEFAULT
from engramql.functions import seams
from engramql.functions.vectors import dot, norm, usable
from engramql.operators.graph import PREDICATES
from engramql.operators.mutations import upsert_edges

#: References in a text: .../fact/<id or prefix>.
FACT_REF = r"/fact/([0-9A-Za-z-]{4,64})"


def vector_table(nodes: DataFrame, dim: int) -> DataFrame:
    """(id, embedding, length): the vectors of one length with their norms, ready to be stored beside the nodes."""
    return nodes.where(usable(F.col("embedding"), dim)).select("id", "embedding", norm(F.col("embedding")).alias("length"))


def citations(texts: DataFrame, nodes: DataFrame, least: int = 4) -> DataFrame:
    """(doc_id, ref, id, state): each reference of a text and the node it names.

    Exact ids first, then prefixes that name one node only.  state: 'ok',
    'deleted' or 'invented'.  Both are equi-joins; prefixes meet on their first
    ``least`` characters.  ``texts`` has doc_id and text, ``nodes`` id and
    tombstoned.
    """
    refs = texts.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(FACT_REF), F.lit(1)))).alias("ref")).withColumn("low", F.lower("ref"))
    n = nodes.select("id", F.coalesce("tombstoned", F.lit(False)).alias("dead"))
    exact = refs.join(n.withColumnRenamed("id", "low"), "low", "left").select("doc_id", "ref", "low", F.when(F.col("dead").isNotNull(), F.col("low")).alias("hit"), "dead")
    open_ = exact.where("hit IS NULL").select("doc_id", "ref", "low").withColumn("k", F.substring("low", 1, least))
    near = open_.join(n.withColumn("k", F.substring("id", 1, least)), "k").where(F.col("id").startswith(F.col("low")))
    one = near.groupBy("doc_id", "ref").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pid"), F.max("dead").alias("pdead")).where("n = 1").drop("n")
    j = exact.join(one, ["doc_id", "ref"], "left")
    found, dead = F.coalesce("hit", "pid"), F.coalesce("dead", "pdead")
    return j.select("doc_id", "ref", found.alias("id"), F.when(found.isNull(), "invented").when(dead, "deleted").otherwise("ok").alias("state"))


def canonical_references(texts: DataFrame, cited: DataFrame) -> DataFrame:
    """(doc_id, text) with references that name a live node by its whole id, others taken out."""
    good = cited.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("ref", F.when(F.col("state") == "ok", F.concat(F.lit("/fact/"), "id")).otherwise("")))).alias("m"))
    j = texts.join(good, "doc_id", "left")
    refs = F.regexp_extract_all("text", F.lit(FACT_REF), F.lit(1))
    named = F.transform(refs, lambda x: F.coalesce(F.element_at("m", x), F.lit("")))
    # the texts between references, each followed by its reference
    text = F.array_join(F.zip_with(F.split("text", FACT_REF, -1), named, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return j.select("doc_id", text.alias("text"))


def document_edges(edges: DataFrame, cited: DataFrame, links: DataFrame, now_ms: int, weight: float = 0.1) -> DataFrame:
    """Edges with the 'cites' and 'doc_link' edges of freshly written documents in place of their old ones.

    ``cited`` is the result of ``citations``; ``links`` has doc_id and target.
    """
    fresh = cited.where("state = 'ok'").select(F.col("doc_id").alias("src"), F.col("id").alias("dst"), F.lit("cites").alias("kind")).unionByName(
        links.select(F.col("doc_id").alias("src"), F.col("target").alias("dst"), F.lit("doc_link").alias("kind"))
    )
    rows = fresh.where("src <> dst").distinct().select("src", "dst", F.col("kind").alias("rel"), F.lit(weight).alias("w"), F.lit(now_ms).cast("bigint").alias("last_access"), "kind")
    written = cited.select(F.col("doc_id").alias("src")).unionByName(links.select(F.col("doc_id").alias("src"))).distinct()
    old = edges.where("kind IN ('cites', 'doc_link')").join(written, "src", "left_semi").join(rows.select("src", "dst", "rel"), ["src", "dst", "rel"], "left_anti")
    return upsert_edges(edges, rows, old)


def gloss_vectors(embed: Callable[[str], list[float]] = seams.embed) -> dict[str, list[float]]:
    """The question of each predicate as a vector: twelve rows, made once."""
    return {p: embed(q) for p, q in PREDICATES.items()}


def predicate_of(cue: Sequence[float], glosses: dict[str, list[float]], floor: float = DEFAULT.gloss_threshold) -> str | None:
    """The predicate whose question is nearest to the cue, the first of equals, if near enough."""
    best, score = None, floor
    c = np.asarray(cue)
    for p, g in glosses.items():
        n = np.linalg.norm(c) * np.linalg.norm(g)
        s = float(c @ np.asarray(g) / n) if n else 0.0
        if s >= score and (best is None or s > score):
            best, score = p, s
    return best


def predicates_of(cues: DataFrame, vector: str, embed: Callable[[str], list[float]] = seams.embed, floor: float = DEFAULT.gloss_threshold) -> DataFrame:
    """Cues with the predicate whose question is nearest to their vector, the first of equals; those near none are left out.

    The twelve question vectors are one literal, so this is a map.
    """
    glosses = F.array(*[F.struct(F.lit(-i).alias("first"), F.lit(p).alias("predicate"), F.array(*[F.lit(float(x)) for x in v]).alias("v")) for i, (p, v) in enumerate(gloss_vectors(embed).items())])
    length = norm(F.col(vector))
    rated = F.transform(glosses, lambda g: F.struct(F.round(dot(F.col(vector), g["v"]) / (length * norm(g["v"])), 9).alias("cos"), g["first"].alias("first"), g["predicate"].alias("predicate")))
    best = cues.withColumn("best", F.array_max(rated))
    return best.where(F.col("best.cos") >= floor).select(*cues.columns, F.col("best.predicate").alias("predicate"))


def ambient_lines(found: DataFrame, width: int = 200) -> DataFrame:
    """(line) of search results: one short line each, best first."""
    return found.orderBy(F.desc("cos"), "id").select(F.concat(F.lit("- "), F.substring(F.regexp_replace("value", r"\s+", " "), 1, width)).alias("line"))


def replayed(recorded: DataFrame, answers: DataFrame, least: float = DEFAULT.snapshot_match) -> DataFrame:
    """(id, similarity, same) of recorded answers (id, expected) and present ones (id, actual): how near they are."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def near(a, b):
        import pandas as pd

        out = []
        for x, y in zip(a, b):
            u, v = np.asarray(seams.embed(x or "")), np.asarray(seams.embed(y or ""))
            n = np.linalg.norm(u) * np.linalg.norm(v)
            out.append(float(u @ v / n) if n else 0.0)
        return pd.Series(out)

    j = recorded.join(answers, "id", "left").withColumn("similarity", near("expected", "actual"))
    return j.select("id", "similarity", (F.col("similarity") >= least).alias("same"))
