"""Tolerant parsing of model output and of JSON columns.

Clean JSON is parsed by the JVM; only what that rejects goes to the salvage
function, in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramql.functions.scalars import ACTION_TYPES
from engramql.operators.graph import PREDICATES

CONTRADICTION = "array<struct<episode_id:string,session_id:string,origin:string>>"
CLAIM = "struct<value:string,type:string,links:array<string>,due_at:string,action_type:string>"
TRIPLE = "array<struct<subject:string,predicate:string,object:string>>"
RELATIONS = ("confirm", "extend", "contradict", "unrelated")


def contradictions(c: Column) -> Column:
    """Pending contradictions as structs; unreadable text is an empty array."""
    return F.coalesce(F.from_json(c, CONTRADICTION), F.array().cast(CONTRADICTION))


def distinct_provenance(c: Column) -> Column:
    """Distinct sessions among contradictions that were not inferred."""
    own = F.filter(c, lambda x: (x["origin"] != "inferred") & x["session_id"].isNotNull())
    return F.size(F.array_distinct(F.transform(own, lambda x: x["session_id"])))


def with_contradiction(c: Column, episode_id: Column, session_id: Column, origin: Column) -> Column:
    item = F.struct(episode_id.alias("episode_id"), session_id.alias("session_id"), origin.alias("origin"))
    return F.to_json(F.array_append(contradictions(c), item))


def salvage_array(text: str | None) -> list:
    """The JSON array in a model's answer: {"items": [...]} or the outermost brackets, cut short if need be."""
    if not text:
        return []
    try:
        whole = json.loads(text)
        if isinstance(whole, dict):
            whole = next((v for v in (whole.get("items"), whole.get("claims"), whole.get("facts")) if isinstance(v, list)), [])
        return whole if isinstance(whole, list) else []
    except ValueError:
        pass
    start = text.find("[")
    if start < 0:
        return []
    end = text.rfind("]")
    tries = [text[start : end + 1]] if end > start else []
    brace = text.rfind("}")
    while brace > start:
        tries.append(text[start : brace + 1] + "]")
        brace = text.rfind("}", start, brace)
        if len(tries) > 8:
            break
    for t in tries:
        try:
            out = json.loads(t)
            return out if isinstance(out, list) else []
        except ValueError:
            continue
    return []


def claim_of(x: object) -> dict | None:
    """A claim with a non-empty value and known kinds, or nothing."""
    if isinstance(x, str):
        x = {"value": x}
    if not isinstance(x, dict) or not isinstance(x.get("value"), str) or not x["value"].strip():
        return None
    kind = x.get("type") if x.get("type") in ("fact", "entity") else "fact"
    links = [y.strip() for y in x.get("links", []) if isinstance(y, str) and y.strip()] if isinstance(x.get("links"), list) else []
    action = x.get("action_type")
    due = x.get("due_at") if isinstance(x.get("due_at"), str) else None
    return {"value": x["value"].strip(), "type": kind, "links": links, "due_at": due, "action_type": (action if action in ACTION_TYPES else "other") if due else None}


def parse_claims(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, claim) of model answers in column ``text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                claims = [c for c in map(claim_of, salvage_array(t)) if c]
                rows += [(k, i, c) for i, c in enumerate(claims)]
            yield pd.DataFrame(rows, columns=[key, "pos", "claim"])

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, pos int, claim {CLAIM}")


def valid_triples(c: Column) -> Column:
    """Trimmed triples of the closed vocabulary with different, non-empty ends."""
    read = F.coalesce(F.from_json(c, TRIPLE), F.array().cast(TRIPLE))
    trimmed = F.transform(read, lambda x: F.struct(F.trim(x["subject"]).alias("subject"), F.trim(x["predicate"]).alias("predicate"), F.trim(x["object"]).alias("object")))
    return F.filter(trimmed, lambda x: x["predicate"].isin(*PREDICATES) & (x["subject"] != "") & (x["object"] != "") & (x["subject"] != x["object"]))


def verdict(c: Column, candidates: Column) -> Column:
    """A judge's answer made safe: unknown relations and ids outside ``candidates`` become 'unrelated'."""
    v = F.from_json(c, "struct<best_candidate_id:string,relation:string,magnitude:double,contradicted_ids:array<string>>")
    known = v["relation"].isin(*RELATIONS) & (F.array_contains(candidates, v["best_candidate_id"]) | (v["relation"] == "unrelated"))
    ok = F.coalesce(known, F.lit(False))
    magnitude = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v["magnitude"], F.lit(0.0))))
    hit = F.array_intersect(F.coalesce(v["contradicted_ids"], F.array().cast("array<string>")), candidates)
    best = F.when(ok, v["best_candidate_id"])
    return F.struct(
        best.alias("best_candidate_id"),
        F.when(ok, v["relation"]).otherwise("unrelated").alias("relation"),
        F.when(ok, magnitude).otherwise(0.0).alias("magnitude"),
        F.when(ok & (v["relation"] == "contradict"), F.when(F.size(hit) > 0, hit).otherwise(F.array(best))).otherwise(F.array().cast("array<string>")).alias("contradicted_ids"),
    )


def text_chunks(c: Column, most: int = 24_000) -> Column:
    """Pieces of at most ``most`` characters, each cut after its last line end if it has one.

    Lines are never split unless one alone is too long.
    """
    lines = F.regexp_extract_all(c, F.lit(r"([^\n]{1," + str(most - 1) + r"}\n?|\n)"), F.lit(1))
    start = F.array(F.lit(""))
    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(last, x)
        return F.when(F.length(joined) <= most, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))
    return F.filter(F.aggregate(lines, start, step), lambda x: x != "")


def heading_sections(c: Column) -> Column:
    """A Markdown text before each level-one or level-two heading."""
    return F.filter(F.split(c, r"(?m)(?=^#{1,2} )"), lambda x: F.trim(x) != "")


def subject_proposals(text: str | None, schema_ids: list[str], most: int = 200) -> list[dict]:
    """Subjects a model proposes, as {name, slug, schemas}: names within ``most`` characters, each slug once, numbers of listed schemas only."""
    body = text or ""
    fence = body.find("```")
    if fence >= 0:
        body = body[fence:].split("\n", 1)[-1].rsplit("```", 1)[0]
    out, seen = [], set()
    for x in salvage_array(body):
        name = x.get("name") if isinstance(x, dict) else None
        if not isinstance(name, str) or not name.strip() or len(name) > most:
            continue
        slug = "-".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in name.lower()).split())
        numbers = x.get("schemas") if isinstance(x.get("schemas"), list) else []
        ids = list(dict.fromkeys(schema_ids[n] for n in numbers if isinstance(n, int) and not isinstance(n, bool) and 0 <= n < len(schema_ids)))
        if slug and slug not in seen and ids:
            seen.add(slug)
            out.append({"name": name.strip(), "slug": slug, "schemas": ids})
    return out
