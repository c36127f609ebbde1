"""Deterministic stand-ins for the model calls: embedding, extraction, judging, naming.

Each is a plain function with the interface of the real call, chosen by the
caller; a service-backed one can take its place.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

_TOKEN = re.compile(r"[^\W_]+")


def embed(text: str, dim: int = 64) -> list[float]:
    """Hashed bag of words as a unit vector; texts without words are the zero vector."""
    v = word_counts(text, dim)
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


@lru_cache(maxsize=1 << 16)
def _place(word: str) -> tuple[int, int]:
    h = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
    return int(h[:4], 16), 1 if h[4] < "8" else -1


def word_counts(text: str, dim: int = 64) -> np.ndarray:
    """Signed counts of the words of the whole text in ``dim`` hash places."""
    v = np.zeros(dim)
    for t in _TOKEN.findall(text.lower()):
        place, sign = _place(t)
        v[place % dim] += sign
    return v


def with_vectors(df: DataFrame, text: str, name: str = "v", dim: int = 64) -> DataFrame:
    """``df`` with the word counts of a text column as vectors, null for null texts and those of no direction; Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [None if t is None else word_counts(t, dim) for t in b.column(text).to_pylist()]
            vectors = pa.array([None if c is None or not c.any() else c for c in counts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, vectors], names=[*b.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))]))


@dataclass
class Claim:
    value: str
    type: str = "fact"
    links: list[str] = field(default_factory=list)


def extract(text: str) -> list[Claim]:
    """Sentences as facts; runs of capitalised words inside them as links."""
    out = []
    for s in re.split(r"(?<=[.!?])\s+|\n+", text or ""):
        s = s.strip()
        if len(_TOKEN.findall(s)) >= 3:
            out.append(Claim(s, "fact", re.findall(r"(?<!^)\b[A-Z][\w-]+(?:\s+[A-Z][\w-]+)*", s)))
    return out


_RELATION = re.compile(r"^\W*(.+?)\s+(uses|depends on|runs on|works on|is part of|prefers|supersedes)\s+(.+?)[.!?]*$", re.IGNORECASE)


def triples(text: str) -> str:
    """'A uses B' sentences as a JSON list of triples."""
    out = []
    for s in re.split(r"(?<=[.!?])\s+|\n+", text or ""):
        if m := _RELATION.match(s.strip()):
            out.append({"subject": m[1], "predicate": re.sub(r"^is_", "", m[2].lower().replace(" ", "_")), "object": m[3]})
    return json.dumps(out)


@dataclass
class Verdict:
    relation: str
    magnitude: float = 0.0


def judge(claim: str, candidate: str) -> Verdict:
    """Equal once normalised: confirm; same opening and different rest: contradict; much shared: extend."""
    a, b = _TOKEN.findall(claim.lower()), _TOKEN.findall(candidate.lower())
    if a == b:
        return Verdict("confirm", 0.0)
    overlap = len(set(a) & set(b)) / max(1, len(set(a) | set(b)))
    if len(a) > 3 and a[:3] == b[:3]:
        return Verdict("contradict", round(1 - overlap, 6))
    return Verdict("extend", 0.0) if overlap >= 0.5 else Verdict("unrelated", 0.0)


def judge_both_ways(claim: str, candidate: str, cheap=judge, strong=judge) -> Verdict:
    """A cheap judge first; contradictions must hold with the sides swapped, else the strong judge decides."""
    first = cheap(claim, candidate)
    if first.relation != "contradict":
        return first
    return first if cheap(candidate, claim).relation == "contradict" else strong(claim, candidate)


def compose(question: str, lines: list[str]) -> str:
    """An answer from retrieved lines, nothing beyond them."""
    return "; ".join(lines)


def as_statement(question: str) -> str:
    """A question as search text: without its opening question words and mark."""
    words = question.strip().rstrip("?").split()
    from engramql.functions.scalars import QUESTION_WORDS

    while words and words[0].lower() in QUESTION_WORDS:
        words.pop(0)
    return " ".join(words) or question
