"""Oversized texts into ordered pieces by recursive bisection.

A text above ``limit`` tokens is cut at the strongest boundary near its middle
(heading, paragraph, line, sentence, word, else between tokens), and each half
still above ``limit - overlap`` is cut again.  Then every piece but the first
takes the last ``overlap`` tokens before it along.  Cuts lie between words of
the tokenizer's pattern wherever that is possible, where the tokens of a piece
are the tokens of the text; a word longer than a piece is cut between tokens
that end with a whole character, and such pieces are counted anew.

Defined results: null, empty and blank texts and texts within the limit have no
pieces; a text without any boundary is cut between tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from engramql.llm.tokens import Encoder, encoder, shipped, split_words

LIMIT, OVERLAP = 512, 32
#: A cut is looked for within this part of the tokens on each side of the middle.
NEAR = 0.3
#: Words of more tokens than this offer cuts inside.
INSIDE = 8


def cut_points(text: str, coder: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, tokens before it, strength) of each place where the text may be cut.

    Strength: 6 heading, 5 paragraph, 4 line, 3 sentence, 2 word, 1 between
    words without space, 0 inside a word.
    """
    words = split_words(text)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    counts = np.fromiter((len(coder.words[w]) for w in words), dtype=np.int64, count=len(words))
    at, before = np.r_[0, np.cumsum(length)], np.r_[0, np.cumsum(counts)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inner = at[1:-1]
    prev, here = codes[inner - 1], codes[inner]
    prev2 = codes[np.maximum(inner - 2, 0)]
    space = lambda c: (c == 32) | ((c >= 9) & (c <= 13)) | (c == 0xA0) | (c == 0x85)
    stop = lambda c: np.isin(c, [ord(x) for x in ".!?…。！？"])
    strength = np.ones(len(inner), dtype=np.int64)
    strength[space(prev) | space(here)] = 2
    strength[(stop(prev) & space(here)) | (stop(prev2) & space(prev))] = 3
    strength[prev == 10] = 4
    strength[(prev == 10) & ((prev2 == 10) | ((prev2 == 13) & (inner > 2)))] = 5
    strength[(prev == 10) & (here == ord("#"))] = 6
    strength = np.r_[9, strength, 9] if len(words) else np.array([9])
    extra = []
    for i in np.flatnonzero(counts > INSIDE):
        data, done = words[i].encode("utf-8", "surrogatepass"), 0
        for n, token in enumerate(coder.words[words[i]][:-1], 1):
            done += len(coder.vocabulary.token[token])
            if data[done] & 0xC0 != 0x80:
                extra.append((at[i] + len(data[:done].decode("utf-8", "surrogatepass")), before[i] + n, 0))
    if extra:
        e = np.array(extra, dtype=np.int64)
        at, before, strength = np.r_[at, e[:, 0]], np.r_[before, e[:, 1]], np.r_[strength, e[:, 2]]
        order = np.argsort(at, kind="stable")
        at, before, strength = at[order], before[order], strength[order]
    return at, before, strength


def bisect(before: np.ndarray, strength: np.ndarray, most: int) -> list[int]:
    """Indices of the cuts so that no part has more than ``most`` tokens where a cut can help."""
    cuts, todo = [0, len(before) - 1], [(0, len(before) - 1)]
    while todo:
        lo, hi = todo.pop()
        size = before[hi] - before[lo]
        if size <= most or hi - lo < 2:
            continue
        middle = before[lo] + size / 2
        a = int(np.searchsorted(before, middle - NEAR * size, side="left"))
        b = int(np.searchsorted(before, middle + NEAR * size, side="right"))
        a, b = max(a, lo + 1), min(b, hi)
        if a >= b:
            a, b = lo + 1, hi
        best = a + int(np.lexsort((np.abs(before[a:b] - middle), -strength[a:b]))[0])
        cuts.append(best)
        todo += [(lo, best), (best, hi)]
    return sorted(set(cuts))


def pieces(text: str, coder: Encoder, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, own_start, end, tokens) of each piece, offsets in characters; [] within the limit.

    text[own_start:end] of all pieces joined is the text; text[start:own_start]
    is shared with the piece before.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be below half the limit")
    at, before, strength = cut_points(text, coder)
    if before[-1] <= limit:
        return []
    cuts = bisect(before, strength, limit - overlap)
    while True:
        out, over = [], []
        for i in range(len(cuts) - 1):
            lo, hi = cuts[i], cuts[i + 1]
            first = lo
            if i and overlap:
                # the earliest cut with at most ``overlap`` tokens to share, no further back than the piece before
                first = max(int(np.searchsorted(before, before[lo] - overlap, side="left")), cuts[i - 1])
            if strength[first] > 0 and strength[hi] > 0:
                # white space at the end of a piece is one word there, whatever followed it in the text
                body = hi
                while body > first and text[at[body] - 1].isspace():
                    body -= 1
                tokens = int(before[body] - before[first]) + coder.count(text[at[body] : at[hi]])
            else:
                tokens = coder.count(text[at[first] : at[hi]])
            if tokens > limit and hi - lo > 1:
                over.append((lo, hi))
            out.append((int(at[first]), int(at[lo]), int(at[hi]), tokens))
        if not over:
            return out
        # cuts inside words gave these pieces more tokens than they had in the text: they alone are halved once more
        halves = [lo + x for lo, hi in over for x in bisect(before[lo : hi + 1], strength[lo : hi + 1], int(before[hi] - before[lo]) - 1)]
        cuts = sorted({*cuts, *halves})


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, own_start, end, tokens, text) of the texts above the limit; a map without a shuffle."""
    name = shipped(documents, path)
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, own_start bigint, end bigint, tokens bigint, text string"
    names = ["doc_id", "piece", "start", "own_start", "end", "tokens", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name)
        for b in batches:
            for low in range(0, b.num_rows, 500):
                part = b.slice(low, 500)
                source, rows = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    # a token has at least one byte, so shorter texts are within the limit
                    if text and (len(text) > limit or len(text.encode("utf-8", "surrogatepass")) > limit):
                        found = pieces(text, coder, limit, overlap)
                        source += [i] * len(found)
                        rows += [(k, *p, text[p[0] : p[2]]) for k, p in enumerate(found)]
                if rows:
                    k, start, own, end, tokens, body = zip(*rows)
                    columns = [part.column(0).take(pa.array(source)), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, own, end, tokens)), pa.array(body, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)
