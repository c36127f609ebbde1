"""Encoding with a public byte-level BPE vocabulary by prefix dynamic programming.

A text is cut into words by the vocabulary's pattern, and a word's bytes are
encoded left to right: every byte prefix has exactly one valid last token,
namely the one that ends there, whose start is a prefix already encoded, and
which stands next to that prefix's last token when the two are encoded
together.  Storing that token for each prefix gives the encoding of every
prefix at once, so bytes may be appended exactly (``WordPrefixes.extend``) and
an edit re-encodes only the words around it (``EncodedText.edit``).

Words repeat, so a worker keeps the ids of words it has seen, in a table that
is emptied when full; the result never depends on it.  Long words take their
candidate tokens from an Aho-Corasick automaton, so the time of a word without
any break stays linear.

Defined results: null and empty texts have the empty list of ids.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: Folder of the public vocabulary files on the driver, which ships them to the workers; never copied into the repository.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

#: The vocabulary's word pattern (a fixed value of the public tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The same pattern for texts of a range of characters whose classes are plain: ASCII, Latin letters up to U+024F and
# common punctuation.  The standard library reads them several times faster.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = "\t-\r \u0085 "
_PLAIN = re.compile(r"[\x00-ɏ‐-‧‰-⁞€←-⇿✓✗]*\Z")
_FAST = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_FULL = regex.compile(PATTERN)

#: Words a worker keeps.
KEPT_WORDS = 1 << 20
#: From this length on candidates come from the automaton.
LONG_WORD = 48


def split_words(text: str) -> list[str]:
    """The words of the vocabulary's pattern; joined they are the text."""
    return _FAST.findall(text) if _PLAIN.match(text) else _FULL.findall(text)


class Vocabulary:
    """Ranks of a byte-level BPE and the check whether two tokens may be neighbours."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.base = (max(self.token) + 1).bit_length()
        self._beside: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self._automaton: ahocorasick.Automaton | None = None

    def by_merges(self, piece: bytes) -> list[int]:
        """The definition: merge the neighbours of lowest rank until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            joined = parts[best] + parts[best + 1]
            if joined not in self.ranks:
                break
            parts[best : best + 2] = [joined]
        return [self.ranks[p] for p in parts]

    def beside(self, left: int, right: int) -> bool:
        key = left << self.base | right
        known = self._beside.get(key)
        if known is None:
            known = self._beside[key] = self.by_merges(self.token[left] + self.token[right]) == [left, right]
        return known

    def alone(self, token: int) -> bool:
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = self.by_merges(self.token[token]) == [token]
        return known

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for token, rank in self.ranks.items():
                a.add_word(token.decode("latin-1"), rank)
            a.make_automaton()
            self._automaton = a
        return self._automaton


class WordPrefixes:
    """The last token of every byte prefix of a word; bytes may be appended."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary = vocabulary
        self.piece = b""
        self.last = [-1]
        self.extend(piece)

    def extend(self, more: bytes) -> WordPrefixes:
        """Append bytes; prefixes already encoded are kept."""
        v, start = self.vocabulary, len(self.piece)
        self.piece += more
        b, last = self.piece, self.last
        if len(more) < LONG_WORD:
            for end in range(start + 1, len(b) + 1):
                for begin in range(max(0, end - v.longest), end):
                    token = v.ranks.get(b[begin:end])
                    if token is not None and self._fits(begin, token):
                        last.append(token)
                        break
        else:
            last.extend([-1] * len(more))
            lead = max(0, start - v.longest)
            for end, token in v.automaton().iter(b[lead:].decode("latin-1")):
                end += lead + 1
                if end > start and last[end] < 0 and self._fits(end - len(v.token[token]), token):
                    last[end] = token
        return self

    def _fits(self, begin: int, token: int) -> bool:
        return self.vocabulary.beside(self.last[begin], token) if begin else self.vocabulary.alone(token)

    def ids(self, end: int | None = None) -> list[int]:
        """Ids of the prefix that ends at ``end`` (default: the whole word)."""
        end = len(self.piece) if end is None else end
        out = []
        while end > 0:
            token = self.last[end]
            out.append(token)
            end -= len(self.vocabulary.token[token])
        return out[::-1]


class WordIds(dict):
    """Ids of words, made when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = WordPrefixes(self.vocabulary, word.encode("utf-8", "surrogatepass")).ids()
        if len(word) <= 256:
            self[word] = ids
        return ids


class Encoder:
    """Texts to ids."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.words = WordIds(self.vocabulary)

    def encode(self, text: str | None) -> list[int]:
        words = self.words
        return [i for w in split_words(text) for i in words[w]] if text else []

    def count(self, text: str | None) -> int:
        words = self.words
        return sum([len(words[w]) for w in split_words(text)]) if text else 0


class EncodedText:
    """A text with its words and ids, open to appends and edits."""

    #: A word's end is settled when so many characters follow it.
    REACH = 3

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.words = split_words(text)

    @property
    def ids(self) -> list[int]:
        return [i for w in self.words for i in self.encoder.words[w]]

    def append(self, more: str) -> EncodedText:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> EncodedText:
        """Replace text[start:end]; words before it and, once cuts meet again, after it are kept."""
        ends = np.cumsum([len(w) for w in self.words]) if self.words else np.zeros(0, dtype=int)
        keep = int(np.searchsorted(ends, start - self.REACH, side="right"))
        at = int(ends[keep - 1]) if keep else 0
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        later = {int(e) + shift: i + 1 for i, e in enumerate(ends) if e >= end}
        words = self.words[:keep]
        pattern = _FAST if _PLAIN.match(text) else _FULL
        while at < len(text):
            m = pattern.match(text, at)
            words.append(m.group())
            at = m.end()
            if at >= start + len(new) and at in later:
                words += self.words[later[at] :]
                break
        self.text, self.words = text, words
        return self


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder for a vocabulary file (a path, or the name of a shipped file), loaded once a process."""
    if name not in _encoders:
        _encoders[name] = Encoder(name if os.path.dirname(name) else SparkFiles.get(name))
    return _encoders[name]


def vocabulary_path(name: str = DEFAULT_VOCABULARY, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, name)


def shipped(df: DataFrame, path: str | None = None) -> str:
    """The name under which Spark sends the driver's vocabulary file to every worker, those started later included."""
    path = os.path.realpath(path or vocabulary_path())
    df.sparkSession.sparkContext.addFile(f"file://{path}")
    return os.path.basename(path)


def id_lists(ids: Iterable[list[int]]) -> pa.Array:
    flat, offsets = [], [0]
    for x in ids:
        flat.extend(x)
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(np.array(offsets, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))


def encode_texts(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of each text; a map over the rows, without a shuffle."""
    name = shipped(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name).encode
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                yield pa.RecordBatch.from_arrays([part.column(0), id_lists(encode(t) for t in part.column(1).to_pylist())], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"{key} {documents.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n): the number of tokens of each text; null and empty texts have 0."""
    name = shipped(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(name).count
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t) for t in b.column(1).to_pylist()], pa.int64())], names=[key, "n"])

    return documents.select(key, text).mapInArrow(run, f"{key} {documents.schema[key].dataType.simpleString()}, n bigint")
