"""Encoding, packing and splitting."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from engramql.llm import packing as P
from engramql.llm import splitting as S
from engramql.llm import tokens as T

CODER = T.encoder(T.vocabulary_path())
REAL = Tokenizer.from_file(T.vocabulary_path("byte_bpe_50k.json"))
REAL.encode_special_tokens = True
TEXTS = [
    "", " ", "  a  b ", "it's we'll 'S", "\n\n\nx\r\n\t y", "naïve café — “quotes” … 123½ ²", "日本語のテキスト", "🙂🙃 👩‍👩‍👧", "<|endoftext|>", "a" * 3000, "x​y­z\x00\x1c\x85", "́combining", "١٢٣ Ⅷ", "ß" * 500,
    "0123456789" * 300, "=-=" * 400, "don't-stop_me.now(x)=>[y]", "ﬁ ligature İstanbul ǅ", "﻿bom", "한국어 텍스트",
]


def real(text):
    return REAL.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_public_tokenizer(text):
    assert CODER.encode(text) == real(text)
    assert CODER.count(text) == len(real(text))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert CODER.encode(text) == real(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 'tslrevmd\n\r\tß1²—x")), max_size=40))
def test_plain_and_full_patterns_agree(text):
    assert T._FAST.findall(text) == T._FULL.findall(text)


def test_long_words_by_automaton():
    r = random.Random(1)
    for _ in range(5):
        word = "".join(r.choice("etaoinshrdlucmf") for _ in range(2000))
        assert T.WordPrefixes(CODER.vocabulary, word.encode()).ids() == real(word)


def test_every_prefix_and_append():
    word = "antidisestablishmentarianism".encode()
    whole = T.WordPrefixes(CODER.vocabulary, word)
    grown = T.WordPrefixes(CODER.vocabulary)
    for i in range(1, len(word) + 1):
        grown.extend(word[i - 1 : i])
        assert whole.ids(i) == grown.ids() == CODER.vocabulary.by_merges(word[:i])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 'tsle\n日1.")), max_size=30), st.integers(0, 30), st.integers(0, 30), st.text(alphabet=st.sampled_from(list("ab 'tl\n日1.")), max_size=8))
def test_edits(text, a, b, new):
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    e = T.EncodedText(CODER, text).edit(a, b, new)
    assert e.text == text[:a] + new + text[b:] and e.words == T.split_words(e.text)
    assert T.EncodedText(CODER, text).append(new).ids == CODER.encode(text + new)


DOCS = "doc_id bigint, text string, n string, ids string, piece string, container string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], DOCS)


def test_encode_table(spark):
    got = {r.doc_id: list(r.ids) for r in T.encode_texts(docs(spark, [*enumerate(TEXTS), (100, None)])).collect()}
    assert got == {**{i: real(t) for i, t in enumerate(TEXTS)}, 100: []}
    assert T.encode_texts(docs(spark, [])).count() == 0


def test_sum_of_squares_rule():
    """Against the rule evaluated in full for every choice."""
    r = random.Random(3)
    sizes = [r.randint(1, 11) for _ in range(120)]
    got = P.sum_of_squares(np.array(sizes), 12)
    fills: list[int] = []
    for s, c in zip(sizes, got):
        level = lambda fs: sum(sum(f == h for f in fs) ** 2 for h in range(1, 12))
        best = min(level(fills[:i] + [f + s] + fills[i + 1 :]) if f is not None else level(fills + [s]) for i, f in [*[(i, f) for i, f in enumerate(fills) if f + s <= 12], (None, None)])
        if c == len(fills):
            fills.append(s)
        else:
            fills[c] += s
        assert max(fills) <= 12 and level(fills) == best


def packed(spark, sizes, **kw):
    df = spark.createDataFrame([(f"d{i:05d}", n, "x") for i, n in enumerate(sizes)], "item string, n bigint, container string")
    return P.fill_containers(df, **kw).collect()


def test_packing_keeps_everything(spark):
    r = random.Random(5)
    sizes = [0, 100, 101, 250, 1000] + [r.choice([7, 13, 50, 99]) for _ in range(1200)]
    rows = packed(spark, sizes, capacity=100, shard=200)
    fill, per = {}, {}
    for x in rows:
        per.setdefault(x.item, []).append(x)
        if x.container is not None:
            fill[x.container] = fill.get(x.container, 0) + x.tokens
    assert max(fill.values()) <= 100
    for i, n in enumerate(sizes):
        parts = sorted(per[f"d{i:05d}"], key=lambda x: x.piece)
        assert sum(p.tokens for p in parts) == n and [p.first_token for p in parts] == list(range(0, max(n, 1), 100))
        assert len(parts) == 1 or n > 100
    assert all((x.container is None) == (x.tokens == 0) for x in rows)
    assert len(fill) <= 1.1 * -(-sum(sizes) // 100)


def test_one_size_for_all(spark):
    rows = packed(spark, [60] * 500, capacity=100, shard=100)
    assert len({x.container for x in rows}) == 500
    assert packed(spark, []) == []


LONG = "# Head\n\n" + "One sentence here. Another one follows!\n" * 60 + "\n## Next\n\n" + "word " * 300 + "\n\n" + "y" * 4000 + " 日本語" * 200


@pytest.mark.parametrize("limit, overlap", [(64, 0), (64, 16), (200, 32), (512, 32)])
def test_pieces(limit, overlap):
    got = S.pieces(LONG, CODER, limit, overlap)
    assert "".join(LONG[own:end] for _, own, end, _ in got) == LONG
    for k, (start, own, end, n) in enumerate(got):
        assert n == CODER.count(LONG[start:end]) <= limit
        assert (k == 0 and start == own) or got[k - 1][1] <= start <= own
    if overlap:
        assert sum(own > start for start, own, *_ in got[1:]) > 0.9 * (len(got) - 1)
    assert S.pieces("short", CODER, limit, overlap) == []


def test_cuts_prefer_headings():
    text = "word " * 200 + "\n# Title\n" + "word " * 200
    got = S.pieces(text, CODER, 300, 0)
    assert [text[own:].startswith("# Title") for _, own, *_ in got] == [False, True]


def test_split_table(spark):
    rows = [(1, LONG), (2, None), (3, ""), (4, "  "), (5, "short"), (6, "🙂" * 3000), (None, "z" * 30_000)]
    got = S.split_documents(docs(spark, rows)).collect()
    assert {r.doc_id for r in got} == {1, 6, None}
    assert all(r.tokens <= S.LIMIT for r in got)
    six = sorted((r for r in got if r.doc_id == 6), key=lambda r: r.piece)
    assert "".join(r.text[r.own_start - r.start :] for r in six) == "🙂" * 3000
