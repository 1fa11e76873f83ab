"""The codec against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import bpe, tokens

from .test_tokens import DOCS, ODD, fixture, library, packed

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.mark.parametrize("name", NAMES)
def test_texts(name):
    own, theirs = bpe.codec(tokens.public_path(name)), library(name)
    texts = ODD + ["".join(random.Random(i).choices("etaoinshrdlu-éA'1. ", k=200)) for i in range(50)]
    for text, got in zip(texts, own.encode_all(texts), strict=True):
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert got == packed(ids), text
        assert own.decode(got).decode() == theirs.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abcdehinorstu", min_size=1, max_size=14), min_size=1, max_size=8))
def test_words(words):
    own = bpe.codec(tokens.public_path(NAMES[0])).merges
    assert own.encode(words) == [own.merge(w) for w in words]
    assert own.ordered


def test_speculation_is_mostly_right():
    own = bpe.codec(tokens.public_path(NAMES[0])).merges
    words = ["thonre", "sttible", "retitioning", "working", "understand", "aaaaaaa", "internationalization"]
    proposals = [own.propose(w) for w in words]
    right = [p == own.merge(w) for p, w in zip(proposals, words, strict=True)]
    for p, ok in zip(proposals, right, strict=True):
        assert bool(own.apart(np.array(p[:-1]), np.array(p[1:])).all()) == ok


def test_small_vocabulary_with_ties():
    own = bpe.Merges({"a": 0, "b": 1, "aa": 2, "ab": 3, "aab": 4}, [("a", "a"), ("a", "b"), ("aa", "b")], "")
    for n in range(1, 9):
        for i in range(2**n):
            word = "".join("ab"[i >> k & 1] for k in range(n))
            assert own.encode([word]) == [own.merge(word)]


def test_query(spark):
    theirs = library(NAMES[0])
    for docs in (spark.read.parquet(DOCS), fixture(spark)):
        want = []
        for doc_id, text in docs.select("doc_id", "text").collect():
            ids = theirs.encode(text or "", add_special_tokens=False).ids
            want.append((doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted(map(str, (tuple(r) for r in bpe.round_trip(docs).collect()))) == sorted(map(str, want))
    back = bpe.decode(bpe.encode(fixture(spark))).collect()
    assert len(back) == fixture(spark).count()
    assert bpe.round_trip(fixture(spark).limit(0)).collect() == []
