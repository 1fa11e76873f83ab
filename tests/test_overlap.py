"""The best source of a text, by an automaton, against every source by itself."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.functions import automaton, text
from spindrift.operators import overlap
from spindrift.plans import queries

SF = "/root/testdata/sf0.001"


def best(plain, sources):
    """By brute force: the source of the longest shared substring, of several the first, and the earliest such substring."""
    most = max((len(text.shared(plain, s)) for s in sources), default=0)
    return next(((k, text.shared(plain, s)) for k, s in enumerate(sources) if most and len(text.shared(plain, s)) == most), (-1, ""))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", max_size=9), max_size=6), st.text("abcd", max_size=12))
def test_automaton(sources, plain):
    assert automaton.Automaton(tuple(sources)).best(plain) == best(plain, sources)


def test_automaton_is_linear():
    rng = random.Random(1)
    sources = tuple("".join(rng.choices("abcdefgh", k=4000)) for _ in range(10)) + ("ab" * 5000, "a" * 10_000)
    made = automaton.Automaton(sources)
    assert len(made.length) <= 2 * sum(map(len, sources))
    began = time.time()
    assert made.best("a" * 200_000 + sources[3][100:2000])[0] == 11
    assert time.time() - began < 3


def test_shared_of_crafted_texts_is_fast():
    """Sequences whose hashes modulo a power of two are equal whatever the base."""
    morse = "".join("ab"[k.bit_count() % 2] for k in range(40_000))
    began = time.time()
    assert text.shared(morse[:16_384], morse[20_000:36_384]) in morse[20_000:36_384]
    assert time.time() - began < 0.5


def rows():
    rng = random.Random(7)
    sources = [(k * 3, "".join(rng.choices("abcde ", k=40))) for k in range(30)] + [(None, "unseen by all"), (7, None), (8, "!!"), (90, "xyzxyz"), (1, "xyzxyz")]
    texts = [(k, "".join(rng.choices("abcde", k=60))) for k in range(50)] + [(100, "--xyz, XYZ"), (100, "--xyz, XYZ"), (101, None), (102, "qqq"), (None, "xy")]
    return texts, sources


def test_best_source(spark):
    texts, sources = rows()
    known = sorted((i, text._plain(t)) for i, t in sources if i is not None and text._plain(t))
    want = []
    for key, t in texts:
        k, shared = best(text._plain(t), [s for _, s in known])
        want.append((key, known[k][0] if k >= 0 else None, len(shared), shared))
    df, of = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(sources, "item_id long, text string")
    for most in (overlap.MOST_CHARS, 200):  # one automaton; groups
        got = overlap.best_source(df, of, "doc_id", "item_id", most)
        assert got.columns == ["doc_id", "item_id", "lcs", "shared"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    none = overlap.best_source(df, of.limit(0), "doc_id", "item_id").collect()
    assert len(none) == len(texts) and {(r.item_id, r.lcs, r.shared) for r in none} == {(None, 0, "")}
    assert overlap.best_source(df.limit(0), of, "doc_id", "item_id").count() == 0


def test_best_source_of_the_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    known = sorted((r.item_id, text._plain(r.text)) for r in items)
    got = {r.doc_id: (r.item_id, r.lcs, r.shared) for r in queries.f4_f5_best_source(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs[::8]:
        k, shared = best(text._plain(d.text), [s for _, s in known])
        assert got[d.doc_id] == (known[k][0] if k >= 0 else None, len(shared), shared)
