"""Packing and bit-plane files against the tokenizers library on whole texts."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import bpe, packing, planes, tokens

DOCS = "/root/testdata/sf0.001/documents.parquet"
ODD = ["", " ", "  two  spaces ", "a\nb", "a \nb", "\n\nx\n", "tab\tin", "end<|endoftext|>here", "<|startoftext|> A", "İstanbul ſ K", "é café", "x y", "日本語 テキスト", "a\x00b c", "it's we'll I'D", "a\x1cb \x1c c", "é è", "1234 5 6", "😀 ok", "x" * 5000, "\0lead next", "a \0b"]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_path(name))


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    ours, theirs = bpe.Codec(tokens.public_path(name), most=50), library(name)
    for text in ODD:
        assert ours.encode_all([text]) == [packed(theirs.encode(text, add_special_tokens=False).ids)], text
    assert ours.encode_all(ODD) == [packed(theirs.encode(text, add_special_tokens=False).ids) for text in ODD]
    assert ours.encode_all([]) == [] and ours.encode_all(["", ""]) == [b"", b""]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_long_texts_are_divided(name, monkeypatch):
    monkeypatch.setattr(tokens.divided, "__defaults__", (100,))
    monkeypatch.setattr(bpe, "TOGETHER", 300)
    theirs, rng = library(name), random.Random(3)
    texts = [" ".join(rng.choice(["word", "two  spaces", "it's", "x\ny", "é", "日本", "," * 150, "a" * 400, "end."]) for _ in range(60)) for _ in range(20)]
    assert bpe.Codec(tokens.public_path(name)).encode_all(texts) == [packed(theirs.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(tokens.divided(np.frombuffer(("ab " * 1000).encode(), np.uint8), np.array([0, 3000]))[1]) > 10


def test_other_families_use_the_library(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2}, [("a", "b")]))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    own.save(str(tmp_path / "t.json"))
    codec = bpe.Codec(str(tmp_path / "t.json"))
    assert codec.kind is None and codec.encode_all(["ab b", ""]) == [packed([2, 1]), b""]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é\n\t'sÉ1.,<|>\u0301\u00a0\x1c Aﬁtrevml¼ßȺ²\u2028"), max_size=30), max_size=4))
def test_encoder_on_random_texts(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        assert bpe.codec(tokens.public_path(name)).encode_all(texts) == [packed(library_cached(name).encode(t, add_special_tokens=False).ids) for t in texts]


_kept = {}


def library_cached(name):
    return _kept.setdefault(name, library(name)) if name not in _kept else _kept[name]


def fixture(spark, extra=True):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "a\nb", "x"), (None, "no id", "y"), (100, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


def test_pack(spark):
    theirs = library("byte_bpe_50k.json")
    for docs in (spark.read.parquet(DOCS), fixture(spark)):
        rows = packing.pack(docs).collect()
        want = defaultdict(int)
        for doc_id, text in docs.select("doc_id", "text").collect():
            ids = theirs.encode(text or "", add_special_tokens=False).ids + [0]
            for i, (start, n) in enumerate(packing.cut_points(len(ids), 2048)):
                want[doc_id, i, start, n, zlib.crc32(packed(ids[start : start + n]))] += 1
        got = defaultdict(int)
        sequences = defaultdict(list)
        for r in rows:
            got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
            sequences[r.sequence_id].append((r.offset, r.length))
        assert got == want
        for slots in sequences.values():
            at = 0
            for offset, n in sorted(slots):
                assert offset == at
                at += n
            assert at <= 2048
        assert len(sequences) <= max(1, -(-sum(r.length for r in rows) // 2048) * 1.05 + 1)


def test_pack_empty(spark):
    assert packing.pack(fixture(spark).limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_places_everything(counts):
    bins, seen = defaultdict(list), defaultdict(int)
    rows = sorted(packing.plan(counts, 40))
    ends = [(r[0], n[1] if n and n[0] == r[0] else counts[r[0]]) for r, n in zip(rows, [*rows[1:], None])]
    for (length, rank, sequence, offset), (_, end) in zip(rows, ends):
        assert seen[length] == rank
        for i in range(end - rank):
            bins[sequence + i].append((offset, length))
        seen[length] = end
    assert seen == counts
    for slots in bins.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= 40
    least = max(-(-sum(k * v for k, v in counts.items()) // 40), sum(v for k, v in counts.items() if k > 20))  # no two pieces over half fit together
    assert len(bins) == max(bins, default=-1) + 1 <= least * 1.7 + 1


def test_planes_round_trip(spark):
    theirs = library("word_bpe_49k.json")
    for docs in (spark.read.parquet(DOCS), fixture(spark)):
        texts = sorted(((d, t) for d, t in docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0))
        start, want = 0, []
        for doc_id, text in texts:
            ids = theirs.encode(text or "", add_special_tokens=False).ids + [1]
            want.append((doc_id, start, len(ids), zlib.crc32(packed(ids))))
            start += len(ids)
        for file_ids in (planes.FILE_IDS, 3000):
            got = sorted((tuple(r) for r in planes.round_trip(docs, block=1000, file_ids=file_ids).collect()), key=lambda r: r[1])
            assert got == want


def test_planes_files_are_small_and_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(k, "word " * (k % 90)) for k in range(2000)] + [(5000, "word " * 20_000)], "doc_id long, text string").repartition(7)
    planes.round_trip(docs, block=500, file_ids=4000, folder=f"file://{tmp_path}/files").count()
    files = sorted(tmp_path.glob("files/part-*"), key=lambda p: [int(x) for x in re.fullmatch(r"part-(\d+)-.*-c(\d+)\.txt", p.name).groups()])
    names, sizes = [], []
    for p in files:
        if data := p.read_bytes():
            found = [(doc_id, len(ids) // 4) for doc_id, _, ids in planes.read_docs(data)]
            names += [d for d, _ in found]
            sizes.append(sum(n for _, n in found) - found[-1][1])
    assert names == [*range(2000), 5000]
    assert len(sizes) > 20 and max(sizes) < 4000  # without the document that fills a file


def test_planes_empty(spark):
    assert planes.round_trip(fixture(spark).limit(0)).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=50))
def test_block(ids):
    ids = np.array(ids, np.uint32)
    assert (planes.unpack_block(planes.pack_block(ids)) == ids).all()
