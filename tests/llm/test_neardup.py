"""Near-duplicate groups against exact similarities of all pairs."""

import random
import tracemalloc

import numpy as np
import pytest

from spindrift.llm import components, neardup, simhash


def copies(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(2000)]
    rows, base = [], [rng.choices(vocabulary, k=rng.randint(60, 400)) for _ in range(25)]
    for words in base:
        for _ in range(rng.randint(1, 5)):
            changed = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(changed)))
    rows += [(500, None), (501, ""), (502, "short one"), (503, "Short\tONE"), (504, "another"), (None, rows[0][1]), (None, "x y"), (0, rows[0][1])]
    return rows


def brute(rows, least=0.8):
    forest = components.Forest()
    sets = [(i, set(neardup.shingle_set(t, 5).tolist())) for i, t in rows if i is not None]
    for i, x in sets:
        for j, y in sets:
            if i < j and (x == y or (x | y and len(x & y) / len(x | y) >= least)):
                forest.link(i, j)
    return {i: forest.root(i) for i, _ in sets}


@pytest.mark.parametrize(("tile", "few"), [(4096, 10**6), (7, -1)])
def test_groups(spark, monkeypatch, tile, few):
    monkeypatch.setattr(neardup, "FEW", few)
    rows = copies()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    found = neardup.groups(docs, tile=tile).collect()
    assert len(found) == len(rows)
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert all(want[i] == want[c] for i, c in got.items())  # nothing is joined that isn't similar
    linked = [i for i, c in want.items() if c != i]
    assert sum(got[i] == want[i] for i in linked) >= 0.95 * len(linked)
    kept = neardup.keep_first(docs, tile=tile)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for i, c in got.items()}) and ids.count(None) == 2


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.groups(docs).collect() == [] and neardup.keep_first(docs).collect() == []


def test_spanning_forest_is_minimal():
    rng = np.random.default_rng(5)
    for n in (1, 5, 40):
        ends = np.array([(i, j) for i in range(n) for j in range(i) if rng.random() < 0.5] or [(0, 0)])
        far = rng.integers(0, 20, len(ends))
        kept = neardup.spanning(ends, far)
        for limit in range(20):
            a, b = components.Forest(), components.Forest()
            for k in np.nonzero(far <= limit)[0]:
                a.link(*map(int, ends[k]))
            for k in kept[far[kept] <= limit]:
                b.link(*map(int, ends[k]))
            assert all(a.root(i) == b.root(i) for i in range(n))


def variants(n=150, words=304, edits=(3, 5), seed=4):
    """Variants of one text, each with a few words changed far from one another."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        changed = list(base)
        for k in rng.sample(range(words // 10), rng.randint(*edits)):
            changed[k * 10 + 4] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(changed)))
    return rows


@pytest.mark.parametrize(("tile", "most"), [(4096, 2_000_000), (20, 10_000)])
def test_every_close_pair_is_verified(spark, monkeypatch, tile, most):
    monkeypatch.setattr(neardup, "MOST", most)
    rows = variants()
    sets = {i: set(neardup.shingle_set(t, 5).tolist()) for i, t in rows}
    lanes = {i: neardup.sketch(t) for i, t in rows}
    want = components.Forest()
    for i, _ in rows:
        for j in range(i):
            d = np.bitwise_count(lanes[i] ^ lanes[j])
            if d[0] <= neardup.RADIUS and d.sum() <= neardup.WIDE and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                want.link(i, j)
    got = {r.doc_id: r.component_id for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()}
    assert got == {i: want.root(i) for i, _ in rows}
    assert 1 < sum(i != c for i, c in got.items())


def test_exact_setting_loses_no_pair(spark):
    """Short texts, whose sketches say least: pairs of 4 shared shingles and 1 own, and others about the bound."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for k in range(220):
        base = [word() for _ in range(8 + k % 9)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base, *[word() for _ in range(1 + k % 3)]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in neardup.groups(docs, **neardup.EXACT).collect()} == want
    assert sum(i != c for i, c in want.items()) > 60
    assert sorted(r.doc_id for r in neardup.keep_first(docs, **neardup.EXACT).collect()) == sorted({*want.values()})


def test_repeated_lines_decide_nothing(spark):
    rng = random.Random(8)
    line = " ".join(f"l{k}" for k in range(11))
    own = [" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(104)) for c in "abc"]
    rows = [(i, "\n".join([text] + [line] * 50)) for i, text in enumerate(own[:2])]  # alike in the repeated line alone
    rows += [(2, own[2] + " q r s t u v w x y z q r s t u"), (3, own[2] + " q r s t u v w x y z" * 200 + " q r s t u")]  # equal shingle sets
    got = {r.doc_id: r.component_id for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}


def test_equal_sketches_are_verified(spark, monkeypatch):
    real = neardup.described
    monkeypatch.setattr(neardup, "described", lambda t, w=5: np.append(np.zeros(4, np.uint64), real(t, w)[4:]))
    rows = [(0, "a b c d e f g"), (1, "h i j k l m n"), (2, "A b c d e f g"), (3, None)]
    got = {r.doc_id: r.component_id for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3}


@pytest.mark.parametrize(("module", "few"), [("neardup", 10**6), ("simhash", 10**6), ("simhash", -1)])
def test_unlike_texts_of_one_id_stay(spark, monkeypatch, module, few):
    """Rows are dropped by their text, not by their doc_id alone; with a broadcast and without."""
    monkeypatch.setattr(simhash, "FEW", few)
    x, y, z = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(1, x), (3, x), (3, y), (4, z), (4, y), (4, z), (None, x), (None, None), (5, None), (6, None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, text_hash int")
    kept = {"neardup": neardup, "simhash": simhash}[module].keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame([(1, x), (3, y), (4, z), (None, x), (None, None), (5, None)], "doc_id long, text string").collect()))


def test_tiles_miss_no_pair():
    rng = random.Random(2)
    docs = [(rng.choice([0, 1, 2, 3, 5, 17, 100, 120, 125, 126, 3000]), rng.randint(24, 40)) for _ in range(400)]
    step = lambda n: int(np.floor(np.log2(n + 1) * neardup.STEPS))
    counts = {}
    for n, ones in docs:
        counts[step(n), ones] = counts.get((step(n), ones), 0) + 1
    for tile in (5, 40, 10**6):
        tiles = neardup.Tiles(counts, tile)
        meets = {(t, p) for t in range(len(tiles.bounds)) for p in tiles.partners(t, 4, neardup.steps_apart(0.8))}
        of = lambda n, ones: range(tiles.first[step(n), ones][0], sum(tiles.first[step(n), ones]))
        for n, ones in docs:
            for m, others in docs:
                if min(n, m) >= 0.8 * max(n, m) and abs(ones - others) <= 4:
                    assert all((min(a, b), max(a, b)) in meets for a in of(n, ones) for b in of(m, others))


def test_one_tile_of_near_copies_in_bounded_memory():
    rng = np.random.default_rng(6)
    x = np.tile(rng.integers(0, 2**64, 4, np.uint64), (16_384, 1))
    for k in range(4):
        x[:, k] ^= np.uint64(1) << rng.integers(0, 64, len(x), np.uint64)
    tracemalloc.start()
    i, j = neardup.close(x.view(np.int64), x.view(np.int64), True, neardup.RADIUS, neardup.WIDE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(i) == len(x) - 1 and len(set(i.tolist()) | set(j.tolist())) == len(x)
    assert peak < 400e6


def test_recall_by_number_of_shingles():
    """Pairs of similarity 0.8 within both radii, of random shingles."""
    rng = np.random.default_rng(7)

    def bits(shared, own):
        each = rng.integers(0, 2, (shared + own, 256), np.int8)
        return each[:shared], each[shared:]

    for shared, a, b, least in ((4, 0, 1, 0.95), (8, 1, 1, 0.99), (16, 2, 2, 0.99), (40, 5, 5, 0.99), (240, 30, 30, 0.99)):
        hit = 0
        for _ in range(600):
            common, left = bits(shared, a)
            right = rng.integers(0, 2, (b, 256), np.int8)
            x, y = common.sum(0) + left.sum(0), common.sum(0) + right.sum(0)
            apart = (2 * x > shared + a) != (2 * y > shared + b)
            hit += apart[:64].sum() <= neardup.RADIUS and apart.sum() <= neardup.WIDE
        assert hit >= least * 600
