"""The epsilon grid order join against all cosines."""

import math
import random

import numpy as np

from spindrift.llm import egrid

SCHEMA = "vec_id long, embedding array<double>"


def model(rows, least=0.9):
    """By brute force: (vec_id, links, component, kept) of every row."""
    usable = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    good = [i for i, (_, v) in enumerate(rows) if usable(v)]
    up, n = {i: i for i in good}, dict.fromkeys(range(len(rows)), 0)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(good):
        for j in good[:k]:
            x, y = rows[i][1], rows[j][1]
            if len(x) == len(y) and (x == y or egrid.exact_cosine(np.array(x), np.array(y)) >= least):
                n[i] += 1
                n[j] += 1
                up[root(i)] = root(j)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        if i not in up:
            out.append((vec_id, 0, vec_id, True))
            continue
        ids = [rows[j][0] for j in good if root(j) == root(i) and rows[j][0] is not None]
        least_id = min(ids, default=None)
        out.append((vec_id, n[i], least_id, vec_id == least_id))
    return sorted(out, key=repr)


def run(spark, rows, **given):
    made = egrid.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), **given)
    return sorted(map(tuple, made.collect()), key=repr)


def test_clusters_chains_and_odd_rows(spark):
    draw = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = draw.normal(size=12)
        for _ in range(12):
            rows.append((len(rows), (centre + draw.normal(size=12) * draw.choice([0.05, 0.4, 0.8])).tolist()))
    turn = lambda a: [math.cos(a), math.sin(a)] + [0.0] * 10
    rows += [(1000 + k, turn(k * 0.44)) for k in range(7)]  # a chain whose ends are far apart
    rows += [(2000 + k, rows[0][1]) for k in range(40)] + [(5, rows[5][1]), (5, rows[70][1]), (None, rows[3][1]), (None, [9.0] * 3), (None, [9.0] * 3)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 12), (3003, [1.0, None]), (3004, [math.nan] * 12), (3005, [math.inf] + [0.0] * 11), (3006, [2.0, 2.0, 2.0]), (3007, [1e300] * 12), (3008, [1e-300] * 12), (3009, [-0.0] + [1.0] * 11), (3010, [0.0] + [1.0] * 11)]
    want = model(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, block=7) == want  # many blocks and levels
    assert sum(r[1] for r in want) > 500


def test_links_at_the_bound(spark):
    """Cosines of 0.9 but for rounding, by exact sums, wherever the vectors fall."""
    rows = [(k, [0.9 * s, math.sqrt(1 - 0.81) * s, 0.0]) for k, s in enumerate((1.0, 3.0, 0.1, 7.7))] + [(10 + k, [s, 0.0, 0.0]) for k, s in enumerate((1.0, 0.3, 2.0))]
    assert run(spark, rows, block=2) == run(spark, rows) == model(rows)


def test_skips_what_is_far_and_loses_nothing(spark):
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(40, 16))
    x = np.repeat(centres, 100, axis=0) + draw.normal(size=(4000, 16)) * 0.05
    made = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], SCHEMA)
    classes = egrid.marked(made).selectExpr("size", "key", "v", "vec_id AS first", "1L AS copies")
    basis, epsilon = egrid.axes(classes), math.sqrt(0.2)
    sequence = egrid.blocks(classes, basis, epsilon, 20)  # smaller than clusters; a block that spans two has a wide box
    pairs = egrid.block_pairs(sequence, epsilon).collect()
    n = sequence.count()
    assert n >= 200 and len(pairs) < n * (n + 1) / 2 / 3
    one = egrid.Block(sequence.first().asDict() | {"data": bytes(sequence.first()["data"])}, basis)
    near, counts, _, compared = egrid.compared(one, one, 0.9, True)
    assert (near == near.T).all() and counts.sum() == near.sum() and compared <= one.n**2
    got = {(r[0], r[1]) for r in run(spark, [(k, v.tolist()) for k, v in enumerate(x)], block=100)}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == set(enumerate(((u @ u.T >= 0.9).sum(axis=1) - 1).tolist()))


def test_stars_join_what_is_near():
    draw = random.Random(2)
    for _ in range(50):
        near = np.array([[draw.random() < 0.08 for _ in range(20)] for _ in range(15)])
        members, roots = egrid.stars(near, np.arange(15), np.arange(100, 120))
        up = {}

        def root(i):
            while up.setdefault(i, i) != i:
                i = up[i]
            return i

        for i, j in zip(*np.nonzero(near), strict=True):
            up[root(int(i))] = root(int(j) + 100)
        assert len(members) == len(set(members)) == len(up) - len({root(i) for i in up})
        assert all(root(m) == root(r) for m, r in zip(members, roots, strict=True))


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]
