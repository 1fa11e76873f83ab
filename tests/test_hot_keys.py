"""What holds for a key of any size: running sums in two levels, selection in rounds, packing by doubled steps; each against the way of small keys and a plain model."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from spindrift.functions import numerals
from spindrift.operators import gate, ledger, provenance, scan, timeline


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, rng.randint(-5, 9)])) for k, n in ((1, 3000), (2, 1), (None, 40), (3, 200)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i int, x long").repartition(5)
    want = []
    for k in (1, 2, None, 3):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        want += [(*r, s) for r, s in zip(mine, accumulate(r[2] or 0 for r in mine), strict=True)]
    for most in (scan.HOT, 100):
        got = scan.running(df, ["k"], [F.col("i")], {"s": F.col("x")}, most)
        assert got.columns == ["k", "i", "x", "s"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    down = scan.running(df.where("k = 3"), ["k"], [F.desc("i")], {"s": F.lit(1)}, 10).collect()
    assert sorted((200 - r.i, r.s) for r in down) == [(n, n) for n in range(1, 201)]
    assert scan.running(df.limit(0), ["k"], [F.col("i")], {"s": F.col("x")}).count() == 0


def test_no_task_holds_a_hot_key(spark):
    """The largest task of the second level holds a range of the key, not all of it."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), "id", (F.col("id") % 7).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as so few rows would meet in one
    try:
        made = scan.running(df, ["k"], [F.col("id")], {"s": F.col("x")}, 1000)
        parts = made.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 150_000
    assert made.where("id = 199999").first().s == sum(i % 7 for i in range(200_000))


def test_times_and_budgets_do_not_depend_on_the_split(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 11 / 10).alias("d"), F.col("id").cast("string").alias("text"))
    for f in (lambda most: timeline.timed(df, F.col("d"), 0.25, "k", "id", most=most), lambda most: timeline.shared_out(df, F.length("text"), F.lit(1.0), F.lit(9.0), "k", "id", most)):
        assert sorted(map(tuple, f(scan.HOT).collect())) == sorted(map(tuple, f(50).collect()))
    start, end = timeline.running_spans(F.col("d"), 0.25, "k", "id")
    old = sorted(map(tuple, df.select("k", "id", start, end).collect()))
    new = sorted((r.k, r.id, r.start, r.end) for r in timeline.timed(df, F.col("d"), 0.25, "k", "id", most=50).collect())
    assert [r[:2] for r in new] == [r[:2] for r in old] and [x for r in new for x in r[2:]] == pytest.approx([x for r in old for x in r[2:]])
    calls = df.select("k", "id", F.col("d").alias("estimate"), F.col("d").alias("actual"))
    guarded = [sorted(map(tuple, ledger.budget_guard(calls, "k", "id", 300.0, most).collect())) for most in (scan.HOT, 50)]
    assert guarded[0] == guarded[1]
    for k in range(3):
        spent, open_ = 0.0, True
        for r in [r for r in guarded[0] if r[0] == k]:
            open_ = open_ and spent + r[2] <= 300
            assert (pytest.approx(spent), open_) == (r[4], r[5])
            spent += r[3]


def segments(spark, n, keys=1):
    """Of which many repeat others, and few reach the threshold."""
    i = F.col("id")
    points = F.array(F.struct((i % 5).cast("double").alias("value"), F.lit("a").alias("unit")), F.struct((i % 3).cast("double").alias("value"), F.lit("b").alias("unit")))
    start = (i * 37 % 1009).cast("double")
    return spark.range(n).select((i % keys).alias("video"), i.alias("pos"), (i + 1).cast("int").alias("id"), start.alias("start"), (start + 1 + i % 40).alias("end"), F.concat(F.lit("topic "), F.md5((i % 50).cast("string"))).alias("topic"), F.sha2((i % 83).cast("string"), 256).alias("summary"), (i % 4 == 0).alias("has_chart_data"), (1 + i % 5).cast("int").alias("hook_score"), points.alias("data_points"))


@pytest.mark.parametrize(("n", "keys", "most", "block"), [(3000, 7, 6, 4), (100_000, 1, 3, gate.BLOCK)])
def test_selection_in_rounds_is_the_walk(spark, n, keys, most, block):
    rows = segments(spark, n, keys)
    whole = gate.select(rows, "video", most=most, block=10**9).select("video", "pos", "selected", "skip_reason")
    rounds = gate.select(rows, "video", most=most, block=block).select("video", "pos", "selected", "skip_reason")
    assert whole.exceptAll(rounds).count() == 0 and rounds.count() == n
    assert 0 < rounds.where("selected").count() <= most * keys
    assert {r[0][:9] for r in rounds.select("skip_reason").distinct().collect()} >= {"", "duplicate", "hook_scor"}


def lines(rows, most_chars, most_span):
    out, buf = [], []
    for pos, start, end, text in rows:
        text = text.strip() if text else ""
        if not text:
            continue
        if buf and (sum(len(t) for _, _, t in buf) + len(text) > most_chars or (end is not None and end - buf[0][1] > most_span)):
            out.append((buf[0][0], buf[0][1], "".join(t for _, _, t in buf)))
            buf = []
        buf.append((pos, start, text))
    return out + ([(buf[0][0], buf[0][1], "".join(t for _, _, t in buf))] if buf else [])


def test_packed_lines_of_split_recordings(spark):
    rng = random.Random(9)
    rows = []
    for video, n in ((1, 2500), (2, 1), (3, 40), (4, 333), (5, 3)):
        at = 0.0
        for pos in range(n):
            size = rng.choice([0, 1, 1, 2, 3, 5, 8, 19, 30])
            end = at + rng.choice([0.1, 0.5, 2.0, 9.0])
            rows.append((video, pos, at, None if rng.random() < 0.01 else end, rng.choice(["", " ", "\t", None]) if not size else " " * (pos % 2) + "x" * size + "\n"))
            at = end
    df = spark.createDataFrame(rows, "video long, pos long, start double, end double, text string").repartition(6)
    for most_chars, most_span in ((20, 6.0), (7, 1e9)):
        want = sorted((v, *x) for v in range(1, 6) for x in lines([r[1:] for r in rows if r[0] == v], most_chars, most_span))
        for given in ({}, {"most": 10, "chunk": 32}):
            assert sorted(map(tuple, timeline.packed(df, "video", most_chars, most_span, **given).collect())) == want
    folded = df.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "text"))).alias("s")).select("video", F.inline(timeline.packed_lines(F.col("s"), 20, 6.0)))
    assert sorted((r.video, r.start, r.text) for r in folded.collect()) == sorted((r.video, r.start, r.text) for r in timeline.packed(df, "video", 20, 6.0).collect())


def test_packed_lines_of_one_long_recording(spark):
    i = F.col("id")
    rows = spark.range(300_000).select(F.lit(1).alias("video"), i.alias("pos"), (i * 1.0).alias("start"), (i + 0.9).alias("end"), F.expr("repeat('x', 1 + id % 13)").alias("text"))
    one, split = timeline.packed(rows, "video"), timeline.packed(rows, "video", most=1000)
    assert one.count() == split.count() > 20_000
    assert one.exceptAll(split).count() == 0


def test_figures_of_large_sources(spark, monkeypatch):
    """By buckets, where a key has too many values to ask each: the same as by one join, and as by brute force."""
    rng = random.Random(3)
    draw = lambda: rng.choice([0.0, 1e-7, -1e-4, 2e-4, 2.1e-4, 2.2e-4, 2.6e-4, 1.0, -3.5, 1e6, 3e4]) * (1 + rng.uniform(-0.01, 0.01)) + rng.choice([0, 5e-7])
    values = [(rng.randrange(4), draw(), rng.choice(["", "萬元", "億", None])) for _ in range(400)] + [(1, None, "萬"), (None, 1.0, "")]
    source = [(rng.randrange(4), draw() * rng.choice([1, 1e4])) for _ in range(150)] + [(2, None)]
    near = lambda k, v: v is not None and any(k == j and s is not None and abs(s - v) <= max(1e-6, 0.005 * abs(v)) for j, s in source)
    scale = {"萬元": 1e4, "億": 1e8, "萬": 1e4}
    df, of = spark.createDataFrame(values, "k int, value double, unit string"), spark.createDataFrame(source, "k int, value double")
    for few in (provenance.FEW, 1):
        monkeypatch.setattr(provenance, "FEW", few)
        assert sorted(map(tuple, provenance.stated(df, of, ["k"]).collect()), key=repr) == sorted((r for r in values if near(*r[:2])), key=repr)
        want = [(k, v, u, near(k, v) or (v is not None and u in scale and near(k, v * scale[u]))) for k, v, u in values]
        assert sorted(map(tuple, provenance.stated_with_unit(df, of, ["k"]).collect()), key=repr) == sorted(want, key=repr)


def test_near_pairs_of_large_keys(spark):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcd", k=12)) for _ in range(6)]
    rows = [(i % 3 + (i > 240), i, "".join(c if rng.random() > 0.12 else "z" for c in rng.choice(base))) for i in range(250)] + [(0, 1000 + i, base[0]) for i in range(40)]
    sets = {i: frozenset(t[j : j + 2] for j in range(len(t) - 1)) for _, i, t in rows}
    like = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    want = {(k, i, j): like(i, j) for k, i, _ in rows for m, j, _ in rows if k == m and i < j and like(i, j) >= 0.5}
    df = spark.createDataFrame(rows, "k int, id int, text string")
    for small in (1000, 60, 1):
        got = gate.near_pairs(df, "k", small=small).collect()
        assert len(got) == len(want) and {(r.k, r.a, r.b): r.similarity for r in got} == pytest.approx(want)
    pairs, members = gate.near_classes(df, "k")
    assert members.count() == len(rows) and members.where(f"k = 0 AND class = {min(i for k, i, t in rows if k == 0 and sets[i] == frozenset(base[0][j:j + 2] for j in range(11)))}").count() >= 40
    assert pairs.count() == pairs.select("k", "a", "b").distinct().count() < len(want)


def test_spelled_numbers_are_read_again(spark):
    numbers = [0, 5, 10, 12, 30, 99, 110, 1000, 1010, 1110, 4321, 9990, 12_000, 23_450, 10**6 + 2 * 10**5, 98_760_000, 3 * 10**8 + 45_670_000, 10**12 - 10**4]
    rows = spark.createDataFrame([(n,) for n in [*numbers, -1, 10**12, None]], "n long").select("n", numerals.spelled(F.col("n")).alias("t")).collect()
    said = {r.n: r.t for r in rows}
    assert (said[-1], said[10**12], said[None]) == (None, None, None)
    assert said[12_000] == "一萬二千" and said[1010] == "一千零一十" and said[0] == "零"
    assert {n: numerals.stated(said[n])[0][1] for n in numbers} == {n: [float(n)] for n in numbers}
