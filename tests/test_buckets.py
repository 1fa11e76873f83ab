"""Tables in buckets: what changed is computed again and nothing else, and changes kept beside a table."""

import random

from pyspark.sql import functions as F

from spindrift.sources import buckets

ROWS = "k long, i long, x long"


def frame(spark, rows, schema=ROWS):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_fingerprints_have_no_order_and_see_each_change(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i, rng.choice([None, i])) for i in range(400)] + [(None, 1, 1), (7, 7, 7), (7, 7, 7)]
    prints = lambda r: {tuple(x) for x in buckets.prints(frame(spark, r), ["k"], 16).collect()}
    first = prints(rows)
    rng.shuffle(rows)
    assert prints(rows) == first and len(first) <= 16
    for other in (rows[1:], [*rows, rows[0]], [(rows[0][0], rows[0][1], -9), *rows[1:]], [(rows[0][0], rows[0][2], rows[0][1]), *rows[1:]]):
        if sorted(other, key=repr) != sorted(rows, key=repr):
            assert prints(other) != first


def test_only_what_changed_is_computed_again(spark, tmp_path):
    seen = []

    def totals(rows):
        seen.append({r.k for r in rows.select("k").distinct().collect()})
        return rows.groupBy("k").agg(F.sum("x").alias("x")).where("x <> 13")

    table = buckets.Buckets(spark, f"file://{tmp_path}/t", "k long, x long", ["k"], 32)
    where = lambda keys: {r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(buckets.bucket_of(["k"], 32)).collect()}
    rows = [(k, i, k + i) for k in range(100) for i in range(3)]
    states = [rows, rows, [(k, i, x + (k == 5)) for k, i, x in rows if k != 9], [(k, i, x) for k, i, x in rows if k < 4], [], [(1, 1, 13), (2, 1, 1)]]
    changes = [set(range(100)), set(), {5, 9}, set(range(4, 100)), set(range(4)), {1, 2}]
    for state, change in zip(states, changes, strict=True):
        got, written = buckets.refreshed(table, frame(spark, state), totals)
        want = {}
        for k, _, x in state:
            want[k] = want.get(k, 0) + x
        assert {r.k: r.x for r in got.collect()} == {k: x for k, x in want.items() if x != 13}
        if change <= {5, 9} or change == set(range(100)):
            assert set(written) == where(change)  # 5 and 9 have changed, and with them nothing but their buckets
    assert len(seen) == 5  # a state like the one before computes nothing


def test_three_rounds_of_changes(spark, tmp_path):
    rng = random.Random(4)
    schema = "k long, g string, v string"
    table, want, seq = buckets.Deltas(spark, f"file://{tmp_path}/t", schema, ["k", "g"], 16), {}, 0
    assert table.read().count() == 0 and table.compact() == []
    for _ in range(3):
        seq += 1
        rows = {(rng.randrange(60), rng.choice("ab")): f"{seq}-{i}" for i in range(40)}
        table.upsert(frame(spark, [(*k, v) for k, v in rows.items()], schema), seq)
        want |= rows
        seq += 1
        gone = [(rng.randrange(60), rng.choice("ab")) for _ in range(15)]
        table.delete(frame(spark, gone, "k long, g string"), seq)
        for k in gone:
            want.pop(k, None)
        read = lambda: sorted(map(tuple, table.read().collect()))
        assert read() == sorted((*k, v) for k, v in want.items())
        written = table.compact()
        assert written and read() == sorted((*k, v) for k, v in want.items())
        assert table.deltas().count() == 0 and table.compact() == []
    seq += 1
    table.upsert(frame(spark, [(1000, "a", "x")], schema), seq)
    assert len(table.compact()) == 1  # one bucket is written for one row


def test_reading_opens_only_live_files(spark, tmp_path):
    table = buckets.Buckets(spark, f"file://{tmp_path}/t", "k long, x long", ["k"], 8)
    same = lambda rows: rows.groupBy("k").agg(F.sum("x").alias("x"))
    for add in range(3):
        got, _ = buckets.refreshed(table, frame(spark, [(k, 0, k + add * (k == 3)) for k in range(40)]), same)
    files = got.select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 8 and len(list(tmp_path.glob("t/data/gen=*/bucket=*/part-*"))) > files
