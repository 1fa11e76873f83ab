"""Streams: a budget in state with reservations and timers, over restarts; bursts of calls, late ones counted apart."""

import datetime

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from spindrift.streaming import bursts, budget

CALLS = "k long, seq long, ts timestamp, call long, kind string, micros long"


def at(hours):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def feed(spark, folder, rows, schema=CALLS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, hours=3.0, most=1.0):
    """One run over the files that are there, from the checkpoint of the runs before."""
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with budget.state_store(spark):
        told = budget.reserved(stream, "k", most, hours, late="0 seconds")
        told.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sorted(((r.k, r.kind, r.call, r.micros, r.admitted, r.spent, r.reserved) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=repr)


def test_reservations_restart_and_timers(spark, tmp_path):
    feed(spark, f"{tmp_path}/in", [(1, 3, at(0.3), 11, "reserve", 500_000), (1, 1, at(0.1), 10, "reserve", 400_000), (1, 2, at(0.2), 10, "settle", 300_000), (2, 4, at(0.1), 20, "reserve", 1_000_000)])
    first = run(spark, tmp_path)
    assert (1, "reserve", 10, 400_000, True, 0, 400_000) in first and (1, "settle", 10, 300_000, None, 300_000, 0) in first  # in the order of seq, whatever that of rows
    assert (1, "reserve", 11, 500_000, True, 300_000, 500_000) in first and (2, "reserve", 20, 1_000_000, True, 0, 1_000_000) in first
    feed(spark, f"{tmp_path}/in", [(1, 5, at(0.5), 12, "reserve", 150_000), (3, 6, at(9), 30, "reserve", 1)])  # a late event of another key moves the watermark
    second = run(spark, tmp_path)
    new = [r for r in second if r not in first]
    assert (1, "reserve", 12, 150_000, True, 300_000, 650_000) in new  # with what the first run knew
    assert (2, "released", 20, 1_000_000, None, 0, 0) in new and (1, "released", 11, 500_000, None, 300_000, 150_000) in new
    feed(spark, f"{tmp_path}/in", [(2, 7, at(9.5), 21, "reserve", 900_000), (2, 8, at(9.6), 22, "reserve", 200_000), (2, 9, at(9.7), 23, "reserve", 1)])
    third = [r for r in run(spark, tmp_path) if r not in second]
    assert {(r[2], r[4]) for r in third if r[0] == 2} == {(21, True), (22, False), (23, False)}  # given back, so there is room; the first refusal ends the key


def test_a_key_of_several_arrow_batches(spark, tmp_path):
    """The order of seq holds over all rows of a key in a micro-batch, however many batches carry them."""
    rows = [(1, n, at(n / 1e6), n // 2, ("reserve", "settle")[n % 2], 10) for n in range(3000)]
    feed(spark, f"{tmp_path}/in", rows[::-1])
    name = "spark.sql.execution.arrow.transformWithStateInPandas.maxRecordsPerBatch"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = run(spark, tmp_path, most=0.01)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert name and sorted(r[2] for r in found if r[1] == "reserve" and r[4]) == list(range(1000))


def test_bursts_and_late_calls(spark, tmp_path):
    schema = "k long, ts timestamp, usd double"
    minute = lambda m: at(m / 60)

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = bursts.bursts(stream, "k", "5 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        return bursts.dropped(q), sorted((r.k, r.start, r.n, r.usd) for r in spark.read.schema("k long, start timestamp, end timestamp, n long, usd double").parquet(f"{tmp_path}/out").collect())

    feed(spark, f"{tmp_path}/in", [(1, minute(0), 1.0), (1, minute(4), 2.0), (1, minute(20), 4.0), (2, minute(2), 8.0)], schema)
    late, found = go()
    assert late == 0 and found == [(2, minute(2), 1, 8.0)] or found == [(1, minute(0), 2, 3.0), (2, minute(2), 1, 8.0)]
    feed(spark, f"{tmp_path}/in", [(1, minute(60), 0.0), (1, minute(22), 16.0)], schema)
    go()
    feed(spark, f"{tmp_path}/in", [(1, minute(3), 32.0), (3, minute(61), 0.0)], schema)
    late, found = go()
    assert late == 1
    assert found == [(1, minute(0), 2, 3.0), (1, minute(20), 2, 20.0), (2, minute(2), 1, 8.0)]


def test_bursts_of_a_batch(spark):
    rows = spark.createDataFrame([(1, at(m / 60), 1.0) for m in (0, 4, 9, 13.5, 30)], "k long, ts timestamp, usd double")
    assert sorted((r.n, r.usd) for r in bursts.bursts(rows, "k", "5 minutes").collect()) == [(1, 1.0), (4, 4.0)]  # a gap of just five minutes doesn't divide


class Handle:
    """A store in memory that counts what is asked of it."""

    def __init__(self):
        self.asked, self.timers, self.kept = 0, [], {}

    def getValueState(self, name, schema):
        return Kept(self, name)

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)


class Kept:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def _ask(self):
        self.handle.asked += 1
        return self.handle.kept

    def get(self):
        return self._ask().get(self.name)

    def exists(self):
        return self.name in self._ask()

    def put(self, value):
        self._ask()[self.name] = value

    update = put

    def clear(self):
        self._ask().pop(self.name, None)


def given(calls):
    return [Row(seq=n, at=round(hours * 3_600_000), call=call, kind=kind, micros=amount) for n, (hours, call, kind, amount) in enumerate(calls)]


def test_a_key_costs_few_calls_to_the_store():
    handle, machine = Handle(), budget.Budget(1_000_000, 3.0)
    machine.init(handle)
    told = list(machine.handleInputRows((1,), given([(n / 100, n // 2, ("reserve", "settle")[n % 2], 10) for n in range(40)]), TimerValues(0, 0)))
    assert len(told) == 40 and told[-1].spent == 200 and told[-1].reserved == 0
    assert handle.asked <= 2 and handle.timers == []  # what is settled in the batch needs no timer and no list


def test_one_timer_stands_for_all_reservations_of_a_key():
    handle, machine, hour = Handle(), budget.Budget(1_000_000, 3.0), 3_600_000
    machine.init(handle)
    list(machine.handleInputRows((1,), given([(1, 10, "reserve", 5), (0, 11, "reserve", 7), (2, 12, "reserve", 1)]), TimerValues(0, 0)))
    assert handle.timers == [3 * hour]
    told = list(machine.handleExpiredTimer((1,), TimerValues(0, 4.5 * hour), ExpiredTimerInfo(3 * hour)))
    assert [(r.call, r.kind, r.micros, r.reserved) for r in told] == [(11, "released", 7, 6), (10, "released", 5, 1)]  # all that is due by the watermark, in the order it falls due
    assert handle.timers == [3 * hour, 5 * hour]
    told = list(machine.handleInputRows((1,), given([(5.5, 10, "settle", 4)]), TimerValues(0, 4.5 * hour)))
    assert [(r.call, r.kind, r.spent, r.reserved) for r in told] == [(12, "released", 0, 0), (10, "settle", 4, 0)]  # one given back may settle a span later
    list(machine.handleExpiredTimer((1,), TimerValues(0, 20 * hour), ExpiredTimerInfo(handle.timers[-1])))
    assert "reservations" not in handle.kept
