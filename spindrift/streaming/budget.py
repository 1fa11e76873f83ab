"""A budget that a stream of calls draws on: calls reserve money and settle, and what isn't settled in time is given back.

State by key: what is spent, whether the budget has ended, and the list of open reservations. A reservation falls due a span after its event time; a timer gives it back when the watermark passes that, or an event of its key that is later does. Amounts are whole millionths of a dollar, so sums are exact. An extension of the running budget guard (ledger.budget_guard): where every call settles before the next, the same calls are admitted.

The list holds the open reservations of one key; the rows of a key in one micro-batch are brought together and taken in the order of seq.
"""

from __future__ import annotations

import contextlib
import math
from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a reservation that nobody settles is given back after.
HOURS = 3.0
TOLD = "seq long, call long, kind string, micros long, admitted boolean, spent long, reserved long"
_ROW = Row("key", *[x.split()[0] for x in TOLD.split(", ")])


def micros(usd: Column) -> Column:
    return F.round(usd * 1_000_000).cast("long")


class Budget(StatefulProcessor):
    """Rows (seq, ts, call, kind 'reserve' or 'settle', micros) of a key to rows of TOLD, of kind 'reserve', 'settle' and 'released'.

    Keys with few rows in a batch are the rule, so a key costs few calls to the store: the list is read only of known keys and written only where something is or was open, and one timer stands for all reservations of a key, at the first that falls due.
    """

    def __init__(self, most: int, hours: float):
        self.most, self.span = most, round(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "spent long, ended boolean")
        self.list = handle.getListState("reservations", "call long, micros long, due long, back boolean")

    def _load(self) -> None:
        known = self.totals.get()
        self.spent, self.ended = (int(known[0]), bool(known[1])) if known else (0, False)
        rows = self.list.get() if known and self.list.exists() else ()
        self.open = {int(r[0]): (int(r[1]), int(r[2]), bool(r[3])) for r in rows}
        self.held = sum(m for m, _, back in self.open.values() if not back)
        self.known, self.first = (self.spent, self.ended) if known else None, self._due()
        self.listed, self.timed = bool(self.open), self.first

    def _due(self) -> float:
        return min((due for _, due, _ in self.open.values()), default=math.inf)

    def _keep(self) -> None:
        """Stores what has changed, and a timer at the first reservation due unless that has been its time before."""
        if self.known != (self.spent, self.ended):
            self.totals.update((self.spent, self.ended))
        if self.open:
            self.list.put([(call, *r) for call, r in self.open.items()])
            if (first := self._due()) != self.timed:
                self.handle.registerTimer(first)
        elif self.listed:
            self.list.clear()

    def _released(self, key: tuple, now: int) -> Iterator[Row]:
        """Gives back what is due; such a call is known for one span more, as it may still settle. Nothing is looked through before the first is due."""
        if now < self.first:
            return
        for call, (amount, due, back) in sorted(self.open.items(), key=lambda r: r[1][1]):
            if due > now:
                break
            if back:
                del self.open[call]
                continue
            self.open[call] = (amount, due + self.span, True)
            self.held -= amount
            yield _ROW(key[0], None, call, "released", amount, None, self.spent, self.held)
        self.first = self._due()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._load()
        seqs, times, calls, amounts, reserves = array("q"), array("q"), array("q"), array("q"), bytearray()
        for r in rows:  # a key's rows as plain numbers, as there may be many
            seqs.append(r.seq)
            times.append(r.at)
            calls.append(r.call)
            amounts.append(r.micros)
            reserves.append(r.kind == "reserve")
        for i in sorted(range(len(seqs)), key=seqs.__getitem__):
            now, call, amount, admitted = times[i], calls[i], amounts[i], None
            yield from self._released(key, now)
            if reserves[i]:
                admitted = not self.ended and self.spent + self.held + amount <= self.most
                self.ended = not admitted
                if admitted:
                    self._settled(call)  # a call that reserves anew holds what it reserved last
                    self.open[call] = (amount, now + self.span, False)
                    self.held, self.first = self.held + amount, min(self.first, now + self.span)
            elif self._settled(call):
                self.spent += amount
            yield _ROW(key[0], seqs[i], call, "reserve" if reserves[i] else "settle", amount, admitted, self.spent, self.held)
        self._keep()

    def _settled(self, call: int) -> bool:
        """Closes a call's reservation, if there is one."""
        was = self.open.pop(call, None)
        if was and not was[2]:
            self.held -= was[0]
        return was is not None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        self.timed = math.inf  # this timer is gone
        yield from self._released(key, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        self._keep()

    def close(self) -> None:
        pass


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that processors with timers need, for queries started inside; the session's own choice comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def reserved(calls: DataFrame, key: str, most_usd: float, hours: float = HOURS, late: str = "1 hour") -> DataFrame:
    """(key, seq, call, kind, micros, admitted, spent, reserved) for a stream of calls(key, seq, ts, call, kind, micros): whether a reservation is admitted, it and what is spent and reserved not passing the budget; the first that is refused ends the key. spent and reserved are after the row; a settled call's micros are what it cost, whatever was reserved; one that is settled after its reservation was given back still counts, up to a span later. Start the query within state_store()."""
    kind = dict(calls.dtypes)[key]
    rows = calls.withWatermark("ts", late).select(F.col(key).alias("key"), "seq", "ts", F.unix_millis("ts").alias("at"), "call", "kind", "micros")
    return rows.groupBy("key").transformWithState(Budget(round(most_usd * 1_000_000), hours), f"key {kind}, {TOLD}", "append", "EventTime").withColumnRenamed("key", key)
