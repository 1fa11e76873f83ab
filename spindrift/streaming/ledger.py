"""The ledger as a stream: running rollups with late rows, and a budget that state keeps over batches. An extension; batches are the parity path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly(rows: DataFrame, ts: str, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """(window start, stage, usd, n) of ledger rows(ts, stage, usd), final when the watermark passes."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "stage").agg(F.sum("usd").alias("usd"), F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "stage", "usd", "n")


def guarded(rows: DataFrame, key: str, most: float) -> DataFrame:
    """(key, seq, usd, admitted) of rows(key, seq, usd): a row goes ahead while what its key has spent and its own amount don't pass the budget; the first that would ends the key."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, open_ = state.get if state.exists else (0.0, True)
        rows, out = pd.concat(list(batches)).sort_values("seq"), []  # a key's rows of a micro-batch may come in several
        for usd in rows["usd"]:
            open_ = open_ and spent + usd <= most
            spent += usd if open_ else 0.0
            out.append(open_)
        yield pd.DataFrame({key: name[0], "seq": rows["seq"], "usd": rows["usd"], "admitted": out})
        state.update((float(spent), bool(open_)))

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {dict(rows.dtypes)[key]}, seq long, usd double, admitted boolean", "spent double, open boolean", "append", GroupStateTimeout.NoTimeout)
