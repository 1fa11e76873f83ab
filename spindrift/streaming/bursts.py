"""Bursts of calls: the calls of a key with no more than a gap between neighbours, as session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def bursts(calls: DataFrame, key: str, gap: str, late: str = "10 minutes", value: str = "usd") -> DataFrame:
    """(key, start, end, n, usd) of each burst of calls(key, ts, value), end being a gap after its last call. Of a stream a burst is final when the watermark, `late` behind the latest call, passes its end; calls that come after the watermark are left out, and dropped() counts them. Spark merges neighbouring calls of a key before it shuffles them."""
    rows = calls.withWatermark("ts", late) if calls.isStreaming else calls
    found = rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias(value))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", value)


def dropped(query: StreamingQuery) -> int:
    """Late rows that a finished query left out, of one key and burst counted once for each micro-batch they came in."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
