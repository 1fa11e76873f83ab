"""Timed text: interval joins, packing, allocation of time, windows of scenes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.text import stripped
from ..storage import stored
from . import scan


def overlaps(spans: DataFrame, segments: DataFrame, key: str, pad: float = 0.0, bucket: float = 60.0) -> DataFrame:
    """Pairs of spans(key, span_id, lo, hi) and segments(key, pos, start, end, text) that overlap by more than a point, spans widened by pad.

    Both sides are dealt into time buckets besides the key, so a long recording is split over tasks; a pair counts in the first bucket that both reach, so it comes once.
    """
    widened = spans.select(key, "span_id", (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi")).where("hi > lo")
    first, last = (lambda c: F.floor(c / bucket)), (lambda c: F.floor(c / bucket))
    left = widened.withColumn("b", F.explode(F.sequence(first(F.col("lo")), last(F.col("hi")))))
    right = segments.where(F.col("end") >= F.col("start")).withColumn("b", F.explode(F.sequence(first(F.col("start")), last(F.col("end")))))
    joined = left.join(right, [key, "b"]).where((F.col("end") > F.col("lo")) & (F.col("start") < F.col("hi")))
    return joined.where(F.col("b") == F.greatest(first(F.col("lo")), first(F.col("start")))).drop("b")


def ordered_text(group: DataFrame, keys: list[str], order: str = "pos", text: str = "text", sep: str = "") -> DataFrame:
    """The texts of each group, joined in order."""
    return group.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), sep).alias("text"))


def running_spans(duration: Column, gap: float, key: Column | str, order: Column | str, digits: int = 3) -> tuple[Column, Column]:
    """Start and end of consecutive pieces with a gap after each; the gap belongs to the piece before it."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(duration + gap).over(before), F.lit(0.0))
    return F.round(start, digits), F.round(start + duration + gap, digits)


def timed(pieces: DataFrame, duration: Column, gap: float, key: str, order: str, digits: int = 3, most: int = scan.HOT) -> DataFrame:
    """pieces with start and end as running_spans has them, for keys of any size; summed exactly."""
    whole = scan.exact(duration + gap)
    summed = scan.running(pieces.withColumn("_d", duration), [key], [F.col(order)], {"_upto": whole}, most)
    end = F.col("_upto").cast("double")
    return summed.select(*pieces.columns, F.round((F.col("_upto") - F.coalesce(scan.exact(F.col("_d") + gap), F.lit(0))).cast("double"), digits).alias("start"), F.round(end, digits).alias("end"))


def shared_out(texts: DataFrame, length: Column, lo: Column, hi: Column, key: str, order: str, most: int = scan.HOT) -> DataFrame:
    """texts with start and end as allocated has them, for keys of any size."""
    named = texts.withColumn("_n", length.cast("long"))
    totals = named.groupBy(key).agg(F.greatest(F.sum("_n"), F.lit(1)).alias("_total"))
    summed = scan.running(named, [key], [F.col(order)], {"_done": F.col("_n")}, most).join(totals, key)
    span = F.greatest(hi - lo, F.lit(0.0))
    return summed.select(*texts.columns, (lo + span * (F.col("_done") - F.col("_n")) / F.col("_total")).alias("start"), (lo + span * F.col("_done") / F.col("_total")).alias("end"))


def allocated(length: Column, lo: Column, hi: Column, key: str, order: str) -> tuple[Column, Column]:
    """Start and end of texts that share a span in proportion to their lengths."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    span, total = F.greatest(hi - lo, F.lit(0.0)), F.greatest(F.sum(length).over(whole), F.lit(1))
    done = F.sum(length).over(upto)
    return lo + span * (done - length) / total, lo + span * done / total


def phrases(text: Column, target: int = 30) -> Column:
    """Pieces of a text: sentences end a piece, and words of a sentence are joined without a space up to target characters. One pattern finds a piece: the most characters up to the target that end where a word or the sentence does, else the whole of a longer word; so a text takes time in proportion to its length, however many pieces it has."""
    from ..functions.text import SENTENCE_ENDS

    inside, end = rf"[^\s{SENTENCE_ENDS}]", f"[{SENTENCE_ENDS}]"
    fits = rf"(?:{inside}\s*+){{0,{target - 1}}}(?:{end}|{inside}(?!\S))|" if target > 0 else ""
    found = F.regexp_extract_all(text, F.lit(f"{fits}{inside}++{end}?|{end}"), F.lit(0))
    return F.transform(found, lambda piece: F.regexp_replace(piece, r"\s+", ""))


def packed_lines(segments: Column, most_chars: int = 60, most_span: float = 15.0) -> Column:
    """array<struct<start, text>> of an ordered array of structs (start, end, text): neighbours are joined until a line would be too long or span too much time; blank ones are skipped."""
    line = "struct<start:double,text:string>"
    begin = F.struct(F.array().cast(f"array<{line}>").alias("done"), F.lit(0.0).alias("start"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        text = stripped(s.text)
        blank, fresh = F.coalesce(text, F.lit("")) == "", acc.text == ""
        flush = ~fresh & ((F.length(acc.text) + F.length(text) > most_chars) | (s.end - acc.start > most_span))
        whole = F.struct(acc.start.alias("start"), acc.text.alias("text"))
        done = F.when(~blank & flush, F.array_append(acc.done, whole)).otherwise(acc.done)
        start = F.when(~blank & (fresh | flush), s.start).otherwise(acc.start)
        out = F.when(blank, acc.text).when(flush, text).otherwise(F.concat(acc.text, text))
        return F.struct(done.alias("done"), start.cast("double").alias("start"), out.alias("text"))

    return F.aggregate(segments, begin, step, lambda acc: F.when(acc.text != "", F.array_append(acc.done, F.struct(acc.start.alias("start"), acc.text.alias("text")))).otherwise(acc.done))


#: Rows of a recording that one task packs where a recording is split.
CHUNK = 16_384
_LINE = "pos long, start double, text string"


def packed(segments: DataFrame, key: str, most_chars: int = 60, most_span: float = 15.0, most: int = scan.HOT, chunk: int = CHUNK) -> DataFrame:
    """(key, pos, start, text) of the lines of segments(key, pos, start, end, text), pos and start of their first segment: neighbours are joined until a line would be too long or span too much time; blank ones are skipped.

    Recordings of up to `most` segments stream through a task each, in order. A longer one is dealt into chunks. Where a line starts says where the next one does, no further on than a line has characters; so each chunk tells, for each of its first segments, at which of the next chunk's first segments the line that reaches there ends. These steps are doubled, two of them make one over twice as many chunks, and going down the powers of two finds where each chunk's first line really starts; then all chunks pack at once.
    """
    rows = segments.select(key, F.col("pos").cast("long").alias("pos"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), stripped(F.col("text")).alias("text")).where("text <> ''")
    kind = dict(rows.dtypes)[key]
    if not scan.hot(rows, [key], most):
        ordered = rows.repartition(key).sortWithinPartitions(key, "pos")
        return ordered.mapInArrow(lambda batches: _stream(batches, key, most_chars, most_span), f"{key} {kind}, {_LINE}")
    chunk = max(chunk, most_chars + 1)
    counted = scan.running(rows, [key], [F.col("pos")], {"n": F.lit(1), "upto": F.length("text")}, most)
    number, within = F.floor((F.col("n") - 1) / chunk), (F.col("n") - 1) % chunk
    both = F.when((within < most_chars) & (number > 0), F.array(number, number - 1)).otherwise(F.array(number))  # the first ones also end the chunk before
    dealt = stored(counted.select(key, F.explode(both).alias("chunk"), "n", "upto", "pos", "start", "end", "text"))
    steps = stored(dealt.groupBy(key, "chunk").applyInArrow(lambda names, t: _steps(names, t, key, chunk, most_chars, most_span), f"{key} {kind}, chunk long, entry long, exit long"))
    longest = steps.agg(F.max("chunk")).first()[0] or 0
    doubled, width = [steps], 1
    while 2 * width <= longest:  # from chunks that are multiples of a power of two, over as many chunks
        far = doubled[-1].select(key, (F.col("chunk") - width).alias("chunk"), F.col("entry").alias("exit"), F.col("exit").alias("to"))
        near = doubled[-1].where(F.col("chunk") % (2 * width) == 0)
        doubled.append(stored(near.join(far, [key, "chunk", "exit"]).select(key, "chunk", "entry", F.col("to").alias("exit"))))
        width *= 2
    begins = steps.where("chunk = 0").select(key, "chunk", F.lit(0).cast("long").alias("entry")).distinct()
    for step in reversed(doubled):
        begins = stored(begins.unionByName(begins.join(step, [key, "chunk", "entry"]).select(key, (F.col("chunk") + width).alias("chunk"), F.col("exit").alias("entry"))))
        width //= 2
    placed = dealt.join(begins, [key, "chunk"])
    return placed.groupBy(key, "chunk").applyInArrow(lambda names, t: _pack_chunk(names, t, key, chunk, most_chars, most_span), f"{key} {kind}, {_LINE}")


def _stream(batches: Iterator[pa.RecordBatch], key: str, most_chars: int, most_span: float) -> Iterator[pa.RecordBatch]:
    """Lines of rows (key, pos, start, end, text) in order; one line in memory."""
    now, parts, size, first, begun, kind = None, [], 0, None, 0.0, None
    for b in batches:
        kind, out = b.schema.field(key).type, ([], [], [], [])

        def line() -> None:
            for column, x in zip(out, (now, first, begun, "".join(parts)), strict=True):
                column.append(x)

        for name, pos, start, end, text in zip(*(b.column(c).to_pylist() for c in (key, "pos", "start", "end", "text")), strict=True):
            if parts and (name != now or size + len(text) > most_chars or (end is not None and begun is not None and end - begun > most_span)):
                line()
                parts = []
            if not parts:
                now, first, begun, size = name, pos, start, 0
            parts.append(text)
            size += len(text)
        yield _lines(out, key, kind)
    if parts:
        yield _lines(([now], [first], [begun], ["".join(parts)]), key, kind)


def _lines(columns: tuple[list, list, list, list], key: str, kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.float64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], [key, "pos", "start", "text"])


def _next_lines(t: pa.Table, most_chars: int, most_span: float) -> np.ndarray:
    """For a line that starts at each row of a chunk in order: the row that starts the next one; the number of rows if none does."""
    upto = t.column("upto").to_numpy()
    start, end = (t.column(c).to_numpy().astype(float) for c in ("start", "end"))  # nan where null, which is over no span
    size, n = np.diff(upto, prepend=upto[0] - len(t.column("text")[0].as_py())), len(upto)
    rows = np.arange(n)
    following = np.maximum(np.searchsorted(upto, upto - size + most_chars, "right"), rows + 1)  # by prefix sums of lengths
    for ahead in range(1, most_chars + 1):
        open_ = np.nonzero(rows + ahead < following)[0]
        if not len(open_):
            break
        late = open_[end[open_ + ahead] - start[open_] > most_span]
        following[late] = late + ahead
    return following


def _sorted(t: pa.Table) -> pa.Table:
    return t.sort_by("n").combine_chunks()


def _steps(names: tuple, t: pa.Table, key: str, chunk: int, most_chars: int, most_span: float) -> pa.Table:
    t = _sorted(t)
    n, number = t.num_rows, names[1].as_py()
    to = np.minimum(_next_lines(t, most_chars, most_span), n)
    inside = min(chunk, n)
    leap = np.append(to, n)
    while (leap[:inside] < inside).any():
        leap = np.where(leap < inside, leap[np.minimum(leap, n)], leap)
    entries = np.arange(min(most_chars, inside))
    exits = leap[entries]
    on = exits < n  # else the recording ends here
    entries, exits = entries[on], exits[on] - chunk
    if not len(entries):
        entries, exits = np.array([0]), np.array([-1])  # a chunk that nothing follows
    of = [pa.array([names[0].as_py()] * len(entries), names[0].type), pa.array([number] * len(entries), pa.int64()), pa.array(entries, pa.int64()), pa.array(exits, pa.int64())]
    return pa.table(of, [key, "chunk", "entry", "exit"])


def _pack_chunk(names: tuple, t: pa.Table, key: str, chunk: int, most_chars: int, most_span: float) -> pa.Table:
    """The lines that start in a chunk, from its first one on."""
    t = _sorted(t)
    to, at = _next_lines(t, most_chars, most_span).tolist(), t.column("entry")[0].as_py()
    texts, pos, start = (t.column(c).to_pylist() for c in ("text", "pos", "start"))
    out: tuple[list, list, list, list] = ([], [], [], [])
    while 0 <= at < min(chunk, t.num_rows):
        for column, x in zip(out, (names[0].as_py(), pos[at], start[at], "".join(texts[at : to[at]])), strict=True):
            column.append(x)
        at = to[at]
    return pa.Table.from_batches([_lines(out, key, names[0].type)])


class PackedLines:
    """packed_lines(TABLE(segments) PARTITION BY key ORDER BY (pos), most_chars, most_span) for SQL: the lines of packed(), a partition of the table at a time, a line in memory. The table has columns key (any name and type, the first), pos, start, end and text; the result's columns are the key as the table has it, pos, start and text."""

    @staticmethod
    def analyze(segments: AnalyzeArgument, most_chars: AnalyzeArgument, most_span: AnalyzeArgument) -> AnalyzeResult:
        if not segments.isTable or len(segments.dataType.fields) < 5:
            raise ValueError("packed_lines needs a table of a key, pos, start, end and text")
        if not (most_chars.isConstantExpression and most_span.isConstantExpression):
            raise ValueError("limits of packed_lines must be constants")
        key = segments.dataType.fields[0]
        return AnalyzeResult(T.StructType([T.StructField(key.name, key.dataType), T.StructField("pos", T.LongType()), T.StructField("start", T.DoubleType()), T.StructField("text", T.StringType())]))

    def __init__(self) -> None:
        self.parts: list[str] = []

    def eval(self, row: Row, most_chars: int, most_span: float) -> Iterator[tuple]:
        text = (row["text"] or "").strip()
        if not text:
            return
        end = row["end"]
        if self.parts and (sum(map(len, self.parts)) + len(text) > most_chars or (end is not None and self.start is not None and float(end) - self.start > float(most_span))):
            yield self._line()
        if not self.parts:
            self.key, self.pos, self.start = row[0], int(row["pos"]), None if row["start"] is None else float(row["start"])
        self.parts.append(text)

    def _line(self) -> tuple:
        text = "".join(self.parts)
        self.parts = []
        return self.key, self.pos, self.start, text

    def terminate(self) -> Iterator[tuple]:
        if self.parts:
            yield self._line()


def register(spark: SparkSession) -> None:
    """Makes packed_lines available to SQL."""
    spark.udtf.register("packed_lines", udtf(PackedLines))


def bucket_of(i: Column, lines: Column, buckets: Column) -> Column:
    """Which of `buckets` even runs the i-th (from 0) of `lines` lines falls in: bucket j takes [j*lines div buckets, (j+1)*lines div buckets)."""
    return F.floor(((i + 1) * buckets - 1) / lines)


def scenes(lines: DataFrame, key: str, wanted: Column, total: str = "total") -> DataFrame:
    """(key, scene, start, end) from lines(key, pos from 0, start, end, total): the first line alone, the others in even runs; the last scene ends a second after the total."""
    whole = Window.partitionBy(key)
    n = lines.withColumn("n", F.count("*").over(whole)).withColumn("w", F.greatest(F.lit(1), F.least(wanted, F.col("n"))))
    scene = F.when((F.col("pos") == 0) | (F.col("w") == 1), F.lit(0)).otherwise(1 + bucket_of(F.col("pos") - 1, F.col("n") - 1, F.col("w") - 1))
    grouped = n.withColumn("scene", scene.cast("int")).groupBy(key, "scene").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first(total).alias(total))
    last = F.max("scene").over(whole)
    return grouped.select(key, "scene", F.when(F.col("scene") == 0, F.lit(0.0)).otherwise(F.col("start")).alias("start"), F.when(F.col("scene") == last, F.col(total) + 1.0).otherwise(F.col("end")).alias("end"))


def last_extended(end: Column, total: Column, key: str, order: str) -> Column:
    """Ends, the last of each key moved to a second after the total if that is later."""
    following = F.lead(end).over(Window.partitionBy(key).orderBy(order))
    return F.when(following.isNull(), F.greatest(end, total + 1.0)).otherwise(end)


def filled(value: Column, key: str, order: str, default: Column) -> Column:
    """The last value up to here that isn't null; before the first one, default."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(value, ignorenulls=True).over(upto), default)


def furthest(index: Column, key: str, order: str) -> Column:
    """A state that only moves on: the largest index so far."""
    return F.coalesce(F.max(index).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def chunk(t: Column, seconds: float = 600.0) -> Column:
    return F.floor(t / seconds)


def transcript_summary(segments: DataFrame, key: str, known: Column) -> DataFrame:
    """(key, segments, chars, duration) of segments(key, end, text): the duration that is known, else the latest end."""
    return segments.groupBy(key).agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars"), F.coalesce(F.first(known), F.max("end")).alias("duration"))


def processed_or_known(processed: Column, original: Column, name: Column) -> Column:
    """Seconds of audio that are processed, else the original length; a recording without either stops the query."""
    usable = F.coalesce(F.when(processed > 0, processed), F.when(original > 0, original))
    return F.when(usable.isNull(), F.raise_error(F.concat(F.lit("no duration known for "), name))).otherwise(usable)
