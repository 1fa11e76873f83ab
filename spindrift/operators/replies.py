"""Replies of language models: JSON of unknown make read into candidate segments and scripts, and the prompts that ask for them.

Replies are parsed once into variants, so that texts, numbers, lists and objects can be told apart; a JSON null counts as absent. All lists of a reply stay arrays of its row, which a recording's few segments and lines fit, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce, numerals, text
from . import choose, gate, ledger

_POINTS = "array<struct<label:string,value:double,unit:string>>"
#: Assumed length of a transcript, its speed, and where else its length may be known, in order; fixed values.
ASSUMED_CHARS, CHARS_A_SECOND = 3000, 4.0
CHAR_KEYS = ("transcript_chars", "chars", "text_chars", "estimated_chars")
SECOND_KEYS = ("seconds_estimated", "seconds_billed", "duration_sec", "processed_duration_sec")
#: What stands for an empty list in a prompt, a fixed value.
NOTHING = "- （無）"


def variant(reply: Column) -> Column:
    """A reply, code fences taken off, as a variant; null where it is no JSON."""
    from ..sources.adapters import unfenced

    return F.try_parse_json(unfenced(reply))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value's expression in the plan once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind(v: Column) -> Column:
    """TEXT, LIST, OBJECT, NOTHING (a null or absent value) or OTHER (numbers and truth values)."""
    return let(F.schema_of_variant(v), lambda of: F.when(of.isNull() | (of == "VOID"), "NOTHING").when(of == "STRING", "TEXT").when(of.startswith("ARRAY"), "LIST").when(of.startswith("OBJECT"), "OBJECT").otherwise("OTHER"))


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def string(v: Column) -> Column:
    """A value as text; null for nothing."""
    return let(v, lambda x: F.when(kind(x) != "NOTHING", x.cast("string")))


def items(v: Column) -> Column:
    """The items of a list; none of any other value."""
    return F.coalesce(let(v, lambda x: F.when(kind(x) == "LIST", F.try_variant_get(x, "$", "array<variant>"))), F.array().cast("array<variant>"))


def plain(v: Column) -> Column:
    """A text, number or truth value as text, '' for any other."""
    return F.coalesce(let(v, lambda x: F.when(kind(x).isin("TEXT", "OTHER"), x.cast("string"))), F.lit(""))


def seconds(v: Column, default: float = 0.0) -> Column:
    return let(plain(v), lambda x: coerce.as_double(x, default))


def whole(v: Column, default: int) -> Column:
    return let(plain(v), lambda x: coerce.as_int(x, default))


def truth(v: Column) -> Column:
    """Texts that mean yes; of other values those that are not zero, false or empty."""
    return let(v, lambda x: F.when(kind(x) == "TEXT", coerce.as_bool(x.cast("string"))).otherwise(~F.coalesce(string(x), F.lit("null")).isin("null", "false", "0", "0.0", "[]", "{}")))


def points(v: Column) -> Column:
    """array<struct<label, value, unit>> of a list's objects whose value is a number; others are dropped, never defaulted."""
    objects = F.filter(items(v), lambda p: kind(p) == "OBJECT")
    return coerce.points(F.transform(objects, lambda p: F.struct(string(field(p, "label")).alias("label"), plain(field(p, "value")).alias("value"), string(field(p, "unit")).alias("unit"))))


def texts(v: Column) -> Column:
    """A text as a list of itself, a list's items that aren't blank as texts, nothing of other values."""
    listed = lambda x: F.filter(F.transform(items(x), lambda y: F.coalesce(y.cast("string"), F.lit("None"))), lambda y: text.stripped(y) != "")
    return let(v, lambda x: F.when(kind(x) == "TEXT", F.array(x.cast("string"))).otherwise(listed(x)))


def candidates(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with segments, an array of structs (id, start, end, topic, summary, key_points, data_points, has_chart_data, hook_score).

    Items that are no objects, have no topic or don't end after they start are dropped. A repeated id becomes one more than the largest before it; a missing one is the item's place. A chart needs the flag and two points; scores are held to 1 to 5. A reply without a list has no segments.
    """

    missing = -(2**31)

    def one(item: Column, i: Column) -> Column:
        made = F.struct(
            (kind(item) == "OBJECT").alias("good"),
            (i + 1).alias("place"),
            whole(field(item, "id"), missing).alias("id"),
            seconds(field(item, "start")).alias("start"),
            seconds(field(item, "end")).alias("end"),
            text.stripped(F.coalesce(string(field(item, "topic")), F.lit(""))).alias("topic"),
            text.stripped(F.coalesce(string(field(item, "summary")), F.lit(""))).alias("summary"),
            texts(field(item, "key_points")).alias("key_points"),
            points(field(item, "data_points")).alias("data_points"),
            truth(field(item, "has_chart_data")).alias("flag"),
            whole(field(item, "hook_score"), 1).alias("score"),
        )
        return let(made, lambda s: F.struct(s.good, s.place, s.id, s.start, s.end, s.topic, s.summary, s.key_points, s.data_points, (s.flag & (F.size(s.data_points) >= 2)).alias("has_chart_data"), F.greatest(F.lit(1), F.least(F.lit(5), s.score)).alias("hook_score")))

    listed = replies.withColumn("_made", F.transform(items(field(variant(F.col(reply)), "segments")), one))
    kept = listed.withColumn("_kept", F.filter("_made", lambda s: s.good & (s.topic != "") & (s.end > s.start)))
    own = F.transform("_kept", lambda s: F.when(s.id == missing, s.place).otherwise(s.id).cast("long"))
    numbered = kept.withColumn("_ids", gate.unique_ids(own))
    segments = F.zip_with("_kept", "_ids", lambda s, i: F.struct(i.cast("int").alias("id"), *[s[n].alias(n) for n in ("start", "end", "topic", "summary", "key_points", "data_points", "has_chart_data", "hook_score")]))
    return numbered.withColumn("segments", segments).drop("_made", "_kept", "_ids")


def scripts(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies(reply, topic, has_chart_data, attribution) with script, a struct (title, hook, lines, chart, est_seconds, ai_shot); null where the reply is no JSON object.

    Lines may be texts or objects; blank ones are dropped, numbers in them written in units. Without a hook the first line is it; a first line that says the hook again is dropped. A chart needs the flag and a series with points of one unit; its kind is bar unless line is said. One of the lines must hold the attribution, else it becomes the second.
    """
    found = replies.withColumn("_v", let(variant(F.col(reply)), lambda v: F.when(kind(v) == "OBJECT", v)))
    v = F.col("_v")

    def line(item: Column, of: Column) -> Column:
        words = F.when(of == "TEXT", item.cast("string")).when(of == "OBJECT", string(field(item, "text")))
        visual = F.when(of == "OBJECT", string(field(item, "visual")))
        return F.struct(text.stripped(F.coalesce(words, F.lit(""))).alias("text"), ((of == "OBJECT") & truth(field(item, "emphasis"))).alias("emphasis"), text.stripped(F.coalesce(visual, F.lit(""))).alias("visual"))

    def series(item: Column) -> Column:
        return F.struct(F.coalesce(string(field(item, "name")), F.lit("")).alias("name"), let(points(field(item, "points")), choose.major_points).alias("points"))

    def trimmed(name: str, default: Column) -> Column:
        return text.stripped(F.coalesce(F.nullif(string(field(v, name)), F.lit("")), default))

    found = found.withColumn("_lines", F.filter(F.transform(items(field(v, "lines")), lambda item: let(kind(item), lambda of: line(item, of))), lambda x: x.text != ""))
    # one call of the numerals' function a row: the lines, then hook and title
    spoken = F.concat(F.transform("_lines", lambda x: x.text), F.array(trimmed("hook", F.lit("")), trimmed("title", F.col("topic"))))
    found = found.withColumn("_said", numerals.humanise_each(spoken)).withColumn("_n", F.size("_lines"))
    found = found.withColumn("_lines", F.transform("_lines", lambda x, i: F.struct(F.get("_said", i).alias("text"), x.emphasis, x.visual)))
    found = found.withColumn("_first", F.get("_lines", F.lit(0)).text)
    found = found.withColumn("_hook", F.coalesce(F.nullif(F.get("_said", F.col("_n")), F.lit("")), "_first", F.lit(""))).withColumn("_title", F.get("_said", F.col("_n") + 1))
    again = (F.col("_n") > 0) & coerce.same_line(F.col("_first"), F.col("_hook"))
    found = found.withColumn("_lines", F.when(again, F.slice("_lines", 2, F.greatest("_n", F.lit(1)))).otherwise(F.col("_lines")))
    cited = F.struct(F.col("attribution").alias("text"), F.lit(False).alias("emphasis"), F.lit("").alias("visual"))
    found = found.withColumn("_lines", choose.with_line(F.col("_lines"), lambda x: x.text.contains(F.col("attribution")), cited))
    found = found.withColumn("_chart", let(field(v, "chart"), lambda c: F.when(F.col("has_chart_data") & (kind(c) == "OBJECT"), c)))
    chart = F.col("_chart")
    found = found.withColumn("_series", F.filter(F.transform(F.filter(items(field(chart, "series")), lambda x: kind(x) == "OBJECT"), series), lambda x: F.size(x.points) > 0))
    drawn = let(F.lower(string(field(chart, "type"))), lambda t: F.when(t.isin("bar", "line"), t).otherwise("bar"))
    spec = F.struct(drawn.alias("type"), F.coalesce(F.nullif(string(field(chart, "title")), F.lit("")), "topic").alias("title"), F.coalesce(string(field(chart, "y_label")), F.lit("")).alias("y_label"), F.col("_series").alias("series"))
    length = let(seconds(field(v, "est_seconds"), 30.0), lambda x: F.when(x == 0, 30.0).otherwise(x))
    script = F.struct(F.col("_title").alias("title"), F.col("_hook").alias("hook"), F.col("_lines").alias("lines"), F.when(F.size("_series") > 0, spec).alias("chart"), length.alias("est_seconds"), trimmed("ai_shot", F.lit("")).alias("ai_shot"))
    return found.withColumn("script", F.when(v.isNotNull(), script)).drop("_v", "_lines", "_said", "_n", "_first", "_hook", "_title", "_chart", "_series")


def bullets(listed: Column, line: Callable[[Column], Column]) -> Column:
    """A bullet for each item, or the word for nothing."""
    return F.when(F.size(listed) > 0, F.array_join(F.transform(listed, lambda x: F.concat(F.lit("- "), line(x))), "\n")).otherwise(NOTHING)


def script_prompt(segment: Column, said: Column, attribution: Column) -> Column:
    """What asks for the script of a segment: a struct (id, start, end, topic, summary, key_points, data_points, has_chart_data), what was said in it, and the sentence that names the source."""
    figure = lambda p: F.concat(p.label, F.lit(": "), numerals.general(p.value), p.unit)
    return F.concat(
        F.lit("segment_id: "), segment.id.cast("string"), F.lit("\ntopic: "), segment.topic, F.lit("\nsummary: "), segment.summary, F.lit("\nhas_chart_data: "), segment.has_chart_data.cast("string"),
        F.lit("\n出處句（必須完整出現在第 1 或第 2 句）："), attribution, F.lit("\n\nkey_points:\n"), bullets(segment.key_points, lambda x: x), F.lit("\n\ndata_points（數字只能用這些，或逐字稿裡出現的）:\n"), bullets(segment.data_points, figure),
        F.lit("\n\n原始逐字稿片段（"), text.clock(segment.start), F.lit("–"), text.clock(segment.end), F.lit("，只供了解事實，禁止照抄）：\n"), said,
    )


def estimate_basis(transcript: Column, meta: Column) -> tuple[Column, Column]:
    """Characters that an estimate counts with, and where they come from: the transcript if there is one, else the first positive length, else the first positive duration, of a map of numbers, else an assumed length."""
    chars, basis = F.length(transcript).cast("long"), F.when(transcript.isNotNull(), "transcript")
    for keys, scale, note in ((CHAR_KEYS, 1.0, "{}"), (SECOND_KEYS, CHARS_A_SECOND, "{} x " + f"{CHARS_A_SECOND} chars/s")):
        for key in keys:
            given = F.when(F.element_at(meta, F.lit(key)) > 0, F.element_at(meta, F.lit(key)))
            chars, basis = F.coalesce(chars, (given * scale).cast("long")), F.coalesce(basis, F.when(given.isNotNull(), note.format(key)))
    return F.coalesce(chars, F.lit(ASSUMED_CHARS).cast("long")), F.coalesce(basis, F.lit("assumed"))


def with_rejected(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """All clips, accepted ones and then rejected ones, told apart by the column accepted."""
    return accepted.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False)))


def estimated_cost(chars: Column, clips: Column, cheap: str, strong: str) -> Column:
    """Estimated dollars of both passes; models are named as in the price table."""
    per = lambda key, tokens: sum(t * p for t, p in zip(tokens, ledger.LLM_MILLION[key], strict=True)) / 1e6
    fixed, out = ledger.CHEAP_PASS
    first = (F.floor(chars / 1.3) + 1 + fixed) * (ledger.LLM_MILLION[cheap][0] / 1e6) + out * ledger.LLM_MILLION[cheap][1] / 1e6
    return F.round(first + clips * per(strong, ledger.STRONG_PASS), 6)
