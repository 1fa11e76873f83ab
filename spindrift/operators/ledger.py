"""Spending: price lookups, ledger rows, rollups, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import STAGES
from . import scan

# US dollars a minute, a million tokens in and out, a million characters, and what else a price needs.
STT_MINUTE = {"openai/gpt-4o-mini-transcribe": 0.003, "openai/gpt-4o-transcribe": 0.006, "openai/gpt-transcribe": 0.0045, "openai/whisper-1": 0.006, "local/faster-whisper": 0.0}
LLM_MILLION = {"openai/gpt-5-nano": (0.05, 0.40), "openai/gpt-4o-mini": (0.15, 0.60), "openai/gpt-5-mini": (0.25, 2.00), "openai/gpt-4.1-mini": (0.40, 1.60), "openai/gpt-5": (1.25, 10.00)}
TTS_MILLION = {"edge/edge-tts": 0.0, "openai/gpt-4o-mini-tts": 0.60, "openai/tts-1": 15.00}
TTS_AUDIO_CHARACTER = {"openai/gpt-4o-mini-tts": 12.0 / 1_000_000 * 4}
VIDEO_SECOND = 0.25
#: US dollars a video, by model, resolution or mode, and seconds.
VIDEO = {("MiniMax-Hailuo-02", "512P", 6): 0.08, ("MiniMax-Hailuo-02", "768P", 6): 0.27, ("MiniMax-Hailuo-02", "1080P", 6): 0.54, ("kling-v1", "std", 5): 0.18, ("kling-v1", "std", 10): 0.36, ("kling-v2-5-turbo", "std", 5): 0.31, ("kling-v2-5-turbo", "std", 10): 0.62}
#: Assumed tokens (in on top of the text, out) of the cheap pass and (in, out) of the strong pass for one clip.
CHEAP_PASS, STRONG_PASS = (600, 3300), (1200, 1600)


def price_key(provider: Column | str, model: Column | str) -> Column:
    return F.concat_ws("/", provider, model)


def _literal(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}D" if isinstance(x, float) else str(x)


def static_table(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A table of constants in the plan, whose size the optimizer knows."""
    listed = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({', '.join(names)})")


def prices(spark: SparkSession, table: dict, names: tuple[str, ...]) -> DataFrame:
    """A static price table (key, names...), of the size of the dictionary."""
    return static_table(spark, [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in table.items()], ("key", *names))


def priced(rows: DataFrame, table: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """rows(key, ...) with their prices; unknown keys are free. Spark broadcasts a price table that it knows to be small, as the static ones, and shuffles any other."""
    joined = rows.join(table, "key", "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})


def strictly_priced(rows: DataFrame, table: DataFrame, keys: list[str], price: str) -> DataFrame:
    """rows with their price; a key without one stops the query."""
    joined = rows.join(table, keys, "left")
    return joined.withColumn(price, F.when(F.col(price).isNull(), F.raise_error(F.concat(F.lit("no price for "), F.concat_ws("/", *keys)))).otherwise(F.col(price)))


def stt_rows(usage: DataFrame, *keep: str) -> DataFrame:
    """Ledger rows of usage(stage, provider, model, seconds, estimated): minutes; with further columns to keep."""
    table = prices(usage.sparkSession, STT_MINUTE, ("price",))
    minutes = F.col("seconds") / 60.0
    return priced(usage.withColumn("key", price_key("provider", "model")), table, ("price",)).select("stage", "provider", "model", F.lit("minute").alias("unit"), F.round(minutes, 3).alias("quantity"), F.col("price").alias("unit_price_usd"), F.round(minutes * F.col("price"), 6).alias("usd"), "estimated", F.concat(F.bround("seconds").cast("long").cast("string"), F.lit("s audio")).alias("note"), *keep)


def llm_rows(usage: DataFrame, *keep: str) -> DataFrame:
    """Two ledger rows for each of usage(stage, provider, model, input_tokens, output_tokens, estimated, note), with further columns to keep."""
    table = prices(usage.sparkSession, LLM_MILLION, ("price_in", "price_out"))
    found = priced(usage.withColumn("key", price_key("provider", "model")), table, ("price_in", "price_out"))
    kinds = [F.struct(F.lit(u).alias("unit"), F.col(u).cast("double").alias("quantity"), (F.col(p) / 1e6).alias("unit_price_usd"), F.round(F.col(u) * F.col(p) / 1e6, 6).alias("usd")) for u, p in (("input_tokens", "price_in"), ("output_tokens", "price_out"))]
    return found.select("stage", "provider", "model", "estimated", "note", *keep, F.inline(F.array(*kinds))).select("stage", "provider", "model", "unit", "quantity", "unit_price_usd", "usd", "estimated", "note", *keep)


def tts_rows(usage: DataFrame) -> DataFrame:
    """Ledger rows of usage(stage, provider, model, characters, estimated); one model's audio is billed a character besides."""
    table = prices(usage.sparkSession, {k: v / 1e6 + TTS_AUDIO_CHARACTER.get(k, 0.0) for k, v in TTS_MILLION.items()}, ("price",))
    return priced(usage.withColumn("key", price_key("provider", "model")), table, ("price",)).select("stage", "provider", "model", F.lit("characters").alias("unit"), F.col("characters").cast("double").alias("quantity"), F.col("price").alias("unit_price_usd"), F.round(F.col("characters") * F.col("price"), 6).alias("usd"), "estimated", F.lit("").alias("note"))


def reference_rows(clips: DataFrame) -> DataFrame:
    """What a hosted video API would charge for clips(seconds): estimated rows of provider 'reference'."""
    return clips.select(F.lit("s4_render").alias("stage"), F.lit("reference").alias("provider"), F.lit("ai-video-api").alias("model"), F.lit("second").alias("unit"), F.col("seconds").alias("quantity"), F.lit(VIDEO_SECOND).alias("unit_price_usd"), F.round(F.col("seconds") * VIDEO_SECOND, 4).alias("usd"), F.lit(True).alias("estimated"), F.lit("hosted video API").alias("note"))


def tokens_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 1.3) + 1


def pass_estimates(text_chars: Column, clips: Column) -> Column:
    """array of (pass, input_tokens, output_tokens) estimated for a transcript of so many characters and so many clips."""
    cheap = F.struct(F.lit("a").alias("pass"), (F.floor(text_chars / 1.3) + 1 + CHEAP_PASS[0]).alias("input_tokens"), F.lit(CHEAP_PASS[1]).cast("long").alias("output_tokens"))
    strong = F.struct(F.lit("b").alias("pass"), (clips * STRONG_PASS[0]).cast("long").alias("input_tokens"), (clips * STRONG_PASS[1]).cast("long").alias("output_tokens"))
    return F.array(cheap, strong)


def processed_seconds(seconds: Column, head: float, tail: float, speedup: float, silence: float = 0.03) -> Column:
    """Estimated audio left after trimming, cutting silence and speeding up."""
    return F.round(F.greatest(F.lit(0.0), seconds - head - tail) * (1 - silence) / speedup, 1)


def usd(raw: Column) -> Column:
    """A ledger amount of unknown make as a double; what can't be read is nothing."""
    return F.coalesce(raw.try_cast("double"), F.lit(0.0))


def is_reference() -> Column:
    return F.coalesce(F.col("provider") == "reference", F.lit(False))


def is_estimate() -> Column:
    return F.coalesce("estimated", F.lit(False)) & ~is_reference()


def is_real() -> Column:
    return ~F.coalesce("estimated", F.lit(False)) & ~is_reference()


def is_strong_pass(strong_model: str) -> Column:
    """Whether a row pays for the strong pass: by its note, else by its model."""
    note = F.lower(F.translate(F.coalesce("note", F.lit("")), "_-", "  "))
    return F.when(note.contains("pass b") | note.contains("passb"), True).when(note.contains("pass a") | note.contains("passa"), False).otherwise(F.coalesce(F.col("model") == strong_model, F.lit(False)))


def total(where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, F.col("usd"))), F.lit(0.0))


def rollup(ledger: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Spent, estimated and reference amounts, and further aggregates, in one aggregation."""
    sums = [F.round(total(w), 6).alias(n) for w, n in ((is_real(), "spent_usd"), (is_estimate(), "estimated_usd"), (is_reference(), "reference_usd"))]
    return ledger.groupBy(*keys).agg(*sums, *more) if keys else ledger.agg(*sums, *more)


def written(ledger: DataFrame, path: str, mode: str = "append") -> dict[str, float]:
    """Writes ledger rows and says what they come to, as rollup does, counted in the one pass that writes them; rows of a task that is tried again count once."""
    told = Observation()
    sums = {"spent_usd": total(is_real()), "estimated_usd": total(is_estimate()), "reference_usd": total(is_reference())}
    ledger.observe(told, *[c.alias(n) for n, c in sums.items()]).write.mode(mode).parquet(path)
    return {n: round(told.get[n], 6) for n in sums}


def by_stage(ledger: DataFrame, videos: DataFrame, key: str, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """One row for each video and each stage, also those without ledger rows; rows count for the stage they name."""
    if videos is ledger:  # one pass: the stages' sums side by side, then a row for each
        per = [(s, F.col("stage") == s) for s in stages]
        kinds = ((is_real(), "spent_usd"), (is_estimate(), "estimated_usd"), (is_reference(), "reference_usd"))
        wide = ledger.groupBy(key).agg(*[F.round(total(w & own), 6).alias(f"{n}_{i}") for i, (_, own) in enumerate(per) for w, n in kinds])
        rows = F.array(*[F.struct(F.lit(s).alias("stage"), *[F.col(f"{n}_{i}").alias(n) for _, n in kinds]) for i, (s, _) in enumerate(per)])
        return wide.select(key, F.inline(rows))
    grid = videos.select(key).distinct().withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    return grid.join(rollup(ledger, [key, "stage"]), [key, "stage"], "left").na.fill(0.0, ["spent_usd", "estimated_usd", "reference_usd"])


def in_stage_order(ledger: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """The ledgers of all stages one after another: rows of known stages with part, the stage's place from 1. One scan."""
    part = F.array_position(F.array(*map(F.lit, stages)), F.col("stage")).cast("int")
    return ledger.where(F.col("stage").isin(*stages)).withColumn("part", part)


def history(runs: DataFrame, key: str) -> DataFrame:
    """(key, history_usd): what all runs(key, usd) cost."""
    return runs.groupBy(key).agg(F.sum("usd").alias("history_usd"))


def savings_ratio(naive: Column, spent: Column) -> Column:
    """How many times the naive way would cost; null unless both are positive."""
    return F.when((naive > 0) & (spent > 0), F.round(naive / spent, 6))


def dry_run_estimate(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, estimate_usd): estimated amounts, without reference rows."""
    return ledger.groupBy(*keys).agg(total(is_estimate()).alias("estimate_usd"))


def render_totals(clips: DataFrame, key: str, kept: float = 0.97) -> DataFrame:
    """(key, seconds, saved_pct, reference_usd) of clips(key, seconds): total time, percent saved by what processing leaves of it, and what a hosted API would charge."""
    seconds = F.sum("seconds")
    return clips.groupBy(key).agg(seconds.alias("seconds"), F.round(100 * (1 - seconds * kept / seconds), 2).alias("saved_pct"), F.round(seconds * VIDEO_SECOND, 4).alias("reference_usd"))


def gate_counts(segments: DataFrame, key: str, selected: Column, model: str) -> DataFrame:
    """(key, total, selected, charts, saved_usd) of segments(key, has_chart_data): what the gate chose, and what the strong pass would have cost for the rest."""
    clip = sum(t * p for t, p in zip(STRONG_PASS, LLM_MILLION[model], strict=True)) / 1e6
    return segments.groupBy(key).agg(F.count("*").alias("total"), F.count_if(selected).alias("selected"), F.count_if("has_chart_data").alias("charts"), F.round(F.count_if(~selected) * clip, 6).alias("saved_usd"))


def saved_by_cache(per_stage: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """What the stages cost that each video's last run found cached; runs(key, run, stages_cached)."""
    last = runs.groupBy(key).agg(F.max_by("stages_cached", "run").alias("cached")).select(key, F.explode(F.array_distinct("cached")).alias("stage"))
    return per_stage.join(last, [key, "stage"], "left_semi").groupBy(key).agg(F.round(F.sum("spent_usd"), 6).alias("saved_usd"))


def naive_alternative(ledger: DataFrame, segments: DataFrame, key: str, strong_model: str) -> DataFrame:
    """What it would cost to pay the strong pass for every segment and a hosted API for the clips; segments(key, selected)."""
    paid = ledger.groupBy(key).agg(total(is_reference()).alias("reference_usd"), total(is_real() & (F.col("stage") == "s3_script") & is_strong_pass(strong_model)).alias("strong_usd"))
    counts = segments.groupBy(key).agg(F.count("*").alias("n"), F.count_if("selected").alias("chosen"))
    whole = F.when((F.coalesce("chosen", F.lit(0)) > 0) & (F.col("strong_usd") > 0), F.col("strong_usd") * F.col("n") / F.col("chosen")).otherwise(0.0)
    return paid.join(counts, key, "left").select(key, F.round("strong_usd", 6).alias("strong_usd"), F.round(whole, 6).alias("all_segments_usd"), F.round(F.col("reference_usd") + whole, 6).alias("naive_usd"))


def budget_guard(calls: DataFrame, key: str, order: str, most: float, hot: int = scan.HOT) -> DataFrame:
    """calls(key, order, estimate, actual) with spent_before and whether a call goes ahead: it and all before it must not pass the budget. Keys of any size, summed exactly."""
    actual = scan.exact(F.coalesce(F.col("actual"), F.lit(0)))
    upto = scan.running(calls.withColumn("_actual", actual), [key], [F.col(order)], {"_upto": F.col("_actual")}, hot)
    spent = (F.col("_upto") - F.col("_actual")).cast("double")
    over = upto.withColumn("spent_before", spent).withColumn("_over", (F.col("spent_before") + F.col("estimate") > most).cast("int"))
    refused = scan.running(over, [key], [F.col(order)], {"_refused": F.col("_over")}, hot)
    return refused.select(*calls.columns, "spent_before", (F.col("_refused") == 0).alias("admitted"))


def worst_provider(chain: DataFrame, key: str) -> DataFrame:
    """The dearest provider left in each chain(key, pos, provider, usd); of equals the first."""
    sums = chain.groupBy(key, "provider").agg(F.sum("usd").alias("usd"), F.min("pos").alias("pos"))
    return sums.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("usd"), "pos"))).where("r = 1").drop("r", "pos")


def worst_left(chain: DataFrame, key: str) -> DataFrame:
    """(key, at, worst): for each place in a chain(key, at, usd) of providers, at from 0, the dearest price from there on."""
    after = Window.partitionBy(key).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    return chain.select(key, "at", F.max("usd").over(after).alias("worst"))


def chain_guard(shots: DataFrame, chain: DataFrame, key: str, order: str, most: float) -> DataFrame:
    """shots(key, order, used, actual) with active, estimate, spent_before and admitted: before each shot the budget must hold what is spent and the dearest of the providers that are left. A provider that was passed over stays so: active is the furthest place in the chain(key, at, usd) used before."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    active = shots.withColumn("active", F.coalesce(F.max("used").over(before), F.lit(0)))
    left = worst_left(chain, key).select(key, F.col("at").alias("active"), F.col("worst").alias("estimate"))
    return budget_guard(active.join(left, [key, "active"]), key, order, most)


def billed_quantity(unit: Column, shots: Column, seconds: Column) -> Column:
    """What a provider bills by: graphics-card seconds and video seconds for each shot, or videos."""
    return F.when(unit.isin("gpu_second", "second"), shots * seconds).when(unit == "video", shots.cast("double")).otherwise(F.lit(0.0))


def frames(seconds: Column, rate: int = 24) -> Column:
    """A frame count of the form 8k + 1, at least 9."""
    n = F.bround(seconds * rate).cast("long")
    return F.greatest(F.lit(9).cast("long"), F.floor((n + 6) / 8) * 8 + 1)


def snapped(seconds: Column, short: int, long: int) -> Column:
    """The duration on offer that covers the seconds, else the longer one."""
    return F.when(seconds <= short, short).otherwise(long)


def video_prices(spark: SparkSession) -> DataFrame:
    """(model, mode, seconds, price): the static table with a key of three columns, for strictly_priced."""
    return static_table(spark, [(*k, v) for k, v in VIDEO.items()], ("model", "mode", "seconds", "price"))


def footage_rows(requests: DataFrame) -> DataFrame:
    """Ledger rows of requests(provider, n, estimated): searches cost nothing."""
    return requests.select(F.lit("s4_render").alias("stage"), "provider", F.lit("search").alias("model"), F.lit("request").alias("unit"), F.col("n").cast("double").alias("quantity"), F.lit(0.0).alias("unit_price_usd"), F.lit(0.0).alias("usd"), "estimated", F.concat(F.col("n").cast("string"), F.lit(" search(es)")).alias("note"))
