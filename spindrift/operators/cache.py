"""Results kept by the hash of their configuration, and the record of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import STAGES


def quoted(text: Column) -> Column:
    """A JSON string with non-ASCII kept."""
    out = text
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), out, F.lit('"'))


def canonical(config: Column) -> Column:
    """JSON of a map of JSON values by key, keys sorted, ', ' and ': ' between: {"a": 1, "b": "x"}."""
    entries = F.array_sort(F.map_entries(config))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e.key), F.lit(": "), F.coalesce(e.value, F.lit("null")))), ", "), F.lit("}"))


def config_hash(config: Column) -> Column:
    """The first 16 hex digits of SHA-256 over the canonical JSON."""
    return F.left(F.sha2(canonical(config), 256), F.lit(16))


def search_name(query: Column) -> Column:
    """The first 12 hex digits of SHA-1 of a query."""
    return F.left(F.sha1(query), F.lit(12))


def shot_key(provider: Column, model: Column, prompt: Column, seconds: Column, seed: Column, width: Column, height: Column, fps: Column) -> Column:
    """The configuration hash of a generated shot."""
    number = lambda c: c.cast("string")
    return config_hash(F.create_map(F.lit("provider"), quoted(provider), F.lit("model"), quoted(model), F.lit("prompt"), quoted(prompt), F.lit("seconds"), number(seconds), F.lit("seed"), number(seed), F.lit("width"), number(width), F.lit("height"), number(height), F.lit("fps"), number(fps)))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: what upserts leave behind."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows in place of those of equal keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").select(table.columns).unionByName(rows)


def fresh(records: DataFrame, wanted: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """records(keys, config_hash, outputs array of paths) that may be reused: the hash is the wanted one, and there are outputs, all in files(path)."""
    same = records.join(wanted, [*keys, "config_hash"], "left_semi").where("size(outputs) > 0")
    missing = same.select(*keys, F.explode("outputs").alias("path")).join(files, "path", "left_anti").select(*keys).distinct()
    return same.join(missing, keys, "left_anti")


def order_of(stage: Column, stages: tuple[str, ...] = STAGES) -> Column:
    """Place of a stage from 0; null for an unknown one."""
    at = F.array_position(F.array(*map(F.lit, stages)), stage) - 1
    return F.when(at >= 0, at)


def invalidated(records: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """records(key, stage) left when for each of starts(key, stage) that stage and all later ones go."""
    first = starts.groupBy(key).agg(F.min(order_of(F.col("stage"))).alias("_from"))
    return records.join(first, key, "left").where(F.col("_from").isNull() | (order_of(F.col("stage")) < F.col("_from"))).drop("_from")


def reached(stage: Column, until: str, stages: tuple[str, ...] = STAGES) -> Column:
    """Whether a stage is no later than the first whose name starts with until; without such a one all are."""
    last = next((i for i, s in enumerate(stages) if s.startswith(until)), len(stages) - 1)
    return order_of(stage, stages) <= last


def with_parent(configs: DataFrame, key: str) -> DataFrame:
    """configs(key, stage, config_hash) with the hash of the stage before."""
    before = configs.select(key, (order_of(F.col("stage")) + 1).alias("_ord"), F.col("config_hash").alias("parent_hash"))
    return configs.withColumn("_ord", order_of(F.col("stage"))).join(before, [key, "_ord"], "left").drop("_ord")


def hit_any(wanted: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """wanted(key, cache_key), a row for each provider of a chain: whether any of them is in kept(cache_key)."""
    hits = wanted.join(kept.select("cache_key").distinct(), "cache_key", "left_semi").select(key).distinct().withColumn("_hit", F.lit(True))
    return wanted.select(key).distinct().join(hits, key, "left").select(key, F.coalesce("_hit", F.lit(False)).alias("hit"))


def merged(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Full-outer merge of two maps as rows: new values win, new keys are added."""
    return old.select(key, F.col(value).alias("_old")).join(new.select(key, F.col(value).alias("_new")), key, "full_outer").select(key, F.coalesce("_new", "_old").alias(value))


def with_outputs(outputs: Column, more: Column) -> Column:
    """A record's map of outputs with further ones; of equal names the further one counts."""
    return F.map_concat(F.map_filter(outputs, lambda k, v: ~F.map_contains_key(more, k)), more)


def sidecar_hits(wanted: DataFrame, sidecars: DataFrame, files: DataFrame) -> DataFrame:
    """wanted(path, key) with cached: whether the file at path is in files(path) and its sidecar(path, key) names the same key."""
    there = sidecars.select("path", "key").distinct().join(files.select("path").distinct(), "path", "left_semi").withColumn("cached", F.lit(True))
    return wanted.join(there, ["path", "key"], "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
