"""Whether figures are stated by their source: tolerance joins, and the gate on charts.

A figure meets its source in one join on the key that asks whether any value is near, where no key has more than a few hundred values. Larger sources are dealt into buckets of logarithms: a figure asks one bucket, and a source's value stands in the three that figures within the tolerance may ask, so a band join is a semi-join on equal keys with the exact predicate, of which Spark splits hot ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numerals
from . import scan

#: Width of a bucket of logarithms; more than -log(1 - 0.005), so values within the tolerance are at most one bucket apart.
WIDTH = 0.0051
#: Values of a key's source that each of its figures may be compared with.
FEW = 256


def _small(x: Column, tolerance: float) -> Column:
    """Whether the absolute tolerance may rule."""
    return F.abs(x) <= 1e-6 / tolerance * 1.1


def _by_log(x: Column, tolerance: float, sign: Column, move: int = 0) -> Column:
    return F.struct(sign.cast("int").alias("sign"), (F.floor(F.log(F.abs(x)) / (WIDTH * tolerance / 0.005)) + move).alias("b"))


def _by_size(x: Column, move: int = 0) -> Column:
    return F.struct(F.lit(0).alias("sign"), (F.floor(x / 2e-6) + move).alias("b"))


def _asked(x: Column, tolerance: float) -> Column:
    """The bucket a figure asks: by sign and logarithm; small ones by size."""
    return F.when(_small(x, tolerance), _by_size(x)).otherwise(_by_log(x, tolerance, F.signum(x)))


def _told(x: Column, tolerance: float) -> Column:
    """The buckets a source's value stands in: of each kind that a figure within the tolerance may ask, and its neighbours."""
    moves = (-1, 0, 1)
    logs = F.when(x != 0, F.array(*[_by_log(x, tolerance, F.signum(x), m) for m in moves])).otherwise(F.array())
    sizes = F.when(F.abs(x) <= 1e-6 / tolerance * 1.2, F.array(*[_by_size(x, m) for m in moves])).otherwise(F.array())
    return F.concat(logs, sizes)


def _near(figure: str, source: str, tolerance: float) -> str:
    return f"abs({source} - {figure}) <= greatest(1e-6D, {float(tolerance)!r}D * abs({figure}))"


def _same(keys: list[str]) -> str:
    return " AND ".join(f"s.`{k}` = v.`{k}`" for k in keys)


def _hit(values: DataFrame, target: Column, source: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """values whose target a source of many values states."""
    asked = values.withColumn("_t", target).withColumn("_a", _asked(F.col("_t"), tolerance)).withColumns({"_sign": F.col("_a.sign"), "_b": F.col("_a.b")}).drop("_a")
    told = source.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("value").alias("_s"), F.inline(_told(F.col("value"), tolerance)).alias("_sign_of", "_b_of"))
    same = (F.col("_sign") == F.col("_sign_of")) & (F.col("_b") == F.col("_b_of"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    near = F.abs(F.col("_s") - F.col("_t")) <= F.greatest(F.lit(1e-6), tolerance * F.abs("_t"))
    return asked.join(told, same & near, "left_semi").drop("_t", "_sign", "_b")


def stated(values: DataFrame, source: DataFrame, keys: list[str], tolerance: float = 0.005) -> DataFrame:
    """Rows of values(keys, value) for which source(keys, value) has a value within max(1e-6, tolerance * |value|)."""
    if scan.hot(source, keys, FEW):
        return _hit(values, F.col("value"), source, keys, tolerance)
    return values.sparkSession.sql(f"SELECT * FROM {{v}} v WHERE EXISTS (SELECT 1 FROM {{s}} s WHERE {_same(keys)} AND {_near('v.value', 's.value', tolerance)})", v=values, s=source.select(*keys, "value"))


def stated_with_unit(values: DataFrame, source: DataFrame, keys: list[str], tolerance: float = 0.005) -> DataFrame:
    """values(keys, value, unit) with stated: as it is, or scaled by the first character of its unit."""
    if not scan.hot(source, keys, FEW):
        scaled = values.withColumn("_scaled", F.col("value") * numerals.unit_scale(F.col("unit")))
        near = " OR ".join(_near(f"v.{c}", "s.value", tolerance) for c in ("value", "_scaled"))
        told = values.sparkSession.sql(f"SELECT *, EXISTS (SELECT 1 FROM {{s}} s WHERE {_same(keys)} AND ({near})) AS stated FROM {{v}} v", v=scaled, s=source.select(*keys, "value"))
        return told.drop("_scaled")
    figures = values.select(*keys, "value", "unit").distinct()
    scaled = figures.withColumn("_target", F.explode(F.array_compact(F.array(F.col("value"), F.col("value") * numerals.unit_scale(F.col("unit"))))))
    found = _hit(scaled, F.col("_target"), source, keys, tolerance).select(*keys, "value", "unit").distinct().withColumn("_hit", F.lit(True)).alias("f")
    same = F.lit(True)
    for c in (*keys, "value", "unit"):
        same = same & F.col(f"v.{c}").eqNullSafe(F.col(f"f.{c}"))
    return values.alias("v").join(found, same, "left").select(*[F.col(f"v.{c}") for c in values.columns], F.coalesce("f._hit", F.lit(False)).alias("stated"))


def checked_chart(points: DataFrame, source: DataFrame, clip: str) -> DataFrame:
    """points(clip, series, pos, label, value, unit) that their clip's source(clip, value) states, of series that keep at least two."""
    kept = stated_with_unit(points, source, [clip]).where("stated").drop("stated")
    enough = kept.groupBy(clip, "series").count().where("count >= 2").select(clip, "series")
    return kept.join(enough, [clip, "series"], "left_semi")


def nested_chart(points: DataFrame, clip: str) -> DataFrame:
    """(clip, series): array of (name, points) in order of the points."""
    series = points.groupBy(clip, "series").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "value", "unit"))).alias("points"))
    return series.groupBy(clip).agg(F.array_sort(F.collect_list(F.struct(F.col("series").alias("name"), F.transform("points", lambda p: F.struct(p.label, p.value, p.unit)).alias("points")))).alias("series"))


def spoken(text: Column, attribution: Column, source: Column) -> Column:
    """Flags 'text:TOKEN' for numbers of a text, its attribution taken out, that the source doesn't state."""
    return F.transform(numerals.unstated(numerals.number_tokens(F.replace(text, attribution, F.lit(""))), source), lambda t: F.concat(F.lit("text:"), t))


def verified_clips(clips: DataFrame, again: Callable[[DataFrame], DataFrame], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected of clips(keys, text, attribution, source, ...), source being an array of stated values, with numbers_unverified and rewrite_attempts: a clip whose text says a number that its source doesn't is written again once, by again(clips), and what comes back is verified anew, so the flags are those of the final text."""
    from ..plans.engine import retried_once

    def check(rows: DataFrame) -> DataFrame:
        flags = rows.withColumn("numbers_unverified", spoken(F.col("text"), F.col("attribution"), F.col("source")))
        return flags.withColumn("ok", F.size("numbers_unverified") == 0)

    first = clips.withColumns({"numbers_unverified": F.lit(None).cast("array<string>"), "rewrite_attempts": F.lit(0)})
    return retried_once(first, check, lambda failing: again(failing).withColumn("rewrite_attempts", F.lit(1)), keys)
