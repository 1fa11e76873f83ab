"""Picking rows or array items by several criteria in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least short side of a rendition that is good enough, and longest footage that is preferred, in seconds.
SHORT_SIDE, PREFERRED_SECONDS = 1080, 30


def rendition(files: Column, short_side: int = SHORT_SIDE) -> Column:
    """Of an array of structs (width, height, file_type, link): an mp4 with a link, portrait ones if any, the fewest pixels among those with a long enough short side, else the most; the first of equals; null without any."""
    usable = F.filter(files, lambda f: (f.file_type == "video/mp4") & (F.coalesce(f.link, F.lit("")) != ""))

    def ranked(f: Column, i: Column) -> Column:
        w, h = F.coalesce(f.width, F.lit(0)).cast("long"), F.coalesce(f.height, F.lit(0)).cast("long")
        enough = F.least(w, h) >= short_side
        return F.struct((h <= w).alias("landscape"), (~enough).alias("small"), F.when(enough, w * h).otherwise(-w * h).alias("pixels"), i.alias("i"), f.alias("file"))

    return F.get(F.array_sort(F.transform(usable, ranked)), F.lit(0)).file


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    return first_n(rows, keys, 1, *order)


def footage(videos: DataFrame, key: str, preferred: float = PREFERRED_SECONDS) -> DataFrame:
    """For each key of videos(key, pos, duration, file) the first usable one, short ones before long ones."""
    return first_by(videos.where("file is not null"), [key], F.when(F.col("duration") <= preferred, 0).otherwise(1), "pos")


def video_list(videos: DataFrame) -> DataFrame:
    """videos(name, stages, updated) with those that have stages first, then the latest update, then the name."""
    return videos.orderBy((F.col("stages") > 0).desc(), F.desc("updated"), "name")


def shot_prompts(visuals: Column, ai_shot: Column, fallback: Column, shots: int) -> Column:
    """Prompts of so many shots: the first is the clip's own or a fallback, each other the first visual that isn't empty in its even run of lines, else the first prompt."""
    first = F.coalesce(F.nullif(ai_shot, F.lit("")), fallback)
    n, m = F.size(visuals), F.lit(shots - 1)

    def run(j: Column) -> Column:
        lo, hi = F.floor(j * n / m).cast("int"), F.floor((j + 1) * n / m).cast("int")
        return F.coalesce(F.get(F.filter(F.slice(visuals, lo + 1, hi - lo), lambda v: v != ""), F.lit(0)), first)

    return F.array(first) if shots < 2 else F.concat(F.array(first), F.transform(F.sequence(F.lit(0), m - 1), run))


def footage_queries(visuals: Column, ai_shot: Column, with_hook: bool = True) -> Column:
    """Footage queries of a clip's lines; the hook borrows the first visual that isn't empty, else the clip's own."""
    hook = F.coalesce(F.get(F.filter(visuals, lambda v: v != ""), F.lit(0)), ai_shot)
    return F.concat(F.array(hook), visuals) if with_hook else visuals


def chart_series(series: Column) -> Column:
    """The first two series that have points."""
    return F.slice(F.filter(series, lambda s: F.size(s.points) > 0), 1, 2)


def first_unit(series: Column) -> Column:
    """The first unit that isn't empty, '' without any."""
    units = F.flatten(F.transform(series, lambda s: F.transform(s.points, lambda p: p.unit)))
    return F.coalesce(F.get(F.filter(units, lambda u: u != ""), F.lit(0)), F.lit(""))


def with_line(lines: Column, has: Callable[[Column], Column], line: Column) -> Column:
    """Lines, with the given one as second (or only one) if none has what is asked."""
    there = F.exists(lines, has)
    return F.when(there, lines).when(F.size(lines) == 0, F.array(line)).otherwise(F.concat(F.slice(lines, 1, 1), F.array(line), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))))


def with_attribution(lines: Column, attribution: Column) -> Column:
    """Lines, with the attribution as second one (or only one) if none has it."""
    return with_line(lines, lambda x: x.contains(attribution), attribution)


def major_points(points: Column) -> Column:
    """Of an array of structs (label, value, unit) those of the most frequent unit, of equal ones that seen first; none if fewer than two are left of two or more."""
    units = F.transform(points, lambda p: p.unit)
    ranked = F.transform(F.array_distinct(units), lambda u, i: F.struct((-F.size(F.filter(units, lambda x: x == u))).alias("n"), i.alias("i"), u.alias("unit")))
    kept = F.filter(points, lambda p: p.unit == F.array_min(ranked).unit)
    return F.when((F.size(points) < 2) | (F.size(kept) >= 2), F.when(F.size(points) < 2, points).otherwise(kept)).otherwise(F.slice(points, 1, 0))


def accepted(clips: DataFrame, where: Column, key: str, order: str, most: int) -> DataFrame:
    """The first `most` clips of each key, in order, that are accepted."""
    return first_n(clips.where(where), [key], most, order)


def first_n(rows: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each key in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def by_start(chosen: DataFrame, *ties: str) -> DataFrame:
    """Chosen segments in the order of their starts."""
    return chosen.orderBy("start", *ties)
