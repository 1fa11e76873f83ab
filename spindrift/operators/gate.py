"""Ranking and greedy selection of segments without near-duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import grams, normalise
from ..storage import stored
from . import scan

#: Limits at which two segments count as duplicates: bigram Jaccard, equal figures, share of the shorter one's time.
TEXT, FIGURES, TIME = 0.5, 2, 0.5


def time_overlap(a: Column, b: Column) -> Column:
    """Common time of two structs (start, end) as a share of the shorter."""
    common = F.greatest(F.lit(0.0), F.least(a.end, b.end) - F.greatest(a.start, b.start))
    return common / F.greatest(F.lit(1e-6), F.least(a.end - a.start, b.end - b.start))


def jaccard(x: Column, y: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def duplicate(a: Column, b: Column) -> Column:
    """Why segment a repeats the chosen segment b, or null; segments are structs (start, end, bigrams, figures)."""
    return (
        F.when(jaccard(a.bigrams, b.bigrams) >= TEXT, F.lit("text similarity"))
        .when(F.size(F.array_intersect(a.figures, b.figures)) >= FIGURES, F.lit("same figures"))
        .when(time_overlap(a, b) >= TIME, F.lit("time overlap"))
    )


def ranked(segments: DataFrame, key: str) -> DataFrame:
    """With rank: chart data first, then score, then earlier start, then input order."""
    return segments.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("has_chart_data"), F.desc("hook_score"), "start", "pos")))


def prepared(segments: DataFrame) -> DataFrame:
    """With bigrams and figures from topic, summary and data_points(array of structs with value and unit)."""
    return segments.withColumn("bigrams", F.array_distinct(grams(normalise(F.concat("topic", "summary")), 2))).withColumn("figures", F.array_distinct(F.transform("data_points", lambda p: F.struct(p.value, p.unit))))


#: Segments of a key that one array may hold; more are chosen in rounds.
BLOCK = 512
_CHOSEN = "array<struct<place:struct<chart:int,unscored:boolean,score:double,start:double,pos:bigint>,id:bigint,start:double,end:double,bigrams:array<string>,figures:array<struct<value:double,unit:string>>>>"


def place() -> Column:
    """A segment's place in the ranking, to be compared: as ranked() orders a key."""
    chart = F.when(F.col("has_chart_data"), 0).when(~F.col("has_chart_data"), 1).otherwise(2)
    return F.struct(chart.alias("chart"), F.col("hook_score").isNull().alias("unscored"), (-F.col("hook_score")).cast("double").alias("score"), F.col("start").cast("double").alias("start"), F.col("pos").cast("long").alias("pos"))


def _mine(s: Column) -> Column:
    """What is kept of a chosen segment."""
    return F.struct(s["place"].alias("place"), s["id"].cast("long").alias("id"), s["start"].cast("double").alias("start"), s["end"].cast("double").alias("end"), s["bigrams"].alias("bigrams"), s["figures"].alias("figures"))


def _repeats(s: Column, chosen: Column) -> Column:
    """Why a segment repeats the first of the chosen ones before it that it repeats, or null."""
    why = lambda c: F.when(c["place"] < s["place"], F.concat(F.lit("duplicate of segment "), c["id"].cast("string"), F.lit(" ("), duplicate(s, c), F.lit(")")))
    return F.get(F.filter(F.transform(chosen, why), lambda r: r.isNotNull()), F.lit(0))


def select(segments: DataFrame, key: str, threshold: int = 3, most: int = 3, block: int = BLOCK) -> DataFrame:
    """segments(key, pos, id, start, end, topic, summary, has_chart_data, hook_score, data_points) with selected and skip_reason.

    A walk down the ranking: a score below the threshold, then a likeness to a chosen segment, then the cap skips a segment. Keys of up to `block` segments walk their arrays. A larger key is chosen in rounds, its segments staying rows of as many tasks as it takes: the best `block` open segments of each key walk on from what is chosen, then all others are joined with the chosen ones, and what repeats one, or comes after the cap, is open no more. Each round chooses the best open segment at least, so there are `most` rounds at most.
    """
    rows = prepared(segments).withColumn("place", place())
    score = F.col("hook_score")
    low = F.when(score < threshold, F.concat(F.lit("hook_score "), score.cast("string"), F.lit(f" < threshold {threshold}")))
    over = F.lit("over max_clips budget")
    listed = F.struct("place", "pos", "id", "start", "end", "bigrams", "figures")

    def step(acc: Column, s: Column) -> Column:
        free = _repeats(s, acc).isNull() & (F.size(acc) < most)
        return F.when(free, F.array_append(acc, _mine(s))).otherwise(acc)

    def walked(best: DataFrame, before: DataFrame | None) -> DataFrame:
        """(key, chosen) after the arrays of best rows."""
        arrays = best.groupBy(key).agg(F.array_sort(F.collect_list(listed)).alias("walk"))
        begin = F.array().cast(_CHOSEN)
        if before is not None:
            arrays, begin = arrays.join(before, key, "left"), F.coalesce("chosen", begin)
        return arrays.select(key, F.aggregate("walk", begin, step).alias("chosen"))

    def settled(chosen: DataFrame) -> DataFrame:
        mine = F.col("_s")
        told = rows.withColumn("_s", F.struct(*listed_names)).withColumn("_low", low).join(chosen, key, "left")
        is_chosen = F.exists(F.coalesce("chosen", F.array().cast(_CHOSEN)), lambda c: c["place"] == mine["place"])
        reason = F.coalesce("_low", F.when(is_chosen, F.lit("")), _repeats(mine, F.col("chosen")), over)
        return told.withColumn("skip_reason", reason).withColumn("selected", F.col("skip_reason") == "").select(*segments.columns, "selected", "skip_reason")

    listed_names = ["place", "pos", "id", "start", "end", "bigrams", "figures"]
    if not scan.hot(segments, [key], block):
        return settled(walked(rows.where(low.isNull()), None))
    rows = stored(rows)
    open_, chosen = rows.where(low.isNull()), None
    while True:
        first = Window.partitionBy(key).orderBy("place")
        best = open_.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= block)  # Spark drops the rest of a key before it is shuffled
        new = stored(walked(best, chosen))
        chosen = new if chosen is None else stored(new.unionByName(chosen.join(new, key, "left_anti")))
        met = open_.withColumn("_s", F.struct(*listed_names)).join(new, key).where(F.size("chosen") < most)
        mine = F.col("_s")
        left = met.where(~F.exists("chosen", lambda c: c["place"] == mine["place"]) & _repeats(mine, F.col("chosen")).isNull())
        open_ = stored(left.select(rows.columns))
        if not open_.limit(1).count():
            return settled(chosen)


def unique_ids(ids: Column) -> Column:
    """An array of ids in which a repeated id becomes one more than the largest before it."""
    return F.aggregate(ids, F.array().cast("array<bigint>"), lambda acc, x: F.array_append(acc, F.when(F.array_contains(acc, x), F.array_max(acc) + 1).otherwise(x)))


def major_unit(points: DataFrame, keys: list[str]) -> DataFrame:
    """points(keys, pos, value, unit) of the most frequent unit of each key, of equal ones that seen first; keys left with fewer than two points go, those that had fewer stay."""
    counted = points.groupBy(*keys, "unit").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first"))).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    best = best.where("r = 1 and (n >= 2 or total < 2)").select(*keys, "unit")
    return points.join(best, [*keys, "unit"], "left_semi")


#: Texts of a key that one array may hold for all to be compared in it.
SMALL = 64


def near_pairs(texts: DataFrame, key: str, least: float = TEXT, small: int = SMALL) -> DataFrame:
    """Pairs (a, b, similarity) of one key's texts(key, id, text) with a < b and bigram Jaccard of at least `least`, each pair once, equal texts too.

    Keys of up to `small` texts compare them in an array, by one shuffle of the sets. Of a larger key equal sets are one class first; classes meet by an inverted index with prefix filtering, and their members only in what is returned (near_classes() returns the classes themselves, where equal texts may be many).
    """
    sets = _sets(texts, key)
    if not scan.hot(texts, [key], small):
        return _small_pairs(sets, key, least)
    many = texts.groupBy(key).count().where(F.col("count") > small).select(key)
    classes, members = near_classes(texts.join(many, key, "left_semi"), key, least)
    links = classes.unionByName(members.groupBy(key, "class").count().where("count > 1").select(key, F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("similarity")))
    x, y = (members.select(key, F.col("class").alias(c), F.col("id").alias(i)) for c, i in (("a", "_x"), ("b", "_y")))
    met = links.join(x, [key, "a"]).join(y, [key, "b"])
    once = (F.col("a") != F.col("b")) & (F.col("_x") != F.col("_y")) | (F.col("_x") < F.col("_y"))
    spread = met.where(once).select(key, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "similarity")
    return spread.unionByName(_small_pairs(sets.join(many, key, "left_anti"), key, least))


def _sets(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(key, "id", F.array_distinct(grams(normalise(F.col("text")), 2)).alias("set")).where("size(set) > 0")


def _small_pairs(sets: DataFrame, key: str, least: float) -> DataFrame:
    listed = sets.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "set"))).alias("all"))

    def likeness(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x.set, y.set))
        return both / (F.size(x.set) + F.size(y.set) - both)

    def pairs(x: Column, i: Column) -> Column:
        later = F.filter(F.slice("all", i + 2, F.size("all")), lambda y: (y.id > x.id) & (F.least(F.size(x.set), F.size(y.set)) >= least * F.greatest(F.size(x.set), F.size(y.set))))
        return F.filter(F.transform(later, lambda y: F.struct(x.id.alias("a"), y.id.alias("b"), likeness(x, y).alias("similarity"))), lambda p: p.similarity >= least)

    return listed.select(key, F.inline(F.flatten(F.transform("all", pairs))))


def near_classes(texts: DataFrame, key: str, least: float = TEXT) -> tuple[DataFrame, DataFrame]:
    """Of texts(key, id, text): pairs (key, a, b, similarity) of classes of equal bigram sets, a < b, of a Jaccard similarity of at least `least`, and their members (key, class, id); a class is named by its least id. However many texts are equal, they are one class.

    An inverted index with prefix filtering: bigrams are ordered by how rare they are among a key's classes, and two sets that reach the similarity share one of their first size - ceil(least * size) + 1 bigrams. So frequent bigrams are in few prefixes; a pair is compared where its first shared one meets.
    """
    sets = _sets(texts, key).withColumn("set", F.array_sort("set"))
    classes = stored(sets.groupBy(key, "set").agg(F.min("id").alias("id")))
    members = stored(sets.join(classes.select(key, "set", F.col("id").alias("class")), [key, "set"]).select(key, "class", "id"))
    flat = classes.select(key, "id", F.explode("set").alias("gram"))
    rare = flat.groupBy(key, "gram").count()
    ranked_sets = flat.join(rare, [key, "gram"]).groupBy(key, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("count", "gram"))), lambda x: x.gram).alias("set"))
    ranked_sets = stored(ranked_sets)
    prefix = F.slice("set", 1, (F.size("set") - F.ceil(F.size("set") * least - 1e-9) + 1).cast("int"))
    opened = stored(ranked_sets.select(key, "id", "set", F.posexplode(prefix).alias("at", "gram")))
    x, y = (opened.select(key, "gram", F.col("id").alias(n), F.col("set").alias(f"_{n}"), F.col("at").alias(f"at_{n}")) for n in ("a", "b"))
    n, m = F.size("_a"), F.size("_b")
    enough = F.ceil(least / (1 + least) * (n + m) - 1e-9)  # shared bigrams that the similarity takes
    room = F.least(n - F.col("at_a"), m - F.col("at_b"))  # what this bigram and all after it can make
    met = x.join(y, [key, "gram"]).where((F.col("a") < F.col("b")) & (F.least(n, m) >= least * F.greatest(n, m)) & (room >= enough))
    first = F.get(F.array_intersect("_a", "_b"), F.lit(0)) == F.col("gram")  # both are in one order, so a pair counts where its first shared bigram is
    found = met.where(first).select(key, "a", "b", jaccard(F.col("_a"), F.col("_b")).alias("similarity"))
    return found.where(F.col("similarity") >= least), members
