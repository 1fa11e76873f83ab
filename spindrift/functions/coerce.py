"""Values of unknown make, as text, coerced to types: what can't be read becomes a default or is dropped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a decimal number; casts alone would take '12d' too.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
#: Texts that mean yes, fixed values.
YES = ("true", "1", "yes", "是")


def number(text: Column) -> Column:
    """A double, or null if the text is no decimal number."""
    return F.when(text.rlike(NUMBER), F.trim(text).cast("double"))


def bare(text: Column) -> Column:
    """Without thousands separators and percent signs."""
    return F.trim(F.regexp_replace(text, "[,%]", ""))


def as_double(text: Column, default: float = 0.0) -> Column:
    """Numbers, with , and % taken out, and mm:ss or h:mm:ss as seconds; else default."""
    parts = F.transform(F.split(bare(text), ":"), number)
    return F.coalesce(F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x), F.lit(default))


def as_int(text: Column, default: int) -> Column:
    """The nearest integer, halves to even; else default."""
    return F.coalesce(F.bround(number(text)).cast("int"), F.lit(default))


def as_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*YES), F.lit(False))


def points(raw: Column) -> Column:
    """array<struct<label, value, unit>> from structs of texts: items whose value is no number are dropped, never defaulted."""
    made = F.transform(raw, lambda p: F.struct(F.coalesce(p.label, F.lit("")).alias("label"), number(bare(p.value)).alias("value"), F.coalesce(p.unit, F.lit("")).alias("unit")))
    return F.coalesce(F.filter(made, lambda p: p.value.isNotNull()), F.array().cast("array<struct<label:string,value:double,unit:string>>"))


def texts(items: Column) -> Column:
    """Items that aren't blank."""
    return F.coalesce(F.filter(items, lambda x: F.trim(x) != ""), F.array().cast("array<string>"))


def same_line(a: Column, b: Column) -> Column:
    from .text import normalise

    return normalise(a) == normalise(b)
