"""Numbers that a text states in Arabic or Chinese numerals.

Every quirk of the numeral system that results depend on is kept: a trailing digit counts a tenth of the unit before it, a lone decimal point reads as zero, N成 yields N and ten times N, and a bare unit is no number.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text

# Numerals, their values, and the patterns of runs, ranges, tenths and tens.
DIGIT = {"零": 0, "〇": 0, "一": 1, "二": 2, "兩": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
POWER = {"十": 10, "百": 100, "千": 1000}
MYRIAD = {"億": 10**8, "亿": 10**8, "萬": 10**4, "万": 10**4}
RUN = re.compile(r"(?:百分之)?[0-9０-９][0-9０-９,.]*(?:[萬万億亿](?:[0-9０-９](?![0-9０-９]))?)?|(?:百分之)?[零〇一二兩两三四五六七八九十百千萬万億亿點点]+")
BETWEEN = set("到至~～-－–—跟和與")
TENTHS = re.compile(r"([一二兩两三四五六七八九十]|[0-9]+)成(?![本交績效])")
TENS = re.compile(r"([一二兩两三四五六七八九]|[1-9])字頭")
FULL_WIDTH = str.maketrans("０１２３４５６７８９", "0123456789")

TOKEN = T.StructType([T.StructField("tok", T.StringType()), T.StructField("vals", T.ArrayType(T.DoubleType()))])

_SECTIONS = re.compile("".join(f"(?:(.*?){big})?" for big in MYRIAD) + "(.*)")
_POWERS = re.compile("([^十百千]*)([十百千])")


def _last_digit(text: str) -> int:
    found = [DIGIT[c] for c in text if c in DIGIT]
    return found[-1] if found else 0


def section(text: str) -> float:
    """A numeral below ten thousand; of digits in a row the last counts, and one after hundreds or thousands a tenth of that unit."""
    total, end, unit = 0.0, 0, 0
    for m in _POWERS.finditer(text):
        unit, end = POWER[m[2]], m.end()
        total += (_last_digit(m[1]) or 1) * unit
    rest = _last_digit(text[end:])
    return total + (rest * (unit / 10) if unit > 10 else rest)


def chinese(text: str) -> float | None:
    """A whole numeral with sections of ten thousands and hundred millions and decimals; None for a bare unit."""
    head, point, tail = text.replace("点", "點").partition("點")
    whole = _whole(head) if head or not point else 0.0
    digits = [DIGIT[c] for c in tail if c in DIGIT]
    if whole is None or not digits:
        return whole
    size = 10 ** len(digits)
    return (int(whole) * size + int("".join(map(str, digits)))) / size


def _whole(text: str) -> float | None:
    if not set(text) & {*DIGIT, "十"}:
        return None
    *heads, rest = _SECTIONS.fullmatch(text).groups()
    there = [(head, big) for head, big in zip(heads, MYRIAD.values(), strict=True) if head is not None]
    total = float(sum((section(head) if head else 1) * big for head, big in there))
    return total + (DIGIT[rest] * there[-1][1] / 10 if there and rest in DIGIT else section(rest))


def unglued(run: str) -> list[str]:
    """A run cut where a new number must start: at a unit no smaller than the one before, and at the second bare digit after a unit."""
    cuts, level = [0], 0
    for i, c in enumerate(run):
        if c in MYRIAD:
            if level and MYRIAD[c] >= level:
                cuts.append(i)
            level = MYRIAD[c]
        elif i > 1 and run[i - 2] in MYRIAD and run[i - 1] in DIGIT and c in DIGIT:
            cuts.append(i)
            level = 0
    return [run[a:b] for a, b in zip(cuts, [*cuts[1:], len(run)], strict=True)]


def readings(run: str) -> list[float]:
    """The values that a run may mean."""
    run = run.translate(FULL_WIDTH).removeprefix("百分之")
    if not run[:1].isdigit():
        return [v for part in unglued(run) if (v := chinese(part)) is not None]
    m = re.match(r"([0-9]+(?:\.[0-9]+)?)(?:([萬万億亿])([0-9])?)?", run.replace(",", ""))
    value = float(m[1])
    if not m[2]:
        return [value]
    big = MYRIAD[m[2]]
    return [value, value * big + int(m[3] or 0) * big / 10]


def stated(text: str) -> list[tuple[str, list[float]]]:
    """Tokens of a text with their readings, in order; tenths and tens after the rest."""
    found = [(m, vals) for m in RUN.finditer(text) if (vals := readings(m[0]))]
    out = []
    for (m, vals), then in zip(found, [*found[1:], None], strict=False):
        shares = then and len(vals) == 1 and m[0][-1] not in MYRIAD and text[m.end() : then[0].start()] in BETWEEN and then[0][0][-1] in MYRIAD
        out.append((m[0], [*vals, vals[0] * MYRIAD[then[0][0][-1]]] if shares else vals))
    return out + [(m[0], [v[0] * 10]) for rule in (TENTHS, TENS) for m in rule.finditer(text) if (v := readings(m[1]))]


#: Tokens from which on a worker hands over the texts that it has read of a batch.
MANY_TOKENS = 10_000


@F.pandas_udf(T.ArrayType(TOKEN))
def number_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The tokens of each text; a batch goes back in pieces, as those of a few MB of figures take hundreds of MB."""
    for batch in texts:
        rows, held = [], 0
        for x in batch:
            rows.append([{"tok": t, "vals": v} for t, v in stated(x or "")])
            held += len(rows[-1])
            if held >= MANY_TOKENS:
                yield pd.Series(rows, dtype=object)
                rows, held = [], 0
        if rows:
            yield pd.Series(rows, dtype=object)


@F.udtf(returnType=TOKEN)
class NumberTokens:
    """number_tokens(text) for SQL, one row for each token."""

    def eval(self, text: str):
        yield from stated(text or "")


def values(tokens: Column) -> Column:
    """All readings, each once."""
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: t.vals)))


def close(value: Column, source: Column, tolerance: float = 0.005) -> Column:
    """Whether source, an array, holds a value within the tolerance of value."""
    return F.exists(source, lambda s: F.abs(s - value) <= F.greatest(F.lit(1e-6), tolerance * F.abs(value)))


def unit_scale(unit: Column) -> Column:
    """What the first character of a unit multiplies by; null for other units."""
    first = F.substring(F.trim(F.coalesce(unit, F.lit(""))), 1, 1)
    return F.when(first.isin("萬", "万"), F.lit(1e4)).when(first.isin("億", "亿"), F.lit(1e8))


def value_stated(value: Column, unit: Column, source: Column, tolerance: float = 0.005) -> Column:
    """Whether the source states the value as it is or scaled by its unit."""
    return close(value, source, tolerance) | F.coalesce(close(value * unit_scale(unit), source, tolerance), F.lit(False))


def unstated(tokens: Column, source: Column, ignore: Column | None = None, tolerance: float = 0.005) -> Column:
    """Tokens none of whose readings the source states, without those that have an ignored reading."""
    ignore = F.array().cast("array<double>") if ignore is None else ignore
    left = F.filter(tokens, lambda t: ~F.arrays_overlap(t.vals, ignore) & ~F.exists(t.vals, lambda v: close(v, source, tolerance)))
    return F.transform(left, lambda t: t.tok)


# Numbers as powers of ten, whole numbers of five digits or more by themselves, and the units they are given in (digits of the number, digits of the unit, name).
_POWER_OF_TEN = re.compile(r"(\d+(?:\.\d+)?)[eE]\+?(\d+)")
_LONG = re.compile(r"(?<![\d.])(\d{5,})(?![\d.])")
_UNITS = ((9, 8, "億"), (6, 4, "萬"))
#: Digits beyond which a number is no double.
_DIGITS = 300


def in_units(digits: str) -> str:
    """A whole number in the largest unit that fits, to six digits; short ones, and those no double holds, stay."""
    bare = (digits if digits.isascii() else "".join(str(unicodedata.decimal(c)) for c in digits)).lstrip("0")
    for least, size, name in _UNITS:
        if least <= len(bare) <= _DIGITS:
            count, rest = bare[:-size], bare[-size:]
            return (f"{int(bare) / 10**size:g}" if rest.strip("0") else count) + name
    return digits


def written_out(mantissa: str, exponent: str) -> str | None:
    """The whole number that a power of ten says; None beyond doubles."""
    if len(exponent) > 3:  # as in a hex string
        return None
    value = float(mantissa) * float(f"1e{exponent}")
    return str(int(float(mantissa) * 10 ** int(exponent))) if math.isfinite(value) else None


def humanised(text: str) -> str:
    """1e+07 and long integers as 萬 and 億; below a hundred thousand, and beyond what a double holds, they stay."""
    plain = _POWER_OF_TEN.sub(lambda m: written_out(m[1], m[2]) or m[0], text)
    return _LONG.sub(lambda m: in_units(m[1]), plain)


@F.pandas_udf(T.StringType())
def humanise(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else humanised(t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def humanise_each(texts: pd.Series) -> pd.Series:
    """The same for each item of an array."""
    return texts.map(lambda ts: None if ts is None else [None if t is None else humanised(t) for t in ts])


def _spelled_section(n: Column) -> Column:
    """A number below ten thousand in Chinese numerals; '' for 0."""
    digit = lambda k: F.floor(n / 10**k) % 10
    name = lambda d: F.translate(d.cast("string"), "123456789", "一二三四五六七八九")
    d3, d2, d1, d0 = (digit(k) for k in (3, 2, 1, 0))
    none = F.lit("")
    parts = [
        F.when(d3 > 0, F.concat(name(d3), F.lit("千"))).otherwise(none),
        F.when(d2 > 0, F.concat(name(d2), F.lit("百"))).when((d3 > 0) & (d1 + d0 > 0), "零").otherwise(none),
        F.when(d1 > 0, F.concat(name(d1), F.lit("十"))).when((d2 > 0) & (d0 > 0), "零").otherwise(none),
        F.when(d0 > 0, name(d0)).otherwise(none),
    ]
    return F.concat(*parts)


def spelled(n: Column) -> Column:
    """A whole number from 0 to below 10**12 in Chinese numerals, with 零 for what is left out between units; null for others."""

    def words(n: Column) -> Column:
        a, b, c = F.floor(n / 10**8), F.floor(n / 10**4) % 10**4, n % 10**4
        zero_b, zero_c = (a > 0) & (b < 1000), (a + b > 0) & ((c < 1000) | (b == 0))
        named = F.transform(F.array(a, b, c), _spelled_section)
        none = F.lit("")
        part = lambda k, zero, unit: F.when(named[k] == "", none).otherwise(F.concat(F.when(zero, "零").otherwise(none), named[k], F.lit(unit)))
        return F.when(n == 0, "零").when((n > 0) & (n < 10**12), F.concat(part(0, F.lit(False), "億"), part(1, zero_b, "萬"), part(2, zero_c, "")))

    return F.get(F.transform(F.array(n.cast("long")), words), F.lit(0))  # a lambda's variable is computed once, however often it is used


def general(value: Column) -> Column:
    """A double to six significant digits without trailing zeros, with an exponent below a ten-thousandth or from a million on; null for null."""
    size = F.abs(value)
    form = lambda pattern: F.call_function("format_number", value, F.lit(pattern))
    out = F.when(size == 0, F.lit("0")).when((size < 9.9999995e-5) | (size >= 999999.5), F.lower(F.regexp_replace(form("0.#####E00"), "E(\\d)", "E+$1")))
    for digits, top in enumerate((9.999995e-4, 9.999995e-3, 9.999995e-2, 0.9999995, 9.999995, 99.99995, 999.9995, 9999.995, 99999.95)):
        out = out.when(size < top, form("0." + "#" * (9 - digits)))
    return out.otherwise(form("0"))


def label(value: Column, unit: Column) -> Column:
    """A value as charts write it: thousands grouped from 1000 on, else six significant digits, and the unit."""
    return F.concat(F.when(F.abs(value) >= 1000, F.format_number(value, 0)).otherwise(general(value)), F.coalesce(unit, F.lit("")))


def register(spark) -> None:
    """Makes number_tokens, humanize_numbers and number_token_list available to SQL, with what text.register adds."""
    text.register(spark)
    spark.udtf.register("number_tokens", NumberTokens)
    spark.udf.register("humanize_numbers", humanise)
    spark.udf.register("number_token_list", number_tokens)
