"""Text functions as columns; shares of n-grams and the longest common substring as Arrow UDFs."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that overlap measures keep, a fixed value: ASCII and full-width letters and digits, and common ideographs.
KEPT = "0-9A-Za-z一-鿿㐀-䶿０-９Ａ-Ｚａ-ｚ"
#: Ends of sentences, a fixed value.
SENTENCE_ENDS = "。！？!?；;"
#: Marks of console output, a fixed value.
MARKUP = r"\[/?(?:(?:bold|dim|italic|underline|red|green|yellow|blue|cyan|magenta|white|black)\s?)*\]"
#: Punctuation that starts no line, a fixed value.
CLOSING = "，。、！？：；」』）》…,.!?:;)"


def normalise(text: Column) -> Column:
    """Kept characters in lower case; null gives ''."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{KEPT}]+", ""))


def grams(text: Column, n: int) -> Column:
    """All character n-grams in order, with repeats; none if the text is shorter than n."""
    if n <= 0:
        raise ValueError("n must be positive")
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


_DROPPED = re.compile(f"[^{KEPT}]+")


def _plain(text: str | None) -> str:
    """As normalise, for one text."""
    return _DROPPED.sub("", text or "").lower()


@functools.lru_cache(maxsize=8)
def _grams_of(source: str, n: int) -> frozenset[str]:
    return frozenset(source[i : i + n] for i in range(len(source) - n + 1))


def gram_counts(text: Column, source: Column, sizes: tuple[int, ...]) -> Column:
    """For each size n a struct (total, hits): the n-grams of a text, repeats counted, and how many of them the source holds; both are normalised in the same pass. Memory grows with the source's length."""
    if min(sizes) <= 0:
        raise ValueError("n must be positive")

    @F.pandas_udf("array<struct<total:bigint,hits:bigint>>")
    def count(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sources in pairs:
            out = []
            for a, b in zip(texts, sources, strict=True):
                a, b, row = _plain(a), _plain(b), []
                for n in sizes:
                    known, total = _grams_of(b, n), max(0, len(a) - n + 1)
                    hits = sum(a[i : i + n] in known for i in range(total)) if known else 0
                    row.append({"total": total, "hits": hits})
                out.append(row)
            yield pd.Series(out, dtype=object)

    return count(text, source)


def share(counts: Column) -> Column:
    """hits / total of a struct (total, hits), 0 without any."""
    return F.when(counts.total > 0, counts.hits / counts.total).otherwise(F.lit(0.0))


def gram_overlap(text: Column, source: Column, n: int) -> Column:
    """Share of the text's n-grams, repeats counted, that the source holds; 0 if the text is shorter than n. Both are normalised first."""
    return share(gram_counts(text, source, (n,))[0])


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the character bigram sets of two normalised texts; 0 if either has none."""
    x, y = F.array_distinct(grams(normalise(a), 2)), F.array_distinct(grams(normalise(b), 2))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


#: The modulus of substring hashes, a Mersenne prime, a base below it, and the base's inverse.
_PRIME = 2**61 - 1
_BASE = 0x1E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, _PRIME)


def _times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo the prime, from halves of 31 bits, as no integer of numpy holds 122 bits."""
    half, low = np.uint64(31), np.uint64(2**31 - 1)
    a_high, a_low, b_high, b_low = a >> half, a & low, b >> half, b & low
    middle = a_low * b_high + a_high * b_low
    whole = a_high * b_high * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & np.uint64(2**30 - 1)) << half) + a_low * b_low
    whole = (whole & np.uint64(_PRIME)) + (whole >> np.uint64(61))
    return np.where(whole >= np.uint64(_PRIME), whole - np.uint64(_PRIME), whole)


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers, n a power of two: those known times the next one double them."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _times(out, np.uint64(pow(base, len(out), _PRIME)))])
    return out


def _sums(text: str) -> np.ndarray:
    """Running sums of the characters, each times a power of the base by its place, modulo the prime; differences of them tell substrings apart."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    out = _times(points, _powers(_BASE, 1 << max(10, len(points).bit_length()))[: len(points)])
    step = 1
    while step < len(out):  # sums of twice as many neighbours each time
        more = out.copy()
        more[step:] += out[:-step]
        out = np.where(more >= np.uint64(_PRIME), more - np.uint64(_PRIME), more)
        step *= 2
    return np.concatenate([np.zeros(1, np.uint64), out])


def _windows(sums: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all substrings of length n."""
    count = len(sums) - n
    apart = sums[n:] + np.uint64(_PRIME) - sums[:count]
    return _times(np.where(apart >= np.uint64(_PRIME), apart - np.uint64(_PRIME), apart), _powers(_INVERSE, 1 << max(10, count.bit_length()))[:count])


#: The base of quick hashes modulo 2**64, and its inverse.
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 2**64)


@functools.lru_cache(maxsize=4)
def _quick_powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


def _quick_sums(text: str) -> np.ndarray:
    """As _sums, modulo 2**64, which numpy does by itself; there are texts of unlike substrings with equal hashes."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * _quick_powers(_ODD, 1 << max(10, len(points).bit_length()))[: len(points)])])


def _quick_windows(sums: np.ndarray, n: int) -> np.ndarray:
    count = len(sums) - n
    return (sums[n:] - sums[:count]) * _quick_powers(_ODD_INVERSE, 1 << max(10, count.bit_length()))[:count]


#: Equal hashes of unlike substrings after which a search goes on with hashes modulo the prime.
_FALSE = 8


def shared(a: str, b: str) -> str:
    """The longest common substring, the earliest in a among the longest. Its length is found by bisection over hashes of all substrings of one length, in memory linear in the texts; what the hashes say is verified on the texts. Quick hashes do for nearly all texts; where they are wrong a few times, hashes modulo a prime take over."""
    low, high, found, wrong = 0, min(len(a), len(b)), "", 0
    if not high:
        return found
    sums, windows = _quick_sums, _quick_windows
    mine, theirs = sums(a), sums(b)
    while low < high:
        n = (low + high + 1) // 2
        there = np.sort(windows(theirs, n))
        asked = windows(mine, n)
        at = np.minimum(np.searchsorted(there, asked), len(there) - 1)
        hit = None
        for i in np.nonzero(there[at] == asked)[0].tolist():
            if a[i : i + n] in b:
                hit = i
                break
            wrong += 1
            if wrong == _FALSE:
                break
        if hit is None and wrong == _FALSE:
            sums, windows, wrong = _sums, _windows, wrong + 1
            mine, theirs = sums(a), sums(b)
        elif hit is None:
            high = n - 1
        else:
            low, found = n, a[hit : hit + n]
    return found


@F.pandas_udf(T.IntegerType())
def shared_length(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Length of the longest common substring of two texts, which it normalises."""
    for a, b in pairs:
        yield pd.Series([len(shared(_plain(x), _plain(y))) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.StringType())
def shared_text(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The longest common substring of two texts, which it normalises."""
    for a, b in pairs:
        yield pd.Series([shared(_plain(x), _plain(y)) for x, y in zip(a, b, strict=True)], dtype=object)


def originality(text: Column, source: Column, n: int = 6, most_overlap: float = 0.15, most_shared: int = 12) -> Column:
    """Struct (ok, overlap, lcs): whether neither the gram overlap nor the longest common substring passes its limit."""
    overlap = share(gram_counts(text, source, (n,))[0])
    lcs = F.length(shared_text(text, source))
    return F.struct(((overlap <= most_overlap) & (lcs <= most_shared)).alias("ok"), overlap.alias("overlap"), lcs.alias("lcs"))


def sentences(text: Column) -> Column:
    """Sentences with their ends; no empty ones."""
    return F.filter(F.split(text, f"(?<=[{SENTENCE_ENDS}])"), lambda s: s != "")


def clock(seconds: Column) -> Column:
    """mm:ss of whole seconds, not below zero; minutes may pass 99."""
    whole = F.greatest(F.lit(0).cast("long"), seconds.cast("long"))
    minutes, rest = F.floor(whole / 60).cast("string"), (whole % 60).cast("string")
    return F.concat(F.when(F.length(minutes) < 2, F.lpad(minutes, 2, "0")).otherwise(minutes), F.lit(":"), F.lpad(rest, 2, "0"))


def ascii_digits(text: Column) -> Column:
    """Full-width digits as ASCII ones."""
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def collapse(text: Column, default: str) -> Column:
    """White space runs as one space, trimmed; default if nothing is left."""
    tidy = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.coalesce(F.nullif(tidy, F.lit("")), F.lit(default))


def csv_items(text: Column) -> Column:
    """Comma-separated items in lower case, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def video_id(url: Column) -> Column:
    """The 11 characters after v=, youtu.be/, shorts/ or embed/, or the whole text if it is such an id; else null."""
    inside = F.nullif(F.regexp_extract(url, r"(?:v=|youtu\.be/|shorts/|embed/)([A-Za-z0-9_-]{11})", 1), F.lit(""))
    return F.coalesce(inside, F.when(url.rlike(r"\A[A-Za-z0-9_-]{11}\z"), url))


def strip_markup(line: Column) -> Column:
    """A log line without [bold] and the like."""
    return F.regexp_replace(line, MARKUP, "")


def wrap(text: Column, width: int) -> Column:
    """Lines of at most width characters; closing punctuation may run over so that it starts none; a line feed ends a line, and a last line without text is left out."""
    full = rf"[^\n]{{{width}}}[{re.escape(CLOSING)}]*|[^\n]+"
    lines = F.flatten(F.transform(F.split(F.trim(text), "\n"), lambda part: F.when(part == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(part, F.lit(full), F.lit(0)))))
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)


#: White space that ends of texts lose.
BLANKS = " \t\n\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(BLANKS))


def safe_id(text: Column) -> Column:
    """Whether a text is 1 to 64 letters, digits, _ or -."""
    return text.rlike(r"\A[A-Za-z0-9_\-]{1,64}\z")


#: What a programme's channel is called, by what its name holds, and the words around a source; fixed values.
CHANNELS = ((("HEALTH 2.0",), ("健康2.0", "健康 2.0"), "TVBS《健康2.0》"),)
NO_SOURCE = "原始節目"
ATTRIBUTION = "根據%s報導指出"


def source_name(channel: Column) -> Column:
    """The programme that clips cite: by what the channel's name holds (in upper case, or as it is), else the name itself, else a general word."""
    out = F.coalesce(F.nullif(channel, F.lit("")), F.lit(NO_SOURCE))
    for upper, plain, name in CHANNELS:
        held = [F.upper(channel).contains(x) for x in upper] + [channel.contains(x) for x in plain]
        out = F.when(F.coalesce(functools.reduce(lambda a, b: a | b, held), F.lit(False)), F.lit(name)).otherwise(out)
    return out


def attribution(source: Column) -> Column:
    return F.format_string(ATTRIBUTION, source)


def first_lines(text: Column, n: int) -> Column:
    return F.slice(F.split(text, "\n"), 1, n)


def nested(json: Column, path: str, default: Column) -> Column:
    """What a JSON text holds at a path as text, or default where any step is missing."""
    return F.coalesce(F.get_json_object(json, path), default)


def register(spark) -> None:
    """Makes lcs_len and lcs_text available to SQL: length and text of the longest common substring of two texts, which they normalise."""
    spark.udf.register("lcs_len", shared_length)
    spark.udf.register("lcs_text", shared_text)
