"""Fill-in-middle transformation of texts, in Spark SQL functions alone.

A text is an array of units (white space with the word after it, or white space at the end), made by one regexp_extract_all. Digits of a SHA-256 over seed and doc_id say where prefix and middle end, whether the text is rearranged at all, and in which of two orders: psm is <P>prefix<S>suffix<M>middle, spm is <S>suffix<P>prefix<M>middle. A text that holds a sentinel stays plain, so the sentinels of an arrangement are the only ones in it and restore() finds the parts by them.

Everything is a projection: no shuffle, no Python, a row in memory at a time. Each step is a projection of its own; Spark keeps two apart where the later uses an expensive column of the earlier more than once.

Defined results: null text counts as empty, an empty text is plain with no units; a null doc_id draws as an empty one; repeated rows come out alike, as nothing but doc_id and text counts; an empty table gives no rows; texts of any length are cut whole; columns of the table that have the names of added ones (n, form, prefix_chars, middle_chars, output) are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit of a text, matched from left to right, a fixed value.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: What stands before prefix, suffix and middle, fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def draws(seed: int, doc_id: Column) -> Column:
    """The eight 8-digit groups of the hex SHA-256 of 'seed:doc_id' as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.transform(F.regexp_extract_all(digest, F.lit(".{8}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("long"))


def _joined(units: Column, start: Column, end: Column) -> Column:
    """Units start (from 0) to end, without end, as text."""
    return F.array_join(F.slice(units, (start + 1).cast("int"), (end - start).cast("int")), "")


def arranged(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """docs(doc_id, text, ...) with n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points, null if plain) and output; of 100 texts about `rate` are rearranged, about `spm_rate` of 100 of these as spm."""
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text.alias("whole"), draws(seed, F.col("doc_id")).alias("h"))
    cut = cut.withColumn("units", F.regexp_extract_all("whole", F.lit(UNIT), F.lit(0)))
    cut = cut.withColumn("n", F.size("units").cast("long"))
    h1, h2, h3, h4 = (F.col("h")[k] for k in range(4))
    marked = F.col("whole").contains(PREFIX) | F.col("whole").contains(SUFFIX) | F.col("whole").contains(MIDDLE)
    form = F.when((F.col("n") == 0) | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cut = cut.withColumns({"form": form, "a": F.least(one, two), "b": F.greatest(one, two)})
    spans = {"p": (F.lit(0), F.col("a")), "m": (F.col("a"), F.col("b")), "s": (F.col("b"), F.col("n"))}
    cut = cut.withColumns({name: F.when(F.col("form") != "plain", _joined(F.col("units"), *span)) for name, span in spans.items()})
    p, m, s = F.concat(F.lit(PREFIX), "p"), F.concat(F.lit(MIDDLE), "m"), F.concat(F.lit(SUFFIX), "s")
    output = F.when(F.col("form") == "psm", F.concat(p, s, m)).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.col("whole"))
    return cut.select("row.*", "n", "form", F.length("p").cast("long").alias("prefix_chars"), F.length("m").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, found by its sentinels; an output is split once."""
    split = F.array(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}"))  # what stands before the first sentinel is empty
    whole = lambda parts, order: F.concat(*[F.get(parts, F.lit(k)) for k in order])
    put = F.transform(split, lambda parts: F.when(form == "psm", whole(parts, (1, 3, 2))).otherwise(whole(parts, (2, 3, 1))))
    return F.when(form == "plain", output).otherwise(F.get(put, F.lit(0)))


def round_trip(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256, the digest of the text rebuilt from the output."""
    made = arranged(docs.select("doc_id", "text"), seed, rate, spm_rate).withColumn("restored", restored(F.col("output"), F.col("form")))
    digest = lambda c: F.sha2(F.col(c), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))
