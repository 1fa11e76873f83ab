"""Secrets in texts: three base patterns, and long strings that look random to character Markov models.

Two first-order Markov models over characters are trained from labelled samples: random strings (what the base patterns find in a bounded sample of the texts, and strings drawn from the alphabets of keys) and ordinary identifiers (words of that sample, joined as identifiers are). A run of key characters, what base spans hold of it cut out, leaves parts; a part of 20 or more is a secret if its mean log-likelihood ratio a character, random over ordinary, exceeds `margin`. The models only add spans.

Spans are of whole matches, in code points, end exclusive. Defined results: null text counts as empty; repeated rows each get their row; a null doc_id keeps its row; an empty table gives no rows, and a sample without words leaves the ordinary model uniform; other columns are ignored (redact keeps them).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The base kinds in the order that breaks ties, fixed values; only the letters of the key words match in either case.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_VALUE = 6
LEAST_RUN = 20

ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789")
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.full(128, 0, np.int64)
CODE[[ord(c) for c in CHARACTERS]] = np.arange(1, len(CHARACTERS) + 1)
SIZE = len(CHARACTERS) + 1

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start and then kind."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS) or "İ" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def pairs_of(text: str) -> np.ndarray:
    """Codes of a string's neighbouring characters; the string's ends count as character 0."""
    codes = CODE[np.frombuffer(text.encode("ascii"), np.uint8)]
    codes = np.concatenate([[0], codes, [0]])
    return codes[:-1] * SIZE + codes[1:]


class Ratio:
    """Log-likelihood ratio of two character models from their pair counts."""

    def __init__(self, chance: np.ndarray, ordinary: np.ndarray, alpha: float = 0.5):
        a, b = ((x.reshape(SIZE, SIZE) + alpha) for x in (chance, ordinary))
        self.ratio = (np.log(a / a.sum(axis=1, keepdims=True)) - np.log(b / b.sum(axis=1, keepdims=True))).ravel()

    def mean(self, text: str) -> float:
        return float(self.ratio[pairs_of(text)].mean())


def drawn(strings: int, seed: int) -> np.ndarray:
    """Pair counts of random strings over the alphabets of keys."""
    chance, counts = random.Random(seed), np.zeros(SIZE * SIZE, np.int64)
    for i in range(strings):
        text = "".join(chance.choices(ALPHABETS[i % len(ALPHABETS)], k=chance.randint(20, 48)))
        np.add.at(counts, pairs_of(text), 1)
    return counts


def fit(docs: DataFrame, sample_rows: int = 5_000, strings: int = 4_000, seed: int = 7) -> Ratio:
    """Trains on about sample_rows of docs(doc_id, text), chosen by a hash, and on `strings` drawn strings."""
    common.short_batches(docs.sparkSession)
    n = docs.select("doc_id").count()
    sample = docs if n <= sample_rows else docs.where(common.hash_share(sample_rows, n, F.col("doc_id"), F.lit("secrets")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SIZE * SIZE), np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                at, words = 0, []
                for start, kind, end in base_spans(text):
                    if start >= at:
                        words += re.findall(r"[A-Za-z]+", text[at:start])
                        found = text[start:end] if kind else re.split(r"[:=\x20\"']+", text[start:end])[-1]
                        np.add.at(counts[0], pairs_of(re.sub(r"[^A-Za-z0-9+/_=-]", "", found)), 1)
                    at = max(at, end)
                words += re.findall(r"[A-Za-z]+", text[at:])
                for i in range(0, len(words), 3):  # as snake_case, camelCase and with digits, in turn
                    part = words[i : i + 3]
                    name = ("_".join(part), part[0] + "".join(w.capitalize() for w in part[1:]), "-".join(part) + str(i % 100))[i // 3 % 3]
                    np.add.at(counts[1], pairs_of(name), 1)
        label, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[label, at])], ["label", "pair", "n"])

    counted = sample.where("text is not null").select(F.col("text").cast("string")).mapInArrow(count, "label int, pair int, n long")
    rows = counted.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()  # at most 2 * SIZE**2 rows
    counts = np.zeros((2, SIZE * SIZE), np.int64)
    for r in rows:
        counts[r.label, r.pair] = r.n
    return Ratio(counts[0] + drawn(strings, seed), counts[1])


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """Start and end of what the spans cover together, in order."""
    out: list[tuple[int, int]] = []
    for start, _, end in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def all_spans(text: str, model: Ratio, margin: float) -> tuple[list[Span], list[Span]]:
    """Base spans; base spans and what the models add."""
    base = base_spans(text)
    added: list[Span] = []
    if max(map(len, text.split()), default=0) >= 20:
        taken, nxt = merged(base), 0
        for m in CANDIDATE.finditer(text):
            while nxt < len(taken) and taken[nxt][1] <= m.start():
                nxt += 1
            at, k = m.start(), nxt
            while k < len(taken) and taken[k][0] < m.end():
                if taken[k][0] - at >= LEAST_RUN and model.mean(text[at : taken[k][0]]) > margin:
                    added.append((at, 3, taken[k][0]))
                at, k = max(at, taken[k][1]), k + 1
            if m.end() - at >= LEAST_RUN and model.mean(text[at : m.end()]) > margin:
                added.append((at, 3, m.end()))
    return base, sorted(base + added)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: Ratio | None = None, margin: float = 1.0) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of every row of docs(doc_id, text)."""
    common.short_batches(docs.sparkSession)
    model = model or fit(docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in b.column(1).to_pylist():
                base, spans = all_spans(text or "", model, margin)
                kinds = [k for _, k, _ in spans]
                for column, x in zip(out, (*map(kinds.count, range(4)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)), strict=True):
                    column.append(x)
            n_assign, n_access, n_hex, n_random = (pa.array(x, pa.int64()) for x in out[:4])
            yield pa.RecordBatch.from_arrays([b.column(0), n_assign, n_access, n_hex, pa.array(out[4], pa.string()), pa.array(out[5], pa.string()), n_random], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(docs: DataFrame, model: Ratio | None = None, margin: float = 1.0, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text replaced by mark (overlapping spans by one); all columns, n_chars too where there is one, follow."""
    model = model or fit(docs)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else blank(t, all_spans(t, model, margin)[1], mark))

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def blank(text: str, spans: list[Span], mark: str) -> str:
    parts, at, open_until = [], 0, -1
    for start, _, end in spans:
        if start >= open_until:
            parts += [text[at:start], mark]
        open_until = at = max(at, end)
    return "".join([*parts, text[at:]])
