"""Language proportions of a text by expectation-maximisation over n-gram likelihoods.

Training counts letter trigrams of labelled texts for each language. A text's trigrams are taken as drawn from a mixture of the languages; expectation-maximisation estimates the proportions. Which languages belong to the mixture is settled by penalised likelihood: the set grows by the language of the next largest proportion as long as its log-likelihood, less `penalty` half-logs of the trigram count for each further language, rises. The language of the largest proportion is predicted, with that proportion as score.

Estimation goes on until no proportion moves by more than `tolerance` (a thousandth), or for `steps` steps (200; on texts of the test tables it ends within a few dozen).

Letters are folded to 60 classes (other scripts by a hash of the code point), so a language has at most 64**3 counts. It is fitted on a bounded sample: the labelled rows whose hash is below the share that `sample_rows` asks for, whole texts. A model takes 2 MB a language on the driver and in each worker; more than `most_languages` distinct labels (200, 400 MB) stop the fit with an error rather than be dropped.

Defined results: a text that is null or has no letter is `und`, score 0; without labelled rows every text is `und`; a null doc_id is never held out and its row is kept; rows with a null lang don't train; repeated rows count each; an empty table gives no rows; other columns are ignored (the pipeline's filter keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

GRAMS = 64**3
NEW = 255


class Classes:
    """Class of each code point: 0 no letter, 1 to 26 a to z, 27 to 63 other letters, in either case alike."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, NEW, np.uint8)

    def of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self.table[points]
        if (classes == NEW).any():
            for p in np.unique(points[classes == NEW]).tolist():
                self.table[p] = self.one(chr(p))
            classes = self.table[points]
        return classes

    @staticmethod
    def one(char: str) -> int:
        if not char.isalpha():
            return 0
        low = char.lower()[0]
        return ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) * 2654435761 % 2**32 % 37


CLASSES = Classes()


def grams(text: str) -> np.ndarray:
    """Trigrams that hold a letter in the middle; what is no letter counts as one word boundary."""
    c = CLASSES.of(text)
    if not c.any():
        return np.zeros(0, np.int32)
    keep = c.astype(bool)
    keep[1:] |= c[:-1].astype(bool)  # the first of what is no letter stays
    c = np.concatenate([[0], c[keep], [0]]).astype(np.int32)
    return (c[:-2] << 12 | c[1:-1] << 6 | c[2:])[c[1:-1] > 0]


def held_out() -> Column:
    """Rows that don't train: crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


class Model:
    def __init__(self, languages: list[str], codes: np.ndarray, ids: np.ndarray, counts: np.ndarray, alpha: float = 0.5, penalty: float = 4.0, tolerance: float = 1e-3, steps: int = 200):
        """codes, ids, counts: a row for each language and trigram that occurred."""
        self.languages, self.penalty, self.tolerance, self.steps = languages, penalty, tolerance, steps
        table = np.full((len(languages), GRAMS), alpha, np.float64)
        np.add.at(table, (codes, ids), counts)
        seen = max(1, len(np.unique(ids)))
        self.p = (table / (np.add.reduce(table, axis=1, keepdims=True) - alpha * (GRAMS - 2 * seen))).astype(np.float64) if len(languages) else table

    def mixture(self, p: np.ndarray, counts: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Proportions by expectation-maximisation from a first guess; p holds the trigrams' probabilities, a row for each language."""
        n = float(counts.sum())
        for _ in range(self.steps if len(share) > 1 else 0):
            weight = counts / (share @ p)
            new = share * (p @ weight) / n
            moved = np.abs(new - share).max()
            share = new
            if moved <= self.tolerance:
                break
        return share / share.sum()

    def value(self, p: np.ndarray, counts: np.ndarray, share: np.ndarray) -> float:
        """Log-likelihood of a mixture less the penalty for each language but the first."""
        return float(counts @ np.log(share @ p) - self.penalty * (len(share) - 1) * np.log(counts.sum()) / 2)

    def proportions(self, ids: np.ndarray) -> tuple[str, float, dict[str, float]]:
        """Predicted language, score, and the mixture."""
        if not len(ids) or not self.languages:
            return "und", 0.0, {}
        unique, counts = np.unique(ids, return_counts=True)
        p = self.p[:, unique]
        share = self.mixture(p, counts, np.full(len(p), 1 / len(p)))
        order = np.argsort(-share, kind="stable")
        best, kept = -np.inf, None
        for size in range(1, len(order) + 1):
            part = order[:size]
            first = np.maximum(share[part], 1e-9)  # a proportion of nothing would stay nothing
            mix = self.mixture(p[part], counts, first / first.sum())
            value = self.value(p[part], counts, mix)
            if value <= best:
                break
            best, kept = value, (part, mix)
        part, mix = kept
        top = int(np.argmax(mix))
        return self.languages[part[top]], float(min(1.0, mix[top])), {self.languages[i]: float(m) for i, m in zip(part, mix, strict=True)}


def fit(docs: DataFrame, sample_rows: int = 20_000, most_languages: int = 200) -> Model:
    """Fits the model on about sample_rows of docs(doc_id, text, lang) that are labelled and not held out; more than most_languages labels among them are an error."""
    common.short_batches(docs.sparkSession)
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = usable.select("doc_id").count()
    if n > sample_rows:
        usable = usable.where(common.hash_share(sample_rows, n, F.col("doc_id"), F.lit("langid")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = grams(text)
                if lang not in held:
                    held[lang] = np.zeros(GRAMS, np.int64)
                np.add.at(held[lang], ids, 1)
        for lang, counts in held.items():
            at = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "gram", "n"])

    labels = usable.select("lang").distinct().limit(most_languages + 1).count()
    if labels > most_languages:
        raise ValueError(f"more than {most_languages} languages; raise most_languages if 2 MB for each fit the workers")
    counted = usable.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(count, "lang string, gram int, n long")
    rows = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # at most GRAMS rows for each of most_languages
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    code = {x: i for i, x in enumerate(languages)}
    return Model(languages, np.array([code[x] for x in names], np.int64), rows.column("gram").to_numpy().astype(np.int64), rows.column("n").to_numpy())


def detect(docs: DataFrame, model: Model | None = None, sample_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, mixture) of every row of docs(doc_id, text, and lang if no model is given)."""
    spark = docs.sparkSession
    common.short_batches(spark)
    shared = spark.sparkContext.broadcast(model or fit(docs, sample_rows))  # bounded by GRAMS

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            found = [model.proportions(grams(t or "")) for t in b.column(2).to_pylist()]
            mixture = pa.array([list(m.items()) for _, _, m in found], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64()), mixture], ["doc_id", "held_out", "lang_pred", "score", "mixture"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(infer, "doc_id long, held_out boolean, lang_pred string, score double, mixture map<string,double>")


def keep_known(docs: DataFrame, least: float = 0.0, sample_rows: int = 20_000) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with a score of at least `least`; `und` goes."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs, sample_rows))

    @F.pandas_udf("boolean")
    def known(texts):
        found = [shared.value.proportions(grams(t or "")) for t in texts]
        return texts.__class__([x != "und" and score >= least for x, score, _ in found], dtype=bool)

    return docs.where(known(F.col("text").cast("string")))
