"""Quality classifier: Bradley-Terry scores learned from preference pairs, cut at a score quantile."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import map_batches, map_values, row_key
from storyloom.llm.quality_rules import repeated_words

SAMPLE_ROWS = 20_000  # labelled rows that the model is fitted on, at most
PAIRS = 40_000
STEPS, RATE, SHRINK = 400, 0.5, 1e-3
THRESHOLD = 0.3
FOLDS = 5
SLOPE = 4.0
FEATURES = ["log_words", "word_length", "symbols", "bars", "bangs", "digits", "capitals", "leading_capitals", "duplicate_lines", "repeated", "top_word", "distinct", "stops", "commas", "long_words", "line_words", "decorated", "echoes"]
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>=_~^@]")
_DECORATED = re.compile(r"[#*$%&!|]$")
_DIGIT = re.compile(r"[0-9]")


def features(text: str | None) -> list[float]:
    """Style of a text as shares, so that length weighs little; an empty text has zeros."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = Counter(words)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    chars = sum(map(len, words))
    return [
        np.log1p(n),
        chars / n,
        min(2.0, len(_SYMBOL.findall(text)) / n),
        min(1.0, text.count("|") / n),
        min(2.0, text.count("!") / n),
        len(_DIGIT.findall(text)) / chars,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        1 - len(set(lines)) / len(lines),
        repeated_words(words) / n,
        (max(count.values()) - 1) / n,
        len(count) / n if n < 200 else np.log(len(count)) / np.log(n),
        text.count(". ") / n,
        text.count(",") / n,
        sum(len(w) > 20 for w in words) / n,
        min(5.0, np.log1p(n / len(lines))),
        sum(1 for w in words if _DECORATED.search(w)) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
    ]


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Rows that labels are never learned from: crc32 of the doc_id as text, modulo the folds, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


class Ranker:
    """score(x) = sigmoid(slope * (w.z(x) - cut) + logit(threshold)); w from pairs, cut a quantile of the training scores."""

    def __init__(self, x: np.ndarray, label: np.ndarray, threshold: float = THRESHOLD, pairs: int = PAIRS, seed: int = 5) -> None:
        self.mean, self.scale = np.zeros(len(FEATURES)), np.ones(len(FEATURES))
        self.weights, self.cut, self.slope, self.threshold = np.zeros(len(FEATURES)), -1.0, SLOPE, threshold
        good, bad = x[label == 1], x[label == 0]
        if not len(good) or not len(bad):
            return  # nothing to compare: every score is the same, over the threshold
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        r = np.random.default_rng(seed)
        better, worse = r.integers(0, len(good), pairs), r.integers(0, len(bad), pairs)
        difference = (good[better] - bad[worse]) / self.scale
        for _ in range(STEPS):  # logistic loss of the preferred minus the other, plus a ridge
            chance = 1 / (1 + np.exp(-np.clip(difference @ self.weights, -50, 50)))
            self.weights += RATE * (difference.T @ (1 - chance) / pairs - SHRINK * self.weights)
        raw = np.sort(self.raw(good)), np.sort(self.raw(bad))
        every = np.sort(np.concatenate(raw))
        levels = np.quantile(every, np.linspace(0, 1, 1001))
        # the quantile with the fewest mistakes; each label weighs the same
        mistakes = np.searchsorted(raw[0], levels) / len(good) + 1 - np.searchsorted(raw[1], levels) / len(bad)
        least = levels[mistakes <= mistakes.min() + 1e-12]
        self.cut = float((least[0] + least[-1]) / 2)
        self.slope = SLOPE / max(1e-9, float(raw[0].mean() - raw[1].mean()))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """The score of each row of features."""
        z = self.slope * (self.raw(x) - self.cut) + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ranker:
    """The model, from at most ``sample_rows`` labelled rows outside the held-out fold: those whose hashed doc_id is smallest.

    Only the sample's features reach the driver, ``sample_rows`` x 18 numbers at most: of rows that share a doc_id one counts.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("top")).where("quality = top")  # contradictory labels teach nothing
    sample = known.select("doc_id", "quality", F.xxhash64("doc_id").alias("draw")).orderBy("draw", "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most sample_rows rows
    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    found = map_values(rows, [F.col("doc_id"), F.col("quality")], F.col("text"), lambda t: ([float(v) for v in features(t)],), schema)
    found = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([r.x for r in found]).reshape(len(found), len(FEATURES))
    return Ranker(x, np.array([r.quality for r in found]))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text_hash, held_out, score, predicted) for each row; scores come from the text alone.

    Null and empty texts: scored like a text without words. Null doc_id: kept, in the fold of the empty string. Repeated rows: rows of their own.
    No labels, or of one kind only: every score is the same and over the threshold. Labels that contradict each other or are null aren't used.
    Empty table: empty result.
    """
    model = fit(docs, labels, sample_rows)
    schema = T.StructType([T.StructField("score", T.DoubleType())])

    def scores(batches: Iterator[pa.Array]) -> Iterator[list[tuple]]:
        for texts in batches:
            x = np.array([features(t.as_py()) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
            yield [(s,) for s in model.score(x).tolist()]

    found = map_batches(docs, row_key(), F.col("text"), scores, schema)
    return found.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int")).select("doc_id", "text_hash", "held_out", "score", "predicted")
