"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed 1- to 3-grams are counted over all training documents. The classifier
is fitted by follow-the-regularised-leader with elastic-net penalties, in one task, on a bounded sample
of them: every language gets an equal share of MAX_TRAIN rows (all of its rows where it has fewer), by
a hash of id and text, and the sample ends at MAX_BYTES of text. Every fifth row of the sample is kept
from the fit and sets the temperature of the softmax, however small the sample. The table of hashed
n-grams is halved for each doubling of the languages beyond 256, so that a model has 2^24 weights at
most. Every document is predicted on its whole text in one Arrow pass without a shuffle.

Defined cases: null texts and texts without a letter are `und` with score 0, and so is every text
when nothing can be learned; rows with a null lang are never learned from; a language none of whose
rows is in the sample, or has a letter, is not learned; rows with null or repeated doc_ids each keep one
result row (a null id counts as fold 0: it is not held out); an empty input gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ftrl import Ftrl, probabilities
from .shared import bounded_sample, fold, materialise, small

#: Hashed n-grams for up to 2^8 languages, and weights of any model, as powers of two.
BITS, WEIGHT_BITS = 16, 24
FOLDS, HELD_OUT = 3, 1
#: Rows and bytes of text that the sample holds at most; every so-manieth of its rows is for calibration.
MAX_TRAIN, MAX_BYTES, CALIBRATE = 7_500, 64 << 20, 5
EPOCHS, ALPHA, BETA, L1, L2 = 2, 0.5, 1.0, 0.3, 1e-3
#: Words of the cuts on which the temperature is fitted too, and the spread of its prior in natural logarithms.
CUTS, PRIOR_SPREAD = (1, 2, 4, 8), 1.0
#: Code points that are handled at a time, so that long texts need little memory.
BLOCK = 1 << 20
UND = "und"
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter; built once in each Python worker."""
    if not _letters:
        _letters.append(np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), bool, sys.maxunicode + 1))
    return _letters[0]


def table_bits(languages: int) -> int:
    return max(min(BITS, WEIGHT_BITS - max(languages - 1, 1).bit_length()), 10)


def gram_counts(text: str, bits: int = BITS) -> np.ndarray | None:
    """Counts of hashed 1-, 2- and 3-grams over letters, each run of other characters as one space; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint32)
    size, shift = 1 << bits, np.uint32(32 - bits)
    total = np.zeros(size, np.int64)
    for at in range(0, len(points), BLOCK):
        p = points[at : at + BLOCK + 2]  # two more, so that no n-gram is lost at the seam
        one, two, three = p[:BLOCK] * _A, p[:-1][:BLOCK] * _B + p[1:][:BLOCK], p[:-2][:BLOCK] * _C
        three = (three + p[1:-1][:BLOCK]) * _B + p[2:][:BLOCK]
        for grams in (one, two * _A, three * _A):
            grams = (grams ^ (grams >> np.uint32(15))) * _C
            total += np.bincount(grams >> shift, minlength=size)
    return total


def _frequencies(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(1 << bits, np.int64), 0
    for batch in batches:
        for value in batch.column("text"):
            counts = gram_counts(value.as_py() or "", bits)
            n += 1
            if counts is not None:
                total += counts > 0
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int64()), pa.array([n, *total[at]], pa.int64())], ["gram", "documents"])


def inverse_frequencies(train: DataFrame, bits: int = BITS) -> np.ndarray:
    """log((1 + n) / (1 + df)) + 1 of each hashed n-gram, over all rows of train; 2^bits + 1 sums reach the driver."""
    found = train.select("text").mapInArrow(lambda it: _frequencies(it, bits), "gram long, documents long").groupBy("gram").agg(F.sum("documents").alias("documents")).toPandas()
    table = dict(zip(found["gram"], found["documents"], strict=True))
    df = np.zeros(1 << bits)
    for gram, documents in table.items():
        if gram >= 0:
            df[gram] = documents
    return (np.log((1.0 + table.get(-1, 0)) / (1.0 + df)) + 1.0).astype(np.float32)


def tfidf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct n-gram ids and values of unit length; None without a letter."""
    counts = gram_counts(text, len(idf).bit_length() - 1)
    if counts is None:
        return None
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / np.sqrt(x @ x)


def cuts(text: str, turn: int) -> list[str]:
    """Runs of 1, 2, 4 and 8 words of a text, from places that `turn` moves: what a model is least sure of."""
    words = text.split()
    return [" ".join(words[at : at + n]) for n in CUTS if len(words) > n for at in [turn * 7919 % (len(words) - n)]]


def _temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature in [0.05, 20] of the greatest posterior under a log-normal prior about 1, by golden section on its logarithm.

    An optimum at an end is no calibration, and an error.
    """

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).sum()) + 0.5 * (t / PRIOR_SPREAD) ** 2

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    ends = low + 0.01, high - 0.01
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    if not ends[0] < (found := (low + high) / 2) < ends[1]:
        raise ValueError(f"the temperature {np.exp(found):.3g} stands at an end of its range")
    return float(np.exp(found))


def _train(frames: Iterator[pd.DataFrame], idf: np.ndarray, languages: list[str]) -> Iterator[pd.DataFrame]:
    """One task over the bounded sample, in hash order. Yields feature -1 for the temperature."""
    index = {lang: i for i, lang in enumerate(languages)}
    columns = max(len(languages), 2)
    model, rows, held, n = Ftrl(len(idf), columns, ALPHA, BETA, L1, L2), [], [], 0
    for frame in frames:
        for text, lang in zip(frame["text"], frame["lang"], strict=True):
            if (x := tfidf(text or "", idf)) is None:
                continue
            if (n := n + 1) % CALIBRATE == 1:
                held += [(*y, index[lang]) for part in (text, *cuts(text, n)) if (y := tfidf(part, idf)) is not None]
            else:
                rows.append((*x, index[lang]))
    eye = np.eye(columns)
    for _ in range(EPOCHS):
        for at, values, truth in rows:
            model.step(at, values, eye[truth])
    w = model.weights()
    temperature = 1.0
    if held:
        scores = np.array([values @ w[at] for at, values, _ in held])
        temperature = _temperature(scores, np.array([t for _, _, t in held]))
    at = np.flatnonzero(np.any(w != 0, axis=1))
    yield pd.DataFrame({"feature": np.r_[-1, at], "weights": [np.full(columns, temperature), *w[at]]})


def _uniform(seed: int, *parts: str) -> F.Column:
    return F.xxhash64(*parts, F.lit(seed)) / F.lit(2.0**64) + 0.5


def training_sample(train: DataFrame, most: int = MAX_TRAIN, most_bytes: int = MAX_BYTES) -> DataFrame:
    """text, lang of the rows that the model learns from; repeated rows (and ties of the hash) count as they come, up to the bounds."""
    counts = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.select(F.col("lang").alias("__lang"), "n"), "language-counts")
    share = most / max(counts.count(), 1)
    drawn = train.join(small(counts), F.col("lang") == F.col("__lang")).where(_uniform(5, "doc_id", "text") < F.lit(share) / F.col("n"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    ordered = drawn.select("doc_id", "lang", _uniform(6, "doc_id", "text").alias("rank"), F.xxhash64("text").alias("tie"), size)
    texts = train.select("doc_id", F.xxhash64("text").alias("tie"), "text", F.col("lang").alias("__own"))
    return bounded_sample(ordered, texts, ["rank", "doc_id", "lang"], most, most_bytes).where("lang = __own").drop("__own")


def fit(docs: DataFrame, most: int = MAX_TRAIN, most_bytes: int = MAX_BYTES) -> dict | None:
    """idf, weights, languages and temperature; None if there is nothing to learn from."""
    train = docs.where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sample = materialise(training_sample(train, most, most_bytes), "language-sample")
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # no more than the sample has rows
    if not languages:
        return None
    idf = inverse_frequencies(train, table_bits(len(languages)))
    one = sample.repartition(1).sortWithinPartitions("rank", "doc_id", "lang").select("text", "lang")
    found = one.mapInPandas(lambda it: _train(it, idf, languages), "feature int, weights array<double>").toPandas()
    weights = np.zeros((len(idf), max(len(languages), 2)), np.float32)
    rows = found[found["feature"] >= 0]
    if len(rows):
        weights[rows["feature"].to_numpy()] = np.stack(rows["weights"].to_numpy())
    return {"idf": idf, "weights": weights, "languages": languages, "temperature": float(found.loc[found["feature"] == -1, "weights"].iloc[0][0])}


def _predict(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model = sent.value
    for batch in batches:
        names, scores = [], []
        for value in batch.column("text"):
            x = None if model is None else tfidf(value.as_py() or "", model["idf"])
            if x is None:
                names.append(UND)
                scores.append(0.0)
                continue
            p = probabilities(x[1] @ model["weights"][x[0]] / model["temperature"])[: len(model["languages"])]
            best = int(np.argmax(p))
            names.append(model["languages"][best])
            scores.append(float(p[best]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            ["doc_id", "held_out", "lang_pred", "score"],
        )


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^WEIGHT_BITS weights at most
    rows = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _predict(it, sent), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
