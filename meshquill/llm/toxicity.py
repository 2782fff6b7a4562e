"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A word counts as itself and as its stems (its first PREFIXES characters), so that inflected and
compounded forms of a word share weights; pairs, pairs with one and with two words skipped, and
triples are of whole words. The classifier is fitted in one task on a bounded sample of labelled
documents (MAX_TRAIN rows and MAX_BYTES of text at most, in the order of a seeded hash of the id); the
L1 penalty leaves few weights, which are broadcast. All documents are scored on their whole text in one
Arrow pass without a shuffle.

Defined cases: null and empty texts get the score of the bias alone; rows with a null toxic label or
a null id in labels are not learned from; repeated labels of one id are one (the larger label); of
repeated doc_ids each text is learned from with that label; rows with null or repeated doc_ids each
keep one result row (a null id counts as fold 0, held out); without any usable label all scores are
0.5; an empty input gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ftrl import Ftrl, probabilities
from .shared import bounded_sample, fold

BITS = 20
FOLDS = 5
#: Labelled documents, and bytes of their texts, that the fit uses at most; passes over them.
MAX_TRAIN, MAX_BYTES, EPOCHS = 12_000, 64 << 20, 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 12.0, 1.0
_WORD = re.compile(r"\w+")
_MASK = np.uint32((1 << BITS) - 1)
#: Odd factors that tell the orders apart: word, pair, pair with one and with two words skipped, triple.
_PAIR, _SKIP1, _SKIP2, _TRIPLE = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))
#: Characters at the start of a longer word that count as a stem of it.
PREFIXES = (3, 4, 5, 6, 7)
BIAS = 0
CACHE_WORDS = 200_000


class WordTable:
    """Hashes of words and of their stems, a row for each word; forgets all of them when full."""

    def __init__(self, most: int = CACHE_WORDS):
        self.most, self.rows, self.table = most, {}, np.empty((1024, 1 + len(PREFIXES)), np.uint32)

    def _add(self, word: str) -> int:
        at = self.rows[word] = len(self.rows)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        whole = zlib.crc32(word.encode()) or 1
        self.table[at] = [whole, *(zlib.crc32(f"{word[:k]}*".encode()) if len(word) > k else whole for k in PREFIXES)]
        return at

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.rows) >= self.most:
            self.rows.clear()
        rows = self.rows
        at = [rows[w] if w in rows else self._add(w) for w in words]
        return self.table[at] if at else self.table[:0]


def features(text: str, cache: WordTable) -> np.ndarray:
    """Hashed n-gram, skip-gram and stem ids of a whole text, in place order and with repeats."""
    found = cache(_WORD.findall(text.lower()))
    found = (found ^ (found >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = found[:, 0]
    parts = [found.T.reshape(-1), h[:-1] * _PAIR + h[1:], h[:-2] * _SKIP1 + h[2:], h[:-3] * _SKIP2 + h[3:], (h[:-2] * _PAIR + h[1:-1]) * _TRIPLE + h[2:]]
    x = np.concatenate(parts)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0x297A2D39)
    return np.maximum((x ^ (x >> np.uint32(16))) & _MASK, np.uint32(1)).astype(np.int64)  # 0 is the bias


def _train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task over the bounded sample; rows arrive in hash order, so the fit is repeatable."""
    cache, rows = WordTable(), []
    for frame in frames:
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            rows.append((np.concatenate([[BIAS], np.unique(features(text or "", cache))]).astype(np.int32), float(toxic)))
    if not rows:
        return
    model = Ftrl(1 << BITS, 1, ALPHA, BETA, L1, L2)
    for _ in range(EPOCHS):
        for at, toxic in rows:
            model.step(at, np.ones(len(at)), np.array([toxic]))
    w = model.weights()[:, 0]
    at = np.flatnonzero(w)
    yield pd.DataFrame({"feature": at.astype(np.int64), "weight": w[at]})


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, most_bytes: int = MAX_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and weights (at most 2^BITS, mostly zero under L1) of the fitted model."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", FOLDS) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id"), F.xxhash64("text").alias("tie"), "text")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).join(known, "doc_id")
    rows = rows.withColumn("rank", F.xxhash64(F.col("doc_id"), F.lit(2)))
    one = bounded_sample(rows, texts, ["rank", "doc_id", "tie"], most, most_bytes).select("text", "toxic")
    found = one.mapInPandas(_train, "feature long, weight double").toPandas()
    return found["feature"].to_numpy(np.int64), found["weight"].to_numpy(np.float64)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    at, weights = model.value
    table = np.zeros(1 << BITS)
    table[at] = weights
    cache = WordTable()
    for batch in batches:
        scores = []
        for value in batch.column("text"):
            x = features(value.as_py() or "", cache)
            x = np.unique(x[table[x] != 0.0])
            scores.append(table[BIAS] + table[x].sum())
        found = probabilities(np.array(scores, float).reshape(-1, 1))[:, 0]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found)], ["doc_id", "held_out", "score"])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS pairs at most
    rows = docs.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(lambda it: _score(it, sent), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels))
