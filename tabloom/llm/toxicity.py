"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, the stems of STEMS letters of longer words (invented and inflected words share them), the pairs
of neighbours and the pairs with one word between them, hashed into 2^BITS places; each that a text has counts once. FTRL-proximal keeps a rate for each coordinate, and its L1 term leaves most weights at
zero, so the model that is broadcast is the places and weights that are left. It is fitted on the driver over at most
MAX_ROWS labelled texts, those with the least hash of their doc_id: a documented bound. Every document is scored whole.

Nulls and texts without words have the score of the bias alone. A doc_id with several labels counts as toxic if one of
them is. Without any labelled row the score is the prior PRIOR for all. Repeated rows each get their row, an empty table
gives an empty one, other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import session, small, table

BITS = 20
MAX_ROWS = 6000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 1.0
STEMS = (4, 5, 6, 7)
PRIOR = 0.1
THRESHOLD = 0.3
WORD = re.compile(r"\w+")
CACHE = 500_000
_PAIR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    """A word's hash and those of its stems, as bytes; a word that is no longer than a stem has its own hash there."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        digest = xxhash.xxh64_intdigest
        own = digest(word.encode("utf-8", "surrogatepass"))
        stems = [digest(("^" + word[:k]).encode("utf-8", "surrogatepass")) if len(word) > k else own for k in STEMS]
        self[word] = h = np.array([own, *stems], np.uint64).tobytes()
        return h


def features(text: str | None, hashes: dict[str, bytes], bits: int = BITS) -> np.ndarray:
    """The places of a text's features, ascending, each once."""
    words = WORD.findall((text or "").lower())
    table_ = np.frombuffer(b"".join(map(hashes.__getitem__, words)), np.uint64).reshape(-1, 1 + len(STEMS))
    h = table_[:, 0]
    every = np.concatenate([table_.ravel(), h[:-1] * _PAIR[0] + h[1:] * _PAIR[1], h[:-2] * _PAIR[2] + h[2:] * _PAIR[3]])
    return np.unique((((every ^ (every >> np.uint64(33))) * _PAIR[0]) >> np.uint64(64 - bits)).astype(np.int32))


def fit(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and weights that aren't zero, and the bias."""
    size = 1 << bits
    z, n, bias_z, bias_n = np.zeros(size), np.zeros(size), 0.0, 0.0

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    bias = log(PRIOR / (1 - PRIOR))
    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            at, y = rows[k]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            b = bias - bias_z / ((BETA + bias_n**0.5) / ALPHA)
            g = _sigmoid(float(w.sum()) + b) - y
            step = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[at] = zs + g - step * w
            n[at] = ns + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / ALPHA * (b - bias)
            bias_n += g * g
    w = weights(z, n)
    left = np.flatnonzero(w)
    return left.astype(np.int32), w[left], bias - bias_z / ((BETA + bias_n**0.5) / ALPHA)


def _sigmoid(x: float) -> float:
    return 1 / (1 + exp(-x)) if x >= 0 else exp(x) / (1 + exp(x))


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            found = [features(t, hashes, bits).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("toxic")], names=["at", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """The model, from the labels of documents that aren't held out."""
    session(docs)
    known = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # of rows that share a doc_id the least text, so that there are max_rows at most
    texts = docs.select("doc_id", "text").join(small(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = texts.select("text", "toxic").mapInArrow(_features(bits), "at binary, toxic int")
    # sorted, as the order of tasks isn't fixed
    found = sorted((bytes(r.at), r.toxic) for r in rows.collect())
    return fit([(np.frombuffer(a, np.int32), y) for a, y in found], bits, epochs)


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def _scores(model, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = model.value
        weights, hashes = np.zeros(1 << bits), _Hashes()
        weights[at] = values
        for batch in batches:
            scores = [_sigmoid(float(weights[features(t, hashes, bits)].sum()) + bias) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    """(doc_id, score) of every document. The model has at most 2^bits weights, so it can be broadcast."""
    spark = session(docs)
    return docs.select("doc_id", "text").mapInArrow(_scores(spark.sparkContext.broadcast(model), bits), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
