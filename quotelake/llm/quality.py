"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are the whole text's words and pairs of neighbouring words, and besides the shapes of words and of such pairs, all
hashed to 2**BITS places; a document's values are its counts over the square root of their number. Training is FTRL-proximal (McMahan et al., 2013), per coordinate, over a bounded
sample of labelled rows: SHARDS learners see disjoint shares, and their weights are averaged. L1 keeps the weights sparse.
Scoring is a sparse dot product of a text's features with the weights, which are broadcast (2**BITS floats, 4 MB).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import U64, flat_words, mix, remainder, slices, utf8, word_hashes

BITS = 20
#: About so many labelled rows are learned from, whatever the input; those with the smallest hashes of their ids.
MOST_ROWS = 24_000
SHARDS, EPOCHS = 8, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.3, 0.3


class _Shapes(dict):
    """Hashes of word shapes: runs of lower-case, upper-case letters and digits count as one sign each (``Then,`` has the shape ``Aa,``)."""

    def __missing__(self, mapped: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[mapped] = value = xxhash.xxh64_intdigest(re.sub(rb"(.)\1+", rb"\1", mapped), 1)
        return value


_shapes = _Shapes()
_MAP = bytes(ord("a") if chr(b).islower() and b < 128 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256))
#: The place of "the same word again".
_AGAIN = 0x5851F42D4C957F2D
_PAIR = 0x9E3779B97F4A7C15


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(places of all n-grams, text by text; bounds of each text's): words, pairs of neighbouring words, shapes of words, and pairs of shapes, or a
    repeat where the two words are equal. So words and pairs that training never saw still tell something by their shapes."""
    words, counts = flat_words(texts)
    total = int(counts.sum())
    h = word_hashes(words, total)
    shape = np.fromiter(map(_shapes.__getitem__, chain.from_iterable(t.translate(_MAP).split() if t else () for t in texts)), U64, total)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = lambda x, salt: (mix(x, salt) >> U64(64 - BITS)).astype(np.int64)
    joined = np.full((total, 4), -1, np.int64)
    joined[:, 0], joined[:, 1] = place(h, 0), place(shape, 1)
    if total > 1:
        inside = owner[:-1] == owner[1:]
        shapes = np.where(h[:-1] == h[1:], U64(_AGAIN), shape[:-1] * U64(_PAIR) + shape[1:])
        joined[:-1, 2] = np.where(inside, place(shapes, 2), -1)
        joined[:-1, 3] = np.where(inside, place(h[:-1] * U64(_PAIR) + h[1:], 3), -1)
    n = np.maximum(0, 4 * counts - 2)
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(n, out=bounds[1:])
    flat = joined.reshape(-1)
    return flat[flat >= 0], bounds


def ftrl_step(z: np.ndarray, n: np.ndarray, at: np.ndarray, x: np.ndarray, y: float) -> None:
    """One update of the accumulators at a document's places, in place."""
    zi, ni = z[at], n[at]
    w = weights_of(zi, ni)
    p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
    g = (p - y) * x
    z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
    n[at] = ni + g * g


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that the accumulators stand for: 0 within L1."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _train(frame: pd.DataFrame) -> pd.DataFrame:
    """One learner: its weights that aren't 0. Place 2**BITS is the bias."""
    frame = frame.sort_values(["__order", "doc_id"], kind="stable")
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    docs = []
    for start in range(0, len(frame), 512):
        part = frame.iloc[start : start + 512]
        places, bounds = features(list(part["text"]))
        for i, y in enumerate(part["label"]):
            at, count = np.unique(places[bounds[i] : bounds[i + 1]], return_counts=True)
            x = count / np.sqrt(max(1, bounds[i + 1] - bounds[i]))
            docs.append((np.append(at, size - 1).astype(np.int32), np.append(x, 1.0).astype(np.float32), float(y)))
    for _ in range(EPOCHS):
        for at, x, y in docs:
            ftrl_step(z, n, at, x, y)
    w = weights_of(z, n)
    at = np.flatnonzero(w)
    return pd.DataFrame({"place": at, "weight": w[at]})


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> np.ndarray:
    """Weights learned from ``labels`` (doc_id, quality) of rows of ``docs`` whose crc32(doc_id as text) mod 3 isn't 1. No usable label: zeros."""
    own = labels.where("doc_id is not null and quality is not null").where(remainder(F.col("doc_id"), 3) != 1)
    own = own.groupBy("doc_id").agg(F.max("quality").alias("label"))
    share = min(1.0, most / max(1, own.count()))
    order = F.xxhash64(F.col("doc_id"), F.lit("quality")).bitwiseAND(F.lit((1 << 52) - 1))
    sample = own.withColumn("__order", order).where(F.col("__order") < int(share * (1 << 52)) + 1)
    rows = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(sample), "doc_id")
    shard = F.pmod(F.col("__order"), F.lit(SHARDS)).cast("int").alias("shard")
    learned = rows.select("doc_id", F.coalesce("text", F.lit(b"")).alias("text"), "label", "__order", shard).groupBy("shard").applyInPandas(_train, "place int, weight double")
    weights = np.zeros((1 << BITS) + 1, np.float32)
    summed = learned.groupBy("place").agg((F.sum("weight") / SHARDS).alias("weight")).toPandas()
    weights[summed["place"].to_numpy()] = summed["weight"].to_numpy()
    return weights


def _scores(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for part in slices(batches, "__text"):
            places, bounds = features(part.column("__text").to_pylist())
            sums = np.zeros(len(places) + 1)
            np.cumsum(w[places], out=sums[1:], dtype=np.float64)
            n = np.diff(bounds)
            logit = w[-1] + (sums[bounds[1:]] - sums[bounds[:-1]]) / np.sqrt(np.maximum(1, n))
            names = [c for c in part.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))], [*names, "__score"])

    return run


def score(spark: SparkSession, docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row's whole text; null and empty texts have the bias' score."""
    model = spark.sparkContext.broadcast(weights)
    rows = docs.select("doc_id", utf8().alias("__text")).mapInArrow(_scores(model), "doc_id long, __score double")
    return rows.select("doc_id", F.col("__score").alias("score"))


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op4's rows: doc_id, held_out, score, predicted. A null doc_id counts as an empty text where its remainder is taken; repeated
    rows score alike; several labels of a document count as the largest; other columns are ignored; empty tables give no rows."""
    scored = score(spark, docs, train(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns kept, whose text scores at least ``threshold``."""
    weights = spark.sparkContext.broadcast(train(docs, labels))
    inner = docs.select(utf8().alias("__text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    kinds = ", ".join(f"c{i} {inner.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(docs.columns)))
    kept = inner.mapInArrow(_scores(weights), f"{kinds}, __score double").where(F.col("__score") >= threshold)
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
