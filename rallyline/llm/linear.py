"""Hashed logistic regression, trained with follow-the-regularised-leader updates on a bounded labelled sample."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyline.llm.common import give_back, map_blocks, text_rows

#: Gives a block's features as (text, feature, value), each feature of a text once.
Features = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled sample; the rest are the learner's constants."""

    max_rows: int = 6000
    bits: int = 18
    epochs: int = 4
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.5
    seed: int = 7


@dataclass(frozen=True)
class Linear:
    bias: float
    weights: np.ndarray

    def scores(self, n: int, owner: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Sparse dot products of n texts, through the logistic function."""
        total = self.bias + np.bincount(owner, self.weights[feature] * value, n)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def remainder(by: int) -> Column:
    """crc32 of the decimal doc_id modulo by; a null doc_id counts as the empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % by


def labelled(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, max_rows: int) -> DataFrame:
    """doc_id, text, label of at most max_rows labelled documents, chosen by a hash of the id.

    Contradicting labels of one id count as the lower one; ids and labels that are null are left out. Only the
    narrow labels are sorted; the chosen ids, at most max_rows, are broadcast to the texts. An id
    on several rows gives several, of which train() uses one, so the bound holds for rows too.
    """
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(may_learn & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    wanted = wanted.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return text_rows(docs).join(F.broadcast(wanted), "doc_id")


def train(sample: DataFrame, features: Features, settings: Settings) -> Linear:
    """Fit on doc_id, text, label. Without rows of both labels the model knows nothing and scores 0.5."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, feature, value = features(batch.column("text"))
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(1, batch.num_rows))
        parts = [(f.astype(np.int32).tobytes(), v.astype(np.float32).tobytes()) for f, v in zip(np.split(feature[order], cut), np.split(value[order], cut), strict=True)]
        return pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array([f for f, _ in parts], pa.binary()), pa.array([v for _, v in parts], pa.binary())], ["doc_id", "label", "features", "vals"])

    rows = map_blocks(sample, work, "doc_id long, label int, features binary, vals binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("label", "features", "vals")).alias("r")).select("doc_id", "r.*")
    model = _fitted(rows, settings)
    give_back()  # the driver goes on to other stages
    return model


def _fitted(rows: DataFrame, settings: Settings) -> Linear:
    kept = sorted((r["doc_id"], r["label"], bytes(r["features"]), bytes(r["vals"])) for r in rows.toLocalIterator())
    examples = [(float(y), np.frombuffer(f, np.int32), np.frombuffer(v, np.float32).astype(float)) for _, y, f, v in kept]
    if len({y for y, _, _ in examples}) < 2:
        return Linear(0.0, np.zeros(1 << settings.bits))
    return follow_leader(examples, settings)


def follow_leader(examples: list[tuple[float, np.ndarray, np.ndarray]], s: Settings) -> Linear:
    """FTRL-proximal, one example at a time in a seeded order; the bias is a feature without penalties."""
    size = 1 << s.bits
    z, n = np.zeros(size), np.zeros(size)
    share = np.mean([y for y, _, _ in examples])
    bias, bias_n = float(np.log(share / (1 - share))), 1.0
    order = np.random.default_rng(s.seed)

    def weights(at: np.ndarray) -> np.ndarray:
        lead, root = z[at], np.sqrt(n[at])
        return np.where(np.abs(lead) <= s.l1, 0.0, (np.sign(lead) * s.l1 - lead) / ((s.beta + root) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for i in order.permutation(len(examples)):
            y, at, value = examples[i]
            w = weights(at)
            error = 1 / (1 + np.exp(-np.clip(bias + w @ value, -40, 40))) - y
            gradient = error * value
            step = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / s.alpha
            z[at] += gradient - step * w
            n[at] += gradient**2
            bias_n += error**2
            bias -= s.alpha * error / np.sqrt(bias_n)
    return Linear(bias, weights(np.arange(size)))


def score(docs: DataFrame, model: Linear, features: Features, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row of docs; the weights, of fixed size, are broadcast."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = known.value.scores(batch.num_rows, *features(batch.column("text")))
        return pa.record_batch([batch.column("doc_id"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_blocks(text_rows(docs), work, "doc_id long, score double, predicted int")
