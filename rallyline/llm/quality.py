"""Operator 1: quality classifier over hashed word n-grams.

Word n-grams are taken of the words themselves (lower case) and of their shapes: what a word ends with, its case,
its length class and whether it repeats the word before. A feature's value is its share of the text's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rallyline.llm import linear
from rallyline.llm.common import map_arrow
from rallyline.llm.text import Block, mix, slices

SETTINGS = linear.Settings()
SCALE = 10.0
_END = np.zeros(256, np.int64)  # letters and digits end a word plainly
_END[33:128] = np.arange(1, 96)
for _a, _z in ((48, 58), (65, 91), (97, 123)):
    _END[_a:_z] = 0
_UPPER, _LOWER = np.zeros(256, np.int64), np.zeros(256, np.int64)
_UPPER[65:91] = _LOWER[97:123] = 1


def _shapes(block: Block) -> np.ndarray:
    """One small number for each word's shape."""
    if not len(block.begin):
        return np.zeros(0, np.int64)
    length = block.end - block.begin
    upper, lower = (np.add.reduceat(table[block.raw], np.stack([block.begin, block.end], 1).ravel()[:-1])[::2] for table in (_UPPER, _LOWER))
    case = np.where(upper + lower == 0, 3, np.where(lower == 0, np.where(upper > 1, 2, 1), np.where(_UPPER[block.raw[block.begin]] == 1, 1, 0)))
    words = block.word_hashes()[:, 0]
    same = np.zeros(len(words), np.int64)
    same[1:] = (words[1:] == words[:-1]) & (block.doc[1:] == block.doc[:-1])
    return ((_END[block.raw[block.end - 1]] * 4 + case) * 6 + np.digitize(length, [3, 6, 10, 15, 25])) * 2 + same


def features(texts: pa.Array, settings: linear.Settings = SETTINGS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owner, feature = _grams(texts, settings.bits)
    key, count = np.unique(owner << 32 | feature, return_counts=True)
    owner, feature = key >> 32, key & 0xFFFFFFFF
    return owner, feature, SCALE * count / np.maximum(np.bincount(owner, count)[owner], 1)


def _grams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    block = Block(texts, lower=True)
    owners, found = [], []
    for kind, (words, orders) in enumerate(((block.word_hashes()[:, 0], (1, 2)), (mix(_shapes(block).astype(np.uint64)), (1, 2, 3)))):
        for k in orders:
            grams, first = block.windows(k, words)
            owners.append(block.doc[first])
            found.append((mix(grams + np.uint64(8 * k + kind + 1)) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(found)


def fit(docs: DataFrame, labels: DataFrame, settings: linear.Settings = SETTINGS) -> linear.Linear:
    sample = linear.labelled(docs, labels, "quality", linear.remainder(5) != 0, settings.max_rows)
    return linear.train(sample, lambda texts: features(texts, settings), settings)


def classify(docs: DataFrame, labels: DataFrame, settings: linear.Settings = SETTINGS, threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    The model learns from at most settings.max_rows labelled documents whose crc32 of the id modulo 5 is not 0,
    and from their texts alone. Null and empty texts have no features and get the model's bias; with no labels of
    both kinds every score is 0.5. A null doc_id counts as the empty string for held_out. Repeated rows score
    alike; an empty table gives no rows. Whole texts are scored, without a shuffle.
    """
    model = fit(docs, labels, settings)
    scored = linear.score(docs, model, lambda texts: features(texts, settings), threshold)
    return scored.select("doc_id", (linear.remainder(5) == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, settings: linear.Settings = SETTINGS, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all columns, that classify() predicts to be good; rules for null texts and ids, repeated
    rows and empty tables as there."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, settings))
    text_at, names = docs.columns.index("text"), [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole.rename_columns(names), names[text_at]):
                found = model.value.scores(batch.num_rows, *features(batch.column(text_at), settings))
                yield batch.filter(pa.array(found >= threshold)).rename_columns(whole.schema.names)

    return map_arrow(docs, run, docs.schema)
