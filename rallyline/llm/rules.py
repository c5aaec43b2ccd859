"""Operator 7: quality rules as weak supervision.

Each rule votes for good or bad text or abstains. The votes of all documents are counted by pattern, of which
there are at most three to the power of the rules; expectation-maximisation over these counts estimates each
rule's accuracy and the share of good texts, and a document is judged by its pattern's posterior probability.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyline.llm.common import map_blocks, text_rows
from rallyline.llm.text import Block, mix, repeated
from rallyline.session import settle

WINDOW = 5
#: The signs of the contract.
SIGNS = np.zeros(256, bool)
SIGNS[list(b"#*$%&|<>")] = True
_UPPER, _LETTER, _LOUD, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOUD[list(b"!?")] = True
_MARK[33:128] = ~_LETTER[33:128]  # in words, neither letters nor digits nor beyond ASCII
_MARK[48:58] = False

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_loud long, n_stutters long, n_marks long"


def measures(docs: DataFrame) -> DataFrame:
    """Counts of every text that the rules read; a null text counts as empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        block = Block(batch.column("text"))
        n = block.n
        words = block.word_hashes()[:, 0]
        salt = mix(np.arange(1, n + 1, dtype=np.uint64))
        grams, first = block.windows(WINDOW, words)
        twice = first[repeated(grams ^ salt[block.doc[first]])]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.subtract.at(cover, twice + WINDOW, 1)
        again = np.bincount(block.doc, weights=np.cumsum(cover)[:-1] > 0, minlength=n)
        begin, end, owner = block.lines()
        worded = np.searchsorted(block.begin, end) > np.searchsorted(block.begin, begin)
        begin, end, owner = begin[worded], end[worded], owner[worded]
        lines = np.bincount(owner, minlength=n)
        _, one = np.unique(block.hashes(begin, end)[:, 0] ^ salt[owner], return_index=True)
        stutter = np.flatnonzero((words[1:] == words[:-1]) & (block.doc[1:] == block.doc[:-1])) + 1
        columns = [
            block.n_words, block.per_text(block.in_word & ((block.raw & 0xC0) != 0x80)), block.per_text(SIGNS[block.raw]),
            lines - np.bincount(owner[one], minlength=n), again, lines, block.per_text(_UPPER[block.raw]),
            block.per_text(_LETTER[block.raw]), block.per_text(_LOUD[block.raw]), np.bincount(block.doc[stutter], minlength=n), block.per_text(_MARK[block.raw]),
        ]
        return pa.record_batch([batch.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in columns)], [c.split()[0] for c in MEASURES.split(", ")])

    return map_blocks(text_rows(docs), work, MEASURES)


def _vote(value: Column, good: float, bad: float) -> Column:
    """1 up to good, 0 from bad on, null between."""
    return F.when(value <= good, 1).when(value >= bad, 0)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


@dataclass(frozen=True)
class Rule:
    name: str
    vote: Callable[[], Column]


RULES = (
    Rule("length", lambda: F.when(F.col("n_words") >= 40, 1).when(F.col("n_words") < 10, 0)),
    Rule("word_length", lambda: F.when(_share("word_chars", "n_words").between(3, 9), 1).when(~_share("word_chars", "n_words").between(2, 14), 0)),
    Rule("signs", lambda: _vote(_share("n_symbols", "n_words"), 0.02, 0.2)),
    Rule("letters", lambda: _vote(_share("n_marks", "word_chars"), 0.06, 0.1)),
    Rule("same_lines", lambda: _vote(_share("n_dup_lines", "n_lines"), 0.05, 0.5)),
    Rule("same_words", lambda: _vote(_share("n_repeat_words", "n_words"), 0.05, 0.2)),
    Rule("capitals", lambda: _vote(_share("n_upper", "n_letters"), 0.2, 0.5)),
    Rule("loud", lambda: _vote(_share("n_loud", "n_words"), 0.05, 0.3)),
    Rule("stutter", lambda: _vote(_share("n_stutters", "n_words"), 0.05, 0.2)),
)


@dataclass(frozen=True)
class LabelModel:
    """Share of good texts, and for each rule how often it is right on good and on bad texts, as fitted."""

    good: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]
    posterior: dict[str, float]


def fit(patterns: dict[str, int], n_rules: int, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over pattern counts, a pattern being '1', '0' or '-' for each rule.

    A rule has its own chances of voting good, bad or not at all on good texts and on bad ones: most rules see
    one kind of bad text and vote good on the others, so one accuracy for both would drown a lone bad vote.
    Starts from texts without a bad vote as good; pseudo-counts keep chances off 0 and 1. Without patterns the
    model is its prior.
    """
    keys = sorted(patterns)
    count = np.array([patterns[k] for k in keys], float)
    votes = np.array([["10-".index(c) for c in k] for k in keys], int).reshape(len(keys), n_rules)
    is_vote = votes[:, :, None] == np.arange(3)
    posterior = np.where((votes == 1).any(1), 0.1, 0.95)
    prior = {1: np.array([4.0, 0.5, 1.0]), 0: np.array([1.0, 2.0, 1.0])}
    for _ in range(rounds):
        good = (count @ posterior + 9) / (count.sum() + 10)
        chances = {}
        for label, weight in ((1, count * posterior), (0, count * (1 - posterior))):
            mass = np.einsum("p,prv->rv", weight, is_vote) + prior[label]
            chances[label] = mass / mass.sum(1, keepdims=True)
        ratio = np.log(chances[1] / chances[0])
        odds = np.log(good / (1 - good)) + np.einsum("prv,rv->p", is_vote, ratio)
        posterior = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return LabelModel(float(good), tuple(chances[1][:, 0]), tuple(chances[0][:, 1]), dict(zip(keys, posterior.tolist(), strict=True)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, posterior.

    base_failed: fewer than 10 words, or more than a fifth of them in repeated windows. kept: not base_failed,
    and a posterior of `least` or more. Null and empty texts have no words and fail. Repeated rows are judged
    each; an empty table gives no rows. Every text is measured once, whole, and only its counts are kept between
    the passes.
    """
    pattern = F.concat(*(F.coalesce(r.vote().cast("string"), F.lit("-")) for r in rules))
    rows = settle(measures(docs).withColumn("pattern", pattern))
    # At most 3^rules patterns, whatever the number of documents.
    model = fit({r["pattern"]: r["n"] for r in rows.groupBy("pattern").agg(F.count("*").alias("n")).collect()}, len(rules))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    known = rows.sparkSession.createDataFrame(list(model.posterior.items()) or [("", 0.0)], "pattern string, posterior double")
    judged = rows.join(F.broadcast(known), "pattern", "left").withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )
