"""Quality rules by weak supervision.

Each rule looks at counts of a text and votes good (1), bad (0) or abstains (-1).  Expectation
maximisation over all documents estimates how accurate each rule is for good and for bad texts,
and the posterior probability of being good replaces the requirement that all rules pass.

A document enters the estimate as its pattern of votes: the patterns of all documents are counted
in Spark (there are at most 3 to the number of rules), so the estimate costs the same at any size.

Defined results: null and empty texts have no words, fail the base rules and are not kept; rules
that need words abstain on them; repeated documents count as often as they stand; with no document
at all the priors stay; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.llm.words import Words, mix, runs, slices, word_hashes, words
from atrium.session import cut_lineage

SYMBOLS = b"#*$%&|<>"  # fixed value
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_ending_lines", "n_stop_words",
          "n_distinct_words")
FEATURES = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)

# Frequent short words of four languages.
STOP_WORDS = "the and of to in is that der die und das den von le la les de et des el los que en y un una".split()


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of a value per word over each text's words."""
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][first])


def _repeated(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Words inside a window of ``width`` words that the same text holds twice or more."""
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= width:
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        starts = np.flatnonzero(text[:len(text) - width + 1] == text[width - 1:])
        window = runs(hashes, starts, starts + width) ^ mix(text[starts].astype(np.uint64) + np.uint64(1))
        _, back, count = np.unique(window, return_inverse=True, return_counts=True)
        twice = starts[count[back] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, np.minimum(twice + width, len(hashes)), -1)
    return _per_text((np.cumsum(covered)[:-1] > 0), first)


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: lines with a word, those equal to an earlier one, those that end in a full stop or the like."""
    data, n = w.data, len(w.at) - 1
    ends = np.union1d(np.flatnonzero(data == 10), w.at[1:][w.at[1:] > 0] - 1)
    ends = ends[ends >= 0]
    stop = np.where(data[ends] == 10, ends, ends + 1) if len(ends) else ends
    # a text's own end also ends a line, so cut points are newlines and text ends
    begin = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    if not len(ends):
        zero = np.zeros(n, np.int64)
        return zero, zero, zero
    text = np.searchsorted(w.at, begin, "right") - 1
    has_word = np.searchsorted(w.start, stop) > np.searchsorted(w.start, begin)
    begin, stop, text = begin[has_word], stop[has_word], text[has_word]
    content = runs(_BYTES[data], begin, stop) ^ mix(text.astype(np.uint64) + np.uint64(1))
    _, at = np.unique(content, return_index=True)
    again = np.ones(len(content), bool)
    again[at] = False
    last = data[w.end[np.searchsorted(w.start, stop) - 1] - 1]
    full = np.isin(last, np.frombuffer(b".!?\"", np.uint8))
    count = lambda flags: np.bincount(text, flags, n).astype(np.int64)
    return count(np.ones(len(text))), count(again), count(full)


_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def features(batches: Iterator[pa.RecordBatch], keep_text: bool = False) -> Iterator[pa.RecordBatch]:
    stops = word_hashes(words(pa.array(STOP_WORDS)))
    for batch in slices(batches):
        w = words(batch.column("text"))
        lines, again, full = _lines(w)
        hashes = word_hashes(w)
        n_words = np.diff(w.first)
        sum_up_to = lambda flags: np.r_[0, np.cumsum(flags, dtype=np.int64)]
        chars = sum_up_to((w.data & 0xC0) != 0x80)  # bytes that begin a code point
        symbols = sum_up_to(np.isin(w.data, np.frombuffer(SYMBOLS, np.uint8)))
        upper, lower = sum_up_to((w.data >= 65) & (w.data <= 90)), sum_up_to((w.data >= 97) & (w.data <= 122))
        shout = (upper[w.end] - upper[w.start] >= 2) & (lower[w.end] == lower[w.start])
        text = np.repeat(np.arange(len(n_words)), n_words)
        seen = np.unique(hashes ^ mix(text.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
        distinct = np.zeros(len(hashes), bool)
        distinct[seen] = True
        values = (n_words, _per_text(chars[w.end] - chars[w.start], w.first), symbols[w.at[1:]] - symbols[w.at[:-1]], again,
                  _repeated(hashes, w.first, 3), lines, _per_text(shout, w.first), full, _per_text(np.isin(hashes, stops), w.first),
                  _per_text(distinct, w.first))
        held = [batch.column("text")] if keep_text else []
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v.astype(np.int64)) for v in values), *held],
                                         names=["doc_id", *COUNTS, *(["text"] if keep_text else [])])


def count_features(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id and the counts of each text, on request with the text itself."""
    made = FEATURES + (", text string" if keep_text else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: features(batches, keep_text), made)


def votes() -> list[F.Column]:
    """The rules: 1 good, 0 bad, -1 abstain.  Bounds are shares of words, characters or lines."""
    words_, lines = F.col("n_words"), F.col("n_lines")

    def rule(value, good, bad, low: bool = False, least: int = 1):
        passes, fails = (value >= good, value <= bad) if low else (value <= good, value >= bad)
        return F.when(words_ < least, -1).when(passes, 1).when(fails, 0).otherwise(-1).cast("int")

    mean_length = F.col("word_chars") / words_
    return [
        rule(F.col("n_symbols") / words_, 0.03, 0.1),
        rule(F.col("n_repeat_words") / words_, 0.25, 0.5),
        rule(F.col("n_dup_lines") / lines, 0.2, 0.4),
        rule(F.col("n_upper_words") / words_, 0.1, 0.3),
        F.when(words_ == 0, -1).when(mean_length.between(3.0, 9.0), 1).when((mean_length < 2) | (mean_length > 12), 0).otherwise(-1).cast("int"),
        rule(F.col("n_stop_words") / words_, 0.06, 0.02, low=True, least=20),
        F.when(words_ < 30, -1).when(F.col("n_distinct_words") < 0.1 * words_, 0).when(F.col("n_distinct_words") > 0.25 * words_, 1).otherwise(-1).cast("int"),
        F.when(words_ == 0, -1).when(F.col("n_ending_lines") >= 0.7 * lines, 1).when(F.col("n_ending_lines") < 0.2 * lines, 0).otherwise(-1).cast("int"),
    ]


class Accuracy(NamedTuple):
    """Prior of good, and per rule the probability of each vote given good and given bad."""

    prior: float
    good: np.ndarray  # rule x vote (0 bad, 1 good, 2 abstain)
    bad: np.ndarray

    def log_odds(self) -> np.ndarray:
        """Evidence of each vote; an abstention says nothing."""
        odds = np.log(self.good) - np.log(self.bad)
        odds[:, 2] = 0.0
        return odds


def estimate(patterns: np.ndarray, weight: np.ndarray, rounds: int = 100, false_alarm: float = 0.02) -> Accuracy:
    """Expectation maximisation of the rules' vote probabilities from distinct vote patterns and their counts.

    Starts from rules that are right more often than not.  A rule's bad votes among good texts are held to ``false_alarm``: without that bound, a kind of
    junk that only one rule sees is explained as that rule's mistakes.
    """
    m = patterns.shape[1]
    good = np.tile([false_alarm, 0.7, 0.3 - false_alarm], (m, 1))
    bad = np.tile([0.4, 0.3, 0.3], (m, 1))
    prior = 0.8
    code = np.where(patterns < 0, 2, patterns).astype(int)
    rule = np.arange(m)
    for _ in range(rounds if len(patterns) else 0):
        odds = np.log(prior) - np.log1p(-prior) + Accuracy(prior, good, bad).log_odds()[rule, code].sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        new_prior = float(np.clip((weight * p).sum() / weight.sum(), 0.02, 0.98))
        for v in range(3):
            at = code == v
            good[:, v] = (weight[:, None] * p[:, None] * at).sum(axis=0) + 1.0
            bad[:, v] = (weight[:, None] * (1 - p)[:, None] * at).sum(axis=0) + 1.0
        good /= good.sum(axis=1, keepdims=True)
        over = np.maximum(good[:, 0] - false_alarm, 0.0)
        good[:, 1:] += (over / good[:, 1:].sum(axis=1))[:, None] * good[:, 1:]
        good[:, 0] -= over
        bad /= bad.sum(axis=1, keepdims=True)
        done = abs(new_prior - prior) < 1e-9
        prior = new_prior
        if done:
            break
    return Accuracy(prior, good, bad)


def pattern_counts(counted: DataFrame, rules: list[F.Column]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vote patterns of all rows and how often each occurs (at most 3 ** rules rows)."""
    rows = counted.select(F.array(*rules).alias("votes")).groupBy("votes").count().collect()
    rows = sorted((tuple(r["votes"]), r["count"]) for r in rows)
    return np.array([v for v, _ in rows], int).reshape(len(rows), len(rules)), np.array([n for _, n in rows], float)


def posterior(rules: list[F.Column], accuracy: Accuracy) -> F.Column:
    """Probability of good given the votes of a row, as plain column arithmetic."""
    odds = F.lit(float(np.log(accuracy.prior / (1 - accuracy.prior))))
    for column, (when_bad, when_good, abstained) in zip(rules, accuracy.log_odds().tolist()):
        odds = odds + F.when(column == 1, when_good).when(column == 0, when_bad).otherwise(abstained)
    return 1 / (1 + F.exp(-odds))


def judge_quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, posterior and kept."""
    counted = cut_lineage(count_features(docs))
    rules = votes()
    accuracy = estimate(*pattern_counts(counted, rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = counted.withColumn("base_failed", failed).withColumn("posterior", posterior(rules, accuracy))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that are kept; rows without an id go."""
    kept = judge_quality(docs, least).filter("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns)
