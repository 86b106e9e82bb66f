"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document; expectation maximisation over the counts of
all vote patterns estimates their accuracies.  The posterior of a sample of about ``SAMPLE`` documents
(those whose hash falls below a threshold; a parameter) then trains a linear scorer on hashed
features: byte trigrams and graded counts.  The scorer judges every document on its whole text, also
where the labellers abstain.

Defined results: null and empty texts have no trigram and get the score of the counts alone; with an
empty table there is no training and no row; repeated rows score alike; only ``doc_id`` and ``text``
are read.  Model size is fixed, so what reaches the driver and the tasks does not grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.llm.rules import COUNTS, count_features, estimate, pattern_counts, posterior, votes
from atrium.llm.words import slices, text_bytes
from atrium.session import cut_lineage

SAMPLE = 6_000
GRAMS = 4096
GRADES = 512
STEPS = 150


def labellers() -> list[F.Column]:
    """The rules, and further overlapping heuristics on length and lines."""
    words_, lines = F.col("n_words"), F.col("n_lines")
    return [
        *votes(),
        F.when(words_ == 0, 0).when(words_ >= 40, 1).otherwise(-1).cast("int"),
        F.when(words_ == 0, -1).when(F.col("n_symbols") > 0.05 * F.col("word_chars"), 0).when(F.col("n_symbols") == 0, 1).otherwise(-1).cast("int"),
        F.when(words_ < 20, -1).when(words_ / lines < 3, 0).when(words_ / lines > 8, 1).otherwise(-1).cast("int"),
    ]


def hashed_features(column: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Row per text: square roots of byte-trigram shares by hash, then graded counts by hash, then 1."""
    data, at = text_bytes(column)
    n = len(column)
    grams = np.zeros((n, GRAMS), np.float32)
    if len(data) > 2:
        low = data.astype(np.uint32)
        code = (low[:-2] * np.uint32(961748927) + low[1:-1] * np.uint32(715225739) + low[2:] * np.uint32(982451653)) >> np.uint32(20)
        text = np.repeat(np.arange(n), np.diff(at))
        inside = text[:-2] == text[2:]
        grams = np.bincount(text[:-2][inside] * GRAMS + code[inside], minlength=n * GRAMS).reshape(n, GRAMS).astype(np.float32)
        grams = np.sqrt(grams / np.maximum(grams.sum(axis=1, keepdims=True), 1))
    share = counts / np.maximum(counts[:, :1], 1)
    grade = np.floor(np.minimum(share, 12.0) * 20).astype(np.int64)
    grade[:, 0] = np.log2(counts[:, 0] + 1).astype(np.int64)
    cell = (grade * 2654435761 + np.arange(counts.shape[1]) * 40503 * 65537) % 4294967291 % GRADES
    graded = np.zeros((n, GRADES), np.float32)
    np.add.at(graded, (np.repeat(np.arange(n), counts.shape[1]), cell.ravel()), 0.3)
    return np.concatenate([grams, graded, np.ones((n, 1), np.float32)], axis=1)


def _counts_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in COUNTS], axis=1).astype(np.float64)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Logistic regression with soft labels on the bounded sample, by accelerated gradient steps."""
    parts = [(hashed_features(b.column("text"), _counts_of(b)), b.column("label").to_numpy()) for b in slices(batches)]
    weights = np.zeros(GRAMS + GRADES + 1, np.float32)
    if parts:
        x, y = np.concatenate([p for p, _ in parts]), np.concatenate([p for _, p in parts]).astype(np.float32)
        ahead, last = weights.copy(), weights.copy()
        for step in range(STEPS):
            error = 1 / (1 + np.exp(-(x @ ahead))) - y
            weights = ahead - 2.0 * ((error @ x) / len(y) + 1e-4 * ahead)
            ahead = weights + step / (step + 3) * (weights - last)
            last = weights
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary())], names=["weights"])


def _score(weights: bytes):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights, np.float32)
        for batch in slices(batches):
            odds = hashed_features(batch.column("text"), _counts_of(batch)) @ w
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(c) for c in COUNTS), pa.array(1 / (1 + np.exp(-odds.astype(np.float64))))],
                names=["doc_id", *COUNTS, "score"])
    return score


def classify_quality(docs: DataFrame, sample: int = SAMPLE, least: float = 0.5, seed: int = 9) -> DataFrame:
    """Per document: doc_id, posterior (weak label), score (of the trained scorer), kept (score >= ``least``)."""
    counted = cut_lineage(count_features(docs))
    rules = labellers()
    accuracy = estimate(*pattern_counts(counted, rules))
    total = counted.count()
    below = min(2**64 * sample // max(total, 1), 2**64 - 1) - 2**63
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.xxhash64(F.lit(seed), "doc_id", "text") <= below)
    labelled = count_features(chosen, keep_text=True).withColumn("label", posterior(rules, accuracy))
    held = labelled.select("text", "label", *COUNTS).repartition(1).mapInArrow(_train, "weights binary").collect()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    texts = count_features(docs, keep_text=True)
    scored = texts.mapInArrow(_score(bytes(held[0][0])), f"doc_id long, {counts}, score double") if held else None
    if scored is None:
        scored = counted.withColumn("score", F.lit(0.0))
    return scored.select("doc_id", posterior(rules, accuracy).alias("posterior"), "score", (F.col("score") >= least).alias("kept"))


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that the scorer keeps; rows without an id go."""
    kept = classify_quality(docs, least=least).filter("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns)
