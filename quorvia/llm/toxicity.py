"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Grades 0 < 1 < ... < K share one weight vector; ordered thresholds part them: the probability of a
grade above g is sigmoid(w.x - t[g]). Features are which hashed words, and leading letters of longer
words, a text has (each once, so long texts don't outweigh short ones). The weights are fitted by
follow-the-regularised-leader updates whose L1 term leaves words that say nothing at nought, on at
most ``TRAIN_ROWS`` labelled documents. The output is the expected severity, the sum of the
probabilities of exceeding each threshold, and the likeliest grade.

Labels with two grades give one threshold, with more grades more of them. Edge cases: null and empty
texts have no features and get the thresholds alone; without labels, severity 0; with one grade only,
severity is that grade; repeated rows are scored each; other columns are not looked at.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quorvia.llm.common import id_and_text, id_ddl, map_arrow, mix64, quiet_gc, texts_of
from quorvia.llm.sparse import Ftrl, chunk_stems, labelled_sample, token_hashes, training_rows

BITS = 20
TRAIN_ROWS = 12_000
EPOCHS = 3


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the distinct words and word beginnings of a text, all of value 1."""
    tokens = token_hashes(text, chunk_stems)
    slots = np.unique((mix64(tokens) >> np.uint64(64 - bits)).astype(np.int64))
    return slots, np.ones(len(slots))


class Ordinal:
    """Weights and ascending thresholds over the grades seen in training."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    @classmethod
    def train(cls, rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int = EPOCHS) -> Ordinal:
        grades = sorted({g for _, _, g in rows})
        size = 1 << bits
        levels = max(0, len(grades) - 1)
        if not levels:
            return cls(grades, np.zeros(size, np.float32), np.zeros(0))
        rank = {g: i for i, g in enumerate(grades)}
        y = np.array([rank[g] for *_, g in rows])
        # thresholds begin where each grade's share puts them
        shares = np.clip([(y > k).mean() for k in range(levels)], 1e-6, 1 - 1e-6)
        thresholds = np.log((1 - shares) / shares)
        model, steps = Ftrl(size, alpha=0.3, beta=1.0, l1=0.6, l2=1e-3), np.zeros(levels)
        for _ in range(epochs):
            for (slots, _, _), rank_y in zip(rows, y):
                w = model.weights(slots)
                above = 1 / (1 + np.exp(-np.clip(w.sum() - thresholds, -35, 35)))
                g = above - (rank_y > np.arange(levels))
                model.update(slots, w, np.full(len(slots), g.sum()))
                steps += g * g
                thresholds = np.maximum.accumulate(thresholds + 0.1 * g / np.sqrt(1 + steps))
        return cls(grades, model.weights().astype(np.float32), thresholds)

    def judge(self, slots: np.ndarray) -> tuple[float, int]:
        """Expected severity and likeliest grade."""
        if not len(self.thresholds):
            only = self.grades[0] if self.grades else 0
            return float(only), only
        z = float(self.weights[slots].sum(dtype=np.float64))
        above = 1 / (1 + np.exp(-np.clip(z - self.thresholds, -35, 35)))
        p = -np.diff(np.concatenate([[1.0], above, [0.0]]))
        return float(p @ np.array(self.grades, np.float64)), self.grades[int(p.argmax())]


def severities(docs: DataFrame, labels: DataFrame, *, target: str = "toxic", threshold: float = 0.5, train_rows: int = TRAIN_ROWS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", fold: bool = False) -> DataFrame:
    """``doc_id, severity, grade, toxic`` of every whole text; toxic: severity of ``threshold`` or more."""
    rows = id_and_text(docs, id_col, text_col)
    model = Ordinal.train(training_rows(labelled_sample(rows, labels, target, train_rows, fold), partial(features, bits=bits)), bits)

    def run(batch: pa.RecordBatch):
        quiet_gc()
        got = [model.judge(features(t, bits)[0]) for t in texts_of(batch)]
        severity = np.array([s for s, _ in got], np.float64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(severity), pa.array([g for _, g in got], pa.int32()), pa.array(severity >= threshold)], ["doc_id", "severity", "grade", "toxic"])

    return map_arrow(rows, run, f"doc_id {id_ddl(docs, id_col)}, severity double, grade int, toxic boolean")
